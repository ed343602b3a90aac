import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import language as lang
from rasterloom.llm.queries import QUERIES

TEXTS = ["Ab c!!  d", "", "é 梦x", "1 2", "a" * 50, "x\ny"]


def plain_counts(text):
    flat = b" " + bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()) + b" "
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(flat) - n + 1):
            if b"  " not in flat[i : i + n]:
                code = int.from_bytes(flat[i : i + n], "big") ^ n
                out[(code * 2654435761) % 2**32 >> (32 - lang.DIM_BITS)] += 1
    return out


def test_counts_equal_plain_counting():
    got = lang.gram_counts(TEXTS)
    for row, text in zip(got, TEXTS, strict=True):
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == dict(plain_counts(text))


def train(small):
    return small.where(~lang.held_out(F.col("doc_id")))


@pytest.fixture(scope="module")
def learned(small):
    return lang.fit(train(small))


def test_frequencies_cover_all_labelled_rows(small, learned):
    rows = [r.text for r in small.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and any(ch.isalpha() for ch in r.text)]
    seen = Counter(d for t in rows for d in plain_counts(t))
    want = np.array([math.log((1 + len(rows)) / (1 + seen[d])) + 1 for d in range(lang.DIMS)])
    assert np.allclose(learned.idf, want, rtol=1e-5)


def test_nearest_centroid_equals_plain_comparison(small, learned):
    centroids = learned.centroids.collect()
    rows = {r.doc_id: r.text for r in small.collect()}
    for r in lang.identify(small, learned).collect():
        counts = plain_counts(rows[r.doc_id])
        v = {d: math.log1p(n) * float(learned.idf[d]) for d, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [(sum(x * c.centre[d] for d, x in v.items()) / norm, c) for c in centroids]
        best = max(x for x, _ in cosines)
        assert abs(best - r.score) < 1e-4
        assert any(c.lang == r.near and best - x < 1e-5 and (abs((1 - x) - 1.25 * c.reach) < 1e-4 or r.rejected == (1 - x > 1.25 * c.reach)) for x, c in cosines)


def test_languages_of_held_out_documents(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    rows = QUERIES["op13_languages"](spark, folder).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    apart = [r for r in rows if r.held_out]
    assert len(apart) > 250 and np.mean([r.lang_pred == truth[r.doc_id] for r in apart]) > 0.98
    assert {r.lang_pred for r in rows} <= set(truth.values()) and all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_documents_do_not_matter(spark, small):
    changed = small.withColumn("lang", F.when(lang.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, lang.identify(small, lang.fit(train(d))).collect())) for d in (small, changed))
    assert a == b


def test_hard_rows(spark, hard_docs, learned):
    docs = hard_docs.withColumns({"near": F.lit("x"), "score": F.lit("x"), "_spoken": F.lit(1)})
    got = lang.identify(docs, learned, keep=("doc_id", "text", "near")).collect()
    assert len(got) == hard_docs.count()
    for r in got:
        spoken = r.text is not None and any(ch.isalpha() for ch in r.text)
        assert (r.near == "und") == (not spoken) and (spoken or (r.score == 0 and not r.rejected))


def test_blocks_of_centroids_give_the_same(small, learned):
    want = sorted(map(tuple, lang.identify(small, learned).collect()))
    assert sorted(map(tuple, lang.identify(small, learned, block=3).collect())) == want


def test_foreign_script_is_rejected(spark, learned):
    docs = spark.createDataFrame([(1, "これは日本語の文章です。東京は大きい都市です。" * 20)], "doc_id long, text string")
    assert lang.identify(docs, learned).first().rejected


def test_empty_tables_and_nothing_learned(spark, no_docs, small, learned):
    assert lang.identify(no_docs, learned).collect() == []
    blank = lang.fit(small.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.near, r.score, r.rejected) for r in lang.identify(small, blank).collect()} == {("und", 0.0, False)}


def test_one_document_per_language(spark):
    docs = spark.createDataFrame([(1, "only one text", "a"), (2, "ein anderer Satz", "b"), (3, "only one text", "a")], "doc_id long, text string, lang string")
    found = lang.identify(docs, lang.fit(docs))
    assert {r.doc_id: r.near for r in found.collect()} == {1: "a", 2: "b", 3: "a"}
