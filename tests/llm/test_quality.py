import re
from collections import Counter

from pyspark.sql import functions as F

from rasterloom.llm import quality
from rasterloom.llm.queries import REPORT


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(small, hard_docs):
    for docs in (small, hard_docs):
        for row in quality.quality_rules(docs, report=REPORT).collect():
            assert tuple(row[m] for m in REPORT) == brute(row.text)


def test_order_of_rules_never_changes_the_verdict(small):
    texts = [(r.text or "").encode() for r in small.collect()]
    verdicts = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        verdicts.append((quality.cascade(quality.Measures(texts), rules) < 0).tolist())
    assert verdicts[0] == verdicts[1]


def test_rules_run_by_rejections_per_cost():
    estimates = {"few_words": (1e-6, 0.1), "repeated_windows": (1e-3, 0.2), "symbols": (1e-6, 0.5)}
    names = [r.name for r in quality.ordered(quality.RULES, estimates)]
    assert names[:3] == ["symbols", "few_words", "repeated_windows"]


def test_later_rules_see_survivors_only():
    seen = []
    watch = quality.Rule("watch", ("n_lines",), lambda n: seen.append(len(n)) or (n < 0))
    quality.cascade(quality.Measures([b"one", b"two words " * 20]), [quality.BASE[0], watch])
    assert seen == [1]


def test_empty_table_and_clashing_columns(no_docs, hard_docs):
    assert quality.quality_rules(no_docs).count() == 0
    clashing = hard_docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y")).withColumn("rule", F.lit(1))
    out = quality.quality_rules(clashing, report=("n_words",))
    assert dict(out.dtypes)["kept"] == "boolean" and dict(out.dtypes)["n_words"] == "bigint" and out.count() == hard_docs.count()
    assert {r.rule for r in out.collect()} == {1}


def test_labelled_good_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    lost = quality.quality_rules(docs).where("not kept").where(F.size(F.split("text", r"\s+")) >= 20)
    assert lost.count() <= 0.02 * docs.count()
