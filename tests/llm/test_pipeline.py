import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import mixing, pieces, quality, secrets
from rasterloom.llm.queries import vocabulary

STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_quality_stage_keeps_what_no_rule_rejects(spark, small, sf):
    rows = small.collect()
    first = quality.cascade(quality.Measures([(r.text or "").encode() for r in rows]), quality.RULES)
    assert ids(corpus_pipeline.quality_stage(spark, small, sf)) == sorted((True, r.doc_id) for r, f in zip(rows, first) if f < 0)


def shingles(text):
    words = (text or "").encode().lower().split()
    n = corpus_pipeline.SHINGLE_WORDS
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_near_copies_stage_keeps_one_of_each_group(spark, small, sf):
    """All pairs of texts, by plain sets of shingles: whatever has a similarity of 0.8 is one group."""
    docs = small.unionByName(small.limit(30).withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= corpus_pipeline.NEAR_SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    keep = {}
    for r, x in zip(rows, label):
        keep[x] = min(keep.get(x, r.doc_id), r.doc_id)
    out = corpus_pipeline.near_copies_stage(spark, docs, sf)
    assert out.columns == docs.columns
    assert ids(out) == sorted((True, d) for d in keep.values())


def test_stages_on_hard_rows_and_on_nothing(spark, hard_docs, no_docs, sf):
    clashing = hard_docs.withColumn("kept", F.lit(1)).withColumn("ids", F.lit("a")).withColumn("slot", F.lit(2)).withColumn("node", F.lit(3))
    clashing = clashing.withColumn("secrets", F.lit("s")).withColumn("row_hash", F.lit(5)).withColumn("fp", F.lit(6))
    for docs in (clashing, clashing.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.dtypes == docs.dtypes, name
            assert {(r.kept, r.secrets, r.row_hash, r.fp) for r in out.collect()} <= {(1, "s", 5, 6)}, name
        corpus_pipeline.pieces_stage(spark, docs, sf).count()
    once = corpus_pipeline.near_copies_stage(spark, hard_docs, sf)
    assert once.where("doc_id = 4").count() == 1 and once.where("doc_id is null").count() == 2


def test_whole_run_equals_its_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs.where(F.col("doc_id").isin([r.doc_id for r in quality.quality_rules(docs).where("kept").collect()])).cache()
    once = corpus_pipeline.near_copies_stage(spark, kept, sf).cache()
    clear = once.collect()
    field = secrets.train(once)
    spans = {r.doc_id: secrets.base_spans(r.text.encode()) for r in clear}
    hidden = corpus_pipeline.secrets_stage(spark, once, sf).cache()
    for r in hidden.collect():
        assert not secrets.base_spans(r.text.encode()) and (not spans[r.doc_id] or "[secret]" in r.text)
    assert field.weights.shape == (secrets.N_FEATURES, 3)
    mixed = mixing.mixed_documents(hidden).collect()
    sampler = pieces.Sampler(vocabulary("piece_bpe_32k.model"), 1.0, 2)
    want = sorted((r.doc_id, len(r.text)) for r in mixed)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, len(sampler.vocabulary.decode(np.array(r.ids)))) for r in got) == want
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got)


def test_near_copies_stage_removes_only_texts_of_that_similarity(spark, sf):
    rng = np.random.default_rng(8)
    passage = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows = [(i, " ".join(passage + [f"own{i}x{j}" for j in range(100)]), "en", "src0", 0) for i in range(8)]  # 0.6 to each other
    rows.append((100, rows[3][1] + " and one word more", "en", "src0", 0))
    out = corpus_pipeline.near_copies_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert ids(out) == [(True, i) for i in range(8)]


def test_near_copies_stage_tells_rows_of_one_id_apart(spark, sf):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, words(1)), (1, words(2)), (2, words(3)), (3, words(1) + " more"), (1, words(1)), (None, words(3)), (None, words(4)), (None, words(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_copies_stage(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(1, words(1)), (1, words(2)), (2, words(3)), (0, words(3)), (0, words(4)), (0, words(4))])
