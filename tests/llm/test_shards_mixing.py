import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import mixing, shards


def brute_shards(rows, n):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode())))
    sizes = [len((r.text or "").encode()) + 16 for r in rows]
    total, before, out, slots = sum(sizes), 0, [], defaultdict(int)
    for r, s in zip(rows, sizes):
        shard = min(n - 1, (2 * before + s) * n // (2 * total))
        out.append((r.doc_id, s, zlib.crc32((r.text or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        before += s
    return out


@pytest.mark.parametrize("n", [1, 7, 40])
def test_shards_equal_brute_force(small, hard_docs, n):
    for docs in (small, hard_docs):
        got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shards.byte_shards(docs, n).collect()]
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(got, key=key) == sorted(brute_shards(docs.collect(), n), key=key)


def test_shards_are_balanced_and_contiguous(small):
    rows = sorted(shards.byte_shards(small, 8).collect(), key=lambda r: r.at)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.size
    mean, most = sum(sums.values()) / 8, max(r.size for r in rows)
    assert all(abs(s - mean) <= most for s in sums.values())


def test_shards_of_nothing(no_docs):
    assert shards.byte_shards(no_docs).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] >= most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_equal_repeated_resharing(spark, small, hard_docs):
    for docs in (small, hard_docs):
        sized = docs.select("source", mixing.word_count("text").alias("size"))
        sizes = {r.source: r.s for r in sized.groupBy("source").agg(F.sum("size").alias("s")).collect()}
        want = brute_targets(sizes)
        for r in mixing.source_targets(sized).collect():
            assert r.target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9)


def test_mix_takes_the_targets(small, hard_docs):
    for docs in (small, hard_docs):
        pieces = mixing.mix_sources(docs, block_words=50).collect()
        taken, target = defaultdict(int), {}
        for p in pieces:
            target[p.source] = p.target
            if p.slot is not None:
                assert 0 <= p.from_word < p.to_word <= p.size
                taken[p.source] += p.to_word - p.from_word
        assert len({p.row for p in pieces}) == docs.count()
        for s, t in target.items():
            assert taken[s] == int(t)
        per_row = defaultdict(int)
        for p in pieces:
            per_row[p.row, p.size] += (p.to_word - p.from_word) if p.slot is not None else 0
        assert all(n <= 3 * size for (_, size), n in per_row.items())


def test_schedule_spreads_sources_evenly(spark):
    targets = spark.createDataFrame([("a", 0, 100_000, 1, 100_000.0, 100_000), ("b", 1, 300_000, 1, 300_000.0, 300_000)], "source string, place int, source_size long, weight long, target double, words long")
    rows = sorted(mixing.slot_schedule(spark, targets, 100).collect(), key=lambda r: r.slot)
    seen = [0, 0]
    for k, r in enumerate(rows, 1):
        assert r.rank == seen[r.place]
        seen[r.place] += 1
        assert abs(seen[0] - k / 4) < 4
    assert seen[0] >= 1000 and seen[1] >= 3000


def test_mix_is_the_same_for_any_partitioning(small):
    def rows(docs):
        return sorted((p.doc_id, p.slot, p.from_word, p.to_word) for p in mixing.mix_sources(docs, block_words=64).collect() if p.slot is not None)

    assert rows(small.repartition(7)) == rows(small.coalesce(1))


def test_mixed_documents_keep_columns_and_words(small, hard_docs, no_docs):
    for docs in (small, hard_docs.withColumn("slot", F.lit("own")).withColumn("size", F.lit(-1))):
        out = mixing.mixed_documents(docs, block_words=50)
        assert out.columns == docs.columns
        words = sum(len((r.text or "").encode().split()) for r in out.collect())
        assert words == sum(p.to_word - p.from_word for p in mixing.mix_sources(docs, block_words=50).collect() if p.slot is not None)
    assert mixing.mixed_documents(no_docs).count() == 0 and mixing.mix_sources(no_docs).count() == 0
