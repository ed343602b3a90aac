import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import pieces, tokenfile
from rasterloom.llm.queries import vocabulary

PIECES, BPE = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "   ", "  a  b", "x ▁ ▁y", "梦鿿😀 é", "tab\t and\nline \n", "don't stop", "q" * 4000, "a b" * 500, "\x1c \x1d end", "<|endoftext|> x<|endoftext|>.", " lead"]


@pytest.fixture(scope="module")
def sampler():
    return pieces.Sampler(PIECES, 1.0, 4)


def segmentations(symbols, spelled):
    if not symbols:
        yield ()
        return
    for n in range(1, len(symbols) + 1):
        if tuple(symbols[:n]) in spelled:
            for rest in segmentations(symbols[n:], spelled):
                yield (spelled[tuple(symbols[:n])], *rest)


@pytest.mark.parametrize("unit", ["the", "abc", "é", "no1", " x"])
def test_draws_follow_the_weights_of_all_segmentations(sampler, unit):
    symbols = sampler.vocabulary.symbols(" " + unit)[0].tolist()
    weight = {s: np.exp(sum(sampler.vocabulary.log_weight[i] for i in s)) for s in segmentations(symbols, sampler.vocabulary.spelled)}
    total = sum(weight.values())
    n = 20_000
    ids, counts = sampler.sample([unit] * n, np.arange(n, dtype=np.int64))
    drawn = [tuple(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
    for s, w in weight.items():
        p = w / total
        assert abs(drawn.count(s) / n - p) <= 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
    assert set(drawn) <= set(weight)


def test_ids_depend_on_key_and_text_only(sampler):
    texts = ODD + ["the quick brown fox " * 30]
    keys = np.arange(len(texts), dtype=np.int64)
    ids, counts = sampler.sample(texts, keys)
    one_by_one = [pieces.Sampler(PIECES, 1.0, 4).sample([t], keys[k : k + 1])[0] for k, t in enumerate(texts)]
    assert all(np.array_equal(a, b) for a, b in zip(np.split(ids, np.cumsum(counts)[:-1]), one_by_one))
    assert not np.array_equal(sampler.sample(texts[-1:], keys[:1])[0], sampler.sample(texts[-1:], keys[1:2])[0])


DENSE = ["".join(chr(0x4E00 + (i * 7919 + k * k * 31) % 4000) for i in range(1000)) for k in range(40)]


def test_bounds_on_memory_do_not_change_ids(monkeypatch):
    """Scripts without spaces: every text is one unit and one chunk."""
    texts, keys = [*DENSE, *ODD, *DENSE[:5]], np.arange(len(DENSE) + len(ODD) + 5, dtype=np.int64)
    want = pieces.Sampler(PIECES, 1.0, 4).sample(texts, keys)[0]
    encoder = tokenfile.ChunkEncoder(BPE)
    chunks = encoder.encode(texts)[0]
    monkeypatch.setattr(pieces, "MOST_EDGES", 20_000)
    monkeypatch.setattr(pieces, "LONG_UNIT", 300)
    monkeypatch.setattr(tokenfile, "MOST_BYTES", 10_000)
    small, tight, got, ids = pieces.Sampler(PIECES, 1.0, 4), tokenfile.ChunkEncoder(BPE), [], []
    for at in range(0, len(texts), 4):
        got.append(small.sample(texts[at : at + 4], keys[at : at + 4])[0])
        ids.append(tight.encode(texts[at : at + 4])[0])
    assert np.array_equal(np.concatenate(got), want) and np.array_equal(np.concatenate(ids), chunks)
    small.sample(["a"], keys[:1])
    tight.encode(["a"])
    assert len(small.keys) < 20_000 and len(tight.flat) < 10_000


def test_one_very_long_unit():
    import time

    unit = "".join(DENSE) * 5  # 200,000 characters without a space
    start = time.perf_counter()
    sampler = pieces.Sampler(PIECES, 1.0, 4)
    ids, _ = sampler.sample([unit], np.zeros(1, np.int64))
    assert sampler.vocabulary.decode(ids) == unit and time.perf_counter() - start < 60
    sampler.sample(["next"] * 3, np.zeros(3, np.int64))


def test_decoding_is_lossless(spark, small, hard_docs, no_docs):
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for docs in (small, odd, hard_docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(0))):
        out = pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES)
        assert out.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
        assert out.count() == docs.count()
    assert pieces.encode_pieces(no_docs, PIECES).count() == 0
    a = {r.doc_id: r.ids for r in pieces.encode_pieces(small.repartition(5), PIECES, seed=3).collect()}
    assert a == {r.doc_id: r.ids for r in pieces.encode_pieces(small.coalesce(1), PIECES, seed=3).collect()}


def test_chunked_encoding_equals_the_library(small):
    encoder = tokenfile.ChunkEncoder(BPE)
    texts = ODD + [r.text for r in small.collect()]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    encoder.shrink()
    ids, counts = encoder.encode(texts[::-1])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[::-1]


def test_random_characters_encode_like_the_library():
    """Every kind of letter, digit, mark and white space beside every other one, cut or not."""
    import random

    draw = random.Random(3)
    kinds = [*"aZst'lvm  \n\t\r\x0b\x0c.,-&<|>09é×÷Àÿȿɀяр梦😀\u0301\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b—\x1c\x1f\x00\x7f½²٣ª", "'s", "'ll", " '", "  ", "\n\n", "<|endoftext|>"]
    encoder = tokenfile.ChunkEncoder(BPE)
    for _ in range(20):
        some = draw.sample(kinds, draw.randint(3, len(kinds)))
        texts = ["".join(draw.choices(some, k=draw.randint(0, 30))) for _ in range(500)]
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_words_are_learnt_apart_from_marks_and_lines():
    """Each word goes through the library once, not once for every mark, line and word beside it."""
    words = [f"{a}{b}o" for a in ["ba", "ke", "ni", "zü", "sç"] for b in ["ra", "te", "li", "mo", "vu", "xy"]]
    texts = [f"{a}{mark}\n{b}{mark} {a}" for a in words for b in words for mark in [".", "!", "&&&"]]
    encoder = tokenfile.ChunkEncoder(BPE)
    ids, counts = encoder.encode(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert len(encoder.lengths) <= 2 * len(words) + 4


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}])
def test_other_pre_tokenizers(tmp_path, change):
    """Texts are cut only for the pre-tokenizer whose cuts are known."""
    import json

    with open(BPE, encoding="utf-8") as f:
        about = json.load(f)
    about["pre_tokenizer"] |= change
    (tmp_path / "other.json").write_text(json.dumps(about), encoding="utf-8")
    encoder = tokenfile.ChunkEncoder(str(tmp_path / "other.json"))
    texts = ["two words.\nA line", "", "x  y", "don't"]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert np.array_equal(tokenfile.join_planes(tokenfile.split_planes(ids, kind), n, kind), ids)


@pytest.mark.parametrize(("kind", "block"), [("bit", 64), ("byte", 1000), ("byte", 1 << 16)])
def test_files_hold_all_ids_in_order(small, hard_docs, kind, block):
    for docs in (small, hard_docs.withColumn("start", F.lit(1)).withColumn("ids", F.lit(2))):
        rows = tokenfile.id_checksums(tokenfile.token_file_round_trip(docs, BPE, planes=kind, block=block)).collect()
        rows = sorted(rows, key=lambda r: r.start)
        encoder = tokenfile.ChunkEncoder(BPE)
        want = []
        for r in docs.collect():
            ids = encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
            want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], key=str) == sorted(want, key=str)
        starts = [0, *itertools.accumulate(r.n_tokens for r in rows)]
        assert [r.start for r in rows] == starts[:-1]
        order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
        assert order == sorted(order)


def test_any_chunk_can_be_read_alone(small, tmp_path):
    files = tokenfile.write_token_files(small, str(tmp_path / "t"), BPE, planes="bit", block=500)
    for _, uri, docs, ids in files:
        reader = tokenfile.Reader(uri)
        assert len(reader.counts) == docs and sum(c[2] for c in reader.index) == ids
        assert [c[1] for c in reader.index] == [500 * k for k in range(len(reader.index))]
        whole = np.concatenate([x for _, x in reader.documents()])
        for k in reversed(range(len(reader.index))):
            assert np.array_equal(reader.chunk(k), whole[500 * k : 500 * k + reader.index[k][2]])


def test_no_documents(no_docs):
    assert tokenfile.token_file_round_trip(no_docs, BPE).count() == 0
