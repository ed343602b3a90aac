import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import links, simhash


def brute_fingerprint(text, k):
    words = (text or "").encode().translate(simhash.LOWER).split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(rows, bits):
    """(doc_id, fingerprint) rows -> smallest reachable id per row."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return [least.get(x) for x in label]


@pytest.mark.parametrize("k", [4, 5])
def test_fingerprints_equal_brute_force(small, hard_docs, k):
    texts = [r.text for r in small.limit(40).collect() + hard_docs.collect()]
    got = simhash.simhashes([(t or "").encode() for t in texts], k)[:, 0].view(np.uint64)
    assert [int(x) for x in got] == [brute_fingerprint(t, k) for t in texts]


@pytest.mark.parametrize(("bits", "bands"), [(4, 3), (4, 1), (7, 4), (11, 4), (14, 5)])
def test_search_finds_every_link(bits, bands):
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(60)]
    points = set(centres)
    for c in centres[:30]:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randint(1, bits + 2)):
                x ^= 1 << b
            points.add(x)
    fps = np.array(sorted(points), dtype=np.uint64)
    want = {frozenset((i, int(j))) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= bits) if j != i}
    own = simhash.Points(fps, np.arange(len(fps)))
    u, v = (np.concatenate(x) for x in zip(*[simhash.search_links(own, own, m, bits // bands, bits) for m in simhash.band_masks(bands)]))

    def groups(pairs):
        label = np.arange(len(fps))
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    changed = True
        return label.tolist()

    assert groups([tuple(p) for p in want]) == groups(list(zip(u, v)))


def test_routing_reaches_every_home_within_the_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    for mask in simhash.band_masks(3):
        leaves = []
        tree = simhash.shard_tree(fps[:200], mask, 4, leaves)
        home, visits = {}, {}
        for shard, rows, own in simhash.route(tree, fps, np.arange(800), np.ones(800, bool), mask, 1):
            for r, o in zip(rows, own):
                visits.setdefault(int(r), set()).add(shard)
                if o:
                    assert int(r) not in home
                    home[int(r)] = shard
        assert len(home) == 800
        for i in range(800):
            for j in np.flatnonzero(simhash.distance(fps, fps[i], mask) <= 1):
                assert home[int(j)] in visits[i]


def test_near_duplicates_equal_brute_force(small, hard_docs):
    for docs in (small, hard_docs):
        rows = [(r.doc_id, brute_fingerprint(r.text, 4)) for r in docs.collect()]
        want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows, 4))), key=str)
        got = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_grids_of_homes_and_visitors_give_the_same(small, monkeypatch):
    want = sorted(map(tuple, simhash.near_duplicates(small).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(simhash, "QUERIES_PER_TASK", 60)
    monkeypatch.setattr(simhash, "HOMES_PER_TASK", 40)
    assert sorted(map(tuple, simhash.near_duplicates(small).select("doc_id", "component_id").collect())) == want


def test_confirmed_links_catch_near_copies_and_leave_others(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choices(words, k=400) for _ in range(60)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(20):
        copy = list(base[i])
        copy[rng.randrange(400)] = "changed"
        rows.append((1000 + i, " ".join(copy)))
    found = dict(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 14, 5, 28).select("doc_id", "component_id").collect())
    assert sum(found[1000 + i] == i for i in range(20)) >= 19
    assert all(found[i] == i for i in range(60))


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7)]
    rng = random.Random(2)
    names = list(range(400))
    rng.shuffle(names)
    got = links.components(spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "u long, v long")).collect()
    path, star = {names[i] for i in range(61)}, {names[100 + i] for i in range(200)}
    assert {r.node: r.root for r in got} == {**dict.fromkeys(path, min(path)), **dict.fromkeys(star, min(star))}


def test_no_documents(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def brute_similar(rows, jaccard):
    """(doc_id, text) rows -> smallest id reachable over pairs of this five-word Jaccard similarity."""
    grams = []
    for _, text in rows:
        words = (text or "").encode().translate(simhash.LOWER).split()
        grams.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (grams[i] == grams[j] or len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= jaccard):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        least[x] = min(doc, least.get(x, doc))
    return {doc: least[x] for (doc, _), x in zip(rows, label)}


@pytest.mark.parametrize("parts", [1_000, 7])
def test_jaccard_links_equal_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "SETS_PER_PART", parts)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows, passage = [], rng.choices(words, k=300)
    for share in (60, 100, 100, 110, 130, 160):  # a family that shares one passage, most of it below 0.8
        rows += [(len(rows) + i, " ".join(passage + rng.choices(words, k=share))) for i in range(6)]
    for edits in (1, 1, 2, 3, 4, 6, 8, 9, 10, 12, 16):  # copies from nearly equal to too far
        for _ in range(3):
            copy = list(passage)
            for at in rng.sample(range(300), edits):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, "the same six words come again " * (i + 3) + end) for i, end in enumerate(["", "", "and now one other thing ends it all"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_similar(rows, 0.8)
    got = dict(simhash.near_duplicates(docs, 5, 64, 1, 128, 0.8).select("doc_id", "component_id").collect())
    assert got == want and 1 < len(set(want.values())) < len(rows)
    loose = dict(simhash.near_duplicates(docs, 5, 14, 5, 28, 0.8).select("doc_id", "component_id").collect())
    assert all(want[d] == want[c] for d, c in loose.items())


def test_repeated_words_do_not_hide_other_text(spark):
    """The majority shingle decides all bits, but the sets are different."""
    rows = [(i, "go " * 400 + " ".join(f"x{i}y{j}" for j in range(60))) for i in range(3)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 14, 5, 28, 0.8)
    assert sorted(r.component_id for r in found.collect()) == [0, 1, 2]
