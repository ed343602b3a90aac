"""SimHash near-duplicates through vantage-point trees over Hamming distance.

Fingerprints: each shingle of words is hashed with XXH64; a bit of the document's
fingerprint is set if it is set in more than half of the hashes.

Linked pairs differ in at most ``max_bits`` bits. Cut into ``bands`` masks, such a
pair differs in at most ``max_bits // bands`` bits of one of them, and Hamming
distance under a mask obeys the triangle inequality like any other. So one
vantage-point tree per mask finds every pair, at a radius that prunes:

1. Documents with equal fingerprints meet in a partial aggregate; from here on a
   group of copies is one row.
2. A tree over a bounded sample of fingerprints gives the shards: a node keeps a
   vantage point and splits at the middle distance. Each fingerprint has one home
   shard and visits, as a query, each shard whose side of a split the triangle
   bounds cannot exclude. Shards with many visitors or homes are served by a grid
   of tasks.
3. Inside a task the shard's own tree splits into rings of equal distance to the
   vantage point; a query goes on only into rings within the radius of its own.
   Leaves compare whole fingerprints.
4. A task returns a spanning set of its links, never all pairs of a group, and
   the components are found with distributed label passing.

A short fingerprint of a very large corpus also meets by chance. Where ``confirm`` is
set, each document carries 128 more fingerprint bits of the same shingles, and a
link holds only if at most ``confirm`` of those differ too; the search itself stays
on the first 64.

Fingerprints are estimates. Where ``jaccard`` is set, they only propose, each of the
three in turn with the other two to confirm: documents with equal sets of shingles are one node, and inside each component of proposed
links the shingle sets themselves are compared. A pair is linked if the Jaccard
similarity of its sets is at least ``jaccard``. Components with many shingles are
cut into parts, each pair of parts is a task of its own, and small ones share tasks.

Null or word-free texts have fingerprint zero. Repeated ids give a row each; where rows
of one id are to be told apart, ``doc_id`` may be a struct of the id and more. Texts
of any length are read whole; an empty table gives no rows; further columns, whatever
their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import as_bytes, mix64, slices, small_batches
from rasterloom.llm.links import components, spanning
from rasterloom.plans.scratch import materialise

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
HASH_SEED = 42
ALL_BITS = (1 << 64) - 1
LEAF = 32
SLICE_TEXT = 2 << 20
SAMPLE_PER_SHARD = 64
QUERIES_PER_TASK = 1_000_000
HOMES_PER_SHARD = 500_000
HOMES_PER_TASK = 500_000
SETS_PER_PART = 1_000
SHINGLES_PER_PART = 500_000


def shingle_digests(text: bytes, words: int) -> list[bytes]:
    """XXH64 (big-endian bytes) of every shingle of a text, repeats included; the whole sequence if shorter."""
    flat = b" ".join(text.translate(LOWER).split())
    if not flat:
        return []
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(flat)]
    digest = xxhash.xxh64_digest
    if len(starts) <= words:
        return [digest(flat, HASH_SEED)]
    return [digest(flat[a:b], HASH_SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def shingle_set(digests: list[bytes]) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64))


def set_hash(shingles: np.ndarray) -> int:
    """One signed 64-bit hash of a whole shingle set."""
    return int.from_bytes(xxhash.xxh64_digest(shingles.astype("<u8").tobytes(), HASH_SEED), "big", signed=True)


def simhashes(texts: list[bytes], words: int, more: int = 0, sets: bool = False) -> np.ndarray:
    """Fingerprints of several texts as int64, one column each: the plain one and ``more`` independent ones.

    The further ones come from scrambled hashes of the same shingles. With ``sets``
    a last column holds the hash of the shingle set.
    """
    digests: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    out = np.zeros((len(texts), 1 + more + sets), dtype=np.int64)
    for i, text in enumerate(texts):
        own = shingle_digests(text, words)
        counts[i] = len(own)
        digests += own
        if sets:
            out[i, -1] = set_hash(shingle_set(own))
    full = np.flatnonzero(counts)
    if len(full):
        hashes = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        for k in range(1 + more):
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            out[full, k] = np.packbits(2 * ones > counts[full][:, None], axis=1).view(">i8").ravel().astype(np.int64)
            hashes = mix64(hashes)
    return out


MORE = ("more1", "more2")


def _key(docs: DataFrame) -> Column:
    """The documents' id as a long, or as it is where it is a struct (an id and more that tells rows apart)."""
    key = F.col("doc_id")
    return key if isinstance(docs.schema["doc_id"].dataType, T.StructType) else key.cast("long").alias("doc_id")


def fingerprints(docs: DataFrame, words: int, more: bool = False, sets: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and, if asked for, two further columns of 64 bits and ``node``, the hash of the shingle set."""
    further = len(MORE) if more else 0
    names = ["doc_id", "fp", *MORE[:further], *(("node",) if sets else ())]
    named = docs.select(_key(docs), "text")
    schema = T.StructType([named.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_TEXT):
                fps = simhashes(as_bytes(piece.column("text")), words, further, sets)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in fps.T]], names=names)

    return small_batches(named).mapInArrow(run, schema)


@dataclass
class Node:
    """A split of a shard tree, or a leaf (``shard`` >= 0)."""

    vantage: int = 0
    middle: int = 0
    near: "Node | None" = None
    far: "Node | None" = None
    shard: int = -1


def distance(x: np.ndarray, y, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(y)) & np.uint64(mask)).astype(np.int16)


def shard_tree(sample: np.ndarray, mask: int, depth: int, shards: list[Node]) -> Node:
    """Split at the middle distance until ``depth``, or until all points are equally far."""
    if depth and len(sample) > 1:
        vantage = int(sample[len(sample) // 2])
        d = distance(sample, vantage, mask)
        middle = int(np.sort(d)[(len(d) - 1) // 2])
        near = d <= middle
        if near.all():
            middle -= 1
            near = d <= middle
        if near.any():
            return Node(vantage, middle, shard_tree(sample[near], mask, depth - 1, shards), shard_tree(sample[~near], mask, depth - 1, shards))
    leaf = Node(shard=len(shards))
    shards.append(leaf)
    return leaf


def route(node: Node, fps: np.ndarray, rows: np.ndarray, home: np.ndarray, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows that visit it, which of them are at home there)."""
    if not len(rows):
        return
    if node.shard >= 0:
        yield node.shard, rows, home
        return
    d = distance(fps[rows], node.vantage, mask)
    for side, inside, own in ((node.near, d <= node.middle + radius, d <= node.middle), (node.far, d > node.middle - radius, d > node.middle)):
        yield from route(side, fps, rows[inside], home[inside] & own[inside], mask, radius)


@dataclass
class Points:
    """Fingerprints with their node numbers and, where links need confirming, further bits (rows x 2)."""

    bits: np.ndarray
    node: np.ndarray
    more: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.bits)


def search_links(homes: Points, queries: Points, mask: int, radius: int, max_bits: int, confirm: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between ``queries`` and ``homes``, as node numbers."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(np.arange(len(homes)), np.arange(len(queries)), mask, radius)]
    while stack:
        h, q, m, r = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > LEAF:
            vantage = homes.bits[h[len(h) // 2]]
            dh = distance(homes.bits[h], vantage, m)
            if dh.min() == dh.max():
                if m != ALL_BITS:  # equal under this mask: go on with the whole fingerprint
                    stack.append((h, q, ALL_BITS, max_bits))
                    continue
            else:
                dq = distance(queries.bits[q], vantage, m)
                oh, oq = np.argsort(dh, kind="stable"), np.argsort(dq, kind="stable")
                h, dh, q, dq = h[oh], dh[oh], q[oq], dq[oq]
                for ring in np.unique(dh):
                    a, b = np.searchsorted(dh, [ring, ring + 1])
                    c, d = np.searchsorted(dq, [ring - r, ring + r + 1])
                    if c < d:
                        stack.append((h[a:b], q[c:d], m, r))
                continue
        step, own = max(1, (1 << 18) // len(h)), homes.bits[h]
        for at in range(0, len(q), step):
            part = q[at : at + step]
            hit = np.flatnonzero(np.bitwise_count(queries.bits[part][:, None] ^ own[None, :]) <= max_bits)
            if not len(hit):
                continue
            x, y = part[hit // len(h)], h[hit % len(h)]
            good = queries.node[x] != homes.node[y]
            if confirm is not None:
                good &= np.bitwise_count(queries.more[x] ^ homes.more[y]).sum(axis=1) <= confirm
            if good.any():
                found.append((queries.node[x[good]], homes.node[y[good]]))
                held += int(good.sum())
            if held > 2_000_000:
                found = [spanning(*(np.concatenate(z) for z in zip(*found, strict=True)))]
                held = len(found[0][0])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return spanning(*(np.concatenate(z) for z in zip(*found, strict=True)))


def band_masks(bands: int) -> list[int]:
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def fingerprint_links(distinct: DataFrame, max_bits: int, bands: int, confirm: int | None = None) -> DataFrame:
    """A spanning set (u, v) of all links between distinct fingerprints: columns fp, node, and further bits to confirm by."""
    spark = distinct.sparkSession
    rows = distinct.count()
    wanted = max(1, math.ceil(math.sqrt(rows / 1000)), math.ceil(rows / HOMES_PER_SHARD))
    depth = math.ceil(math.log2(wanted))
    rate = min(1.0, SAMPLE_PER_SHARD * 2**depth / max(rows, 1))
    order = F.xxhash64(F.col("fp"), F.lit(7))
    extra = list(MORE) if confirm is not None else []
    taken = distinct.where((order.bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)) < rate).collect()
    sample = np.array(sorted(r.fp for r in taken), dtype=np.int64).view(np.uint64)
    sample = sample[np.argsort(np.array([xxhash.xxh64_intdigest(int(x).to_bytes(8, "big"), 3) for x in sample], dtype=np.uint64))]
    radius = max_bits // bands
    masks, trees, layout, tasks = band_masks(bands), [], [], 0
    for mask in masks:
        leaves: list[Node] = []
        tree = shard_tree(sample, mask, depth, leaves)
        load, own = np.ones(len(leaves)), np.ones(len(leaves))
        for shard, visitors, home in route(tree, sample, np.arange(len(sample)), np.ones(len(sample), bool), mask, radius):
            load[shard], own[shard] = len(visitors) / max(rate, 1e-12), home.sum() / max(rate, 1e-12)
        # a shard is a grid: its visitors in chunks, its homes in splits
        chunks = np.maximum(1, np.ceil(load / QUERIES_PER_TASK)).astype(np.int64)
        splits = np.maximum(1, np.ceil(own / HOMES_PER_TASK)).astype(np.int64)
        trees.append(tree)
        layout.append((tasks + np.concatenate([[0], np.cumsum(chunks * splits)[:-1]]), chunks, splits))
        tasks += int((chunks * splits).sum())
    shared = spark.sparkContext.broadcast((trees, layout))  # the shape of the trees: a bounded sample's worth

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_trees, own_layout = shared.value
        for batch in batches:
            fps = np.asarray(batch.column("fp"), dtype=np.int64)
            bits = fps.view(np.uint64)
            for band, (mask, tree) in enumerate(zip(masks, own_trees, strict=True)):
                first, chunks, splits = own_layout[band]
                for shard, visitors, home in route(tree, bits, np.arange(len(bits)), np.ones(len(bits), bool), mask, radius):
                    n, m = int(chunks[shard]), int(splits[shard])
                    chunk = (bits[visitors] % np.uint64(n)).astype(np.int64)
                    at = visitors[np.flatnonzero(home)]
                    split = (mix64(bits[at]) % np.uint64(m)).astype(np.int64) * n
                    to_visit = (np.arange(m)[:, None] * n + chunk[None, :]).ravel()
                    to_hold = (np.arange(n)[:, None] + split[None, :]).ravel()
                    task = first[shard] + np.concatenate([to_visit, to_hold])
                    who = np.concatenate([np.tile(visitors, m), np.tile(at, n)])
                    kind = np.concatenate([np.zeros(m * len(visitors), bool), np.ones(n * len(at), bool)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task, pa.int32()), pa.array(np.full(len(who), band), pa.int32()), pa.array(kind), *[c.take(pa.array(who)) for c in batch.columns]],
                        names=["task", "band", "home", *batch.schema.names],
                    )

    def search(table: pa.Table) -> pa.Table:
        home = np.asarray(table.column("home"), dtype=bool)
        bits = np.asarray(table.column("fp"), dtype=np.int64).view(np.uint64)
        node = np.asarray(table.column("node"), dtype=np.int64)
        more = np.stack([np.asarray(table.column(c), dtype=np.int64) for c in extra], axis=1).view(np.uint64) if extra else None
        homes, queries = (Points(bits[x], node[x], None if more is None else more[x]) for x in (home, ~home))
        u, v = search_links(homes, queries, masks[table.column("band")[0].as_py()], radius, max_bits, confirm)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    columns = ["fp", "node", *extra]
    sent = distinct.select(*columns).mapInArrow(send, "task int, band int, home boolean, " + ", ".join(f"{c} long" for c in columns))
    return sent.groupBy("task").applyInArrow(search, "u long, v long")


def similar_pairs(block: np.ndarray, node: np.ndarray, flat: np.ndarray, starts: np.ndarray, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the pairs of one block whose sets have at least this Jaccard similarity, as nodes.

    ``flat`` holds the distinct elements of each set from ``starts[i]`` to ``starts[i + 1]``.
    Pairs that earlier ones have joined are not looked at.
    """
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[order], prepend=block[order][:1] - 1, append=block[order][-1:] + 1))
    for a, b in zip(edges, edges[1:], strict=False):
        own = order[a:b]
        if len(own) < 2:
            continue
        sizes = starts[own + 1] - starts[own]
        at = np.concatenate([[0], np.cumsum(sizes)])
        _, codes = np.unique(np.concatenate([flat[starts[x] : starts[x + 1]] for x in own]), return_inverse=True)
        mark = np.zeros(len(codes) + 1, dtype=bool)
        label = np.arange(len(own))
        for i in range(len(own) - 1):
            low, high = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
            if not ((label[i + 1 :] != label[i]) & (low >= jaccard * high)).any():
                continue
            mine = codes[at[i] : at[i + 1]]
            mark[mine] = True
            held = np.concatenate([[0], np.cumsum(mark[codes[at[i + 1] :]])])
            mark[mine] = False
            both = held[at[i + 2 :] - at[i + 1]] - held[at[i + 1 : -1] - at[i + 1]]
            hit = i + 1 + np.flatnonzero((both >= jaccard * (low + high - both)) | (both / np.maximum(low + high - both, 1) >= jaccard))
            hit = hit[label[hit] != label[i]]
            if len(hit):
                u.append(np.full(len(hit), node[own[i]]))
                v.append(node[own[hit]])
                label[np.isin(label, label[hit])] = label[i]
    return spanning(np.concatenate(u), np.concatenate(v))


def confirmed_links(docs: DataFrame, reps: DataFrame, proposed: DataFrame, words: int, jaccard: float) -> DataFrame:
    """A spanning set (u, v) of the pairs at ``jaccard`` or more inside each component (node, root) of proposed links.

    ``reps`` gives a document (rep) of each node, whose text is read for the shingles.
    """
    wanted = proposed.select("node", F.col("root").alias("block")).join(reps.select("node", "rep"), "node")
    texts = docs.select(_key(docs), "text")
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "block", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_TEXT):
                own = [shingle_set(shingle_digests(t, words)) for t in as_bytes(piece.column("text"))]
                node = piece.column("node").to_pylist()
                # rows that share an id with the node's document, but hold another text
                same = [i for i, x in enumerate(own) if set_hash(x) == node[i]]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c).take(pa.array(same, pa.int64())) for c in ("node", "block")], pa.array([own[i].view(np.int64) for i in same], pa.list_(pa.int64()))],
                    names=["node", "block", "shingles"],
                )

    sets = materialise(found.mapInArrow(read, "node long, block long, shingles array<long>").dropDuplicates(["node"]), "shingle-sets")
    loads = materialise(sets.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("m")), "shingle-blocks")
    total = loads.agg(F.sum("n"), F.sum("m")).first()
    tasks = max(1, math.ceil((total[0] or 0) / SETS_PER_PART), math.ceil((total[1] or 0) / SHINGLES_PER_PART))
    parts = F.ceil(F.greatest(F.col("n") / SETS_PER_PART, F.col("m") / SHINGLES_PER_PART)).cast("long")
    large = materialise(loads.select("block", parts.alias("parts")).where("parts > 1"), "shingle-large-blocks")
    part = F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts"))
    # each pair of parts of a block is one task, and covers the pairs inside its parts
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: x != F.col("part")))
    grid = sets.join(large, "block").withColumn("part", part).withColumn("other", other)
    grid = grid.withColumn("task", F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other")))
    rest = sets.join(large, "block", "left_anti").withColumn("task", F.pmod(F.xxhash64("block"), F.lit(tasks)))

    def confirm(table: pa.Table) -> pa.Table:
        held = table.column("shingles").combine_chunks()
        starts = np.asarray(held.offsets, dtype=np.int64)
        flat = np.asarray(held.values, dtype=np.int64)
        u, v = similar_pairs(np.asarray(table.column("block"), dtype=np.int64), np.asarray(table.column("node"), dtype=np.int64), flat, starts, jaccard)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    columns = ["task", "block", "node", "shingles"]
    return rest.select(*columns).unionByName(grid.select(*columns)).groupBy("task").applyInArrow(confirm, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, bands: int = 3, confirm: int | None = None, jaccard: float | None = None) -> DataFrame:
    """doc_id, fp and component_id: the smallest id that links can reach, the document's own included.

    Links join fingerprints with at most ``max_bits`` differing bits (and at most
    ``confirm`` of the 128 further ones, where that is given). With ``jaccard``
    these links only propose, and pairs of shingle sets of that similarity are linked.
    """
    own = ["fp", *(MORE if confirm is not None else ())]
    fps = fingerprints(docs, words, confirm is not None, jaccard is not None)
    if jaccard is None:
        node = F.col("fp") if confirm is None else F.xxhash64(*own)
        fps = materialise(fps.withColumn("node", node), "fingerprints")
        reps = fps.groupBy("node", *own).agg(F.min("doc_id").alias("rep"))
    else:
        fps = materialise(fps, "fingerprints")
        reps = fps.groupBy("node").agg(F.min(F.struct("doc_id", *own)).alias("r")).select("node", *[f"r.{c}" for c in own], F.col("r.doc_id").alias("rep"))
    reps = materialise(reps, "fingerprint-reps")
    if jaccard is None or confirm is None:
        links = fingerprint_links(reps, max_bits, bands, confirm)
    else:  # each of the three fingerprints proposes, so a pair is missed only if all of them are far off
        links = None
        for i in range(len(own)):
            turned = reps.select("node", *[F.col(c).alias(n) for c, n in zip(own[i:] + own[:i], own, strict=True)])
            found = fingerprint_links(turned, max_bits, bands, confirm)
            links = found if links is None else links.union(found)
    if jaccard is not None:
        links = confirmed_links(docs, reps, components(links), words, jaccard)
    roots = materialise(components(links).join(reps.select("node", "rep"), "node"), "fingerprint-roots")
    least = materialise(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "fingerprint-least")
    joined = roots.join(least, "root").select("node", "component_id")
    members = materialise(
        reps.join(joined, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")), "fingerprint-members"
    )
    return fps.join(members, "node").select("doc_id", "fp", "component_id")
