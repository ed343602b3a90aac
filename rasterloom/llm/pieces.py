"""SentencePiece segmentations sampled by forward filtering and backward sampling, and lossless decoding.

Spaces belong to the front of the next piece, and no piece of the vocabulary has a
visible character before a space, so the lattice of a text falls apart into units:
a run of spaces and the visible characters after it. A leading space (the
vocabulary's dummy prefix) opens the text.

* Forward: for each distinct unit the weights of all ways to reach a place in it
  are summed from left to right. Characters without a piece of their own go through
  the vocabulary's byte pieces, so every text has a segmentation.
* Backward: each occurrence of a unit walks from its end to its start; at each
  place one of the incoming pieces is drawn by its share of the forward sum. All
  occurrences of a slice walk together as arrays.

A draw is a scrambled mix of the row key, the number of the unit in its text and
the number of the step, so a row's result depends on its key and text alone: any
partitioning, retry or batch size gives the same ids. Draws resolve shares down to
2**-32.

Merge vocabularies score pieces by rank. A piece of rank r weighs
((r + 1) * H) ** -alpha with H the harmonic number of the vocabulary: frequency falls
with rank as in natural text, and ``alpha`` sharpens (above 1) or flattens the draw.

Decoding joins the pieces' bytes and drops the leading space: ids of a text always
decode to that text. Null and empty texts have no pieces and decode to an empty
text. Rows of one key and text get equal ids; a null key counts as a key. An empty
table gives no rows. Texts and units of any length are encoded whole: long units are
filtered and walked place by place, and what a worker keeps between slices is bounded in
units and lattice edges, which changes no id. Other columns pass through, but for those of
the result's names, which are replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import as_texts, mix64, slices, small_batches

SPACE = "▁"
BITS = 32
MOST_UNITS, MOST_EDGES = 120_000, 6_000_000  # of the lattices kept between slices: 100 MB
KEPT_UNIT = 64  # longer units are not kept
LONG_UNIT = 2_000  # symbols; longer units are filtered place by place
FEW = 4  # walkers left after that many steps go on one by one
UNITS_AT_ONCE = 10_000  # lattices built together, a bound on working memory
SLICE_TEXT = 1 << 20


BYTE_SYMBOL = 0x110000  # symbols are code points, and above them the 256 byte pieces
SYMBOL_BITS = 21


class Vocabulary:
    """Pieces, weights and bytes of a SentencePiece vocabulary file, with a trie of the pieces as arrays."""

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(path)
        size = library.get_piece_size()
        normal = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        ranks = {i: k for k, i in enumerate(sorted(normal, key=lambda i: (-library.get_score(i), i)))}
        harmonic = sum(1.0 / (k + 1) for k in range(len(normal) + 256))
        self.log_weight = np.zeros(size)
        self.bytes: list[bytes] = [b""] * size
        self.spelled: dict[tuple[int, ...], int] = {}
        for i in range(size):
            name = library.id_to_piece(i)
            if i in ranks:
                text = name.replace(SPACE, " ")
                if " " in text.lstrip(" "):
                    raise ValueError(f"piece {i} has a space behind visible characters")
                self.bytes[i] = text.encode()
                self.spelled[tuple(map(ord, text))] = i
            elif library.is_byte(i):
                self.bytes[i] = bytes([int(name[3:5], 16)])
                self.spelled[(BYTE_SYMBOL + self.bytes[i][0],)] = i
            self.log_weight[i] = -alpha * np.log((ranks.get(i, len(normal)) + 1) * harmonic)
        self._build_trie()

    def _build_trie(self) -> None:
        states: dict[tuple[int, int], int] = {}
        accepts = {}
        for symbols, piece in self.spelled.items():
            state = 0
            for x in symbols:
                state = states.setdefault((state, x), len(states) + 1)
            accepts[state] = piece
        keys = np.array([state << SYMBOL_BITS | x for state, x in states], dtype=np.int64)
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_to = np.array(list(states.values()), dtype=np.int64)[order]
        self.accepts = np.full(len(states) + 1, -1, dtype=np.int64)
        self.accepts[list(accepts)] = list(accepts.values())
        self.first = np.zeros(BYTE_SYMBOL + 256, dtype=np.int64)
        for (state, x), to in states.items():
            if not state:
                self.first[x] = to
        self.single = self.accepts[self.first] >= 0

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a text, and how many each code point takes: one, or its bytes if it has no piece."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        counts = np.ones(len(points), dtype=np.int64)
        rare = np.flatnonzero(~self.single[points])
        if not len(rare):
            return points, counts
        raw = [chr(x).encode() for x in points[rare]]
        counts[rare] = [len(x) for x in raw]
        out = np.repeat(points, counts)
        starts = (np.cumsum(counts) - counts)[rare]
        out[np.concatenate([np.arange(a, a + len(x)) for a, x in zip(starts, raw, strict=True)])] = BYTE_SYMBOL + np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        return out, counts

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()[1:]


def units(text: str) -> list[str]:
    """The units of a text without their first space: spaces beyond it, then visible characters."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for part in parts:
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    return [*out, " " * (spaces - 1)] if spaces else out


@dataclass
class Lattices:
    """The lattices of several units. Unit u has the places first[u] to last[u]; edges are in order of the place they end at."""

    keys: np.ndarray  # place << BITS | draw at which the edge begins
    before: np.ndarray  # the place that the edge comes from, -1 for the start of the unit
    ids: np.ndarray
    last: np.ndarray


def lattices(new: list[str], vocabulary: Vocabulary) -> Lattices:
    """Forward filtering of all units at once, one numpy step for each place in the longest unit."""
    text = " " + " ".join(new)
    symbols, counts = vocabulary.symbols(text)
    lengths = np.fromiter((len(u) + 1 for u in new), np.int64, len(new))
    sizes = np.add.reduceat(counts, np.cumsum(lengths) - lengths)
    starts = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(new)), sizes)
    stop = (starts + sizes)[unit]
    at, state = np.arange(len(symbols)), vocabulary.first[symbols]
    froms, tos, found = [], [], []
    length = 1
    while len(at):
        piece = vocabulary.accepts[state]
        hit = piece >= 0
        froms.append(at[hit])
        tos.append(at[hit] + length)
        found.append(piece[hit])
        inside = at + length < stop[at]
        at, state = at[inside], state[inside]
        key = state << SYMBOL_BITS | symbols[at + length]
        place = np.minimum(np.searchsorted(vocabulary.edge_keys, key), len(vocabulary.edge_keys) - 1)
        on = vocabulary.edge_keys[place] == key
        at, state = at[on], vocabulary.edge_to[place[on]]
        length += 1
    start, end, ids = np.concatenate(froms), np.concatenate(tos), np.concatenate(found)
    order = np.lexsort((start, end))  # ends grow along the units, so this is also the order of the units
    start, end, ids = start[order], end[order], ids[order]
    owner = unit[start]
    # Place 0 of a unit is its start; the places of all units follow each other.
    source, target = start + owner, end + owner
    heads = np.flatnonzero(np.diff(target, prepend=-1))  # first edge of each place
    score = vocabulary.log_weight[ids]
    forward = np.zeros(len(symbols) + len(new))
    depth = (end - starts[owner])[heads]
    widths = np.diff(heads, append=len(ids))
    long = sizes[owner[heads]] > LONG_UNIT
    by_depth = np.flatnonzero(~long)
    by_depth = by_depth[np.argsort(depth[by_depth], kind="stable")]
    cuts = np.searchsorted(depth[by_depth], np.arange(1, int(depth[by_depth].max(initial=0)) + 2))
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = by_depth[a:b]
        width = widths[own]
        offsets = np.cumsum(width) - width
        edges = np.repeat(heads[own] - offsets, width) + np.arange(int(width.sum()))
        way = forward[source[edges]] + score[edges]
        most = np.maximum.reduceat(way, offsets)
        forward[target[heads[own]]] = most + np.log(np.add.reduceat(np.exp(way - np.repeat(most, width)), offsets))
    if long.any():
        _filter_long(forward, source, target, score, heads[long], widths[long])
    share = np.exp(forward[source] + score - forward[target])
    reached = np.cumsum(share) - share
    reached -= np.repeat(reached[heads], widths)
    draw = np.clip(reached * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    before = np.where(start == starts[owner], -1, source)
    return Lattices(target << BITS | draw, before, ids.astype(np.int32), starts + sizes + np.arange(len(new)))


def _filter_long(forward: np.ndarray, source: np.ndarray, target: np.ndarray, score: np.ndarray, heads: np.ndarray, widths: np.ndarray) -> None:
    """Forward sums of long units one place after the other: a step for all units at once would hold hardly any of them."""
    held: dict[int, float] = {}
    exp, log = math.exp, math.log
    edges = np.repeat(heads - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))
    froms, scores = source[edges].tolist(), score[edges].tolist()
    at = 0
    for place, width in zip(target[heads].tolist(), widths.tolist(), strict=True):
        ways = [held.get(froms[i], 0.0) + scores[i] for i in range(at, at + width)]
        most = max(ways)
        held[place] = most + log(sum([exp(w - most) for w in ways]))
        at += width
    forward[np.fromiter(held, np.int64, len(held))] = np.fromiter(held.values(), np.float64, len(held))


class Sampler:
    """Draws segmentations; lattices of units met before are kept, the rarest and the long ones leave when it is full."""

    def __init__(self, path: str, alpha: float, seed: int) -> None:
        self.vocabulary = Vocabulary(path, alpha)
        self.seed = seed
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.ends = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.int64)
        self.before = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int64)
        self.places = 0

    def _learn(self, new: list[str]) -> None:
        keys, before, ids, ends = [self.keys], [self.before], [self.ids], [self.ends]
        for at in range(0, len(new), UNITS_AT_ONCE):
            found = lattices(new[at : at + UNITS_AT_ONCE], self.vocabulary)
            keys.append(found.keys + (np.int64(self.places) << BITS))
            before.append(np.where(found.before < 0, -1, found.before + self.places).astype(np.int32))
            ids.append(found.ids)
            ends.append(found.last + self.places)
            self.places += int(found.last[-1]) + 1
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        self.keys, self.before, self.ids, self.ends = map(np.concatenate, (keys, before, ids, ends))
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def _shrink(self) -> None:
        often = [u for u, c in self.codes.items() if self.uses[c] > 2 and len(u) <= KEPT_UNIT]
        self._clear()
        if often and len(often) <= MOST_UNITS // 2:
            self._learn(often)
        if len(self.keys) > MOST_EDGES // 2:
            self._clear()

    def _walk(self, place: int, base: np.uint64, step: int) -> np.ndarray:
        """The rest of one long unit's walk: the same draws, without an array operation for every step."""
        out, held, keys, before = [], [], self.keys, self.before
        while place >= 0:
            if not held:
                held = (mix64(base + np.arange(step, step + 4096, dtype=np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)[::-1].tolist()
                step += 4096
            edge = bisect_right(keys, place << BITS | held.pop()) - 1
            out.append(edge)
            place = int(before[edge])
        return self.ids[np.array(out, dtype=np.int64)]

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and the number of ids of each text."""
        if len(self.codes) > MOST_UNITS or len(self.keys) > MOST_EDGES:
            self._shrink()
        lists = [units(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = [u for x in lists for u in x]
        codes = np.fromiter(map(self.codes.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            unknown = [flat[i] for i in missing]
            self._learn(list(dict.fromkeys(unknown)))
            codes[missing] = np.fromiter(map(self.codes.get, unknown), np.int64, len(unknown))
        self.uses += np.bincount(codes, minlength=len(self.uses))
        row = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = mix64(mix64(keys.view(np.uint64) ^ np.uint64(self.seed))[row] + number.astype(np.uint64))
        drawn: list[np.ndarray] = []
        walkers: list[np.ndarray] = []
        steps = np.zeros(len(flat), np.int64)
        alive, at, step = np.arange(len(flat)), self.ends[codes], 0
        while len(alive) > FEW or (len(alive) and step < LONG_UNIT):
            r = (mix64(base[alive] + np.uint64(step)) >> np.uint64(64 - BITS)).astype(np.int64)
            edge = np.searchsorted(self.keys, at << BITS | r, side="right") - 1
            drawn.append(self.ids[edge])
            walkers.append(alive)
            at = self.before[edge].astype(np.int64)
            open_ = at >= 0
            step += 1
            steps[alive[~open_]] = step
            alive, at = alive[open_], at[open_]
        alone = {int(w): self._walk(int(place), base[w], step) for w, place in zip(alive, at, strict=True)}
        for w, ids in alone.items():
            steps[w] = step + len(ids)
        ends = np.cumsum(steps)
        out = np.zeros(int(steps.sum()), np.int32)
        for w, ids in alone.items():
            out[ends[w] - step - len(ids) : ends[w] - step] = ids[::-1]
        for k, (who, ids) in enumerate(zip(walkers, drawn, strict=True)):
            out[ends[who] - 1 - k] = ids
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(bounds)


_SAMPLERS: dict[tuple, Sampler] = {}
_VOCABULARIES: dict[str, Vocabulary] = {}


def _sampler(path: str, alpha: float, seed: int) -> Sampler:
    """This worker process's sampler; what it has kept serves later tasks, and never changes a result."""
    if (path, alpha, seed) not in _SAMPLERS:
        _SAMPLERS[path, alpha, seed] = Sampler(path, alpha, seed)
    return _SAMPLERS[path, alpha, seed]


def _vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode_pieces(
    docs: DataFrame, vocabulary_file: str, alpha: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text", checked: str | None = None
) -> DataFrame:
    """The table with ``ids``: a sampled segmentation of ``text``, reproducible by ``key``. A column of that name is replaced.

    ``checked`` names a column that says whether the ids decode to the text again.
    """
    base = docs.drop("ids", *([checked] if checked else []))
    keyed = base.withColumn("__key", F.xxhash64(F.col(f"`{key}`"), F.col(f"`{key}`").isNull()))
    names = [*base.columns, "ids", *([checked] if checked else [])]
    extra = [T.StructField(checked, T.BooleanType())] if checked else []
    schema = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(vocabulary_file, alpha, seed)
        for batch in batches:
            for piece in slices(batch, text, SLICE_TEXT):
                texts = as_texts(piece.column(text))
                ids, counts = sampler.sample(texts, np.asarray(piece.column("__key"), dtype=np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                own = [c for name, c in zip(piece.schema.names, piece.columns, strict=True) if name != "__key"]
                if checked:
                    back = map(sampler.vocabulary.decode, np.split(ids, np.cumsum(counts)[:-1]))
                    own_check = [pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())]
                else:
                    own_check = []
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(offsets, pa.array(ids)), *own_check], names=names)

    return small_batches(keyed).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, vocabulary_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The table with the text that ``ids`` stand for in the column ``to``. A null list stays null."""
    base = encoded.drop(to) if to != ids else encoded
    schema = T.StructType([*base.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(vocabulary_file)
        for batch in batches:
            values = np.asarray(batch.column(ids).values)
            offsets = np.asarray(batch.column(ids).offsets)
            nulls = np.asarray(batch.column(ids).is_null())
            texts = [None if no else vocabulary.decode(values[a:b]) for a, b, no in zip(offsets, offsets[1:], nulls, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return base.mapInArrow(run, schema)
