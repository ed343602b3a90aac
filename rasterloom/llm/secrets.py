"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The patterns find assignments to secret-like names, access key ids and long hex runs.
The field tags the words of a text as begin, inside or outside of a secret from

* the word's own shape: kinds of characters, length, share of digits, variety;
* neighbouring words: names and shapes of the two before and the one after;
* the file: its size and how much of it are signs that code is made of.

It is fitted here, on a bounded sample: about ``SAMPLE_ROWS`` documents are searched with the
patterns, words inside a pattern's value are the positive labels, and all windows
around them plus some windows without any are the training set. Copies of both with
other names and other random values teach it more than the patterns know. The fit is
penalised maximum likelihood by forward-backward sums.

Decoding is exact Viterbi. A word whose score for "outside" beats the others by more
than all transitions can win back is outside in every best path, so only the short
runs between such words are decoded step by step.

Spans of the patterns always stay. A run that the field tags becomes a span of kind
``crf`` if it touches none of them. Spans count code points, end exclusive. Null and
empty texts have no spans; repeated rows are scanned alike; an empty table gives no
rows and an untrained field, which tags nothing. Texts of any length are scanned whole;
the words that a worker keeps between slices are bounded in number and bytes, which
changes no span. Of equally good tag sequences Viterbi takes the one whose tags come first
(outside, begin, inside) from the end backwards. Other columns pass through, but for one
of the result's name, which is replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import WORD, as_bytes, slices, small_batches
from rasterloom.plans.scratch import materialise

# The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_WORD = re.compile(WORD)
_VALUE = re.compile(r"[A-Za-z0-9+/_.-]{6,}={0,2}")
_HEX_MAP = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))

SAMPLE_ROWS = 20_000
WINDOW = 10
NEGATIVE_SHARE = 0.04
WINDOWS_PER_TEXT = 4
WORD_LIMIT = 200  # characters of a word that training windows carry
OUT, BEGIN, IN = 0, 1, 2
Span = tuple[str, int, int]


def base_spans(raw: bytes) -> list[Span]:
    """The patterns' spans in one text, by start and then kind."""
    spans: list[Span] = []
    small = raw.lower()
    named = any(n in small for n in NAMES)
    access, run = b"AKIA" in raw, b"h" * HEX_LEAST in raw.translate(_HEX_MAP)
    if not (named or access or run):
        return spans
    text = raw.decode()
    if named:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if access:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if run:
        spans += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# ---------------------------------------------------------------- features

_CLASS = bytes(
    97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else 118 if c in b"+/_.=-" else 117 if c >= 128 else 112 for c in range(256)
)
_EDGE = b"\"'`,;:()[]{}<>!?*#$%&|"
_LENGTHS = np.searchsorted(np.array([2, 4, 6, 8, 12, 16, 20, 28, 36, 48, 64]), np.arange(4096), side="right")
SHAPES, SPREADS, IDENT = 64 * 12, 5 * 5 * 2, 1 << 12
# Families of features and where each begins in the weight table.
SIZES = {"bias": 1, "shape": SHAPES, "spread": SPREADS, "before": IDENT, "before_shape": SHAPES, "before2": IDENT, "after": IDENT, "after_shape": SHAPES, "file_size": 8, "file_signs": 5}
FIRST = dict(zip(SIZES, np.concatenate([[0], np.cumsum(list(SIZES.values()))[:-1]]).tolist(), strict=True))
N_FEATURES = sum(SIZES.values())


def word_features(word: bytes) -> tuple[int, int, int]:
    """(shape, spread, identity) of a word."""
    core = word.strip(_EDGE)
    n = len(core)
    kinds = core.translate(_CLASS)
    bits = (b"a" in kinds) | (b"A" in kinds) << 1 | (b"9" in kinds) << 2 | (b"v" in kinds) << 3 | (b"p" in kinds) << 4 | (b"u" in kinds) << 5
    shape = bits * 12 + int(_LENGTHS[min(n, 4095)])
    digits = kinds.count(b"9")
    variety = len(set(core[:64]))
    spread = (min(4, 5 * digits // (n + 1)) * 5 + min(4, variety // 5)) * 2 + (len(core) != len(word))
    return shape, spread, zlib.crc32((core or word).lower()) & (IDENT - 1)


def file_features(raw: bytes) -> tuple[int, int]:
    signs = len(raw) - len(raw.translate(None, b"{};=()<>"))
    return min(7, len(raw).bit_length() // 2), int(np.searchsorted([1, 5, 20, 60], 1000 * signs / max(1, len(raw)), side="right"))


PAD = (0, 0, 0)


def window_features(words: list[bytes], file: tuple[int, int]) -> np.ndarray:
    """Feature numbers of each word, one row per word."""
    own = [PAD, PAD, *map(word_features, words), PAD]
    out = np.zeros((len(words), len(SIZES)), dtype=np.int64)
    for k in range(len(words)):
        two, one, me, after = own[k : k + 4]
        out[k] = (0, me[0], me[1], one[2], one[0], two[2], after[2], after[0], *file)
    return out + np.array(list(FIRST.values()))


# ---------------------------------------------------------------- the field

@dataclass
class Field:
    """Weights of a linear-chain field over outside, begin, inside."""

    weights: np.ndarray  # features x tags
    moves: np.ndarray  # tag x next tag

    @classmethod
    def blank(cls) -> "Field":
        weights = np.zeros((N_FEATURES, 3))
        weights[0, OUT] = 20.0
        return cls(weights, np.zeros((3, 3)))


def fit(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, penalty: float = 0.02) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam on the whole training set."""
    if not windows:
        return Field.blank()
    longest = max(len(t) for _, t in windows)
    n = len(windows)
    features = np.zeros((n, longest, len(SIZES)), dtype=np.int64)
    tags = np.zeros((n, longest), dtype=np.int64)
    inside = np.zeros((n, longest), dtype=bool)
    for k, (x, t) in enumerate(windows):
        features[k, : len(t)], tags[k, : len(t)], inside[k, : len(t)] = x, t, True
    weights, moves = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    gold = np.eye(3)[tags] * inside[..., None]
    pairs = inside[:, 1:]
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    flat = features[inside]
    for step in range(1, steps + 1):
        scores = weights[features].sum(axis=2)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            new = _log_sum(forward[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
            forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], new, 0.0)
        total = _log_sum(forward[:, -1], 1)
        chance = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
        both = np.exp(forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        off = (chance - gold)[inside]
        slope = np.zeros_like(weights)
        for c in range(3):
            slope[:, c] = np.bincount(flat.ravel(), weights=np.repeat(off[:, c], flat.shape[1]), minlength=N_FEATURES)
        for value, gradient, first, second in (
            (weights, slope + penalty * weights, moments[0], moments[1]),
            (moves, both.sum(axis=(0, 1)) - gold_moves + penalty * moves, moments[2], moments[3]),
        ):
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            value -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(weights, moves)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def viterbi(scores: np.ndarray, moves: np.ndarray, before: int | None, after: int | None) -> list[int]:
    """The best tags of a run, given the tags around it (None at the ends of a text)."""
    best = scores[0] + (moves[before] if before is not None else 0.0)
    back = []
    for row in scores[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    if after is not None:
        best = best + moves[:, after]
    tags = [int(best.argmax())]
    for pointers in reversed(back):
        tags.append(int(pointers[tags[-1]]))
    return tags[::-1]


def lead_needed(moves: np.ndarray) -> np.ndarray:
    """By how much "outside" must lead each other tag for it to be outside in every best path."""
    into = np.maximum(0.0, (moves - moves[:, [OUT]]).max(axis=0))
    out = np.maximum(0.0, (moves - moves[[OUT], :]).max(axis=1))
    return into + out


class Tagger:
    """Tags the words of many texts; the scores of words met before are kept."""

    MOST_WORDS, MOST_BYTES = 300_000, 16 << 20

    def __init__(self, field: Field) -> None:
        self.field = field
        self.lead = lead_needed(field.moves)
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.held = 0  # bytes of the words kept
        self.scores = {name: np.zeros((0, 3)) for name in ("own", "before", "before2", "after")}
        self._add([PAD])

    def _add(self, features: list[tuple[int, int, int]]) -> None:
        shape, spread, name = np.array(features, dtype=np.int64).reshape(-1, 3).T
        w = self.field.weights
        new = {
            "own": w[0] + w[FIRST["shape"] + shape] + w[FIRST["spread"] + spread],
            "before": w[FIRST["before"] + name] + w[FIRST["before_shape"] + shape],
            "before2": w[FIRST["before2"] + name],
            "after": w[FIRST["after"] + name] + w[FIRST["after_shape"] + shape],
        }
        self.scores = {k: np.concatenate([v, new[k]]) for k, v in self.scores.items()}

    def runs(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """Per text the (first, last) word of each tagged secret."""
        if len(self.codes) > self.MOST_WORDS or self.held > self.MOST_BYTES:
            self._clear()
        lists = [t.split() for t in texts]
        flat = [w for x in lists for w in (*x, b"", b"")]  # two pads after each text keep neighbours apart
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.codes.setdefault(b"", 0)
        codes = np.fromiter(map(self.codes.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            unknown = [flat[i] for i in missing]
            new = list(dict.fromkeys(unknown))
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
            self._add([word_features(w) for w in new])
            self.held += sum(map(len, new))
            codes[missing] = np.fromiter(map(self.codes.get, unknown), np.int64, len(unknown))
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(flat):
            return found
        score = self.scores["own"][codes]
        pad = {k: v[0] for k, v in self.scores.items()}
        score[1:] += self.scores["before"][codes[:-1]]
        score[0] += pad["before"]
        score[2:] += self.scores["before2"][codes[:-2]]
        score[:2] += pad["before2"]
        score[:-1] += self.scores["after"][codes[1:]]
        starts = np.cumsum(counts + 2) - (counts + 2)
        w = self.field.weights
        files = np.array([file_features(t) for t in texts])
        score += np.repeat(w[FIRST["file_size"] + files[:, 0]] + w[FIRST["file_signs"] + files[:, 1]], counts + 2, axis=0)
        open_ = (score[:, [OUT]] - score[:, 1:] <= self.lead[1:]).any(axis=1)
        open_[starts + counts] = open_[starts + counts + 1] = False
        at = np.flatnonzero(open_)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
            text = int(np.searchsorted(starts, run[0], side="right")) - 1
            first, n = int(run[0] - starts[text]), int(counts[text])
            tags = viterbi(score[run], self.field.moves, OUT if first else None, OUT if first + len(run) < n else None)
            begun = None
            for k, tag in enumerate([*tags, OUT]):
                if begun is not None and tag != IN:
                    found[text].append((first + begun, first + k - 1))
                    begun = None
                if tag == BEGIN or (tag == IN and begun is None):
                    begun = k
        return found


def tagged_spans(raw: bytes, runs: list[tuple[int, int]], taken: list[Span]) -> list[Span]:
    """The character spans of tagged words, cut to the value they hold; those that touch a span of ``taken`` are left out."""
    if not runs:
        return []
    text = raw.decode()
    words = [m.span() for m in _WORD.finditer(text)]
    out = []
    for first, last in runs:
        values = [m.span() for m in _VALUE.finditer(text, words[first][0], words[last][1])]
        if not values:
            continue
        start, end = max(values, key=lambda s: (s[1] - s[0], -s[0])) if first == last else (values[0][0], values[-1][1])
        if all(end <= a or b <= start for _, a, b in taken):
            out.append(("crf", start, end))
    return out


# ---------------------------------------------------------------- training set

def label_windows(raw: bytes, spans: list[Span], negative: bool, rng: random.Random) -> list[tuple[list[bytes], list[int]]]:
    """Windows of words with tags: around the patterns' values, and one without any if asked for."""
    text = raw.decode()
    words = [m.span() for m in _WORD.finditer(text)]
    tags = [OUT] * len(words)
    anchors = []
    for kind, start, end in spans:
        if kind == "assign":
            found = ASSIGN.match(text, start)
            start = found.start(2) if found else start
        own = [k for k, (a, b) in enumerate(words) if a < end and start < b]
        for k in own:
            tags[k] = BEGIN if k == own[0] else IN
        anchors += own[:1]
    if negative and words:
        anchors.append(rng.randrange(len(words)))
    out = []
    for at in list(dict.fromkeys(anchors))[:WINDOWS_PER_TEXT]:
        a, b = max(0, at - WINDOW), at + WINDOW + 1
        out.append(([text[x:y][:WORD_LIMIT].encode() for x, y in words[a:b]], tags[a:b]))
    return out


def training_windows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[list[bytes], list[int], tuple[int, int]]]:
    """Labelled windows of a sample of about ``rows`` documents, never more windows than twice as many documents give.

    Texts are read where they lie; only the windows, of bounded length, travel.
    """
    total = docs.count()
    order = F.xxhash64(F.lit(23), "doc_id", F.length("text"))
    share = order.bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    sample = docs.select("text", order.alias("seed"), share.alias("share")).where(F.col("share") < min(1.0, rows / max(total, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tags, files = [], [], []
            for raw, seed in zip(as_bytes(batch.column("text")), batch.column("seed").to_pylist(), strict=True):
                rng = random.Random(seed)
                spans, negative = base_spans(raw), rng.random() < NEGATIVE_SHARE
                if spans or negative:
                    for w, t in label_windows(raw, spans, negative, rng):
                        words.append(w)
                        tags.append(t)
                        files.append(file_features(raw))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.list_(pa.binary())), pa.array(tags, pa.list_(pa.int32())), pa.array(files, pa.list_(pa.int32()))], names=["words", "tags", "file"]
            )

    windows = materialise(small_batches(sample).mapInArrow(run, "words array<binary>, tags array<int>, file array<int>"), "secret-windows")
    found = windows.limit(2 * rows * WINDOWS_PER_TEXT).collect()
    return sorted(([bytes(w) for w in r.words], list(r.tags), tuple(r.file)) for r in found)


# Names and harmless assignments for the varied copies.
OTHER_NAMES = (b"credential", b"credentials", b"pwd", b"auth", b"auth_token", b"private_key", b"access_key", b"client_secret", b"passphrase", b"bearer", b"session_key", b"signing_key")
HARMLESS = (b"page: 12", b"count = 1234", b"date: 2024-01-05", b"total = 1,234.56", b'name = "Anna"', b"version = 1.2.3", b"mail: anna.lee@mail.example.com", b"size=1024", b"phone: 4995556503", b"card 4785380592391139", b"see https://www.example.com/en/page?id=77", b"isbn: 9783161484100")
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def varied(words: list[bytes], tags: list[int], rng: random.Random) -> tuple[list[bytes], list[int]]:
    """A copy of a window: another name and value where it has a secret, otherwise a secret or a harmless assignment put in."""
    words, tags = list(words), list(tags)
    value = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(20, 64))).encode()
    sign = rng.choice((b"=", b":"))
    if BEGIN in tags:
        at = tags.index(BEGIN)
        if words[at].count(b"=") == 0:
            words[at] = b'"' + value + b'"' if rng.random() < 0.5 else value
            if at > 1:
                words[at - 2], words[at - 1] = rng.choice(OTHER_NAMES), sign
        return words, tags
    put = rng.choice(HARMLESS).split() if rng.random() < 0.7 else [rng.choice(OTHER_NAMES), sign, value]
    marks = [OUT] * len(put)
    if put[-1] == value:
        marks[-1] = BEGIN
    at = rng.randrange(len(words) + 1)
    return words[:at] + put + words[at:], tags[:at] + marks + tags[at:]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """Fit the field on the sample's windows and two varied copies of each."""
    rng = random.Random(29)
    windows = []
    for words, tags, file in training_windows(docs, rows):
        for own_words, own_tags in ((words, tags), varied(words, tags, rng), varied(words, tags, rng)):
            windows.append((window_features(own_words, file), np.array(own_tags)))
    return fit(windows)


_TAGGERS: dict[int, Tagger] = {}


def find_secrets(docs: DataFrame, field: Field | None = None, text: str = "text", to: str = "secrets") -> DataFrame:
    """The table with ``to``: an array of (kind, start, end), by start and then kind. A column of that name is replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs) if field is None else field)  # fixed size
    base = docs.drop(to)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*base.schema.fields, T.StructField(to, T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for piece in slices(batch, text, 2 << 20):
                raw = as_bytes(piece.column(text))
                found = []
                for one, runs in zip(raw, tagger.runs(raw), strict=True):
                    spans = base_spans(one)
                    spans = ordered(spans + tagged_spans(one, runs, spans)) if runs else spans
                    found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, arrow)], names=[*piece.schema.names, to])

    return small_batches(base).mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[secret]") -> DataFrame:
    """The table with the spans of its texts replaced by ``mark``; overlapping spans are replaced as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, own in zip(b.column(text).to_pylist(), b.column(spans).to_pylist(), strict=True):
                if not own:
                    out.append(value)
                    continue
                parts, at = [], 0
                for start, end in _merged([(s["start"], s["end"]) for s in own]):
                    parts += [value[at:start], mark]
                    at = end
                out.append("".join([*parts, value[at:]]))
            columns = [pa.array(out, pa.string()) if n == text else c for n, c in zip(b.schema.names, b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
