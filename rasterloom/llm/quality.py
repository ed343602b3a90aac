"""Quality rules as a short-circuit cascade.

Every rule rejects on a few measures of a text. On a bounded sample each rule's
cost per row and its share of rejected rows are estimated; rules then run in the
order of rejections per cost, and a rule sees only the rows that all rules
before it let pass. The order changes the time, never the verdict: a row is kept
if no rule rejects it.

Nulls and empty texts have no words. Repeated rows and ties are judged one by
one. An empty table gives no rows; texts of any length are measured whole. Other
columns of the input pass through untouched, but for those of the result's names,
which are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import BLANKS, as_bytes, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 8


class Measures:
    """Measures of the texts of one slice, each computed once and only for the rows asked for."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self._words: list[list[bytes] | None] = [None] * len(texts)
        self._values: dict[str, np.ndarray] = {}
        self._known: dict[str, np.ndarray] = {}

    def words(self, row: int) -> list[bytes]:
        if self._words[row] is None:
            self._words[row] = self.texts[row].split()
        return self._words[row]

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        if name not in self._values:
            self._values[name] = np.zeros(len(self.texts), dtype=np.int64)
            self._known[name] = np.zeros(len(self.texts), dtype=bool)
        new = rows[~self._known[name][rows]]
        if len(new):
            self._values[name][new] = MEASURES[name](self, new)
            self._known[name][new] = True
        return self._values[name][rows]


def _per_text(measure: Callable[[bytes], int]) -> Callable[[Measures, np.ndarray], list[int]]:
    return lambda m, rows: [measure(m.texts[i]) for i in rows]


def _n_words(m: Measures, rows: np.ndarray) -> list[int]:
    return [len(m.words(i)) for i in rows]


def _n_shouted(m: Measures, rows: np.ndarray) -> list[int]:
    """Words of two or more code points with capitals and without small letters."""
    joined = (b" ".join(m.words(i)).decode().split(" ") for i in rows)
    return [sum(w.isupper() and len(w) > 1 for w in words) for words in joined]


def _n_lines(text: bytes) -> int:
    return sum(1 for line in text.split(b"\n") if line.strip())


def _n_dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _n_repeat_words(m: Measures, rows: np.ndarray) -> np.ndarray:
    """Words inside an 8-word window that the same text holds at least twice.

    Words become integer codes; codes of 2, 4 and 8 words follow by numbering
    distinct pairs, so equal windows have equal codes and no hash can collide.
    """
    lists = [m.words(i) for i in rows]
    lengths = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    flat = np.empty(int(lengths.sum()), dtype=object)
    flat[:] = [w for x in lists for w in x]
    out = np.zeros(len(rows), dtype=np.int64)
    if len(flat) < WINDOW:
        return out
    codes = pd.factorize(flat)[0].astype(np.int64)
    text = np.repeat(np.arange(len(rows)), lengths)
    step = 1
    while step < WINDOW:
        codes = pd.factorize((codes[:-step] << np.int64(31)) | codes[step:])[0].astype(np.int64)
        step *= 2
    inside = text[: len(codes)] == text[WINDOW - 1 :]
    starts = np.flatnonzero(inside)
    keys = pd.factorize((codes[starts] << np.int64(31)) | text[starts])[0]
    twice = starts[np.bincount(keys, minlength=1)[keys] > 1] if len(starts) else starts
    cover = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, np.minimum(twice + WINDOW, len(flat)), -1)
    np.add.at(out, text[np.cumsum(cover[:-1]) > 0], 1)
    return out


MEASURES: dict[str, Callable[[Measures, np.ndarray], Sequence[int] | np.ndarray]] = {
    "n_words": _n_words,
    "word_chars": _per_text(lambda t: len(t.translate(None, BLANKS).decode())),
    "n_symbols": _per_text(lambda t: len(t) - len(t.translate(None, SYMBOLS))),
    "n_lines": _per_text(_n_lines),
    "n_dup_lines": _per_text(_n_dup_lines),
    "n_repeat_words": _n_repeat_words,
    "n_shouted": _n_shouted,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the arrays of ``measures`` in order and says which rows fail."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
)
RULES = (
    *BASE,
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 12 * n)),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("shouting", ("n_shouted", "n_words"), lambda s, n: 10 * s > 3 * n),
)
SAMPLE_ROWS = 2000


def cascade(m: Measures, rules: Sequence[Rule]) -> np.ndarray:
    """Position in ``rules`` of the first rule that rejects each row, -1 if none does."""
    first = np.full(len(m.texts), -1, dtype=np.int32)
    alive = np.arange(len(m.texts))
    for at, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(*(m.get(name, alive) for name in rule.measures))
        first[alive[bad]] = at
        alive = alive[~bad]
    return first


def rule_estimates(df: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS, text: str = "text") -> dict[str, tuple[float, float]]:
    """Per rule: seconds per row and share of rejected rows, on about ``rows`` rows.

    The sample is drawn row by row at a rate that the size of the table sets;
    tasks send back only three numbers per rule.
    """
    total = df.count()
    if not total:
        return {}
    sample = df.select(F.col(f"`{text}`").alias("text")).where(F.rand(17) < min(1.0, rows / total))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {r.name: [0.0, 0, 0] for r in rules}
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = as_bytes(piece.column("text"))
                for rule in rules:
                    m, every = Measures(texts), np.arange(len(texts))
                    start = time.perf_counter()
                    bad = rule.rejects(*(m.get(name, every) for name in rule.measures))
                    seen[rule.name][0] += time.perf_counter() - start
                    seen[rule.name][1] += int(bad.sum())
                    seen[rule.name][2] += len(texts)
        yield pa.RecordBatch.from_pydict(
            {"rule": list(seen), "s": [v[0] for v in seen.values()], "bad": [v[1] for v in seen.values()], "n": [v[2] for v in seen.values()]}
        )

    found = (
        sample.mapInArrow(measure, "rule string, s double, bad long, n long")
        .groupBy("rule").agg(F.sum("s").alias("s"), F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        .collect()
    )
    return {r.rule: (r.s / r.n, r.bad / r.n) for r in found if r.n}


def ordered(rules: Sequence[Rule], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; ties and unknown rules keep their order."""

    def gain(rule: Rule) -> float:
        cost, rejected = estimates.get(rule.name, (1.0, 0.0))
        return rejected / max(cost, 1e-9)

    return sorted(rules, key=gain, reverse=True)


def quality_rules(
    df: DataFrame,
    rules: Sequence[Rule] = RULES,
    report: Sequence[str] = (),
    sample_rows: int = SAMPLE_ROWS,
    text: str = "text",
) -> DataFrame:
    """The table with ``kept`` and ``rejected_by`` (the first rule of the cascade that fires).

    ``report`` names measures to return for every row, rejected or not; all
    others are computed for rows that reach their rule only. Columns of the
    input that carry one of the new names are replaced.
    """
    new = [*report, "kept", "rejected_by"]
    base = df.drop(*[n for n in new if n != text])
    chain = ordered(rules, rule_estimates(df, rules, sample_rows, text))
    names = np.array([*(r.name for r in chain), None], dtype=object)
    schema = T.StructType(
        [*base.schema.fields, *[T.StructField(n, T.LongType()) for n in report], T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                m = Measures(as_bytes(piece.column(text)))
                first = cascade(m, chain)
                every = np.arange(piece.num_rows)
                extra = [pa.array(m.get(n, every), pa.int64()) for n in report]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *extra, pa.array(first < 0), pa.array(names[first], pa.string())],
                    names=[*piece.schema.names, *new],
                )

    return base.mapInArrow(run, schema)
