"""Conversation repair: the cheapest edits that turn a damaged dialogue into alternating turns.

A conversation's rows are taken by turn (nulls first; rows of one turn by role, then
text). The first fault of each row counts: ``blank`` (nothing but white space),
``duplicate`` (role and text seen earlier in the conversation), ``truncated`` (last
character that is no white space is none of ``.!?``). The edits are Keep (0), Rerole
to user or assistant (3), Delete (4; the only choice for blank and duplicate rows) and
Insert of an empty user or assistant turn anywhere (3); a truncated row that stays
adds 3. The initials of the repaired roles must read ``(s?(ua)+)?``. Among the
cheapest edit sequences the one whose letters are least in ASCII order wins.

Four states suffice (nothing yet, after ``s``, after ``u``, after ``a``), and a letter
and a state fix the next state, so the letters alone fix the repaired dialogue. A row
is one of twelve symbols (role initial s, u, a or other; sound, to be deleted, or
truncated). Consuming a symbol is a 4 x 4 min-plus matrix, a run of equal symbols a
power of it, put together from cached binary powers. The runs are advanced from the
end; then the choices are unrolled from the front, row by row inside each run.

Conversations up to ``long_rows`` rows and ``long_bytes`` bytes meet in one shuffle and
are repaired one at a time. Longer ones, which may hold a third of a table, are cut by a
range shuffle into segments of bounded size. A segment is a product of matrices; the
products of all segments behind it give the costs at its end, and it reports for each
of the four states it may be entered in the letters it would write and the state it
would leave. Only these summaries meet per conversation. The hash of a repaired
conversation reads its rows in order, which SHA-256 cannot share between tasks: they
stream through one task in bounded memory. Its audit is one string by contract.

Defined cases: null roles and texts read as one space; null conversation ids are one
conversation; null turns come first. Repeated rows of one turn are duplicates of each
other. A role whose initial is none of s, u, a (or that is empty) cannot be kept.
An empty table gives no rows; a conversation without rows has an empty audit. Further
columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.plans.scratch import materialise
from rasterloom.plans.skew import salted_join

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
SOUND, GONE, CUT = range(3)  # stays as it is, must be deleted, is truncated
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
INSERT, RECAST, DELETE, TRUNCATED = 3, 3, 4, 3
INF = math.inf
AFTER = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after a user or assistant turn is added
SPEAKER = ("", "", "user", "assistant")  # who spoke last in a state
ENDS = (0.0, INF, INF, 0.0)

LONG_ROWS, LONG_BYTES = 50_000, 32 << 20
DAMAGES = 20

Vector = tuple[float, float, float, float]
Matrix = tuple[Vector, Vector, Vector, Vector]


# --- min-plus algebra over the four states ---


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[s][m] + b[m][t] for m in STATES) for t in STATES) for s in STATES)


def _apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[s][t] + v[t] for t in STATES) for s in STATES)


UNIT: Matrix = tuple(tuple(0.0 if s == t else INF for t in STATES) for s in STATES)


@lru_cache(maxsize=1)
def _inserts() -> Matrix:
    """Cheapest way from state to state by inserted turns alone; two are enough to reach any state."""
    one = tuple(tuple(0.0 if s == t else INSERT if AFTER[s] == t else INF for t in STATES) for s in STATES)
    return _times(one, one)


def _moves(symbol: int, state: int) -> list[tuple[str, float, int]]:
    """(letter, cost, next state) of the edits of one row, letters in ASCII order."""
    role, fault = divmod(symbol, 3)
    out = [("D", DELETE, state)]
    if fault == GONE:
        return out
    extra = TRUNCATED if fault == CUT else 0
    if role == 0 and state == START:
        out.append(("K", extra, AFTER_S))
    if role == 1 and AFTER[state] == AFTER_U or role == 2 and AFTER[state] == AFTER_A:
        out.append(("K", extra, AFTER[state]))
    out.append(("R", RECAST + extra, AFTER[state]))
    return out


@lru_cache(maxsize=None)
def _power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2**bit equal rows."""
    if bit:
        half = _power(symbol, bit - 1)
        return _times(half, half)
    step = [[INF] * 4 for _ in STATES]
    for s in STATES:
        for _, cost, t in _moves(symbol, s):
            step[s][t] = min(step[s][t], cost)
    return _times(_inserts(), tuple(map(tuple, step)))


def advance(symbol: int, length: int, v: Vector) -> Vector:
    """Costs to go before a run, from the costs to go behind it."""
    bit = 0
    while length:
        if length & 1:
            v = _apply(_power(symbol, bit), v)
        length >>= 1
        bit += 1
    return v


def run_matrix(runs: list[tuple[int, int]]) -> Matrix:
    """The matrix of a whole sequence of runs."""
    total = UNIT
    for symbol, length in runs:
        bit = 0
        while length:
            if length & 1:
                total = _times(total, _power(symbol, bit))
            length >>= 1
            bit += 1
    return total


END: Vector = _apply(_inserts(), ENDS)


def unroll(runs: list[tuple[int, int]], state: int, end: Vector, last: bool) -> tuple[str, int]:
    """ASCII-least letters of a cheapest way through ``runs`` from ``state``, and the state it leaves.

    ``end`` holds the costs to go behind the runs; with ``last`` the inserts that
    complete the dialogue are written as well.
    """
    behind = [end]
    for symbol, length in reversed(runs):
        behind.append(advance(symbol, length, behind[-1]))
    letters: list[str] = []
    for (symbol, length), v in zip(runs, reversed(behind[:-1]), strict=True):
        if symbol % 3 == GONE:  # nothing but deletions, and D is the least letter
            letters.append("D" * length)
            continue
        steps = [v]
        for _ in range(length):
            steps.append(advance(symbol, 1, steps[-1]))
        for j in range(length, 0, -1):
            here, after = steps[j], steps[j - 1]
            while True:
                moves = _moves(symbol, state)
                moves.insert(1, ("I", INSERT, AFTER[state]))
                letter, _, to = next(m for m in moves if m[1] + (here if m[0] == "I" else after)[m[2]] == here[state])
                letters.append(letter)
                state = to
                if letter != "I":
                    break
    if last:
        while ENDS[state]:
            letters.append("I")
            state = AFTER[state]
    return "".join(letters), state


@lru_cache(maxsize=50_000)
def _solved(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    v = END
    for symbol, length in reversed(runs):
        v = advance(symbol, length, v)
    return int(v[START]), unroll(list(runs), START, END, True)[0]


def runs_of(symbols: list[int]) -> tuple[tuple[int, int], ...]:
    return tuple((s, sum(1 for _ in g)) for s, g in groupby(symbols))


def solve(symbols: list[int]) -> tuple[int, str]:
    """Cost and letters of the best repair of a whole conversation."""
    runs = runs_of(symbols)
    if len(symbols) > 64:  # long ones are too various to be worth remembering
        return _solved.__wrapped__(runs)
    return _solved(runs)


def repaired_turns(letters: str, roles: list[str], texts: list[str], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of every turn that the letters leave or add."""
    row = 0
    for letter in letters:
        if letter == "I":
            state = AFTER[state]
            yield letter, SPEAKER[state], ""
            continue
        role, text = roles[row], texts[row]
        row += 1
        if letter == "D":
            continue
        state = AFTER_S if letter == "K" and role[:1] == "s" else AFTER[state]
        yield letter, role if letter == "K" else SPEAKER[state], text


# --- rows and their symbols ---

BLANKS = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """The damaged table: crc32 of ``conv_id:turn`` decides what happens to a row.

    Of remainders by 20, 0 drops the row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 makes its role user. Dropped rows stay with ``gone`` set, so
    that their conversation is not forgotten.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % DAMAGES
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), key.alias("_key"))
    text = F.when(F.col("_key") == 1, "").when(F.col("_key") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_key") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_key") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_key") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def _symbol() -> Column:
    """Role and own fault of a row; duplicates are found later."""
    initial = F.substring("role", 1, 1)
    role = F.lit(OTHER)
    for letter, code in ROLES.items():
        role = F.when(initial == letter, code).otherwise(role)
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", GONE).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    return (role * 3 + fault).cast("int")


def _is_legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class _Whole:
    """Repairs conversations that fit into memory, one after the other, from rows sorted by conversation."""

    def __init__(self, turns: bool) -> None:
        self.turns = turns

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv_id, rows) of one conversation at a time, across batch borders."""
        held, group = [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[0] != group:
                    yield group, held
                    held = []
                group = row[0]
                held.append(row[1:])
        if held:
            yield group, held

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in self.rows(batches):
            rows = [r for r in rows if not r[4]]
            seen: set[tuple[str, str]] = set()
            symbols, blank, duplicate = [], 0, 0
            for _, role, text, symbol, _ in rows:
                if symbol % 3 == GONE:
                    blank += 1
                elif (role, text) in seen:
                    symbol += GONE - symbol % 3
                    duplicate += 1
                seen.add((role, text))
                symbols.append(symbol)
            cost, audit = solve(symbols)
            roles, texts = [r[1] for r in rows], [r[2] for r in rows]
            fixed = repaired_turns(audit, roles, texts)
            if self.turns:
                for place, (edit, role, text) in enumerate(fixed):
                    yield conv, place, edit, role, text
                continue
            turns = {r[0] for r in rows if r[0] is not None}
            initials = [r[:1] for r in roles]
            yield (
                conv,
                max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                blank,
                duplicate,
                sum(s % 3 == CUT for s in symbols),
                sum(not _is_legal(a, b) for a, b in zip(initials, initials[1:], strict=False)),
                cost,
                audit,
                hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in fixed).encode()).hexdigest(),
            )


def _emitting(make, schema: pa.Schema, size: int = 2000):
    """Rows of a generator over batches as batches."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in make(batches):
            held.append(row)
            if len(held) == size:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _mapped(df: DataFrame, make, ddl: str, size: int = 2000) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([df.schema["conv_id"], *T.StructType.fromDDL(ddl).fields])
    return df.mapInArrow(_emitting(make, to_arrow_schema(schema), size), schema)


# --- conversations too long for one task ---


def _segments(rows: DataFrame, long_rows: int, long_bytes: int) -> DataFrame:
    """Long conversations in range-partitioned segments, each row once with its number of ``copies``.

    Equal rows of one turn are counted map-side first, so a row repeated a million
    times is one row here; written out, since the borders come from a sample.
    """
    units = rows.where("not gone").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    units = materialise(units.withColumn("symbol", _symbol()).withColumn("_key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)), "conversation-units")
    total = units.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 64).alias("b")).first()
    parts = max(1, math.ceil(total.n / long_rows), math.ceil((total.b or 0) / long_bytes))
    # nulls first, and no two rows share (turn, role, text) inside a conversation
    early = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = units.groupBy("conv_id", "_key").agg(F.min(early).alias("_first"))
    rows = _joined(units, first).select("conv_id", "turn", "role", "text", "copies", "symbol", (F.col("_first.turn").eqNullSafe(F.col("turn"))).alias("fresh"))
    ranged = rows.repartitionByRange(parts, "conv_id", "turn", "role", "text").withColumn("segment", F.spark_partition_id())
    return materialise(ranged, "conversation-segments")


def _joined(units: DataFrame, first: DataFrame) -> DataFrame:
    """Each unit next to the first turn of its role and text; null ids meet as one conversation."""
    left = units.withColumn("_conv", F.struct("conv_id"))
    right = first.select(F.struct("conv_id").alias("_conv"), "_key", "_first")
    return salted_join(left, right, ["_conv", "_key"])


def _segment_runs(table: pa.Table) -> tuple[list[tuple[int, int]], dict]:
    """Runs and counts of one segment, rows in order."""
    rows = table.sort_by([("place", "ascending")]).to_pylist()
    runs: list[tuple[int, int]] = []
    tally = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def put(symbol: int, n: int) -> None:
        if runs and runs[-1][0] == symbol:
            runs[-1] = (symbol, runs[-1][1] + n)
        elif n:
            runs.append((symbol, n))

    for i, r in enumerate(rows):
        symbol, copies = r["symbol"], r["copies"]
        gone = symbol - symbol % 3 + GONE
        if symbol % 3 == GONE:
            tally["blank"] += copies
            put(symbol, copies)
        else:
            new = int(r["fresh"])
            tally["duplicate"] += copies - new
            tally["truncated"] += new * (symbol % 3 == CUT)
            put(symbol, new)
            put(gone, copies - new)
        # copies of one row stand next to each other, and no role may follow itself
        tally["illegal"] += copies - 1
        if i and not _is_legal(rows[i - 1]["initial"], r["initial"]):
            tally["illegal"] += 1
    return runs, tally | {"head": rows[0]["initial"], "tail": rows[-1]["initial"]}


def _long(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Per conversation its sums and audit; and all rows with the letters of their segment."""
    segments = _segments(rows, long_rows, long_bytes)
    key = segments.schema["conv_id"]
    order = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = segments.select("conv_id", "segment", "symbol", "copies", "fresh", F.substring("role", 1, 1).alias("initial"), F.row_number().over(order).alias("place"))

    def measure(table: pa.Table) -> pa.Table:
        runs, tally = _segment_runs(table)
        flat = [x for row in run_matrix(runs) for x in row]
        return pa.table({
            "conv_id": table.column("conv_id").slice(0, 1), "segment": table.column("segment").slice(0, 1),
            "matrix": pa.array([flat], pa.list_(pa.float64())), **{k: pa.array([v]) for k, v in tally.items()},
        })

    def schema(*more: str) -> T.StructType:
        return T.StructType([key, *T.StructType.fromDDL(", ".join(more)).fields])

    tallies = "blank long, duplicate long, truncated long, illegal long, head string, tail string"
    measured = materialise(placed.groupBy("conv_id", "segment").applyInArrow(measure, schema("segment int", "matrix array<double>", tallies)), "segment-costs")

    def suffixes(table: pa.Table) -> pa.Table:
        """Costs to go behind each segment; one small row a segment."""
        rows = table.sort_by([("segment", "ascending")]).to_pylist()
        v, out = END, []
        for i, r in reversed(list(enumerate(rows))):
            border = int(i > 0 and not _is_legal(rows[i - 1]["tail"], r["head"]))
            out.append({"conv_id": r["conv_id"], "segment": r["segment"], "behind": list(v), "last": i == len(rows) - 1, "border": border})
            m = r["matrix"]
            v = _apply(tuple(tuple(m[4 * s : 4 * s + 4]) for s in STATES), v)
        return pa.Table.from_pylist(out, pa.schema([table.schema.field("conv_id"), ("segment", pa.int32()), ("behind", pa.list_(pa.float64())), ("last", pa.bool_()), ("border", pa.int64())]))

    behind = measured.select("conv_id", "segment", "matrix", "head", "tail").groupBy("conv_id").applyInArrow(suffixes, schema("segment int", "behind array<double>", "last boolean", "border long"))
    behind = materialise(behind, "segment-suffixes")

    def write_letters(table: pa.Table) -> pa.Table:
        runs, _ = _segment_runs(table)
        end, last = tuple(table.column("behind")[0].as_py()), table.column("last")[0].as_py()
        ways = [unroll(runs, s, end, last) for s in STATES]
        return pa.table({
            "conv_id": table.column("conv_id").slice(0, 1), "segment": table.column("segment").slice(0, 1),
            "letters": pa.array([[w[0] for w in ways]]), "leaves": pa.array([[w[1] for w in ways]], pa.list_(pa.int32())),
        })

    def null_safe(a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.withColumnsRenamed({"conv_id": "_c", "segment": "_s"})
        return a.join(right, a["conv_id"].eqNullSafe(right["_c"]) & (a["segment"] == right["_s"])).drop("_c", "_s")

    ways = null_safe(placed, behind).groupBy("conv_id", "segment").applyInArrow(write_letters, schema("segment int", "letters array<string>", "leaves array<int>"))
    ways = materialise(ways, "segment-letters")

    def enter(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("segment").to_pylist(), table.column("leaves").to_pylist(), strict=True))
        state, states = START, []
        for _, leaves in rows:
            states.append(state)
            state = leaves[state]
        return pa.table({"conv_id": pa.concat_arrays([c for c in table.column("conv_id").chunks]), "segment": pa.array([r[0] for r in rows], pa.int32()), "state": pa.array(states, pa.int32())})

    entered = ways.select("conv_id", "segment", "leaves").groupBy("conv_id").applyInArrow(enter, schema("segment int", "state int"))
    chosen = null_safe(ways.drop("leaves"), entered).select("conv_id", "segment", F.get("letters", F.col("state")).alias("letters"), "state")
    chosen = materialise(chosen, "segment-choices")

    turns = segments.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    sums = null_safe(measured, behind.select("conv_id", "segment", "border")).groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("border")).alias("illegal")
    )
    total = null_safe(measured, behind.select("conv_id", "segment", "behind"))
    first = total.groupBy("conv_id").agg(F.min_by(F.struct("matrix", "behind"), "segment").alias("f"))
    cost = F.array_min(F.zip_with(F.slice("f.matrix", 1, 4), "f.behind", lambda a, b: a + b)).cast("long")
    out = first.select("conv_id", cost.alias("cost"))
    for more in (turns, sums, audits):
        right = more.withColumnRenamed("conv_id", "_c")
        out = out.join(right, out["conv_id"].eqNullSafe(right["_c"])).drop("_c")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))), null_safe(segments, chosen)


def _stream_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired turns of long conversations, rows arriving in order; holds one row at a time."""
    at, letters, i, state, place = None, "", 0, START, 0

    def inserts():
        nonlocal i, state, place
        while i < len(letters) and letters[i] == "I":
            state, i, place = AFTER[state], i + 1, place + 1
            yield at[0], place - 1, "I", SPEAKER[state], ""

    for batch in batches:
        for conv, segment, role, text, copies, own, entry in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != (conv, segment):
                if at is not None:
                    yield from inserts()
                place = place if at is not None and at[0] == conv else 0
                at, letters, i, state = (conv, segment), own, 0, entry
            for _ in range(copies):
                yield from inserts()
                letter = letters[i]
                i += 1
                if letter == "D":
                    continue
                state = AFTER_S if letter == "K" and role[:1] == "s" else AFTER[state]
                yield conv, place, letter, role if letter == "K" else SPEAKER[state], text
                place += 1
    if at is not None:
        yield from inserts()


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, sha256) of the repaired turns; conversations arrive one after the other."""
    group, digest = (), None
    for conv, place, _, role, text in _stream_turns(batches):
        if group != (conv,):
            if digest:
                yield group[0], digest.hexdigest()
            group, digest = (conv,), hashlib.sha256()
        digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if digest:
        yield group[0], digest.hexdigest()


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the short conversations sorted for one pass, and those of the long ones if there are any."""
    rows = rows.select("conv_id", "turn", "role", "text", "gone")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long = materialise(sizes.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select(F.struct("conv_id").alias("_conv")), "long-conversations")
    some = bool(long.limit(1).count())
    if some:
        keyed = rows.withColumn("_conv", F.struct("conv_id"))
        short = keyed.join(long, "_conv", "left_anti").drop("_conv")
        far = keyed.join(long, "_conv", "left_semi").drop("_conv")
    else:
        short, far = rows, None
    short = short.select("conv_id", "turn", "role", "text", _symbol().alias("symbol"), "gone")
    return short.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text"), far


def _ordered(placed: DataFrame) -> DataFrame:
    rows = placed.select("conv_id", "segment", "role", "text", "copies", "letters", "state", "turn")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")


def audit_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation: faults, cost and letters of its repair, hash of the repaired turns.

    ``rows`` has conv_id, turn, role, text and ``gone`` (rows that only keep their
    conversation in the result).
    """
    short, far = _split(rows, long_rows, long_bytes)
    out = _mapped(short, _Whole(False), DIGEST)
    if far is None:
        return out
    sums, placed = _long(far, long_rows, long_bytes)
    hashes = _mapped(_ordered(placed), _stream_hashes, "repaired_sha256 string").withColumnRenamed("conv_id", "_c")
    digests = sums.join(hashes, sums["conv_id"].eqNullSafe(hashes["_c"]), "left").drop("_c")
    every = far.select("conv_id").distinct().withColumnRenamed("conv_id", "_c")
    whole = every.join(digests, F.col("_c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("_c", "conv_id")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    whole = whole.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(EMPTY_SHA))})
    return out.unionByName(whole.select(*out.columns))


def repair_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role, text."""
    short, far = _split(rows, long_rows, long_bytes)
    out = _mapped(short, _Whole(True), TURNS)
    if far is None:
        return out
    return out.unionByName(_mapped(_ordered(_long(far, long_rows, long_bytes)[1]), _stream_turns, TURNS))
