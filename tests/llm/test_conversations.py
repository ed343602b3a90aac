import hashlib
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import conversations as c
from rasterloom.llm.queries import QUERIES

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """Cheapest letters by exhaustive search over (row, last role, inserts in a row); rows are (role, text, fault)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def go(j, to, count, cost, letter, turn):
            rest = best(j, to, count)
            options.append((cost + rest[0], letter + rest[1], (turn, *rest[2]) if turn else rest[2]))

        for name in ("user", "assistant"):
            if name[0] in follows[last] and inserted < 3:
                go(i, name[0], inserted + 1, 3, "I", name + ":")
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, last, 0, 4, "D", None)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role and role[0] in follows[last]:
                    go(i + 1, role[0], 0, more, "K", f"{role}:{text}")
                for name in ("user", "assistant"):
                    if name[0] in follows[last]:
                        go(i + 1, name[0], 0, 3 + more, "R", f"{name}:{text}")
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def by_hand(rows):
    """(conv_id -> digest) of undamaged rows, by the contract's words."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = role if role is not None else " ", text if text is not None else " "
            key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if key == 0:
                continue
            if key == 1:
                text = ""
            if key == 2:
                text = text.replace(".", "").replace("!", "").replace("?", "")
            if key == 4:
                role = "user"
            kept += [(turn, role, text)] * (2 if key == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            core = text.strip(BLANK)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, turns = plain_repair(tuple((r, t, f) for (_, r, t), f in zip(kept, faults)))
        known = {t for t, _, _ in kept if t is not None}
        first = [r[:1] for _, r, _ in kept]
        out[conv] = (
            max(known) - min(known) + 1 - len(known) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest(),
        )
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in rows}


SYMBOLS = st.lists(st.integers(0, 11), max_size=9)


def plain_symbols(symbols):
    roles = ["system", "user", "assistant", "tool"]
    return tuple((roles[s // 3], f"t{i}", ("", "blank", "truncated")[s % 3]) for i, s in enumerate(symbols))


@settings(max_examples=300, deadline=None)
@given(SYMBOLS)
def test_cost_and_letters_equal_exhaustive_search(symbols):
    assert c.solve(symbols) == plain_repair(plain_symbols(symbols))[:2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(1, 40)), max_size=5))
def test_powers_of_runs_equal_single_rows(runs):
    flat = [s for s, n in runs for _ in range(n)]
    cost, audit = c.solve(flat)
    v = c.END
    for s in reversed(flat):
        v = c.advance(s, 1, v)
    assert cost == v[c.START] == c._apply(c.run_matrix(list(c.runs_of(flat))), c.END)[c.START]
    spent = {"D": 4, "I": 3, "K": 0, "R": 3}
    kept = [s for s, e in zip(flat, [x for x in audit if x != "I"], strict=True) if e in "KR"]
    assert sum(spent[e] for e in audit) + 3 * sum(s % 3 == c.CUT for s in kept) == cost and all(s % 3 != c.GONE for s in kept)


HARD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 4, "user", "cut off"),
    (2, None, None, None), (2, None, "user", "no turn."), (2, 7, "", "no role."), (2, 7, "tool", "a tool."), (2, -3, "user", "\n\t "),
    (None, 0, "user", "no conversation."), (None, None, "assistant", "Yes?"), (None, 1, "assistant", "Yes?"),
    (3, 1, "user", "x" * 50_000 + "."), (3, 2, "assistant", "日本語。"), (3, 3, "assistant", "日本語. \x0b"),
    (4, 0, "user", "ends."), (4, 0, "assistant", "same turn."), (4, 0, "user", "ends."),
] + [(5, i, ("user", "assistant")[i % 2], f"{i // 6}.") for i in range(40)] + [(6, i, "user", "again.") for i in range(25)] + [(7 + i, 0, "user", "One.") for i in range(30)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


def test_hard_rows_equal_exhaustive_search(hard):
    from pyspark.sql import functions as F

    clash = hard.withColumns({n: F.lit("x") for n in ("gone", "symbol", "segment", "copies", "_key", "_conv")})
    assert found(c.audit_conversations(c.damage(clash))) == by_hand(HARD)


@pytest.mark.parametrize("long_rows", [1, 4])
def test_long_conversations_cut_into_segments_give_the_same(hard, long_rows):
    damaged = c.damage(hard)
    assert found(c.audit_conversations(damaged, long_rows=long_rows)) == by_hand(HARD)
    key = lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)
    want = sorted(c.repair_conversations(damaged).collect(), key=key)
    assert sorted(c.repair_conversations(damaged, long_rows=long_rows).collect(), key=key) == want


def test_repaired_turns_carry_the_hash(hard):
    damaged = c.damage(hard)
    digests = found(c.audit_conversations(damaged))
    turns = {}
    for r in sorted(c.repair_conversations(damaged).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, d in digests.items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == d[-1]


def test_empty_table(spark):
    assert c.audit_conversations(c.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_whole_table_equals_exhaustive_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(QUERIES["op11_conversations"](spark, sf))
    assert got == by_hand(rows) and {type(x) for d in got.values() for x in d} == {int, str}
