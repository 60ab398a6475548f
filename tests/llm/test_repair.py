"""Conversation repair against all edit sequences."""

import hashlib
import itertools
import random
import re
from functools import cache

from compare import assert_same
from tessera.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, label int, cost long, audit string"


def faults(rows):
    """blank, duplicate, truncated or None for each row."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+", "", text)[-1:]
        again = (role, text) in seen
        seen.add((role, text))
        out.append("blank" if not last else "duplicate" if again else None if last in ".!?" else "truncated")
    return out


def brute(rows):
    """Every sequence of edits by recursion: the least (cost, audit) with its repaired rows."""
    found = faults(rows)

    @cache
    def best(i, state, inserted):
        out = []
        if i == len(rows):
            if state in (0, 3):
                out.append((0, "", ()))
        else:
            _, role, text = rows[i]
            out += [(3 + c, "D" + a, t) for c, a, t in best(i + 1, state, 0)]
            if found[i] not in ("blank", "duplicate"):
                extra = found[i] == "truncated"
                for initial, to in {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]:
                    if role[:1] == initial:
                        out += [(extra + c, "K" + a, (f"{role}:{text}", *t)) for c, a, t in best(i + 1, to, 0)]
                    if initial != "s":
                        name = {"u": "user", "a": "assistant"}[initial]
                        out += [(2 + extra + c, "R" + a, (f"{name}:{text}", *t)) for c, a, t in best(i + 1, to, 0)]
        if inserted < 4:
            for initial, to in {0: [("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]:
                out += [(2 + c, "I" + a, ({"u": "user:", "a": "assistant:"}[initial], *t)) for c, a, t in best(i, to, inserted + 1)]
        return [min(out)] if out else []

    cost, audit, text = best(0, 0, 0)[0]
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def conversations(seed, n):
    rnd = random.Random(seed)
    texts = ["Hello.", "What?", "cut off", " \t\n", "", "Ends! \n", "no end.x", "é.", "a\nb."]
    out = []
    for c in [*range(n), None]:
        for _ in range(rnd.randint(0, 7)):
            out.append((c, rnd.choice([None, *range(9)]), rnd.choice(["user", "user", "assistant", "assistant", "system", "tool", "", " "]), rnd.choice(texts), 1, 2, "x"))
    return out


def by_conversation(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        out.setdefault(c, []).append((turn, role, text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def test_against_every_edit(spark):
    rows = conversations(1, 400) + [(1000, t, "user", "x", 1, 2, "y") for t in (-(2**63), 2**63 - 1)] + [(1001, t, "user", f"{t}.", 1, 2, "y") for t in range(11)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {c: brute(r) for c, r in by_conversation(rows).items()}
    assert got == want


def test_damage_and_sql(spark):
    """Nulls in every column, repeated rows, ties, conversations that lose all rows; against the recursive query."""
    import duckdb

    rnd = random.Random(4)
    rows = []
    for c in [*range(150), None]:
        for _ in range(rnd.randint(1, 5)):
            row = (c, rnd.choice([None, *range(6)]), rnd.choice([None, "user", "assistant", "system"]), rnd.choice([None, "", "A b.", "Yes! No?", "open"]))
            rows += [row] * rnd.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = df.toArrow()
    assert len(conversations) == len(rows)
    got = repair.audit(df)
    connection = duckdb.connect()
    connection.register("conversations", conversations)
    assert_same(got, connection, repair.ORACLE)
    some = [r for r in got.collect() if not r.audit]
    assert some and len({r.conv_id for r in got.collect()}) == 151
    empty = spark.createDataFrame([], df.schema)
    assert repair.audit(empty).collect() == []


def test_whole_conversation_dropped(spark):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = repair.audit(spark.createDataFrame([(7, turn, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation(spark):
    """Tens of thousands of rows of one role: two edits forever tie, and labels still come out least."""
    n = 40_000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat(id, '.') AS text")
    got = repair.repair(df).first()
    assert got.cost == n and len(got.audit) == n and set(got.audit) == {"K", "R"} and got.gaps == 0 and got.illegal == n - 1
    small = brute([(i, "user", f"{i}.") for i in range(12)])
    few = repair.repair(df.where("turn < 12")).first()
    assert tuple(few)[1:] == small


def test_one_shuffle_of_rows(spark):
    df = spark.createDataFrame(conversations(2, 5), SCHEMA)
    plan = repair.repair(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
