"""Conversation structure repair by weighted finite-state composition.

The rows of a conversation are an input acceptor: a chain of one symbol each (the role's initial, whether the row must go, whether its text is
cut off). An edit transducer keeps, re-roles, deletes and inserts. A role grammar accepts ``(s?(ua)+)?``. The three are composed lazily, row by
row; the composed machine has no cycle but insertions that return to a grammar state, which cost something and so are on no cheapest path.
Its shortest path in topological order is over weights (cost, edits' initials), compared in this order.

Edits up to a row end in that row's own edit, so of two different ones neither begins the other; their order never changes by what follows.
Hence a weight carries a cost and a rank among the at most four grammar states, in place of the string, and a row takes constant time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: What a row costs besides, if its text is cut off and it stays.
CUT_OFF = 1
#: Grammar: state -> {role's initial: next state}; 0 is the start.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Arc:
    """From a grammar state to another by ``inserted`` roles and then ``edit`` of the row (none at the end)."""

    source: int
    target: int
    cost: int
    inserted: tuple[str, ...]
    edit: str
    role: str | None = None

    @property
    def label(self) -> str:
        return "I" * len(self.inserted) + self.edit


@cache
def insertions(state: int) -> list[tuple[int, tuple[str, ...]]]:
    """States reached by inserting alone, each by its shortest way."""
    found = {state: ()}
    todo = [state]
    for s in todo:
        for initial, to in GRAMMAR[s].items():
            if initial in ROLES and to not in found:
                found[to] = (*found[s], ROLES[initial])
                todo.append(to)
    return list(found.items())


@cache
def arcs(state: int, initial: str, must_go: bool, cut_off: bool) -> list[Arc]:
    """What leaves ``state`` in the composed machine over a row: for each next state the arc of least (cost, label)."""
    best: dict[int, Arc] = {}
    for s, inserted in insertions(state):
        found = [Arc(state, s, DELETE, inserted, "D")]
        if not must_go:
            for i, to in GRAMMAR[s].items():
                if i == initial:
                    found.append(Arc(state, to, KEEP + CUT_OFF * cut_off, inserted, "K"))
                if i in ROLES:
                    found.append(Arc(state, to, REROLE + CUT_OFF * cut_off, inserted, "R", ROLES[i]))
        for a in found:
            a = Arc(a.source, a.target, a.cost + INSERT * len(inserted), inserted, a.edit, a.role)
            if a.target not in best or (a.cost, a.label) < (best[a.target].cost, best[a.target].label):
                best[a.target] = a
    return list(best.values())


@cache
def endings(state: int) -> Arc | None:
    """The cheapest insertions that end in an accepting state."""
    found = [Arc(state, s, INSERT * len(inserted), inserted, "") for s, inserted in insertions(state) if s in FINAL]
    return min(found, key=lambda a: (a.cost, a.label), default=None)


@cache
def conversion(a: int, b: int) -> int:
    """What it costs at most to do from state ``a`` all that can follow in state ``b``."""
    if a == b:
        return 0
    by_insertion = [INSERT * len(i) for s, i in insertions(a) if s == b]
    # after an answer all that follows a start does, but that a leading system row must be deleted
    return min([*by_insertion, *([DELETE] if (a, b) == (3, 0) else []), *([0] if (a, b) == (3, 1) else [])], default=10**9)


@dataclass
class Path:
    """The cheapest edits that reach a grammar state: cost, rank of its label, and what they repaired so far."""

    cost: int
    rank: int
    repaired: object
    begun: bool


class Repair:
    """The shortest path, row by row. What leads to each of the four states takes two bytes a row; repaired text is hashed as it comes."""

    def __init__(self):
        self.paths = {0: Path(0, 0, hashlib.sha256(), False)}
        self.back = bytearray()

    @staticmethod
    def said(path: Path, arc: Arc, role: str | None, text: str | None, alone: bool) -> tuple[object, bool]:
        """The digest of what was repaired, with what the arc adds. ``alone``: nobody else goes on from this path."""
        added = [f"{r}:" for r in arc.inserted]
        if arc.edit in ("K", "R"):
            added.append(f"{arc.role or role}:{text}")
        if not added:
            return path.repaired, path.begun
        digest = path.repaired if alone else path.repaired.copy()
        digest.update(("\n" * path.begun + "\n".join(added)).encode("utf-8", "surrogatepass"))
        return digest, True

    def row(self, role: str, text: str, must_go: bool, cut_off: bool) -> None:
        best: dict[int, tuple] = {}
        for path in self.paths.items():
            for arc in arcs(path[0], role[:1], must_go, cut_off):
                key = (path[1].cost + arc.cost, path[1].rank, arc.label)
                if arc.target not in best or key < best[arc.target][0]:
                    best[arc.target] = (key, arc)
        # a state that another reaches for less, with all that can follow, is on no cheapest path
        alive = {t: x for t, x in best.items() if not any(y[0][0] + conversion(u, t) < x[0][0] for u, y in best.items() if u != t)}
        uses: dict[int, int] = {}
        for _, arc in alive.values():
            uses[arc.source] = uses.get(arc.source, 0) + 1
        step, paths = bytearray(8), {}
        for rank, (target, ((cost, _, label), arc)) in enumerate(sorted(alive.items(), key=lambda x: x[1][0][1:])):
            digest, begun = self.said(self.paths[arc.source], arc, role, text, uses[arc.source] == 1)
            paths[target] = Path(cost, rank, digest, begun)
            step[2 * target], step[2 * target + 1] = arc.source, CODES[label]
        self.back += step
        self.paths = paths

    def end(self) -> tuple[int, str, str]:
        """cost, audit, SHA-256 of the repaired rows."""
        found = [((p.cost + a.cost, p.rank, a.label), s, a) for s, p in self.paths.items() if (a := endings(s))]
        (cost, _, label), state, arc = min(found, key=lambda x: x[0])
        digest, _ = self.said(self.paths[state], arc, None, None, False)
        labels = [label]
        for row in range(len(self.back) - 8, -1, -8):
            labels.append(LABELS[self.back[row + 2 * state + 1]])
            state = self.back[row + 2 * state]
        return cost, "".join(reversed(labels)), digest.hexdigest()


#: Labels of a row's arcs as numbers.
LABELS = ["I" * n + e for n in range(3) for e in "DKR"]
CODES = {x: i for i, x in enumerate(LABELS)}

OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [x.split()[0] for x in OUT.split(", ")]
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
LEGAL = ("su", "ua", "au")


class Conversation:
    """One conversation as its rows pass by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair, self.before = conv_id, Repair(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = None

    def row(self, turn: int | None, role: str, text: str, blank: bool, again: bool, cut_off: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut_off and not (blank or again)
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.repair.row(role, text, blank or again, cut_off and not (blank or again))

    def result(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, LARGEST)
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


def repaired(batches):
    """Rows ordered by conversation and place -> a result for each conversation that has rows."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=NAMES)

    now, rows = None, []
    for batch in batches:
        for conv_id, turn, role, text, blank, again, cut_off in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                rows += [now.result()] if now else []
                now = Conversation(conv_id)
            now.row(turn, role, text, blank, again, cut_off)
        yield batch_of(rows)
        rows = []
    yield batch_of([now.result()] if now else [])


#: What counts as white space.
SPACE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with the faults that the query sets, by a checksum of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    what = F.crc32(key.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), what.alias("what")).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with blank, again (role and text were seen before in the conversation) and cut_off. The window needs no shuffle of its own
    where rows are dealt by conv_id."""
    own = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    return rows.withColumns({"blank": last == "", "again": F.row_number().over(own) > 1, "cut_off": ~last.isin(".", "!", "?")})


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows(conv_id, turn, role, text)`` that has rows: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows come by turn, null first, then by role and text. A null conv_id is a conversation like others. Roles and texts may not be null
    (``damaged`` makes them one space). A role that begins with none of the grammar's initials, or is empty, is re-roled or deleted. A gap beyond a
    long is the largest long. Repeated rows are duplicates of the first. Other columns are ignored; an empty table gives an empty one. A conversation's rows pass through one
    task in order, as the digest of its repaired text needs; memory holds eight bytes a row for the audit, never the rows."""
    held = rows.select("conv_id", "turn", "role", "text").repartition("conv_id")
    ordered = with_faults(held).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
    return ordered.select("conv_id", "turn", "role", "text", "blank", "again", "cut_off").mapInArrow(repaired, OUT)


def audit(rows: DataFrame, damage=damaged) -> DataFrame:
    """``repair`` of ``damage(rows)``, with a row of zeros for each conv_id of ``rows`` that the damage leaves without rows. Its nulls count as
    one space, in the checksum's key too."""
    given = rows.select(rows["conv_id"], rows["turn"], rows["role"], rows["text"])
    found = repair(damage(given)).withColumn("there", F.lit(True))
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zip(NAMES[1:], NOTHING, strict=True)))


def oracle() -> str:
    """The same path by a recursive query: a row after the other, the cheapest struct (cost, edits, text) of each state."""
    crc = "list_reduce(list_concat([4294967295], list_transform(generate_series(1, length(key)), lambda i: ascii(key[i])::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
    targets: dict[int, list[str]] = {s: [] for s in GRAMMAR}
    for p in GRAMMAR:
        for s, inserted in insertions(p):
            new = "".join(f" || chr(10) || '{r}:'" for r in inserted)
            begin = f"'c': s[{p + 1}].c + {INSERT * len(inserted)}", f"'a': s[{p + 1}].a || '{'I' * len(inserted)}", f"'t': s[{p + 1}].t{new}"
            there = f"s[{p + 1}] IS NOT NULL"
            targets[s].append(f"CASE WHEN {there} THEN {{{begin[0]} + {DELETE}, {begin[1]}D', {begin[2]}}} END")
            for i, to in GRAMMAR[s].items():
                targets[to].append(f"CASE WHEN {there} AND NOT gone AND initial = '{i}' THEN {{{begin[0]} + cut, {begin[1]}K', {begin[2]} || chr(10) || role || ':' || text}} END")
                if i in ROLES:
                    targets[to].append(f"CASE WHEN {there} AND NOT gone THEN {{{begin[0]} + {REROLE} + cut, {begin[1]}R', {begin[2]} || chr(10) || '{ROLES[i]}:' || text}} END")
    step = ", ".join(f"list_sort(list_filter([{', '.join(targets[s])}], lambda x: x IS NOT NULL))[1]" for s in GRAMMAR)
    ends = [(p, a) for p in GRAMMAR if (a := endings(p))]
    end = ", ".join(f"CASE WHEN s[{p + 1}] IS NOT NULL THEN {{'c': s[{p + 1}].c + {a.cost}, 'a': s[{p + 1}].a || '{a.label}', 't': s[{p + 1}].t{''.join(f" || chr(10) || '{r}:'" for r in a.inserted)}}} END" for p, a in ends)
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
w AS (SELECT *, xor({crc}, 4294967295) % 20 AS what FROM k),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy FROM w WHERE what <> 0),
f AS (SELECT conv_id, turn, role, text, role[1] AS initial, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM f),
r AS (SELECT *, last = '' AS blank, last = '' OR again AS gone, (last NOT IN ('', '.', '!', '?') AND NOT again)::INT AS cut,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS bad FROM g),
p AS (SELECT conv_id, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': '', 't': ''}}, NULL, NULL, NULL] AS s FROM r GROUP BY conv_id
      UNION ALL SELECT r.conv_id, r.i, [{step}] FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
             sum(cut)::BIGINT AS truncated, count(*) FILTER (bad) AS illegal FROM r GROUP BY conv_id),
e AS (SELECT n.*, list_sort(list_filter([{end}], lambda x: x IS NOT NULL))[1] AS best FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = oracle()
