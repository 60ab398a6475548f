"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

How often a document should be taken, on average, grows with its length: the number of binary digits of its words, times a
factor that makes a source's expected words its target, at most ``most`` times. The whole part of it is certain: so many whole
copies. The rest is the document's inclusion probability p, and documents are ranked by the Pareto statistic
[u / (1 - u)] / [p / (1 - p)], u being a random number that the document's id and text fix. From the front of each source's
ranking documents are taken until its remaining words are used up, which is where the statistic passes 1, about; where the next
document would pass the target, the following ``AHEAD`` ones may still fill the gap, and the smallest of those left is taken as well if
that comes nearer to the target.

No source is sorted as a whole: ranks are dealt into ``BUCKETS`` buckets, whose sums say in which one a source's
target lies; that bucket and the documents just behind it are dealt into ``BUCKETS`` finer ones in the same way,
and only what lies in the last such bucket and just behind it is put in order, equal rows as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BUCKETS = 1 << 12
AHEAD = 64
SEED = "mix"
#: Up to so many sources, of some 50 bytes each, are one task's window or sent to every executor; more are dealt out.
SOURCES = 50_000
#: Rows that one task makes of equal ones, about.
EQUAL = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """``rows`` with the sums over those before each in ``order``. If they aren't few they are dealt to ranges, and the totals of the
    ranges before are added: a window over a range, and one over a row for each range."""
    if few:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    dealt = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__{n}").over(w), F.lit(0)).alias(f"__{n}") for n in sums))
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), "__range").withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"__{n}") for n, c in sums.items()})
    return out.drop("__range", *(f"__{n}" for n in sums))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``. Sources by code point, null last, take
    the weights in turn and share ``share`` of all words; a source's target stops at ``most`` times its size, and
    what is over goes to the others by weight. In the order of size by weight those that stop come first, so
    running sums find the level at which no other one stops."""
    n, words = sizes.agg(F.count("*"), F.sum("source_size")).first()
    if not n:
        return sizes.withColumn("target", F.lit(0.0))
    few, by_name = n <= SOURCES, [F.col("source").asc_nulls_last()]
    s = sums_before(sizes, by_name, {"at": F.lit(1)}, few)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = cut(sums_before(s, [F.col("ratio"), *by_name], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, few))
    level = (F.lit(words) * F.lit(share) - F.col("cap_before")) / (F.lit(s.agg(F.sum("weight")).first()[0]) - F.col("weight_before"))
    top = s.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct("ratio", "at"))).first()[0]
    target = F.col("cap").cast("double")
    return s.select("source", "source_size", (target if top is None else F.least(F.lit(top) * F.col("weight"), target)).alias("target"))


def length_class(size: Column) -> Column:
    """The binary digits of a number of words, 0 for none: what expected copies grow with."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0)).cast("long")


def inclusion(classes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, class, whole, p, rest, source_size, target) from ``classes(source, class, words)``: whole copies and inclusion
    probability of the documents of each length class, and the words of its source's target that whole copies leave. Expected copies
    are class times a factor, at most ``most``; from the longest class down, the factor is that of the first class that it leaves below."""
    t = targets.withColumnRenamed("source", "__source")
    c = classes.join(t, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("class") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = c.withColumn("factor", F.when(below > 0, (F.col("target") - above * most) / below))
    whole_source = Window.partitionBy("source")
    c = c.withColumn("factor", F.max_by(F.when(F.col("factor") * F.col("class") <= most, F.col("factor")), F.when(F.col("factor") * F.col("class") <= most, F.col("class"))).over(whole_source))
    copies = F.least(F.lit(float(most)), F.coalesce(F.col("factor") * F.col("class"), F.when(F.col("class") > 0, float(most)).otherwise(0.0)))
    c = c.withColumn("copies", copies).withColumn("copies", F.when(F.abs(F.col("copies") - F.round("copies")) < 1e-9, F.round("copies")).otherwise(F.col("copies")))
    c = c.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.col("whole"))
    return c.select("source", "class", "whole", "p", (F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source)).alias("rest"), "source_size", "target")


def text_key(doc_id: Column, text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(doc_id.isNull(), text)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size (words), source_size, target (of its source), taken (words
    that the mix takes, repeats counted: a multiple of size, at most ``most`` times it), copies, text_key.

    Null texts and texts of white space have size 0 and take nothing; a null source is one source, the last.
    Rows that tie in rank come by id, then size. Repeated rows count as documents of their own; any of them may stand for
    the others. The same input gives the same result in every run. Other columns are ignored; an empty table gives an empty one."""
    name = F.concat(F.lit(f"{seed}/"), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit("/"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), n_words(docs[text_col].cast("string")).alias("size"), text_key(docs[id_col], docs[text_col]).alias("text_key"), ((h + 0.5) / float(1 << 52)).alias("u"))
    rows = cut(rows.withColumn("class", length_class(F.col("size"))))
    classes = cut(rows.groupBy("source", "class").agg(F.sum("size").alias("words")))
    odds = cut(inclusion(classes, source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), most))
    few = odds.count() <= SOURCES

    def by_source(a: DataFrame, b: DataFrame, how: str = "inner", *also: str) -> DataFrame:
        b = b.withColumnsRenamed({c: f"__{c}" for c in ("source", *also)})
        b = F.broadcast(b) if few else b
        same = F.col("source").eqNullSafe(F.col("__source"))
        for c in also:
            same = same & (F.col(c) == F.col(f"__{c}"))
        return a.join(b, same, how).drop("__source", *(f"__{c}" for c in also))

    q = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))
    ranked = by_source(rows, odds, "inner", "class").withColumn("at", F.when(F.col("p") > 0, q / (1 + q)))
    ranked = ranked.withColumn("fine", F.least(F.floor(F.col("at") * BUCKETS * BUCKETS), F.lit(BUCKETS * BUCKETS - 1))).withColumn("bucket", F.floor(F.col("fine") / BUCKETS))
    # Of these the whole copies are all: nothing is chosen, so there is no order to find.
    settled = ranked.where(F.col("p") <= 0).withColumn("chosen", F.lit(False))
    ranked = ranked.where(F.col("p") > 0)

    def edges_of(part: DataFrame, bucket: str) -> DataFrame:
        """(source, edge, edge_end, words_before): the bucket in which a source's remaining words end, the last one that AHEAD
        documents behind it reach into, and the words before the first. At most two times BUCKETS sums a source, about."""
        sums = part.groupBy("source", "rest", "base", F.col(bucket).alias("b")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumns({"words_to": F.col("base") + F.sum("words").over(upto), "n_to": F.sum("n").over(upto)})
        over = sums.where(F.col("words_to") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("b", "words", "words_to", "n_to"), "b").alias("x"))
        over = over.select("source", F.col("x.b").alias("edge"), (F.col("x.words_to") - F.col("x.words")).alias("words_before"), (F.col("x.n_to") + AHEAD).alias("n_end"))
        last = by_source(sums, over).where(F.col("n_to") - F.col("n") < F.col("n_end")).groupBy("source").agg(F.max("b").alias("edge_end"))
        return cut(by_source(over, last, "left").select("source", "edge", "edge_end", "words_before"))

    in_edge = lambda b: (F.col(b) >= F.col("edge")) & (F.col(b) <= F.col("edge_end"))
    rough = edges_of(ranked.withColumn("base", F.lit(0).cast("long")), "bucket")
    edges = edges_of(by_source(ranked, rough).where(in_edge("bucket")).withColumn("base", F.col("words_before")), "fine")

    all_rows = by_source(ranked, edges, "left")
    inside = F.coalesce(in_edge("fine"), F.lit(False))
    # A source whose words end nowhere has all of its ranked documents in front.
    outer = all_rows.where(~inside).withColumn("chosen", F.coalesce(F.col("fine") < F.col("edge"), F.lit(True)))
    keep = ["doc_id", "size", "text_key", "source_size", "target", "whole"]
    near = chosen_near(all_rows.where(inside).groupBy("source", "rest", "words_before", "at", *keep).agg(F.count("*").alias("n")))
    near = repeated(near.select(*keep, "n", "take"), "n", "i").withColumn("chosen", F.col("i") <= F.col("take"))
    done = outer.select(*keep, "chosen").unionByName(settled.select(*keep, "chosen")).unionByName(near.select(*keep, "chosen"))
    copies = F.col("whole") + F.col("chosen").cast("long")
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "text_key")


def chosen_near(near: DataFrame) -> DataFrame:
    """``near``, distinct rows around the edge of each source with their number n, with how many of each are taken."""
    order = Window.partitionBy("source").orderBy("at", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    source = Window.partitionBy("source")
    near = near.withColumns({"k": F.row_number().over(order.rowsBetween(Window.unboundedPreceding, 0)), "n_to": F.sum("n").over(order), "run": F.sum(F.col("n") * F.col("size")).over(order) + F.col("words_before")})
    near = near.withColumn("fits", F.col("run") <= F.col("rest"))
    near = near.withColumns({"n0": F.coalesce(F.max(F.when(F.col("fits"), F.col("n_to"))).over(source), F.lit(0)), "used": F.coalesce(F.max(F.when(F.col("fits"), F.col("run"))).over(source), "words_before")})
    in_window = ~F.col("fits") & (F.col("n_to") - F.col("n") < F.col("n0") + AHEAD)
    ahead = near.where(in_window).groupBy("source", "rest", "used").agg(F.array_sort(F.collect_list(F.struct("k", "size", "n"))).alias("docs"))

    def fill(acc: Column, d: Column) -> Column:
        take = F.least(d["n"], F.floor(acc["gap"] / d["size"]))
        return F.struct((acc["gap"] - take * d["size"]).alias("gap"), F.concat(acc["out"], F.array(F.struct(d["k"].alias("k"), d["size"].alias("size"), d["n"].alias("n"), take.alias("take")))).alias("out"))

    start = F.struct((F.col("rest") - F.col("used")).cast("double").alias("gap"), F.expr("cast(array() as array<struct<k: int, size: bigint, n: bigint, take: bigint>>)").alias("out"))
    ahead = ahead.withColumn("filled", F.aggregate("docs", start, fill))
    gap = F.col("filled.gap")
    nearer = F.filter("filled.out", lambda d: (d["take"] < d["n"]) & (d["size"] > gap) & (d["size"] - gap < gap))
    ahead = ahead.withColumn("one_more", F.array_min(F.transform(nearer, lambda d: F.struct(d["size"], d["k"]))))
    taken = ahead.withColumn("d", F.explode("filled.out")).select(F.col("source").alias("__source"), F.col("d.k").alias("__k"), (F.col("d.take") + F.col("d.k").eqNullSafe(F.col("one_more.k")).cast("long")).alias("take"))
    out = near.join(taken, F.col("source").eqNullSafe(F.col("__source")) & (F.col("k") == F.col("__k")), "left")
    return out.withColumn("take", F.when(F.col("fits"), F.col("n")).otherwise(F.coalesce("take", F.lit(0))))


def repeated(rows: DataFrame, n: str, i: str, per_task: int = EQUAL) -> DataFrame:
    """Each row ``n`` times, numbered from 1 in ``i``; those of one row are made in tasks of about ``per_task``."""
    parts = rows.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / per_task)))).repartition(F.xxhash64(*rows.columns, "__part"))
    first = F.col("__part") * per_task
    return parts.withColumn(i, F.explode(F.sequence(first + 1, F.least(F.col(n), first + per_task)))).drop("__part")


def apply(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as it is taken. Rows with one id and one text are told
    apart by nothing: one of them stands for all, as often as they are taken together."""
    taken = mix(docs, **kwargs)
    each = cut(taken.groupBy(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_key").alias("__text")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__text": text_key(F.col("doc_id"), F.col("text"))}).join(each, ["__id", "__text"])
    out = keyed.where("__rows = 1").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)
    if each.where("__rows > 1").isEmpty():
        return out
    return out.unionByName(repeated(keyed.where("__rows > 1").dropDuplicates(["__id", "__text"]), "__copies", "__copy").select(docs.columns))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  (('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight, source_size * {MOST} AS cap FROM s),
l AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio,
             ((sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w),
top AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM top) * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM l),
e AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END::BIGINT AS class FROM d),
c AS (SELECT e.source, class, sum(size)::BIGINT AS words, any_value(t.target) AS target, any_value(t.source_size) AS source_size FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source GROUP BY e.source, class),
x AS (SELECT *, (target - (coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {MOST})::DOUBLE)
             / nullif(sum(class * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS factor FROM c),
y AS (SELECT source, arg_max(factor, class) AS factor FROM x WHERE factor * class <= {MOST} GROUP BY source),
z AS (SELECT x.source, x.class, x.words, x.target, x.source_size, least({MOST}::DOUBLE, coalesce(y.factor * x.class, CASE WHEN x.class > 0 THEN {MOST}::DOUBLE ELSE 0 END)) AS c0 FROM x LEFT JOIN y ON x.source IS NOT DISTINCT FROM y.source),
o AS (SELECT *, CASE WHEN abs(c0 - round(c0)) < 1e-9 THEN round(c0) ELSE c0 END AS copies FROM z),
i AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p, target - (sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source))::DOUBLE AS rest FROM o),
r AS (SELECT e.doc_id, e.source, e.size, e.u, i.whole, i.p, i.rest, i.source_size, i.target, CASE WHEN i.p > 0 THEN e.u / (1 - e.u) / (i.p / (1 - i.p)) END AS q FROM e JOIN i ON e.source IS NOT DISTINCT FROM i.source AND e.class = i.class),
g AS (SELECT source, doc_id, size, whole, rest, source_size, target, q / (1 + q) AS place, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS n_to, sum(n * size) OVER w AS run FROM g WHERE place IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)),
f AS (SELECT source, count(*) FILTER (run <= rest) AS k0, coalesce(max(n_to) FILTER (run <= rest), 0) AS n0, any_value(rest) - coalesce(max(run) FILTER (run <= rest), 0)::DOUBLE AS gap FROM k GROUP BY source),
a(source, k, size, n, gap, take) AS (
  SELECT source, k0, NULL::BIGINT, NULL::BIGINT, gap, 0::BIGINT FROM f
  UNION ALL
  SELECT a.source, k.k, k.size, k.n, a.gap - least(k.n, floor(a.gap / k.size)) * k.size, least(k.n, floor(a.gap / k.size))::BIGINT
  FROM a JOIN f ON a.source IS NOT DISTINCT FROM f.source JOIN k ON k.source IS NOT DISTINCT FROM a.source AND k.k = a.k + 1 WHERE k.n_to - k.n < f.n0 + {AHEAD}),
h AS (SELECT source, min(gap) AS gap FROM a GROUP BY source),
m AS (SELECT a.source, a.k FROM a JOIN h ON a.source IS NOT DISTINCT FROM h.source WHERE a.n IS NOT NULL AND a.take < a.n AND a.size > h.gap AND a.size - h.gap < h.gap QUALIFY row_number() OVER (PARTITION BY a.source ORDER BY a.size, a.k) = 1),
u AS (SELECT k.*, CASE WHEN k.k <= f.k0 THEN k.n ELSE coalesce(a.take, 0) + (m.k IS NOT NULL)::BIGINT END AS take FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source
      LEFT JOIN a ON a.source IS NOT DISTINCT FROM k.source AND a.k = k.k AND a.n IS NOT NULL LEFT JOIN m ON m.source IS NOT DISTINCT FROM k.source AND m.k = k.k),
v AS (SELECT doc_id, size, source_size, target, whole, n, take FROM u UNION ALL SELECT doc_id, size, source_size, target, whole, n, 0 FROM g WHERE place IS NULL),
b AS (SELECT *, unnest(range(n)) AS j FROM v)
SELECT doc_id, size, source_size, target, (size * (whole + (j < take)::BIGINT))::BIGINT AS taken FROM b"""
