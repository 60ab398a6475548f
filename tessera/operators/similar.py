"""A similarity join of names that loses no match: names meet by an index of bigrams, or by length where they share none.

``match_quality`` is above 0 only for equal names or a compound score over LEAST, with or without prefixes; each way is a form. Two forms that
share a bigram meet under the first one that they share. Without one, the bigram part is 0, at most a first letter is equal, and a longer string
holds no shorter one of two letters or more; so only lengths within RATIO of each other can reach LEAST, and the letters that they share must
reach what the two lengths need. After the meeting a bound from lengths, shared letters and shared bigrams is left, whole-number work on columns that are made
once a name. The score itself, which needs Python, sees what passes.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import strip_prefix
from ..functions.similarity import BIGRAM, CONTAINED, JARO_WINKLER, LEAST, LEVENSHTEIN, grams, match_quality

#: Asked names, or names that they are compared with, that are sent to all executors; more are dealt by the join's key.
MOST_ASKED = 10_000
#: What is sent may take so many bytes, as all of it passes through the driver: a name may be a whole question, and its rows grow with the square of its length.
MOST_BYTES = 32 << 20
#: How many times longer one of two forms without a shared bigram can be. All of the shorter one's letters shared, their score is at most
#: JARO_WINKLER * (0.9 * (2 + x) / 3 + 0.1) + LEVENSHTEIN * x at the ratio 1 / x; a single letter can be contained besides.
RATIO = (0.3 * JARO_WINKLER + LEVENSHTEIN + CONTAINED) / (LEAST - 1e-9 - 0.7 * JARO_WINKLER)


def _letters(s: Column) -> Column:
    """A bit for each letter, of 64: forms that share letters share bits."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(F.substring(s, i, F.lit(1))) % 64).cast("int"))
    return F.when(F.length(s) > 0, F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(i)))).otherwise(F.lit(0).cast("long"))


def forms(names: DataFrame, name: str) -> DataFrame:
    """Two rows for each name: form (0: as it is, 1: without its prefix), and of that form, in lower case, first (letter), n (length), letters, spare (letters
    beyond one for each bit), grams and n_grams."""
    both = F.array(F.lower(name), F.lower(strip_prefix(F.col(name))))
    out = names.select("*", F.posexplode(both).alias("form", "s")).withColumns(_signature()).drop("s")
    return out.withColumns({"spare": F.expr("n - bit_count(letters)"), "n_grams": F.size("grams")})


@cache
def _signature() -> dict[str, Column]:
    return {"first": F.substring("s", 1, 1), "n": F.length("s"), "letters": _letters(F.col("s")), "grams": F.array_sort(grams(F.col("s")))}


@cache
def _meetings() -> tuple[Column, Column, Column, Column]:
    """Which pairs of q and c can reach LEAST; expressions made once: those that met under a bigram and share no earlier one; those of any bigrams; those that
    share one, by numbers alone; those of like length. Equal forms share a bigram, but for those of one letter or none."""
    common, over, letters = F.array_intersect("q.grams", "c.grams"), LEAST - 1e-9, _shared_letters("q", "c")
    near = _bound(letters, F.size(common), 0.4, "q", "c") > over
    might = _bound(letters, F.least("q.n_grams", "c.n_grams"), 0.4, "q", "c") > over
    same = (F.col("q.n") <= 1) & (F.col("q.n") == F.col("c.n")) & (F.col("q.first") == F.col("c.first"))
    low, high = _lengths("q.n")
    like = F.col("c.n").between(low, high)
    return (F.element_at(common, 1) == F.col("q.gram")) & near, (F.size(common) > 0) & near, might, like & (same | (_bound(letters, F.lit(0), 0.1, "q", "c") > over))


def _lengths(n: str) -> tuple[Column, Column]:
    """The least and the greatest length within RATIO of a form's own."""
    return F.least(F.ceil(F.col(n) / RATIO).cast("int"), n), F.greatest(F.floor(F.col(n) * RATIO).cast("int"), n)


def _digits(n: Column) -> Column:
    """How many binary digits a length has."""
    return F.length(F.bin(n))


def sendable(formed: DataFrame, most: int) -> tuple[bool, int, int]:
    """Whether ``forms`` of up to ``most`` names take up to MOST_BYTES where they are sent, with a row for each bigram that holds them all; and the least and
    greatest length of a form. One aggregate."""
    g, n = F.col("n_grams").cast("long"), F.col("n").cast("long")
    rows, taken, low, high = formed.agg(F.count("*"), F.sum(g * (100 + 24 * g + 2 * n) + 7 * (100 + 2 * n)), F.min("n"), F.max("n")).first()
    return rows <= 2 * most and (taken or 0) <= MOST_BYTES, low or 0, high or 0


@cache
def _quality() -> Column:
    return match_quality(F.col("name"), F.col("entity_name"))


def _shared_letters(a: str, b: str) -> Column:
    """No fewer letters, copies counted, than the two forms share: one for each common bit, and those beyond one a bit."""
    both = F.bit_count(F.col(f"{a}.letters").bitwiseAND(F.col(f"{b}.letters"))) + F.least(f"{a}.spare", f"{b}.spare")
    return F.least(both, F.col(f"{a}.n"), F.col(f"{b}.n"))


def _bound(m: Column, shared: Column, prefix: float, a: str, b: str) -> Column:
    """No less than the compound score of forms with at most ``m`` letters and ``shared`` bigrams in common, of which the prefix bonus is at most ``prefix``."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    jaro = F.when(m > 0, (m / x + m / y + 1.0) / 3.0).otherwise(F.lit(0.0))
    first = F.col(f"{a}.first") == F.col(f"{b}.first")
    jaro = F.when(first & (m > 0), jaro + prefix * (1.0 - jaro)).otherwise(jaro)
    both = F.col(f"{a}.n_grams") + F.col(f"{b}.n_grams")
    dice = F.when(both > 0, 2.0 * shared / both).otherwise(F.lit(0.0))
    inside = F.when((m >= x) & ((shared > 0) | (x <= 1)), CONTAINED * x / F.greatest(y, F.lit(1))).otherwise(F.lit(0.0))
    return jaro * JARO_WINKLER + F.when(m > 0, m / F.greatest(x, y)).otherwise(F.lit(0.0)) * LEVENSHTEIN + dice * BIGRAM + inside


def _key(*names: str) -> Column:
    out = F.lit(True)
    for k in names:
        out &= F.col(f"q.{k}").eqNullSafe(F.col(f"c.{k}"))
    return out


def _by_gram(formed: DataFrame) -> DataFrame:
    return formed.withColumn("gram", F.explode("grams"))


def _sent(q: DataFrame, c: DataFrame, by: list[str], send_c: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of forms that share a bigram, and of those of like length, one side broadcast."""
    here, there = (F.broadcast, lambda df: df) if send_c else (lambda df: df, F.broadcast)
    met_first, _, _, can_be_apart = _meetings()
    near = here(_by_gram(c)).alias("c").join(there(_by_gram(q)).alias("q"), _key(*by, "form", "gram")).where(met_first)
    low, high = _lengths("n")
    wide = q.drop("grams").withColumn("digits", F.explode(F.sequence(_digits(low), _digits(high))))
    apart = here(c.drop("grams").withColumn("digits", _digits(F.col("n")))).alias("c").join(there(wide).alias("q"), _key(*by, "form", "digits"))
    return near, apart.where(can_be_apart)


def _dealt(q: DataFrame, c: DataFrame, by: list[str], least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The same with both sides dealt. What meets under a bigram holds numbers alone, and a number for the form, by which its pairs get the rest after that; two
    forms with the same number are compared in vain. Spark takes no account of how many rows an explode makes, so it is told not to broadcast them.
    least, most: lengths of the forms in c; a form in q has a row for each that is near its own."""
    merge = lambda df: df.hint("merge")
    _, can_meet, might_meet, can_be_apart = _meetings()
    q, c = q.withColumn("id", F.xxhash64("name", *by, "form")), c.withColumn("id", F.xxhash64("entity_name", *by, "form"))
    met = _by_gram(c.drop("entity_name")).drop("grams").alias("c").join(merge(_by_gram(q.drop("name")).drop("grams")).alias("q"), _key(*by, "form", "gram")).where(might_meet)
    met = met.select(F.col("q.id").alias("q_id"), F.col("c.id").alias("c_id")).distinct()
    near = merge(met).join(c.alias("c"), F.col("c.id") == F.col("c_id")).join(merge(q).alias("q"), F.col("q.id") == F.col("q_id")).where(_key(*by, "form") & can_meet)
    low, high = _lengths("n")
    wide = q.drop("grams").where((high >= least) & (low <= most)).withColumn("length", F.explode(F.sequence(F.greatest(low, F.lit(least)), F.least(high, F.lit(most)))))
    apart = c.drop("grams").withColumn("length", F.col("n")).alias("c").join(merge(wide).alias("q"), _key(*by, "form", "length"))
    return near, apart.where(can_be_apart)


def candidates(asked: DataFrame, names: DataFrame, by: list[str], most_asked: int | None = MOST_ASKED) -> DataFrame:
    """Distinct pairs of ``asked(name, *by)`` and ``names(entity_name, *by)``, equal in ``by``, among which are all that match. Asked names are broadcast if they
    are few and take few bytes, which one aggregate tells (None: the caller knows it), so that names stream past them; else the names are, if that holds
    for them; else both are dealt. ``names`` may have their ``forms`` already."""
    q = forms(asked.select("name", *by).distinct(), "name")
    c = names if "grams" in names.columns else forms(names.select("entity_name", *by).distinct(), "entity_name")
    if most_asked is None or sendable(q, most_asked)[0]:
        near, apart = _sent(q, c, by, send_c=False)
    else:
        few, least, most = sendable(c, most_asked)
        near, apart = _sent(q, c, by, send_c=True) if few else _dealt(q, c, by, least, most)
    pair = ["q.name", "c.entity_name", *(f"c.{k}" for k in by)]
    # those apart share no bigram: what has one is met by it, and passes here no sooner
    return near.select(*pair).union(apart.select(*pair)).distinct()


def similar(asked: DataFrame, names: DataFrame, by: list[str], most_asked: int | None = MOST_ASKED) -> DataFrame:
    """(name, entity_name, *by, match_quality) of all pairs with a ``match_quality`` above 0. Nulls match nothing; repeated names are one."""
    asked, names = asked.where("name IS NOT NULL"), names.where("entity_name IS NOT NULL")
    found = candidates(asked, names, by, most_asked)
    return found.withColumn("match_quality", _quality()).where("match_quality > 0")
