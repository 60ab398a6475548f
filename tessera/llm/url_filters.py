"""URL filters by a temporal list join.

A filter list is a history of dated entries: on a day a key (a domain, or a domain with a path prefix) is put on
or taken off. An entry is valid from its day to that of the key's next one. A capture is looked up under the domains
above its host and the path prefixes of its URL, as deep as the list's keys go, and each (key, day of fetch) that is asked
for is put in order with the key's entries: the last entry up to the day answers. So each capture meets the list as it
stood when it was fetched, not as it stands now, and a key with a long history costs its entries and days, not
their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: key, category, day, on the list from that day or not. A later entry for a key replaces an earlier one.
ENTRIES = [
    ("tionsh.example.net", "spam", "2024-02-01", True),
    ("tionsh.example.net", "spam", "2024-05-15", False),
    ("tionsh.example.net", "malware", "2024-09-01", True),
    ("tionble.example.com", "adult", "2024-03-10", True),
    ("m.tiontion.example.com", "spam", "2024-01-20", True),
    ("m.tiontion.example.com", "spam", "2024-06-30", False),
    ("ththth.example.org/en", "phishing", "2024-04-04", True),
    ("ththon.example.com/fr", "spam", "2024-02-20", True),
    ("ththon.example.com", "parked", "2024-08-08", True),
    ("thther.example.org", "spam", "2024-07-01", True),
    ("thther.example.org", "spam", "2024-07-01", False),
    ("thther.example.org/en", "phishing", "2024-03-03", True),
    ("ththan.example.net", "adult", "2024-12-01", True),
    ("example.invalid", "parked", "2024-01-01", True),
]


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and closing dot; "" if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def keys_of(url: Column, labels: int, segments: int) -> Column:
    """What a URL can be listed under: domains of its host of up to ``labels`` labels, each with up to ``segments`` path segments."""
    names = F.split(host_of(url), r"\.")
    n = F.size(names)
    domains = F.transform(F.sequence(F.greatest(n - (labels - 1), F.lit(1)), n), lambda k: F.array_join(F.slice(names, k, n - k + 1), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(segments))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    return F.array_distinct(F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p)))))


def listed_key(key: Column) -> Column:
    """A list's key as ``keys_of`` writes it: without scheme, user, port and closing dot; the domain in lower case, no empty segments."""
    rest = F.regexp_replace(F.trim(key), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = host_of(F.concat(F.lit("x://"), rest))
    parts = F.filter(F.split(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    return F.array_join(F.concat(F.array(host), parts), "/")


def history(entries: DataFrame) -> DataFrame:
    """(key, day, listed, category) from ``entries(key, category, day, listed)``, one row for each key and day. Of entries for one key
    on one day the one that takes it off holds, then the last category. Entries without key or day are left out."""
    e = entries.select(listed_key(F.col("key")).alias("key"), F.col("day").cast("date").alias("day"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("listed", F.lit(True)).alias("listed"))
    e = e.where((F.col("key") != "") & F.col("day").isNotNull())
    e = e.groupBy("key", "day").agg(F.max_by(F.struct("category", "listed"), F.struct((~F.col("listed")).cast("int"), "category")).alias("x"))
    return e.select("key", "day", "x.listed", "x.category")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to): while each key is on the list, valid_to being the first day that it no longer holds
    (null: it still does)."""
    e = history(entries).withColumn("valid_to", F.lead("day").over(Window.partitionBy("key").orderBy("day")))
    return e.where("listed").select("key", "category", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """For each row of ``captures``: page_id, host, fetched_on, n_active (entries that held when it was fetched),
    blocked, matched_key (the longest such key, then the first; else null), category (its one).

    Captures meet the list by (key, day) pairs that are made distinct first, so a key with very many captures is asked for once a
    day, and its task has as many rows as it has days and entries. A null URL or one without host is listed under nothing; a null day
    matches nothing; both stay, unblocked. Repeated rows give repeated rows. Other columns are ignored; empty tables give
    empty results, an empty list blocks nothing."""
    e = cut(history(entries))
    depth = F.size(F.split("key", "/"))
    labels, segments = e.agg(F.max(F.size(F.split(F.split("key", "/")[0], r"\."))), F.max(depth) - 1).first()
    rows = captures.select(captures[id_col].alias("page_id"), F.coalesce(captures[url_col], F.lit("")).alias("url"), captures[day_col].cast("date").alias("fetched_on"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "keys": keys_of(F.col("url"), labels or 1, segments or 0)})
    asked = rows.where("host <> '' AND fetched_on IS NOT NULL").select("keys", "fetched_on").distinct()
    k = asked.select("keys", "fetched_on", F.explode("keys").alias("key")).join(e.select("key").distinct(), "key", "left_semi")
    days = k.select("key", F.col("fetched_on").alias("day"), F.lit(None).cast("struct<listed: boolean, category: string>").alias("x"), F.lit(1).alias("asked")).distinct()
    line = days.unionByName(e.select("key", "day", F.struct("listed", "category").alias("x"), F.lit(0).alias("asked")))
    as_of = line.withColumn("x", F.last("x", ignorenulls=True).over(Window.partitionBy("key").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)))
    held = as_of.where("asked = 1 AND x.listed").select("key", F.col("day").alias("fetched_on"), "x.category")
    best = k.join(held, ["key", "fetched_on"]).groupBy("keys", "fetched_on").agg(F.count("*").alias("n"), F.min(F.struct((-F.length("key")).alias("long"), "key", "category")).alias("x"))
    out = rows.join(best, ["keys", "fetched_on"], "left")
    return out.select("page_id", "host", "fetched_on", F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.col("n").isNotNull().alias("blocked"), F.col("x.key").alias("matched_key"), F.col("x.category").alias("category"))


def fetched_on(page_id: Column) -> Column:
    """The table has no day of fetch; the query takes the page's number as a day of 2024."""
    return F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(366)).cast("int"))


def entries_sql() -> str:
    return ", ".join(f"('{k}', '{c}', DATE '{d}', {str(on).lower()})" for k, c, d, on in ENTRIES)


#: An as-of join for each key, in place of intervals.
ORACLE = rf"""
WITH e(key, category, day, listed) AS (VALUES {entries_sql()}),
l AS (SELECT key, day, arg_max(category, (CASE WHEN listed THEN 0 ELSE 1 END, category)) AS category, bool_and(listed) AS listed FROM e GROUP BY key, day),
p AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, (DATE '2024-01-01' + (coalesce(page_id, 0) % 366)::INT)::DATE AS fetched_on FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '') AS host,
        list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM p),
d AS (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h WHERE host <> ''),
j AS (SELECT *, unnest(range(0, len(parts) + 1)) AS n FROM d),
k AS (SELECT DISTINCT r, fetched_on, array_to_string(string_split(host, '.')[i:], '.') || CASE WHEN n = 0 THEN '' ELSE '/' || array_to_string(parts[1:n], '/') END AS key FROM j),
a AS (SELECT k.r, k.key, l.category, l.listed FROM k ASOF JOIN l ON k.key = l.key AND k.fetched_on >= l.day),
b AS (SELECT r, count(*) AS n, arg_min(key, (-length(key), key)) AS matched_key, arg_min(category, (-length(key), key)) AS category FROM a WHERE listed GROUP BY r)
SELECT page_id, host, fetched_on::VARCHAR AS fetched_on, coalesce(n, 0)::BIGINT AS n_active, n IS NOT NULL AS blocked, matched_key, category FROM h LEFT JOIN b USING (r)"""
