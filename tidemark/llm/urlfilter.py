"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries (key, day, action: block, allow or drop). An entry is valid from its day until the next
entry of its key; a drop ends it. A capture matches the entries of its host, of every parent domain and of its host with the first
path segment; of those active on its day the most specific decides (longest key), and without any it is allowed.

Captures are first reduced to distinct (host, segment, day), so a host with a third of all captures is joined once per segment and
day; the decisions are joined back by those keys, where skewed joins are split.

Defined results: a null or unparsable url, and a null day, match nothing and are allowed; entries of one key and day: block
wins over allow over drop; repeated captures are decided each; a null key or day in a list is ignored; empty tables are fine; other
columns are carried along, but for those named decision or matched_key, whose place the results take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, split_join, table, unused, without


def host(url):
    """Lower-case host without user, port or trailing dot; null if there is none."""
    name = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.rtrim(name, F.lit(".")), F.lit(""))


def segment(url):
    """The first path segment, with its slash; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) of the list's entries; valid_to is exclusive, null if open."""
    order = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    by_key = Window.partitionBy("key").orderBy("day")
    daily = entries.where("key is not null and day is not null").groupBy("key", "day").agg(F.min_by("action", order).alias("action"))
    spans = daily.select("key", "action", F.col("day").alias("valid_from"), F.lead("day").over(by_key).alias("valid_to"))
    return spans.where("action <> 'drop'")


def filter_urls(captures: DataFrame, entries: DataFrame, *, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """The captures with decision ('block' or 'allow') and matched_key."""
    own = without(captures, "decision", "matched_key")
    names = unused(own, "host", "segment", "at", "match")
    keyed = own.withColumns(dict(zip(names[:3], (host(F.col(url)), segment(F.col(url)), F.col(day)), strict=True)))
    three = ["host", "segment", "at"]
    times = keyed.select(*[F.col(n).alias(a) for n, a in zip(names[:3], three, strict=True)]).where("host is not null and at is not null").groupBy(*three).agg(F.count(F.lit(1)).alias("n"))
    often, distinct = hot_keys(times, three, times.agg(F.sum("n")).first()[0] or 0), times.drop("n")
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = F.array_distinct(F.concat(parents, F.array(F.concat("host", "segment"))))
    asked = distinct.select("host", "segment", "at", F.explode(keys).alias("key"))
    listed = validity(entries)
    # a key that many captures share, such as a top-level domain, is dealt over many tasks if it has entries, and else left out
    counted = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counted, "key", counted.agg(F.sum("n")).first()[0] or 0)
    if hot:
        met = [r[0] for r in listed.where(F.col("key").isin(hot)).select("key").distinct().collect()]
        asked, hot = asked.where(~F.col("key").isin([k for k in hot if k not in met])), met
    active = split_join(asked, listed, "key", hot, F.hash("host", "segment", "at").cast("long")).where("valid_from <= at and (valid_to is null or at < valid_to)")
    decided = active.groupBy("host", "segment", "at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("m"))
    out = split_join(keyed, decided.toDF(*names), names[:3], often, F.monotonically_increasing_id(), "left")
    return out.select(*[F.col(f"`{c}`") for c in own.columns], F.coalesce(F.col(names[3])["action"], F.lit("allow")).alias("decision"), F.col(names[3])["key"].alias("matched_key"))


def dated_list(hosts: DataFrame) -> DataFrame:
    """A dated list over the hosts (host, segment) met: a third of hosts, a fifth of parent domains and a quarter of sections have
    entries, by their digest: one on a day of 2024, a second that lifts or reverses it, for some a third."""
    digits = lambda a, n: F.conv(F.substring(F.md5("key"), a, n), 16, 10).cast("long")
    parent = F.substring_index("_host", ".", -3)
    keys = hosts.select(F.explode(F.array(F.struct(F.col("_host").alias("key"), F.lit(3).alias("one_in")), F.struct(parent.alias("key"), F.lit(5).alias("one_in")), F.struct(F.concat("_host", "_segment").alias("key"), F.lit(4).alias("one_in")))).alias("e")).select("e.*")
    chosen = keys.distinct().where(digits(1, 6) % F.col("one_in") == 0).select("key").distinct()
    first = digits(7, 6) % 300
    entry = lambda offset, action: F.struct(F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int")).alias("day"), action.alias("action"))
    start = entry(first, F.when(digits(13, 2) % 4 == 0, F.lit("allow")).otherwise(F.lit("block")))
    second = entry(first + 20 + digits(15, 4) % 60, F.when(digits(19, 2) % 3 == 0, F.lit("allow")).otherwise(F.lit("drop")))
    third = entry(first + 90 + digits(21, 4) % 60, F.lit("block"))
    return chosen.select("key", F.explode(F.when(digits(25, 2) % 2 == 0, F.array(start, second, third)).otherwise(F.array(start, second))).alias("e")).select("key", "e.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")))
    hosts = pages.select(host(F.col("url")).alias("_host"), segment(F.col("url")).alias("_segment")).where("_host is not null").distinct()
    return filter_urls(captures, dated_list(hosts))


ORACLE = r"""
WITH c AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS fetched_on,
  nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.'), '') AS host,
  coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1), '') AS segment FROM pages),
k0 AS (SELECT host AS key, 3 AS one_in FROM c WHERE host IS NOT NULL UNION SELECT array_to_string(string_split(host, '.')[-3:], '.'), 5 FROM c WHERE host IS NOT NULL
  UNION SELECT host || segment, 4 FROM c WHERE host IS NOT NULL),
k AS (SELECT DISTINCT key, md5(key) AS m FROM k0 WHERE CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) % one_in = 0),
d AS (SELECT key, CAST('0x' || substr(m, 7, 6) AS BIGINT) % 300 AS first, CAST('0x' || substr(m, 13, 2) AS BIGINT) AS a, CAST('0x' || substr(m, 15, 4) AS BIGINT) AS b,
  CAST('0x' || substr(m, 19, 2) AS BIGINT) AS e, CAST('0x' || substr(m, 21, 4) AS BIGINT) AS f, CAST('0x' || substr(m, 25, 2) AS BIGINT) AS g FROM k),
l AS (SELECT key, DATE '2024-01-01' + CAST(first AS INTEGER) AS day, CASE WHEN a % 4 = 0 THEN 'allow' ELSE 'block' END AS action FROM d
  UNION ALL SELECT key, DATE '2024-01-01' + CAST(first + 20 + b % 60 AS INTEGER), CASE WHEN e % 3 = 0 THEN 'allow' ELSE 'drop' END FROM d
  UNION ALL SELECT key, DATE '2024-01-01' + CAST(first + 90 + f % 60 AS INTEGER), 'block' FROM d WHERE g % 2 = 0),
day1 AS (SELECT key, day, arg_min(action, CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS action FROM l GROUP BY key, day),
v AS (SELECT key, action, day AS valid_from, lead(day) OVER (PARTITION BY key ORDER BY day) AS valid_to FROM day1),
u AS (SELECT DISTINCT host, segment, fetched_on FROM c WHERE host IS NOT NULL),
p AS (SELECT host, segment, fetched_on, unnest(list_distinct(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')), [host || segment]))) AS key FROM u),
m AS (SELECT p.*, v.action, row_number() OVER (PARTITION BY host, segment, fetched_on ORDER BY length(p.key) DESC, p.key DESC) AS rn
  FROM p JOIN v ON p.key = v.key AND v.action <> 'drop' AND v.valid_from <= fetched_on AND (v.valid_to IS NULL OR fetched_on < v.valid_to))
SELECT c.page_id, c.url, c.fetched_on, coalesce(m.action, 'allow') AS decision, m.key AS matched_key
FROM c LEFT JOIN m ON c.host = m.host AND c.segment = m.segment AND c.fetched_on = m.fetched_on AND m.rn = 1
"""
