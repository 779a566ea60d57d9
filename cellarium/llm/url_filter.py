r"""URL filters by a temporal list join (operator 10).

List entries are dated: from `since` on, a pattern (a host, which covers its subdomains, or a host with a path: the page itself and, in
whole segments, all below it; with a final slash only what is below it) is `block`, `allow` or `off`. Sorted by date, the entries of a list and
pattern become validity intervals, open at the end. A capture is looked up under every pattern that can cover it (its host and parent domains, and
each of these with each prefix of its path, as deep as any listed path): an equi-join on the pattern, in which the interval must hold
the capture's time. Of the entries active then, the most specific decides (longest path, then longest host; of equals, allow before
block, then the list's name).

Captures take part as distinct (url, time), and only with those of their patterns that are listed at all: distinct asked patterns, which partial
aggregation makes few even for a host with a third of all captures, are matched with the lists first. Listed patterns and intervals are
broadcast if a count shows that they are few; otherwise joins are shuffles of written tables, which adaptive execution splits.

Edge cases. A null, empty or hostless url matches nothing and has verdict none; so has a null time. Hosts, of patterns too, are compared in lower
case without port, user and a final dot; paths as they are. Entries with a null date or a pattern without a host (`bad_patterns` lists them) are passed over;
of two entries of one list, pattern and date the later action in code point order holds. Repeated captures each get their row. Very long urls are
read whole. Columns of the captures named verdict, pattern or list give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.regexp_replace(rest, r"\.$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(url: Column, depth: int) -> Column:
    """All patterns of up to depth path segments that cover a url: host suffixes, alone and with the path's prefixes, with and without a final slash."""
    labels, parts = F.split(host_of(url), r"\."), F.split(path_of(url), "/")
    none = F.array().cast("array<string>")
    hosts = F.when(host_of(url) != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(none)
    # "/a/b" has the parts "", "a" and "b": i of them make a prefix of i - 1 segments
    steps = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth + 1)))
    each = F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = F.transform(F.filter(steps, lambda i: i < F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    paths = F.when(path_of(url) != "", F.filter(F.array_distinct(F.concat(each, below)), lambda p: p != "")).otherwise(none)
    return F.flatten(F.transform(hosts, lambda h: F.concat(F.array(h), F.transform(paths, lambda p: F.concat(h, p)))))


def normal_pattern(pattern: Column) -> Column:
    """Host in lower case without a final dot, path as it is; null if there is no host."""
    host = F.lower(F.regexp_extract(pattern, r"^([^/:?#@\s]+?)\.?(?:/|$)", 1))
    return F.when(host != "", F.concat(host, F.regexp_extract(pattern, r"^[^/]*(/.*)?$", 1)))


def bad_patterns(entries: DataFrame) -> DataFrame:
    """Entries that can match nothing: without a date, or whose pattern has no host (schemes, ports and users are no part of patterns)."""
    return entries.filter(F.col("since").isNull() | normal_pattern(F.col("pattern")).isNull())


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, pattern, since, action) as list, pattern, action, since, until (null: still)."""
    clean = entries.withColumn("pattern", normal_pattern(F.col("pattern"))).filter("pattern is not null and since is not null").groupBy("list", "pattern", "since").agg(F.max("action").alias("action"))
    by = Window.partitionBy("list", "pattern").orderBy("since")
    return clean.withColumn("until", F.lead("since").over(by)).filter("action in ('block', 'allow')")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """captures with verdict (block, allow, none), pattern and list of the entry that decides."""
    spark = captures.sparkSession
    listed = materialise(intervals(entries), "intervals")
    # no deeper than the deepest listed path
    depth = listed.agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"))))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = captures.select(F.col(url_col).alias("__url"), F.col(time_col).alias("__time")).filter("__url is not null and __time is not null")
    asked = materialise(asked.repartition(tasks, "__url", "__time").distinct(), "asked")
    each = asked.select("__url", "__time", F.explode(patterns_of(F.col("__url"), depth)).alias("pattern"))
    known = each.select("pattern").distinct().join(listed.select("pattern").distinct(), "pattern", "left_semi")
    known = materialise(listed.join(known, "pattern", "left_semi"), "known")
    active = each.join(small(known), "pattern").filter((F.col("since") <= F.col("__time")) & (F.col("until").isNull() | (F.col("__time") < F.col("until"))))
    slash = F.instr("pattern", "/")
    rank = F.struct(F.when(slash > 0, F.length("pattern") - slash).otherwise(-1).alias("path"), F.length("pattern").alias("host"), (F.col("action") == "allow").alias("allow"), F.col("list"), F.col("pattern"), F.col("action"))
    best = active.groupBy("__url", "__time").agg(F.max(rank).alias("__best"))
    met = captures.join(best, (captures[f"`{url_col}`"] == best["__url"]) & (captures[f"`{time_col}`"] == best["__time"]), "left")
    new = {"verdict": F.coalesce(F.col("__best.action"), F.lit("none")), "pattern": F.col("__best.pattern"), "list": F.col("__best.list")}
    return met.select(*[F.col(f"`{c}`") for c in captures.columns if c.lower() not in new], *[c.alias(n) for n, c in new.items()])


#: The tables have neither fetch times nor lists, so the query makes both by rule from hashes of ids and urls. DAYS: of the first half of 2024.
DAYS = 180


def _digit(col: str, n: int) -> Column:
    """A number below n from a hash that DuckDB has too."""
    return F.conv(F.substring(F.md5(col), 1, 7), 16, 10).cast("long") % n


def made_captures(pages: DataFrame) -> DataFrame:
    day = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 7), 16, 10).cast("long") % DAYS
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("fetched"))


def made_entries(pages: DataFrame) -> DataFrame:
    """For a third of the hosts: blocked from some day, off or allowed later. For a quarter of the hosts' first path folders: allowed from some day."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct()
    folders = pages.select(F.concat(host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), "^(/[^/]*/)", 1)).alias("pattern")).filter("pattern like '%/'").distinct()
    start = F.lit("2024-01-01").cast("date")
    first = hosts.filter(_digit("pattern", 3) == 0)
    day = _digit("pattern", 100).cast("int")
    blocked = first.select(F.lit("hosts").alias("list"), "pattern", F.date_add(start, day).alias("since"), F.lit("block").alias("action"))
    later = first.select(F.lit("hosts").alias("list"), "pattern", F.date_add(start, day + 40).alias("since"), F.when(_digit("pattern", 2) == 0, "off").otherwise("allow").alias("action"))
    inside = folders.filter(_digit("pattern", 4) == 0).select(F.lit("folders").alias("list"), "pattern", F.date_add(start, day).alias("since"), F.lit("allow").alias("action"))
    return blocked.unionByName(later).unionByName(inside)


def op10(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(made_captures(pages), made_entries(pages)).select("page_id", "url", "fetched", "verdict", "pattern", "list")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7) AS BIGINT) % 180 AS INTEGER) AS fetched,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
h AS (SELECT DISTINCT host AS pattern FROM p WHERE host <> ''),
f AS (SELECT DISTINCT host || regexp_extract(path, '^(/[^/]*/)', 1) AS pattern FROM p WHERE host || regexp_extract(path, '^(/[^/]*/)', 1) LIKE '%/'),
n AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS d FROM (SELECT pattern FROM h UNION ALL SELECT pattern FROM f)),
e AS (
  SELECT 'hosts' AS list, pattern, DATE '2024-01-01' + CAST(d % 100 AS INTEGER) AS since, 'block' AS action FROM n WHERE d % 3 = 0 AND pattern NOT LIKE '%/'
  UNION ALL
  SELECT 'hosts', pattern, DATE '2024-01-01' + CAST(d % 100 + 40 AS INTEGER), CASE WHEN d % 2 = 0 THEN 'off' ELSE 'allow' END FROM n WHERE d % 3 = 0 AND pattern NOT LIKE '%/'
  UNION ALL
  SELECT 'folders', pattern, DATE '2024-01-01' + CAST(d % 100 AS INTEGER), 'allow' FROM n WHERE d % 4 = 0 AND pattern LIKE '%/'),
v AS (SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS until FROM e),
m AS (
  SELECT p.page_id, p.url, v.action, v.pattern, v.list,
         row_number() OVER (PARTITION BY p.page_id ORDER BY CASE WHEN v.pattern LIKE '%/%' THEN length(v.pattern) - instr(v.pattern, '/') ELSE -1 END DESC, length(v.pattern) DESC, v.action = 'allow' DESC, v.list DESC) AS r
  FROM p JOIN v ON (p.host = v.pattern OR p.host LIKE '%.' || v.pattern OR v.pattern LIKE '%/' AND starts_with(p.host || p.path, v.pattern) OR v.pattern LIKE '%/' AND contains('.' || p.host || p.path, '.' || v.pattern) AND split_part(v.pattern, '/', 1) <> '' AND p.host LIKE '%.' || split_part(v.pattern, '/', 1) AND starts_with(p.path, substr(v.pattern, instr(v.pattern, '/'))))
  WHERE v.action <> 'off' AND v.since <= p.fetched AND (v.until IS NULL OR p.fetched < v.until))
SELECT p.page_id, p.url, p.fetched, coalesce(m.action, 'none') AS verdict, m.pattern, m.list
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1
"""
