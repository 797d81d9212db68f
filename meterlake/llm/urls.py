"""URL filters by a temporal list join.

A list is a log of dated entries: on a day a pattern is added to or removed
from a list.  Patterns are a domain with its subdomains, one host, or a host
with leading path segments.  Each pattern's entries become validity intervals
[from, to), and an as-of join evaluates every capture against the intervals
that hold at its fetch time.

Plan, all in DataFrame functions.  Intervals are gathered into one row a
pattern, so a join by pattern makes no more rows than it is given, however long
the pattern's history.  A capture's patterns are its host's domains and its
leading paths, as deep as the list has any.  Captures are first counted by URL
and time, so that repeated ones are joined once.  The list is broadcast only if
its intervals are at most ``BROADCAST_INTERVALS``; else Spark joins by shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_INTERVALS = 100_000

#: Patterns of well-known kinds of unwanted hosts in the test tables, with the days of their entries.
DOMAIN_ENTRIES = [
    ("gambling", "domain", "casino-win.example.com", "2023-06-01", "add"),
    ("gambling", "domain", "free-bets.example.com", "2024-02-15", "add"),
    ("gambling", "domain", "free-bets.example.com", "2024-09-01", "remove"),
    ("adult", "domain", "adult-x.example.net", "2024-01-20", "add"),
    ("pharmacy", "domain", "cheap-pills.example.com", "2024-03-10", "add"),
    ("pharmacy", "domain", "cheap-pills.example.com", "2024-05-10", "remove"),
    ("pharmacy", "domain", "cheap-pills.example.com", "2024-08-10", "add"),
    ("tracking", "domain", "ads-track.example.com", "2023-01-01", "add"),
    ("tracking", "host", "m.ads-track.example.com", "2024-07-01", "remove"),
    ("allowed", "prefix", "www.cheap-pills.example.com/de", "2024-04-01", "add"),
    ("suspended", "domain", "example.org", "2024-10-01", "add"),
    ("suspended", "domain", "example.org", "2024-10-15", "remove"),
]
ENTRY = "list string, kind string, pattern string, day string, action string"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and a last dot; empty if there is none."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.\-]*:", "")
    rest = F.when(rest.startswith("//"), F.substring_index(F.regexp_replace(F.substr(rest, F.lit(3)), r"[/?#\\].*$", ""), "@", -1)).otherwise(F.lit(""))
    return F.regexp_replace(F.regexp_replace(rest, r":[0-9]*$", ""), r"\.$", "")


def path_of(url: Column) -> Column:
    """The path of a URL without query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/\\]*", "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of ``list, kind, pattern, day, action`` entries, gathered by pattern key.

    Entries with a null part, an unknown kind or action, or no date are left
    out.  Of several entries for one pattern and day in a list, a removal counts.
    An addition to what is on the list already, or a removal of what isn't,
    changes nothing.
    """
    day = F.try_to_date("day")
    known = F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("kind").isin("domain", "host", "prefix") & F.col("action").isin("add", "remove") & day.isNotNull()
    rows = entries.where(known).select("list", F.concat_ws(":", "kind", F.lower("pattern")).alias("key"), day.alias("day"), "action")
    rows = rows.groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    # one row a list and key: its days in order; an interval runs from an addition to the next entry
    days = rows.groupBy("list", "key").agg(F.array_sort(F.collect_list(F.struct("day", "action"))).alias("log"))
    spans = F.transform(F.col("log"), lambda e, i: F.struct(e["day"].alias("since"), F.try_element_at("log", i + 2)["day"].alias("until"), e["action"].alias("action")))
    days = days.select("list", "key", F.explode(F.filter(spans, lambda s: s["action"] == "add")).alias("s"))
    return days.groupBy("key").agg(F.collect_list(F.struct("list", "s.since", "s.until")).alias("spans"))


def _keys(host: Column, path: Column, labels: int, segments: int) -> Column:
    """Pattern keys that a capture may meet."""
    parts = F.split(host, r"\.")
    domain = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.concat(F.lit("domain:"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")))
    steps = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    prefix = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(segments))), lambda n: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")))
    none = F.array().cast("array<string>")
    return F.concat(F.when(F.lit(labels > 0), domain).otherwise(none), F.array(F.concat(F.lit("host:"), host)), F.when((F.size(steps) > 0) & F.lit(segments > 0), prefix).otherwise(none))


def evaluated(captures: DataFrame, entries: DataFrame, allowed: tuple[str, ...] = ("allowed",)) -> DataFrame:
    """Every capture with the lists that it is on at its fetch time.

    Inputs ``page_id, url, fetched_on`` (a date) and the list's entries, see
    :func:`intervals`; other columns are ignored.  Output, one row per input row:
    ``page_id, url, fetched_on, host, lists`` (names in order, joined by
    commas), ``n_lists, blocked``; blocked is on a list and on no
    allowing one.  Captures with a null or host-less URL, or no time, are on no list.
    Repeated captures each have a row; an empty table gives none, and without entries nothing is listed.
    """
    spans = intervals(entries)
    size = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0)), *(F.coalesce(F.max(F.when(F.col("key").startswith(k), F.size(F.split("key", by)))), F.lit(d)) for k, by, d in (("domain:", r"\.", 0), ("prefix:", "/", 1)))).first()
    spans = F.broadcast(spans) if size[0] <= BROADCAST_INTERVALS and size[1] <= BROADCAST_INTERVALS else spans
    counted = captures.select("page_id", "url", F.col("fetched_on").cast("date").alias("fetched_on")).groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("copies"))
    counted = counted.withColumn("host", host_of(F.col("url")))
    keyed = counted.withColumn("key", F.explode(F.when(F.col("host") != "", _keys(F.col("host"), path_of(F.col("url")), size[2], size[3] - 1)).otherwise(F.array(F.lit("")))))
    active = F.filter(F.coalesce("spans", F.array().cast("array<struct<list:string,since:date,until:date>>")), lambda s: (s["since"] <= F.col("fetched_on")) & F.coalesce(F.col("fetched_on") < s["until"], F.lit(True)))
    met = keyed.join(spans, "key", "left").withColumn("on", F.transform(active, lambda s: s["list"]))
    found = met.groupBy("page_id", "url", "fetched_on", "host", "copies").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("on")))).alias("on"))
    allows = F.exists("on", lambda x: x.isin(*allowed)) if allowed else F.lit(False)
    return found.select("page_id", "url", "fetched_on", "host", F.array_join("on", ",").alias("lists"), F.size("on").alias("n_lists"), ((F.size("on") > 0) & ~allows).alias("blocked"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def reported_hosts(pages: DataFrame) -> DataFrame:
    """A dated list made from the captures: every third host is reported some weeks after its first capture, and half of those are cleared later."""
    first = pages.select(host_of(F.col("url")).alias("pattern"), F.col("page_id").cast("long").alias("page_id")).where("pattern <> ''").groupBy("pattern").agg(F.min("page_id").alias("f"))
    start = F.lit("2024-01-01").cast("date")
    day = lambda n: F.date_add(start, n.cast("int")).cast("string")
    log = lambda n, action, every: F.struct(day(n).alias("day"), F.lit(action).alias("action"), F.lit(every).alias("every"))
    f = F.col("f")
    logs = F.array(log(F.pmod(f, F.lit(90)), "add", 3), log(90 + F.pmod(f, F.lit(200)), "remove", 6), log(300 + F.pmod(f, F.lit(50)), "add", 12))
    rows = first.select("pattern", "f", F.explode(logs).alias("e")).where(F.pmod(F.col("f"), F.col("e.every")) == 0)
    return rows.select(F.lit("reported").alias("list"), F.lit("host").alias("kind"), "pattern", "e.day", "e.action")


def fixed_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAIN_ENTRIES, ENTRY)


_FIXED = ", ".join(str(e) for e in DOMAIN_ENTRIES)
ORACLE = rf"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
         regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '') AS host,
         lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*', '')) AS path
  FROM pages
), hosts AS (
  SELECT host AS pattern, min(page_id) AS f FROM captures GROUP BY host
), entries AS (
  SELECT * FROM (VALUES {_FIXED}) v(list, kind, pattern, day, action)
  UNION ALL SELECT 'reported', 'host', pattern, CAST(DATE '2024-01-01' + CAST(f % 90 AS INTEGER) AS VARCHAR), 'add' FROM hosts WHERE f % 3 = 0
  UNION ALL SELECT 'reported', 'host', pattern, CAST(DATE '2024-01-01' + CAST(90 + f % 200 AS INTEGER) AS VARCHAR), 'remove' FROM hosts WHERE f % 6 = 0
  UNION ALL SELECT 'reported', 'host', pattern, CAST(DATE '2024-01-01' + CAST(300 + f % 50 AS INTEGER) AS VARCHAR), 'add' FROM hosts WHERE f % 12 = 0
), daily AS (
  SELECT list, kind, pattern, CAST(day AS DATE) AS day, max(action) AS action FROM entries GROUP BY ALL
), spans AS (
  SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM daily
), met AS (
  SELECT DISTINCT c.page_id, s.list FROM captures c JOIN spans s
    ON s.action = 'add' AND s.day <= c.fetched_on AND (s.until IS NULL OR c.fetched_on < s.until)
   AND CASE s.kind WHEN 'host' THEN c.host = s.pattern
                   WHEN 'domain' THEN c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)
                   ELSE starts_with(c.host || c.path || '/', s.pattern || '/') END
), lists AS (
  SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, count(*) AS n_lists, bool_or(list = 'allowed') AS allowed FROM met GROUP BY page_id
)
SELECT page_id, url, fetched_on, host, coalesce(lists, '') AS lists, CAST(coalesce(n_lists, 0) AS INTEGER) AS n_lists,
       coalesce(n_lists, 0) > 0 AND NOT coalesce(allowed, FALSE) AS blocked
FROM captures LEFT JOIN lists USING (page_id)
"""
