"""URL filters with dated lists.

List entries carry dates: an entry is added, removed and perhaps added again. Its history becomes
validity intervals, and every capture is matched, by an as-of join, against the entries that were
active when it was fetched. A capture's URL matches an entry through its keys: its host and every
domain above it, and its host with each leading part of the path, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host_of(url):
    return F.lower(F.regexp_extract(url, HOST, 1))


def url_keys(url, depths):
    """The keys of a URL: "d:" and a domain suffix, "p:" and host with path prefix; none of a null or other text.

    `depths` is what `depths_of` returns: only keys with as many labels or parts as some entry has are made,
    since a URL of many parts would have as many keys, each nearly as long as it.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = F.transform(F.filter(depths["labels"], lambda k: k <= n), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    prefix = F.transform(F.filter(depths["parts"], lambda k: k <= F.size(parts)), lambda k: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.when(host != "", F.concat(suffix, prefix)).otherwise(F.array().cast("array<string>"))


def depths_of(entries: DataFrame) -> DataFrame:
    """One row, depths: the numbers of labels of the entries' domains and of parts of their paths, each once."""
    kind, name = F.substring("key", 1, 2), F.expr("substring(key, 3)")
    labels = F.when(kind == "d:", F.size(F.split(name, r"\.")))
    parts = F.when(kind == "p:", F.nullif(F.size(F.split(name, "/")) - 1, F.lit(0)))
    return entries.select(F.collect_set(labels).alias("labels"), F.collect_set(parts).alias("parts")).select(F.struct("labels", "parts").alias("depths"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, valid_from, valid_to) from dated rows (key, list, action, at): action "add" or "remove".

    An entry is active from an add, inclusive, to the next row of its key and list, exclusive; without one
    it stays active (valid_to null). Of rows of one date a remove counts after an add. Rows with a null key, list or date are void.
    """
    w = Window.partitionBy("key", "list").orderBy("at", "action")
    dated = entries.where("key is not null and list is not null and at is not null").select("key", "list", "action", "at").distinct()
    return dated.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add' and (valid_to is null or valid_to > at)").select("key", "list", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, at_col: str) -> DataFrame:
    """One row a capture: id, url, at, n_matches (active entries), lists (their lists, sorted), blocked.

    Captures are narrowed to their keys before the join with the intervals; keys that no entry has
    end there, whichever side Spark broadcasts or shuffles, and hot keys are ones that a skew join
    splits. A null or unparsable url, or a null fetch time, matches nothing; repeated captures count
    apart only if their ids differ, and repeated rows come back once each; empty lists block nothing.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("at"))
    probes = rows.distinct().crossJoin(F.broadcast(depths_of(entries))).select("id", "url", "at", F.explode(url_keys(F.col("url"), F.col("depths"))).alias("key"))
    live = intervals(entries)
    met = probes.join(live, "key").where((F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    found = met.groupBy(F.col("id").alias("__id"), F.col("url").alias("__url"), F.col("at").alias("__at")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("__id")) & F.col("url").eqNullSafe(F.col("__url")) & F.col("at").eqNullSafe(F.col("__at")), "left")
    return out.select("id", "url", "at", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n").isNotNull().alias("blocked"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date that follows from page_id (the table has none): one of the days of 2024."""
    day = F.pmod(F.coalesce("page_id", F.lit(0)) * 7919, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def lists_of(pages: DataFrame) -> DataFrame:
    """Dated list rows for the hosts of `pages` (the tables have no list): of each 16 hosts by MD5, 3 are
    on list "host" for a time, 2 of them once more; 2 others have a path on list "path"; one domain is on list "domain"."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    kind, start = F.col("h") % 16, (F.col("h") / 16).cast("int") % 200
    first = hosts.where(kind < 3).select(F.concat(F.lit("d:"), "host").alias("key"), F.lit("host").alias("list"), F.explode(F.array(F.struct(F.lit("add").alias("action"), day(start).alias("at")), F.struct(F.lit("remove").alias("action"), day(start + 90).alias("at")))).alias("x")).select("key", "list", "x.*")
    again = hosts.where(kind < 2).select(F.concat(F.lit("d:"), "host").alias("key"), F.lit("host").alias("list"), F.lit("add").alias("action"), day(start + 150).alias("at"))
    path = hosts.where((kind >= 3) & (kind < 5)).select(F.concat(F.lit("p:"), "host", F.lit("/en")).alias("key"), F.lit("path").alias("list"), F.lit("add").alias("action"), day(start).alias("at"))
    domain = pages.sparkSession.sql("SELECT 'd:example.net' AS key, 'domain' AS list, action, to_date(at) AS at FROM VALUES ('add', '2024-03-01'), ('remove', '2024-05-01') AS t(action, at)")
    return first.unionByName(again).unionByName(path).unionByName(domain)


SQL = r"""
WITH caps AS (
  SELECT page_id, url, (DATE '2024-01-01' + (((page_id * 7919) % 366))::INT) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages
), hosts AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT AS h FROM caps WHERE host <> ''
), placed AS (
  SELECT host, h % 16 AS kind, DATE '2024-01-01' + ((h // 16) % 200)::INT AS start FROM hosts
), live AS (
  SELECT 'd:' || host AS key, 'host' AS list, start AS a, start + 90 AS b FROM placed WHERE kind < 3
  UNION ALL SELECT 'd:' || host, 'host', start + 150, NULL FROM placed WHERE kind < 2
  UNION ALL SELECT 'p:' || host || '/en', 'path', start, NULL FROM placed WHERE kind IN (3, 4)
  UNION ALL SELECT 'd:example.net', 'domain', DATE '2024-03-01', DATE '2024-05-01'
), keyed AS (
  SELECT page_id, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: 'd:' || array_to_string(string_split(host, '.')[-k:], '.')),
    list_transform(range(1, len(parts) + 1), lambda k: 'p:' || host || '/' || array_to_string(parts[1:k], '/')))) AS key
  FROM caps WHERE host <> ''
), met AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM keyed JOIN live USING (key)
  WHERE fetched >= a AND (b IS NULL OR fetched < b) GROUP BY page_id
)
SELECT caps.page_id, url, fetched, coalesce(n, 0) AS n_matches, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
FROM caps LEFT JOIN met ON met.page_id = caps.page_id
"""


def op4_url_lists(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = filter_urls(captures_of(pages), lists_of(pages), "page_id", "url", "fetched")
    return out.withColumnsRenamed({"id": "page_id", "at": "fetched"})
