"""URL filters: a sort-merge range join of urls with host and path rules.

A rule (host, path, verdict) fits a url whose host is the rule's host or a subdomain of it and whose path starts with
the rule's path. The canonical key of a host suffix and a path is the suffix's labels in reverse, each ended by '#',
then '?' and the path; neither sign can stand in a host or path, so a rule fits exactly when its key is a prefix of the
url's key for that suffix, that is when the url's key lies in [key, key + 0xFF) in byte order (0xFF is in no UTF-8
text). Such intervals nest or are disjoint. A url stands once for each number of labels that some rule's host has. All
these rows and the interval ends are swept together, sorted within their host suffix: a stack of the open intervals is
kept, and a row takes the innermost. A url's best row decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.llm.common import lower_az, table

#: A host suffix with more urls than this is dealt over several sweeps, each with that suffix's rules.
ROWS_PER_SWEEP = 500
#: Bounds the broadcast list of such suffixes: none has fewer than 1/HOT_SUFFIXES of the urls.
HOT_SUFFIXES = 4096


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))
    return lower_az(host), path


def reversed_key(labels: Column, depth: int) -> Column:
    """The last `depth` labels in reverse, each ended by '#'; null if there are fewer."""
    key = F.concat(F.array_join(F.reverse(F.slice(labels, F.greatest(F.size(labels) - depth + 1, F.lit(1)), depth)), "#"), F.lit("#"))
    return F.when(F.size(labels) >= depth, key)


def interval_ends(rules: DataFrame) -> DataFrame:
    """Two rows a rule, (depth, suffix, key, kind, open): kind 0 opens, 1 closes; open is the innermost rule after it.

    The stack as a window: after a closing end at height h, its top is the last rule that was opened to height h.
    Rules nest only within one host, so the sweep is keyed by it. Of rules with equal host and path, block wins.
    """
    host, path = lower_az(F.trim(F.coalesce("host", F.lit("")))), F.coalesce("path", F.lit(""))
    labels = F.split(host, r"\.")
    r = rules.select(host.alias("host"), path.alias("path"), "verdict").where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.withColumn("depth", F.size(labels)).withColumn("suffix", F.concat(F.array_join(F.reverse(labels), "#"), F.lit("#")))
    rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), F.col("verdict"))
    key = F.concat("suffix", F.lit("?"), "path").cast("binary")
    ends = r.select("depth", "suffix", rule.alias("own"), F.explode(F.array(F.struct(key.alias("key"), F.lit(0).alias("kind")), F.struct(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(1).alias("kind")))).alias("e"))
    ends = ends.select("depth", "suffix", "own", "e.*")
    sweep = Window.partitionBy("suffix").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("height", F.sum(F.when(F.col("kind") == 0, 1).otherwise(-1)).over(sweep))
    at_height = Window.partitionBy("suffix", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("kind") == 0, F.col("own")), ignorenulls=True).over(at_height)
    # a struct around it, as "no rule is open" must not be taken for "no end here"
    return ends.select("depth", "suffix", "key", "kind", F.struct(F.when(F.col("height") > 0, top).alias("rule")).alias("open"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows_per_sweep: int = ROWS_PER_SWEEP) -> DataFrame:
    """(id_col, url_col, host, path, rule, verdict) for each row of pages; other columns are not read.

    The longest fitting rule decides (of equally long ones the longer host, then the later text); without one the rule
    is null and the verdict `default`. Null urls and urls without '://' have an empty host and path and fit nothing.
    Repeated rows stay repeated. No rules or no pages: every verdict is the default, or no rows.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    ends = interval_ends(rules)
    # rules are configuration: what comes here is one small number for each length of host, not rows
    depths = [d for (d,) in sorted(ends.select("depth").distinct().collect())]
    none = F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    if not depths:
        return _judged(urls.withColumn("best", none), id_col, url_col, default)
    labels = F.split("host", r"\.")
    suffixes = F.filter(F.array(*(reversed_key(labels, d) for d in depths)), lambda x: x.isNotNull())
    limit = max(rows_per_sweep, urls.count() // HOT_SUFFIXES)
    hot = urls.select(F.explode(suffixes).alias("hot")).groupBy("hot").count().where(F.col("count") > limit)
    hot = F.broadcast(hot.select("hot", F.ceil(F.col("count") / limit).cast("int").alias("n")))  # len(depths) * HOT_SUFFIXES at most
    rows = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("suffix", F.explode_outer(suffixes))
    rows = rows.join(hot, F.col("suffix") == F.col("hot"), "left")
    # a host that is shorter than all rules has no suffix; such rows meet no rule anywhere
    shares = F.when(F.col("suffix").isNull(), HOT_SUFFIXES).otherwise(F.coalesce("n", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), shares).cast("int")).drop("hot", "n")
    rows = rows.withColumn("key", F.concat("suffix", F.lit("?"), "path").cast("binary")).withColumn("kind", F.lit(2))
    own = ends.join(hot, F.col("suffix") == F.col("hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))
    both = rows.unionByName(own.select("suffix", "salt", "key", "kind", "open"), allowMissingColumns=True)
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("top", F.last("open", ignorenulls=True).over(sweep)).where("kind = 2")
    best = swept.groupBy("row").agg(*(F.first(c).alias(c) for c in ("id", "url", "host", "path")), F.max("top.rule").alias("best"))
    return _judged(best, id_col, url_col, default)


def _judged(urls: DataFrame, id_col: str, url_col: str, default: str) -> DataFrame:
    return urls.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The contract's rules, in its order.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op9_url_filters(spark, sf_dir):
    """The longest rule that fits each url. Null urls and such without a host have an empty host and path, no rule, and the
    method's own verdict; repeated rows are judged alike; an empty table gives no rows."""
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u2 AS (SELECT row_number() OVER () AS n, * FROM u),
m AS (
  SELECT u2.n, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM u2 JOIN r ON (u2.host = r.host OR ends_with(u2.host, '.' || r.host)) AND starts_with(u2.path, r.path)
  GROUP BY u2.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u2 LEFT JOIN m USING (n)
"""
