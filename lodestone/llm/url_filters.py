"""URL allow and block rules over host suffixes and path prefixes.

Each URL is expanded into the (host suffix, path prefix) expressions a rule could be written as; expressions meet
rules in an equi-join on a short prefix of their digests, full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lower_ascii

#: (host, path, verdict)
DEFAULT_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PREFIX_HEX = 8  # 32 bits of the digest


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no '://'."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = DEFAULT_RULES, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's URL: (key, host, path, rule, verdict).

    rules: (host, path, verdict) rows, as a list or a DataFrame of that shape; a rule fits its host and all
    subdomains if the URL's path starts with the rule's. The longest rule (host and path together) wins; ties go to
    the longer host, then to block. No rule: rule is null and the verdict is `default`. Null URLs and ones without
    '://' have empty host and path and match no rule. Repeated rows are judged one by one; an empty table gives no
    rows; other columns are ignored.

    An expression is made only for the shapes (labels of the host, characters of the path) that some rule has, so a
    host of a thousand labels costs no more than others. Distinct (host, path) pairs are expanded, not rows.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules or [("", "", "")]])
        rules = spark.range(1 if rules else 0).select(F.inline(listed))
    book = rules.select(lower_ascii(F.col("host")).alias("__rh"), F.coalesce(F.col("path"), F.lit("")).alias("__rp"), F.col("verdict").alias("__v")).filter("__rh IS NOT NULL")
    book = book.groupBy("__rh", "__rp").agg(F.max("__v").alias("__v"))
    book = book.select("*", _digest(F.col("__rh"), F.col("__rp")).alias("__rd")).withColumn("__short", F.substring("__rd", 1, PREFIX_HEX))
    # a list of (labels, characters) pairs; as many as rules have lengths, whatever the number of rules
    shapes = book.select(F.size(F.split("__rh", "\\.")).alias("k"), F.length("__rp").alias("m")).distinct().collect()

    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("__id"), host.alias("__h"), path.alias("__p"))
    pairs = rows.select("__h", "__p").filter("__h <> ''").distinct()
    # one constant, however many shapes there are
    made = F.array(*[F.struct(F.lit(s.k).alias("k"), F.lit(s.m).alias("m")) for s in shapes]) if shapes else F.array().cast("array<struct<k:int,m:int>>")
    labels = F.split("__h", "\\.")
    fits = F.filter(made, lambda s: (s["k"] <= F.size(labels)) & (s["m"] <= F.length("__p")))
    tried = pairs.select("__h", "__p", F.explode(fits).alias("__s")).select("__h", "__p", F.struct(F.expr("substring_index(__h, '.', -__s.k)").alias("h"), F.expr("substring(__p, 1, __s.m)").alias("p")).alias("__e"))
    tried = tried.select("__h", "__p", _digest(F.col("__e.h"), F.col("__e.p")).alias("__d")).withColumn("__short", F.substring("__d", 1, PREFIX_HEX))
    won = (
        tried.join(book, "__short")
        .filter(F.col("__d") == F.col("__rd"))
        .groupBy("__h", "__p")
        .agg(F.max(F.struct((F.length("__rh") + F.length("__rp")).alias("n"), F.length("__rh").alias("hn"), F.col("__v").alias("v"), F.concat("__rh", "__rp").alias("r"))).alias("__w"))
    )
    # rows without a host match nothing: their ids spread them over the join's tasks
    spread = rows.withColumn("__j", F.when(F.col("__h") != "", F.col("__p")).otherwise(F.coalesce(F.col("__id").cast("string"), F.lit(""))))
    return spread.join(won.withColumnRenamed("__p", "__j"), ["__h", "__j"], "left").select(
        F.col("__id").alias(key), F.col("__h").alias("host"), F.col("__p").alias("path"), F.col("__w.r").alias("rule"), F.coalesce(F.col("__w.v"), F.lit(default)).alias("verdict")
    )


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hits AS (
  SELECT host, path, max({'n': length(rh) + length(rp), 'hn': length(rh), 'v': v, 'r': rh || rp}) AS w
  FROM (SELECT DISTINCT host, path FROM s) p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2
)
SELECT page_id, s.host, s.path, w.r AS rule, coalesce(w.v, 'allow') AS verdict FROM s LEFT JOIN hits USING (host, path)
"""
