"""Host-level quality rules.

Every document is measured by built-in expressions; failures are aggregated by host, each host's failure rate is
shrunk towards all hosts' by a beta prior fitted to the hosts' own rates, and the hosts' verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_GAPS, hint_small, materialize, whole_row, word_array

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_FAILURE = 0.5


def _n_repeat(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more.

    A cheap pass compares the number of distinct window hashes; only texts in which two hashes are equal are sorted
    by the windows themselves, so hashes never decide.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    plain = F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) == F.size(h))[0]
    ordered = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(WINDOW)), " ").alias("w"), i.alias("i"))))
    doubled = F.transform(
        F.array(ordered),
        lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["w"] == x["w"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["w"] == x["w"]))),
    )[0]
    places = F.array_sort(F.transform(doubled, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).cast("long").alias("s")),
        lambda a, x: F.struct(x.alias("p"), (a["s"] + F.least(F.lit(WINDOW), x - a["p"])).alias("s")),
        lambda a: a["s"],
    )
    return F.when(n <= WINDOW, F.lit(0).cast("long")).when(plain, F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """keep, then __words and the measures of each row's whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.call_function("btrim", x, F.lit(WORD_GAPS)) != "")
    # a projection that isn't deterministic stays one: else a filter on the measures is pushed below it, and the words are
    # split again for each of them
    words = F.when(F.monotonically_increasing_id() >= 0, word_array(t))
    return (
        docs.select(*keep, t.alias("__t"), words.alias("__w"))
        .select(
            *[F.col(c) for c in docs.select(*keep).columns],
            F.size("__w").cast("long").alias("__n_words"),
            F.length(F.array_join("__w", "")).cast("long").alias("__word_chars"),
            F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("__n_symbols"),
            F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0].alias("__n_dup_lines"),
            _n_repeat(F.col("__w")).alias("__n_repeat_words"),
        )
        .withColumn("__base_failed", (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words")))
    )


def host_verdicts(measured: DataFrame, max_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """(__host, __rejected) from rows with __host and __base_failed.

    The prior is a beta distribution with the mean of the hosts' rates and their variance less what sampling adds to it: of
    hosts with n documents, a rate varies by m (1 - m) / n + v (1 - 1 / n), with m and v the prior's mean and variance.
    Where nothing else makes the rates vary, its weight is 1e6 documents, so that all hosts have the common rate.
    """
    hosts = materialize(measured.groupBy("__host").agg(F.count("*").alias("__n"), F.sum(F.col("__base_failed").cast("long")).alias("__f")), "quality-rates")
    mean, varies, noise = (x or 0.0 for x in hosts.agg(F.avg(F.expr("__f / __n")), F.var_pop(F.expr("__f / __n")), F.avg(F.expr("1 / __n"))).first())
    spread = (varies - mean * (1 - mean) * noise) / (1 - noise) if noise < 1 else 0.0
    weight = max(1.0, min(1e6, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else 1e6
    rate = (F.col("__f") + F.lit(mean * weight)) / (F.col("__n") + F.lit(weight))
    return hosts.select("__host", (rate > max_failure).alias("__rejected"))


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """Measures and verdict of every row: (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    A row fails its own rules if it has under 20 words or over 30 % of its words lie in repeated 8-word windows; it is
    kept if it doesn't fail and its host's shrunk failure rate is at most max_host_failure. Null and empty texts have
    no words and fail. Rows without a host (null) form one host. Repeated rows count each; an empty table gives no
    rows; other columns are ignored.
    """
    measured = materialize(measure(docs, text, [F.col(key).alias("__id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host")]), "quality")
    bad = materialize(host_verdicts(measured, max_host_failure).filter("__rejected").select("__host", F.lit(True).alias("__bad")), "quality-hosts")
    joined = measured.join(hint_small(bad, bad.count()), "__host", "left")
    return joined.select(
        F.col("__id").alias(key),
        *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        (~F.col("__base_failed") & F.col("__bad").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """The rows of docs that judge_documents() keeps, with all their columns (measured twice, so that texts aren't moved).

    Null and empty texts fail and go, rows without a host are of one host, repeated rows all stay or all go; an empty table
    stays empty.
    """
    home = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host")
    bad = materialize(host_verdicts(measure(docs, text, [home]), max_host_failure).filter("__rejected").select("__host"), "quality-hosts")
    good = measure(docs, text, [whole_row(docs), home]).filter(~F.col("__base_failed"))
    return good.join(hint_small(bad, bad.count()), "__host", "left_anti").select("__row.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), p AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM p) WHERE c > 1
), c AS (SELECT r, count(DISTINCT i + k) AS n FROM q, (SELECT unnest(range(0, 8)) AS k) GROUP BY r
), m AS (
  SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (r)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY 1
), z AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS x, avg(1 / n) AS y FROM h
), s AS (SELECT m, CASE WHEN y < 1 THEN (x - m * (1 - m) * y) / (1 - y) ELSE 0 END AS v FROM z
), k AS (SELECT *, CASE WHEN v > 1e-12 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS a FROM s
), x AS (SELECT host, (f + m * a) / (n + a) > 0.5 AS rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM b JOIN x USING (host)
"""
