"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. It starts as one bucket; a bucket over the byte limit
is split on its next bit, and only such buckets, until every shard fits. What is split is a histogram of bytes by
hash prefix, so that the texts are read once however many splits there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import KEY_ROWS, materialize, whole_row

WORD_BITS = 60  # of the key's digest; then those of the text's hash and of a row number go on, so equal keys come apart too
ALL_BITS = 3 * WORD_BITS
MAX_BYTES = 32 << 20


def _bits(first: int, width: int) -> str:
    """SQL for bits [first, first+width) of the three 60-bit words k, t and s; a range lies within one word."""
    return f"shiftright(__{'kts'[first // WORD_BITS]}, {WORD_BITS - first % WORD_BITS - width}) & (shiftleft(1L, {width}) - 1)"


def shard_documents(docs: DataFrame, max_bytes: int = MAX_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Give each row a shard of at most max_bytes of UTF-8 text.

    Returns (key, n_bytes, shard, depth, shard_bytes, oversized): shard is the bit string of the hash prefix ('' for
    the root), depth its length. A null text has 0 bytes; a null key hashes as the empty string. Rows with equal keys
    share 60 bits of digest and are told apart by a hash of their texts, then by a row number, so even repeated rows split:
    which of them goes where is arbitrary. A single row larger than the limit has a shard of its own with oversized true. An
    empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    out = _assigned(docs, max_bytes, key, text)
    return out.select(F.col("__id").alias(key), F.col("__b").alias("n_bytes"), F.col("__p").alias("shard"), F.length("__p").cast("long").alias("depth"), F.col("__sb").alias("shard_bytes"), (F.col("__sb") > max_bytes).alias("oversized"))


def write_shards(docs: DataFrame, folder: str, max_bytes: int = MAX_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs, all columns, as Parquet under folder, one file for each of shard_documents()'s shards; returns (shard, n_docs, n_bytes).

    The file of a shard is in shard=s<bits>/ (shard_=..., and so on, if docs has such a column). Texts are written twice and shuffled once: rows get a number that stays, the
    numbers get their shards, and both meet by it. An empty table makes no file.
    """
    numbered = materialize(docs.select(whole_row(docs), F.col(key).alias("__id"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__number")), "shard-rows")
    placed = materialize(_assigned(numbered, max_bytes, "__id", "__text", "__number"), "shard-places").select(F.col("__n").alias("__number"), "__b", F.concat(F.lit("s"), "__p").alias("shard"))
    name = "shard"
    while name in docs.columns:
        name += "_"
    rows = numbered.select("__number", "__row").join(placed.select("__number", F.col("shard").alias("__shard")), "__number")
    rows.repartition("__shard").select("__row.*", F.col("__shard").alias(name)).write.partitionBy(name).parquet(folder)
    return placed.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("__b").alias("n_bytes"))


def _assigned(docs: DataFrame, max_bytes: int, key: str, text: str, row: str | None = None) -> DataFrame:
    """(__n, __id, __b, __p, __sb) of every row: number, key, bytes, shard and the shard's bytes."""
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sizes = docs.select(
        F.col(key).alias("__id"), digest.alias("__k"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("__b"),
        F.expr(f"shiftright(xxhash64(coalesce(`{text}`, '')), 4) & (shiftleft(1L, 60) - 1)").alias("__t"), (F.col(row) if row else F.monotonically_increasing_id()).alias("__n"),
    )
    rows = materialize(sizes, "shard-sizes").withColumn("__s", F.expr("shiftright(xxhash64(__n), 4) & (shiftleft(1L, 60) - 1)"))
    total, count = rows.agg(F.coalesce(F.sum("__b"), F.lit(0)), F.count("*")).first()
    step = max(1, min(20, math.ceil(math.log2(max(1, total / max_bytes))) + 3))
    while WORD_BITS % step:
        step += 1

    settled, pending, done = [], rows.withColumn("__p", F.lit("")), 0
    while count:
        cells = materialize(pending.select("__p", F.expr(_bits(done, step)).alias("__c"), "__b").groupBy("__p", "__c").agg(F.sum("__b").alias("__b"), F.count("*").alias("__n")), "shard-cells")
        buckets = (
            cells.select("__p", "__c", "__b", "__n", F.explode(F.sequence(F.lit(0 if done == 0 else 1), F.lit(step))).alias("__d"))
            .groupBy("__p", "__d", F.expr(f"shiftright(__c, {step} - __d)").alias("__q"))
            .agg(F.sum("__b").alias("__b"), F.sum("__n").alias("__n"))
        )
        fits = F.expr(f"__b <= {max_bytes} OR __n = 1")
        full = buckets.filter(~fits).select("__p", (F.col("__d") + 1).alias("__d"), F.col("__q").alias("__up"))
        leaves = buckets.filter(fits).withColumn("__up", F.shiftright("__q", 1))
        is_root = F.col("__d") == (0 if done == 0 else 1)
        leaves = leaves.filter(is_root).unionByName(leaves.filter(~is_root).join(full, ["__p", "__d", "__up"], "left_semi"))
        leaves = materialize(leaves.select("__p", "__d", "__q", F.col("__b").alias("__sb")), "shard-leaves")
        named = pending.withColumn("__c", F.expr(_bits(done, step)))
        # the directory: which leaf each occurring cell belongs to
        suffix = F.when(F.col("__d") == 0, "").otherwise(F.expr("lpad(conv(cast(__q as string), 10, 2), __d, '0')"))
        reached = cells.select("__p", "__c", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("__d")).withColumn("__q", F.expr(f"shiftright(__c, {step} - __d)"))
        directory = materialize(reached.join(leaves, ["__p", "__d", "__q"]).select("__p", "__c", suffix.alias("__suffix"), "__sb"), "shard-directory")
        if directory.count() <= KEY_ROWS:
            directory = F.broadcast(directory)
        settled.append(named.join(directory, ["__p", "__c"]).select("__n", "__id", "__b", F.concat("__p", "__suffix").alias("__p"), "__sb"))
        done += step
        over = buckets.filter((F.col("__d") == step) & ~fits).select("__p", F.col("__q").alias("__c"))
        over = materialize(over, "shard-over")
        if done >= ALL_BITS or over.isEmpty():
            break
        pending = materialize(
            named.join(over, ["__p", "__c"], "left_semi").select("__n", "__id", "__k", "__t", "__s", "__b", F.concat("__p", F.expr(f"lpad(conv(cast(__c as string), 10, 2), {step}, '0')")).alias("__p")),
            "shard-pending",
        )
    out = settled[0] if settled else rows.select("__n", "__id", "__b", F.lit("").alias("__p"), F.lit(0).cast("long").alias("__sb"))
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def oracle(max_bytes: int) -> str:
    """SQL for shards of 20 bits at most, unless texts are larger than the limit."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k, CAST(coalesce(strlen(text), 0) AS BIGINT) AS b FROM documents
), c AS (SELECT k >> 40 AS c, sum(b) AS b, count(*) AS n FROM d GROUP BY 1
), s AS (SELECT g.d, c.c >> (20 - g.d) AS q, sum(b) AS b, sum(n) AS n FROM c, (SELECT unnest(range(0, 21)) AS d) g GROUP BY 1, 2
), l AS (
  SELECT s.* FROM s LEFT JOIN s p ON p.d = s.d - 1 AND p.q = s.q >> 1
  WHERE (s.b <= {max_bytes} OR s.n = 1) AND (s.d = 0 OR (p.b > {max_bytes} AND p.n > 1))
)
SELECT d.doc_id, d.b AS n_bytes, CASE WHEN l.d = 0 THEN '' ELSE lpad(bin(l.q), CAST(l.d AS INTEGER), '0') END AS shard,
       CAST(l.d AS BIGINT) AS depth, CAST(l.b AS BIGINT) AS shard_bytes, l.b > {max_bytes} AS oversized
FROM d JOIN l ON l.q = d.k >> CAST(60 - l.d AS INTEGER)
"""
