"""Named queries over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import graphs, matrices, partitioning, reports, sorting, tasks
from ..session import shared_folder, table
from ..sources import generators
from ..streaming import counters, requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Settings that queries and SQL share.
RUN, BIT, PARTS, RANK_STEPS, DIMS = 1024, 3, 7, 6, 64
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- sorting ----


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def sort_rank(spark: SparkSession, d: str) -> DataFrame:
    return sorting.with_position(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "rank", start=1).select("o_orderkey", "rank")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.floor("o_totalprice").cast("long").alias("v"), F.col("o_orderkey").alias("pos"))
    return o.filter("pos % 2 = 0"), o.filter("pos % 2 = 1")


@query("SELECT pos, side, row_number() OVER (ORDER BY v, side, pos) AS rank FROM (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey AS pos, CAST(o_orderkey % 2 AS INTEGER) AS side FROM orders)")
def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    left, right = _halves(spark, d)
    return sorting.merge_runs(left, right, "v", "pos").select("pos", "side", "rank")


@query(f"SELECT o_orderkey AS pos, (o_orderkey // {2 * RUN}) * {2 * RUN} + row_number() OVER (PARTITION BY o_orderkey // {2 * RUN} ORDER BY o_totalprice, o_orderkey) - 1 AS new_pos FROM orders")
def bottom_up_pass(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("v"))
    return sorting.bottom_up_pass(o, RUN).select("pos", "new_pos")


def _permutation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("v"), "o_totalprice")
    return sorting.with_position(o, ["o_totalprice", "v"]).select("pos", "v")


_PERMUTATION = "(SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_orderkey AS v FROM orders)"


@query(f"SELECT pos, v, row_number() OVER (ORDER BY (v >> {BIT}) & 1, pos) - 1 AS new_pos FROM {_PERMUTATION}")
def radix_pass(spark: SparkSession, d: str) -> DataFrame:
    return sorting.radix_pass(_permutation(spark, d), BIT)


@query(f"SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM {_PERMUTATION}")
def radix_sort(spark: SparkSession, d: str) -> DataFrame:
    return sorting.radix_sort(_permutation(spark, d)).select("pos", "v")


@query(f"SELECT count(*) FILTER (pos <> v) AS violations FROM (SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM {_PERMUTATION})")
def sorted_check(spark: SparkSession, d: str) -> DataFrame:
    placed = sorting.with_position(_permutation(spark, d).select("v"), ["v"])
    return placed.agg(F.count_if(fn.is_sorted_violation("pos", "v")).alias("violations"))


@query("SELECT k, CAST((o_orderkey >> k) & 1 AS INTEGER) AS bit, count(*) AS n FROM orders, (SELECT CAST(unnest(range(0, (SELECT greatest(1, length(bin(max(o_orderkey)))) FROM orders))) AS INTEGER) AS k) GROUP BY 1, 2")
def bit_histogram(spark: SparkSession, d: str) -> DataFrame:
    """All places that the greatest key has."""
    o = table(spark, d, "orders")
    greatest = o.agg(F.max(fn.bit_length("o_orderkey"))).first()[0] or 0
    return sorting.bit_histogram(o, "o_orderkey", max(1, greatest))


@query(
    f"""WITH p AS {_PERMUTATION}, s AS (SELECT CAST(ceil(count(*) / {PARTS}) AS BIGINT) AS c FROM p),
h AS (SELECT CAST(pos // c AS INTEGER) AS part, CAST((v >> {BIT}) & 1 AS INTEGER) AS bit, count(*) AS n FROM p, s GROUP BY 1, 2)
SELECT part, bit, n, CAST(coalesce(sum(n) OVER (PARTITION BY bit ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM h"""
)
def bit_histogram_parts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").count()
    p = _permutation(spark, d).select(partitioning.split_ceil(F.col("pos"), n, PARTS).alias("part"), fn.kth_bit("v", BIT).alias("bit"))
    return sorting.exclusive_offsets(p.groupBy("part", "bit").agg(F.count("*").alias("n")), "part", "bit", "n")


@query("SELECT CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE length(bin(p_partkey)) END AS INTEGER) AS bits, count(*) AS n FROM part GROUP BY 1")
def bit_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(fn.bit_length("p_partkey").alias("bits")).agg(F.count("*").alias("n"))


@query("SELECT r AS run, CAST(ceil(n / (2 * r)) AS BIGINT) AS merges FROM (SELECT CAST(1 AS BIGINT) << CAST(unnest(range(0, 62)) AS BIGINT) AS r), (SELECT count(*) AS n FROM orders) WHERE r < n")
def merge_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Of every pass that a bottom-up sort makes."""
    return sorting.merge_tasks(spark, table(spark, d, "orders").count())


# ---- partitioners ----

_COUNT = "(SELECT count(*) AS n FROM part)"
_PART_IDS = f"(SELECT unnest(range(0, {PARTS})) AS p)"


@query(f"SELECT CAST(p AS INTEGER) AS part, p * (n // {PARTS}) AS start, CASE WHEN p = {PARTS - 1} THEN n ELSE (p + 1) * (n // {PARTS}) END AS stop FROM {_PART_IDS}, {_COUNT}")
def split_floor(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.bounds(spark, table(spark, d, "part").count(), PARTS, "floor")


@query(f"SELECT CAST(t - 1 AS INTEGER) AS part, min(p_partkey) AS start, max(p_partkey) + 1 AS stop FROM (SELECT p_partkey, ntile({PARTS}) OVER (ORDER BY p_partkey) AS t FROM part) GROUP BY 1")
def split_balanced(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    part = partitioning.split_balanced(F.col("p_partkey"), p.count(), PARTS)
    return p.groupBy(part.alias("part")).agg(F.min("p_partkey").alias("start"), (F.max("p_partkey") + 1).alias("stop"))


@query(f"SELECT CAST(p_partkey // CAST(ceil(n / {PARTS}) AS BIGINT) AS INTEGER) AS part, min(p_partkey) AS start, max(p_partkey) + 1 AS stop FROM part, {_COUNT} GROUP BY 1")
def split_ceil(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.bounds(spark, table(spark, d, "part").count(), PARTS, "ceil").filter("start < stop")


# ---- graphs ----


def supplier_part(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts as one undirected graph; a part's node is its key behind the suppliers'."""
    base = table(spark, d, "supplier").count()
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return graphs.undirected(pairs.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + base).alias("dst")))


_EDGES = """b AS (SELECT count(*) AS n FROM supplier), p AS (SELECT DISTINCT l_suppkey AS s, l_partkey + n AS t FROM lineitem, b),
e AS (SELECT s AS src, t AS dst FROM p UNION ALL SELECT t, s FROM p)"""
_LEVELS = f"WITH RECURSIVE {_EDGES}, w(v, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.v WHERE w.level < 8), l AS (SELECT v, min(level) AS level FROM w GROUP BY v)"


@query(f"WITH {_EDGES} SELECT src AS v, count(*) AS n_neighbors, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM e GROUP BY 1")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    lists = graphs.adjacency(supplier_part(spark, d))
    return lists.select("v", F.size("neighbors").cast("long").alias("n_neighbors"), F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def edges_distinct(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graphs.in_degree(pairs).select(F.col("dst").alias("l_suppkey"), F.col("n").alias("n_parts"))


def three_out(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return generators.three_out_graph(spark, table(spark, d, "part").count())


_THREE = "n AS (SELECT count(*) AS n FROM part), e AS (SELECT DISTINCT i AS src, (i * i + j * i) % n AS dst FROM (SELECT unnest(range(0, (SELECT n FROM n))) AS i), (SELECT unnest(range(0, 3)) AS j), n)"


@query(f"WITH {_THREE} SELECT dst, count(*) AS n FROM e GROUP BY 1")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graphs.in_degree(three_out(spark, d)[0])


@query(f"WITH {_THREE} SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY dst), 8) AS w FROM e")
def transition_weights(spark: SparkSession, d: str) -> DataFrame:
    return graphs.transition_weights(three_out(spark, d)[0]).withColumn("w", F.round("w", 8))


@query(f"WITH {_EDGES} SELECT DISTINCT dst AS v FROM e WHERE src < 3")
def bfs_expand(spark: SparkSession, d: str) -> DataFrame:
    return graphs.expand(spark.range(3).select(F.col("id").alias("v")), supplier_part(spark, d))


@query(f"WITH {_EDGES}, f AS (SELECT DISTINCT dst AS v FROM e WHERE src = 0), c AS (SELECT DISTINCT e.dst AS v FROM f JOIN e ON e.src = f.v) SELECT v FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.v = c.v) AND v <> 0")
def bfs_next(spark: SparkSession, d: str) -> DataFrame:
    e = supplier_part(spark, d)
    start = spark.range(1).select(F.col("id").alias("v"))
    first = graphs.expand(start, e)
    return graphs.unvisited(graphs.expand(first, e), start.unionByName(first))


@query(f"{_LEVELS} SELECT level, count(*) AS n FROM l GROUP BY 1")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return graphs.bfs_levels(supplier_part(spark, d), 0).groupBy("level").agg(F.count("*").alias("n"))


@query(f"{_LEVELS} SELECT count(*) AS visited FROM l")
def bfs_count(spark: SparkSession, d: str) -> DataFrame:
    return graphs.bfs_count(supplier_part(spark, d), 0)


@query(f"WITH {_THREE}, w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY dst) AS w FROM e) SELECT src AS v, round(sum(w * (dst + 1)), 6) AS y FROM w GROUP BY 1")
def spmv(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = three_out(spark, d)
    y = graphs.spmv(graphs.transition_weights(edges), nodes.withColumn("e", (F.col("v") + 1).cast("double")))
    return y.select("v", F.round("y", 6).alias("y"))


def _rank_sql(steps: int) -> str:
    parts = [f"WITH {_THREE}, w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY dst) AS w FROM e), x0 AS (SELECT unnest(range(0, (SELECT n FROM n))) AS v, CAST(1 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS acc)"]
    for k in range(1, steps + 1):
        parts.append(f"s{k} AS (SELECT x.v, x.acc + coalesce(y.y, 0) AS s FROM x{k - 1} x LEFT JOIN (SELECT src, sum(w * e) AS y FROM w JOIN x{k - 1} ON dst = v GROUP BY src) y ON y.src = x.v)")
        parts.append(f"x{k} AS (SELECT v, s / n AS e, s / n AS acc FROM s{k}, (SELECT sqrt(sum(s * s)) AS n FROM s{k}))")
    return ",\n".join(parts) + f"\nSELECT v, round(e / (SELECT sum(e) FROM x{steps}), 8) AS rank FROM x{steps}"


@query(_rank_sql(RANK_STEPS))
def pagerank_k(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = three_out(spark, d)
    return graphs.rank(edges, nodes, iterations=RANK_STEPS).select("v", F.round("rank", 8).alias("rank"))


@query()
def pagerank_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Until two steps are at most a millionth apart. Rows only: the number of steps depends on the graph."""
    edges, nodes = three_out(spark, d)
    return graphs.rank(edges, nodes, threshold=1e-6).select("v", F.round("rank", 6).alias("rank"))


#: Graphs of the many: as many nodes each as their number says.
MANY, MANY_STEPS, MANY_THRESHOLD = (20, 31, 50), 40, 1e-2


def _many_sql() -> str:
    """Graph g of n nodes points from i to (i * i + j * i) mod n; a graph stays as it is once a step was at most the threshold."""
    graphs_ = ", ".join(f"({g}, {n})" for g, n in enumerate(MANY))
    parts = [
        f"WITH g(graph_id, n) AS (SELECT CAST(a AS BIGINT), CAST(b AS BIGINT) FROM (VALUES {graphs_}) t(a, b)), x0 AS (SELECT graph_id, CAST(unnest(range(0, n)) AS BIGINT) AS v, CAST(1 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS acc, FALSE AS ended FROM g)",
        "d AS (SELECT DISTINCT graph_id, v AS src, (v * v + j * v) % n AS dst FROM x0 JOIN g USING (graph_id), (SELECT unnest(range(0, 3)) AS j)), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY graph_id, dst) AS w FROM d)",
    ]
    for k in range(1, MANY_STEPS + 1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT x.graph_id, x.v, x.e, x.ended, x.acc + coalesce(y.y, 0) AS s FROM x{k - 1} x LEFT JOIN (SELECT w.graph_id, src, sum(w * e) AS y FROM w JOIN x{k - 1} z ON dst = z.v AND w.graph_id = z.graph_id GROUP BY 1, 2) y ON y.src = x.v AND y.graph_id = x.graph_id)")
        parts.append(f"t{k} AS MATERIALIZED (SELECT graph_id, v, e, ended, s / sqrt(sum(s * s) OVER (PARTITION BY graph_id)) AS u FROM s{k})")
        parts.append(f"x{k} AS MATERIALIZED (SELECT graph_id, v, CASE WHEN ended THEN e ELSE u END AS e, CASE WHEN ended THEN e ELSE u END AS acc, ended OR sqrt(sum((u - e) * (u - e)) OVER (PARTITION BY graph_id)) <= {MANY_THRESHOLD} AS ended FROM t{k})")
    return ",\n".join(parts) + f"\nSELECT graph_id, v, round(e / sum(e) OVER (PARTITION BY graph_id), 8) AS rank FROM x{MANY_STEPS}"


@query(_many_sql())
def pagerank_many(spark: SparkSession, d: str) -> DataFrame:
    """Several graphs in one plan, each until its own steps are at most MANY_THRESHOLD apart; the SQL goes on for steps that none of them needs."""
    edges, nodes = (reports.union_all(*[three.withColumn("graph_id", F.lit(g).cast("long")) for g, three in enumerate(side)]) for side in zip(*[generators.three_out_graph(spark, n) for n in MANY]))
    return graphs.rank_graphs(edges, nodes, threshold=MANY_THRESHOLD).select("graph_id", "v", F.round("rank", 8).alias("rank"))


# ---- vectors and matrices ----


@query("SELECT round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS norm FROM customer")
def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    return graphs.l2_norm(table(spark, d, "customer"), "c_acctbal").select(F.round("norm", 4).alias("norm"))


@query("SELECT round(sqrt(sum((c_acctbal - c_custkey) * (c_acctbal - c_custkey))), 4) AS error FROM customer")
def l2_error(spark: SparkSession, d: str) -> DataFrame:
    return graphs.l2_distance(table(spark, d, "customer"), "c_acctbal", "c_custkey").select(F.round("error", 4).alias("error"))


@query("SELECT p_partkey, round(p_retailprice / (SELECT sum(p_retailprice) FROM part), 10) AS share FROM part")
def l1_share(spark: SparkSession, d: str) -> DataFrame:
    return graphs.share_of_total(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("share", 10).alias("share"))


def _gram(spark: SparkSession, d: str, dims: int) -> DataFrame:
    return matrices.gram_of_vectors(table(spark, d, "embeddings"), "embedding", dims)


def _gram_sql(dims: int) -> str:
    return f"x AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS b FROM embeddings, (SELECT CAST(unnest(range(0, {dims})) AS INTEGER) AS k)), a AS (SELECT p.k AS i, q.k AS j, sum(p.b * q.b) AS a FROM x p JOIN x q USING (vec_id) GROUP BY 1, 2)"


@query(f"WITH {_gram_sql(DIMS)} SELECT i, j, round(a, 6) AS a FROM a")
def gram(spark: SparkSession, d: str) -> DataFrame:
    return _gram(spark, d, DIMS).select("i", "j", F.round("a", 6).alias("a"))


@query(f"WITH {_gram_sql(DIMS)} SELECT i, j, round(a, 6) AS a FROM a")
def gram_join(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("i", "b"))
    return matrices.gram(cells.withColumn("b", F.col("b").cast("double"))).select("i", "j", F.round("a", 6).alias("a"))


@query()
def cholesky(spark: SparkSession, d: str) -> DataFrame:
    """The factor of all components' Gram matrix, 16 columns at a time; held against numpy in place of SQL."""
    return matrices.factor_relational(_gram(spark, d, DIMS), DIMS, block=16).select("i", "j", F.round("l", 6).alias("l"))


@query()
def cholesky_dense(spark: SparkSession, d: str) -> DataFrame:
    """The same by one task."""
    one = _gram(spark, d, DIMS).withColumn("matrix_id", F.lit(0).cast("long"))
    return matrices.factor_many(one).select("i", "j", F.round("l", 6).alias("l"))


@query(f"WITH {_gram_sql(DIMS)} SELECT i, j, printf('%8.4f', a) AS cell FROM a WHERE i < 5 AND j < 5")
def matrix_corner(spark: SparkSession, d: str) -> DataFrame:
    return matrices.top_left(_gram(spark, d, DIMS), "a")


# ---- reports ----


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def events_mean(spark: SparkSession, d: str) -> DataFrame:
    return reports.mean_runs(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.round("mean", 6).alias("mean"))


@query(
    """WITH s AS (SELECT CASE WHEN event_type = 'error' THEN -1 ELSE value END AS l FROM events)
SELECT round(sum(l) FILTER (l >= 0), 4) AS total, count(*) FILTER (l >= 0) AS n_ok, count(*) FILTER (l < 0) AS n_failed, round(avg(l) FILTER (l >= 0), 6) AS mean FROM s"""
)
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select(F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value")).alias("latency"))
    return reports.latency_summary(samples).select(F.round("total", 4).alias("total"), "n_ok", "n_failed", F.round("mean", 6).alias("mean"))


@query(
    "SELECT user_id, "
    + ", ".join(f"coalesce(printf('%.6f', arg_min(value, event_id) FILTER (event_type = '{t}') / 1e9), '') AS {t}" for t in EVENT_TYPES)
    + f" FROM events WHERE event_type IN {EVENT_TYPES} GROUP BY 1"
)
def pivot_first(spark: SparkSession, d: str) -> DataFrame:
    return reports.first_value_pivot(table(spark, d, "events"), "user_id", "event_type", list(EVENT_TYPES), "value", "event_id")


@query(
    "SELECT num_threads, size, "
    + ", ".join(f"coalesce(printf('%.6f', arg_min(value, event_id) FILTER (event_type = '{t}') / 1e9), '') AS {t}" for t in EVENT_TYPES)
    + f" FROM (SELECT *, CAST(event_id % 4 AS INTEGER) AS num_threads, user_id AS size FROM events WHERE event_type IN {EVENT_TYPES}) GROUP BY 1, 2"
)
def pivots_by_threads(spark: SparkSession, d: str) -> DataFrame:
    """A pivot for each thread count, written as one tab-separated file each and read again."""
    from ..sources import result_files as files

    runs = table(spark, d, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("num_threads"), F.col("user_id").alias("size"), F.col("event_type").alias("program_name"), F.col("value").alias("time"))
    pivots = reports.pivots_by_threads(runs, list(EVENT_TYPES), "event_id")
    folder = files.new_folder(spark)
    files.write_pivots(pivots, folder, "num_threads", "size")
    kept = files.read_rows(spark, folder, pivots.schema)
    return kept.select("num_threads", "size", *[F.coalesce(t, F.lit("")).alias(t) for t in EVENT_TYPES])


@query("SELECT l_orderkey AS x, round(l_extendedprice / 1e9, 12) AS y FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'R'")
def thread_split(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("num_threads"), F.col("l_returnflag").alias("program_name"), F.col("l_orderkey").alias("size"), F.col("l_extendedprice").alias("time"))
    return reports.series(reports.split_by_threads(runs, 2)[0], "R").select("x", F.round("y", 12).alias("y"))


@query("SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS rank FROM (SELECT DISTINCT p_brand FROM part)")
def distinct_sorted(spark: SparkSession, d: str) -> DataFrame:
    return sorting.distinct_ranks(table(spark, d, "part"), "p_brand")


@query("SELECT r_name, c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)")
def run_matrix(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_matrix(table(spark, d, "region").select("r_name"), table(spark, d, "customer").select("c_mktsegment").distinct())


@query("SELECT event_id, user_id AS array_size, event_type AS program_name, CAST(event_id % 8 AS INTEGER) AS num_threads, CAST(printf('%.6f', value * 1000) AS DOUBLE) AS time FROM events")
def log_scan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = fn.perf_line(F.col("user_id"), F.col("event_type"), F.col("event_id") % 8, F.lit(1), F.lit(1048576), F.format_string("%.6f", F.col("value") * 1000))
    logs = e.select("event_id", F.concat(F.lit("sorting ...\n"), line, F.lit("\nPERFDATA,1,later,1,1,1,1\n")).alias("value"))
    return reports.scan_perf_log(logs).select("event_id", "array_size", "program_name", "num_threads", "time")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(printf('%.6f', value * 1000) AS DOUBLE) END AS time FROM events")
def traversal_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a traversal prints its time; every fifth output has none."""
    line = F.format_string("Serial BFS traversal time: %.6f ns\n", F.col("value") * 1000)
    logs = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("n = 5\n"), line)).otherwise("traversal time: none").alias("value"))
    return reports.scan_traversal_log(logs).select("event_id", "time")


@query(
    r"""SELECT o_orderkey, coalesce(TRY_CAST(nullif(regexp_extract(t, '^\s*([+-]?\d+)', 1), '') AS INTEGER), 0) AS n
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '  -' || o_orderkey || 'x' || o_orderstatus END AS t FROM orders)"""
)
def atoi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("  -"), F.col("o_orderkey").cast("string"), F.lit("x"), F.col("o_orderstatus")))
    return o.select("o_orderkey", fn.atoi(text).alias("n"))


@query("SELECT l_orderkey, l_linenumber, date_diff('microsecond', o_orderdate, l_shipdate) AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def elapsed(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", fn.elapsed_us("o_orderdate", "l_shipdate").alias("us"))


@query(
    """WITH t AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
SELECT count(*) AS n_threads, round(avg(1000), 4) AS mean_launch_us, round(avg(epoch_us(b) - epoch_us(a)), 4) AS mean_work_us, round(avg(500), 4) AS mean_destroy_us, round(avg(epoch_us(b) - epoch_us(a) + 1500), 4) AS mean_total_us FROM t"""
)
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "events").groupBy(F.col("user_id").alias("thread_id")).agg(F.min("ts").alias("work_start"), F.max("ts").alias("work_end"))
    threads = spans.withColumns({"launch": F.expr("work_start - INTERVAL 1 MILLISECOND"), "destroy": F.expr("work_end + INTERVAL 500 MICROSECOND")})
    means = reports.lifecycle_means(threads)
    return means.select("n_threads", *[F.round(c, 4).alias(c) for c in means.columns[1:]])


def _reply_sql(request: str, source: str) -> str:
    """What the server's snprintf() writes into 4,096 bytes, as hex digits: a byte is two of them."""
    head = "hex(encode('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/plain' || chr(13) || chr(10) || 'Content-Length: ' || n_body || chr(13) || chr(10) || 'Connection: close' || chr(13) || chr(10) || chr(13) || chr(10)))"
    return f"SELECT page_id, n_body, upper(substr({head} || h, 1, 8190)) AS response FROM (SELECT page_id, h, CAST(length(h) // 2 AS BIGINT) AS n_body FROM (SELECT page_id, substr(hex(encode({request})), 1, 8190) AS h FROM {source}))"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Pages as requests; every third one gets letters of several bytes in front."""
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("é漢"), F.col("html"))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", html.alias("value"))


_REQUEST = "CASE WHEN page_id % 3 = 0 THEN 'é漢' || html ELSE html END"


def _replies(answered: DataFrame) -> DataFrame:
    read = F.least(F.octet_length("value"), F.lit(fn.scalars.REQUEST_BYTES)).cast("long")
    return answered.select("page_id", read.alias("n_body"), F.hex("response").alias("response"))


@query(_reply_sql(_REQUEST, "pages"))
def request_echo(spark: SparkSession, d: str) -> DataFrame:
    return _replies(requests.respond(_requests(spark, d)))


@query(_reply_sql(_REQUEST, "pages"))
def request_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same requests as they arrive in a folder, five files at once at most, answered by a stream."""
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    arriving = _requests(spark, d)
    arriving.repartition(12).write.parquet(f"{folder}/in")
    requests.serve_files(spark, f"{folder}/in", arriving.schema, f"{folder}/out")
    return _replies(spark.read.parquet(f"{folder}/out"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def running_count(spark: SparkSession, d: str) -> DataFrame:
    return counters.drain_counts(spark, f"{d}/events.parquet", "event_type")


@query("SELECT l_orderkey, count(*) AS n_tasks, count(*) = max(l_linenumber) AS complete FROM lineitem GROUP BY 1")
def task_completion(spark: SparkSession, d: str) -> DataFrame:
    return reports.task_completion(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) FILTER (regexp_matches(o_orderpriority, '^[12]')) AS n FROM orders")
def matching_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.matching_lines(table(spark, d, "orders"), "^[12]", "o_orderpriority")


@query("SELECT vec_id, count(*) AS n_dims, round(sum(x), 5) AS total FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def explode_collect(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    lists = flat.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["x"].cast("double"))
    return lists.select("vec_id", F.size("l").cast("long").alias("n_dims"), F.round(total, 5).alias("total"))


@query("SELECT i AS pos, (i * 7919 + 13) % n AS v FROM (SELECT unnest(range(0, (SELECT count(*) FROM part))) AS i), (SELECT count(*) AS n FROM part)")
def arithmetic_ints(spark: SparkSession, d: str) -> DataFrame:
    return generators.arithmetic_ints(spark, table(spark, d, "part").count())


@query(
    "WITH n AS (SELECT count(*) AS n FROM supplier), g AS (SELECT i, CAST(unnest(range(0, 50 + i % 51)) AS BIGINT) AS j FROM (SELECT unnest(range(0, (SELECT n FROM n))) AS i)), "
    "e AS (SELECT i AS src, (i * 31 + j * j * 17 + j + 1) % n AS dst FROM g, n), k AS (SELECT * FROM e WHERE src <> dst), u AS (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k) "
    "SELECT src AS v, count(*) AS degree, min(dst) AS least, max(dst) AS most FROM u GROUP BY 1"
)
def random_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    edges = generators.arithmetic_multigraph(spark, table(spark, d, "supplier").count())
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"), F.min("dst").alias("least"), F.max("dst").alias("most"))


@query(
    "WITH b AS (SELECT i, k, CAST((i * 7 + k * 3 + i * k) % 10 + 1 AS DOUBLE) AS b FROM (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS i), (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS k)) "
    "SELECT p.i, q.i AS j, sum(p.b * q.b) AS a FROM b p JOIN b q USING (k) GROUP BY 1, 2"
)
def spd_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrices.gram(generators.arithmetic_factor(spark, 12))


@query("SELECT g AS graph_id, count(*) AS n_edges FROM (SELECT unnest(range(0, 3)) AS g), (SELECT unnest(range(0, 60)) AS i) GROUP BY 1")
def graph_files(spark: SparkSession, d: str) -> DataFrame:
    """Graph files written and read again: 3 graphs of 20 nodes with 3 edge lines each."""
    from ..sources import graph_files as files

    edges, nodes = generators.three_out_graph(spark, 20, distinct=False)
    graphs_ = spark.range(3).select(F.col("id").alias("graph_id"))
    folder = files.write_graphs(edges.crossJoin(F.broadcast(graphs_)), nodes.crossJoin(F.broadcast(graphs_)))
    return files.read_graphs(spark, folder, 3)[0].groupBy("graph_id").agg(F.count("*").alias("n_edges"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IS NOT NULL")
def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended to a tab-separated result in two steps and read again."""
    from ..sources import result_files as files

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    folder = files.new_folder(spark)
    files.append_rows(o.filter("o_orderkey % 2 = 0"), folder)
    files.append_rows(o.filter("o_orderkey % 2 = 1"), folder)
    return files.read_rows(spark, folder, o.schema)


@query("SELECT n_regionkey AS graph_id, count(*) AS total FROM nation GROUP BY 1")
def totals_by_file(spark: SparkSession, d: str) -> DataFrame:
    return reports.total_by(table(spark, d, "nation").withColumnRenamed("n_regionkey", "graph_id"), "graph_id")


@query(f"SELECT c_custkey, CAST(t - 1 AS INTEGER) AS part FROM (SELECT c_custkey, ntile({PARTS}) OVER (ORDER BY c_custkey) AS t FROM customer)")
def balanced_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    return c.select("c_custkey", partitioning.split_balanced(F.col("c_custkey"), c.count(), PARTS).alias("part"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS running FROM lineitem")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    """A running count inside each class."""
    return sorting.running_offsets(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n_tasks, CAST(sum(n + 1) AS DOUBLE) AS total FROM (SELECT unnest(range(0, 1000)) AS n)")
def task_pool(spark: SparkSession, d: str) -> DataFrame:
    """A thousand tasks that each add one."""
    return tasks.completed(tasks.run_tasks(spark, 1000, lambda i: i + 1))


@query(f"SELECT CAST(w AS INTEGER) AS worker, CAST((w + 1) * 1000 // {PARTS} - w * 1000 // {PARTS} AS BIGINT) AS n_tasks, TRUE AS in_order FROM (SELECT unnest(range(0, {PARTS})) AS w)")
def task_log(spark: SparkSession, d: str) -> DataFrame:
    """What each worker's log says of a thousand tasks: how many it ran, and that each ended after it had started."""
    log = tasks.logged_tasks(spark, 1000, lambda i: i + 1, PARTS)
    return log.groupBy("worker").agg(F.count("*").alias("n_tasks"), F.bool_and(F.col("ended_ns") >= F.col("started_ns")).alias("in_order"))


@query("SELECT count(*) AS n, sum(v) AS total, count(DISTINCT v) AS n_distinct FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS v)")
def shuffled_permutation(spark: SparkSession, d: str) -> DataFrame:
    """A seeded shuffle keeps every number once."""
    p = generators.permutation(spark, table(spark, d, "customer").count())
    return p.agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.count_distinct("v").alias("n_distinct"))


@query("SELECT p_size, count(*) AS n_brands, min(p_brand) AS first_brand FROM (SELECT DISTINCT p_size, p_brand FROM part) GROUP BY 1")
def union_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Local results concatenated, then made distinct."""
    p = table(spark, d, "part").select("p_size", "p_brand")
    merged = reports.union_distinct(p.filter("p_size % 2 = 0"), p.filter("p_size % 2 = 1"), p.filter("p_size = 7"))
    return merged.groupBy("p_size").agg(F.count("*").alias("n_brands"), F.min("p_brand").alias("first_brand"))
