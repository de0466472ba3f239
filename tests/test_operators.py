"""Kernels against small models of their own, and edge cases."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone.operators import graphs, matrices, partitioning, reports, sorting
from lodestone.sources import generators, graph_files, result_files
from lodestone.streaming import counters, requests


def array(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, v long")


def values(df):
    return [r.v for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("data", [[], [5], [3, 3, 3], list(range(9)), list(range(9))[::-1], [4, 1, 4, 0, 2, 7, 7, 1, 3, 6, 5]])
def test_bottom_up_sort(spark, data):
    assert values(sorting.bottom_up_sort(array(spark, data), len(data))) == sorted(data)


def test_stable_sort_keeps_order(spark):
    rows = sorting.stable_sort(array(spark, [2, 1, 2, 1]), "v", "pos").collect()
    assert [(r.v, r.pos) for r in rows] == [(1, 1), (1, 3), (2, 0), (2, 2)]


def test_with_position_is_global(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    rows = sorting.with_position(df, ["k"]).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_ranges_grow_with_the_rows(spark):
    assert [sorting.radix_parts(n) for n in (0, 10, 10**8, 10**10)] == [64, 64, 100, 10_000]
    rows = sorting.radix_pass(array(spark, [1, 0, 3, 2, 5]), 0, parts=2).orderBy("pos").collect()
    assert [r.new_pos for r in rows] == [2, 0, 3, 1, 4]
    assert [tuple(r) for r in sorting.merge_tasks(spark, 5).orderBy("run").collect()] == [(1, 3), (2, 2), (4, 1)]


def test_digits_of_several_bits(spark, monkeypatch):
    """Ranges and digits of any size give the stable order."""
    data = [37, 5, 5, 1023, 0, 512, 37, 64, 8, 7, 6, 5, 900, 901, 5]
    for width, parts in ((1, 3), (3, 2), (4, 7), (10, 1)):
        rows = sorting.radix_pass(array(spark, data), 2, parts=parts, width=width).orderBy("new_pos").collect()
        places = sorted(range(len(data)), key=lambda i: data[i] >> 2 & (1 << width) - 1)
        assert [(r.pos, r.v, r.new_pos) for r in rows] == [(i, data[i], at) for at, i in enumerate(places)]
    monkeypatch.setattr(sorting, "CELLS", 64 * 5)  # two bits a pass
    assert values(sorting.radix_sort(array(spark, data))) == sorted(data)


def test_radix_sort(spark):
    data = [6, 0, 5, 3, 2, 4, 1]
    assert values(sorting.radix_sort(array(spark, data))) == sorted(data)
    assert values(sorting.radix_sort(array(spark, []))) == []
    with pytest.raises(ValueError):
        sorting.radix_sort(array(spark, [1, -1]))


@pytest.mark.parametrize("n,parts", [(0, 3), (1, 3), (2, 3), (7, 3), (9, 3), (10, 4)])
@pytest.mark.parametrize("how", ["floor", "balanced", "ceil"])
def test_splits_cover_and_are_disjoint(spark, n, parts, how):
    rows = partitioning.bounds(spark, n, parts, how).orderBy("part").collect()
    assert [x for r in rows for x in range(r.start, r.stop)] == list(range(n))
    part = partitioning.SPLITS[how]
    got = spark.range(n).select("id", part(F.col("id"), n, parts).alias("p")).collect() if n else []
    assert all(rows[r.p].start <= r.id < rows[r.p].stop for r in got)


def test_bits(spark):
    row = spark.createDataFrame([(0,), (36,), (-1,)], "n long").select(fn.bit_length("n").alias("b"), fn.kth_bit("n", 2).alias("k")).collect()
    assert [r.b for r in row] == [0, 6, None]
    assert row[1].k == 1


def test_atoi(spark):
    texts = ["12abc", " -7", "x", "", None, "99999999999", "+3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.atoi("t").alias("n")).collect()
    assert [r.n for r in rows] == [12, -7, 0, 0, 0, 0, 3]


def test_response_is_cut(spark):
    texts = ["GET /", "x" * 5000, None, "é" * 3000, "a\x00b", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    out = [bytes(r.response) for r in requests.respond(rows).collect()]
    wanted = []
    for t in texts:
        if t is not None:
            read = t.encode()[:4095]
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Length: {len(read)}\r\nConnection: close\r\n\r\n".encode()
            wanted.append((head + read.split(b"\0")[0])[:4095])
    assert out == wanted and len(out[1]) == len(out[2]) == 4095


def test_requests_arrive_in_a_folder(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"GET /{i}" if i % 4 else None) for i in range(24)], "id long, value string")
    frame.repartition(12).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # what has been answered isn't answered again
        requests.serve_files(spark, f"{tmp_path}/in", frame.schema, f"{tmp_path}/out", backlog=5)
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [i for i in range(24) if i % 4]


def test_requests_come_from_a_connection(spark, tmp_path):
    """Lines of a socket are answered as they come; the source ends with the connection."""
    import socket
    import threading
    import time

    server = socket.create_server(("localhost", 0))

    def send():
        peer, _ = server.accept()
        peer.sendall(b"GET /a\nGET /b\n")
        time.sleep(8)
        peer.close()

    sender = threading.Thread(target=send, daemon=True)
    sender.start()
    stream = requests.respond(requests.listen(spark, "localhost", server.getsockname()[1]))
    running = stream.writeStream.format("memory").queryName("replies").option("checkpointLocation", f"{tmp_path}/state").start()
    for _ in range(60):
        if spark.table("replies").count() == 2:
            break
        time.sleep(0.5)
    running.stop()
    server.close()
    assert sorted(r.value for r in spark.table("replies").collect()) == ["GET /a", "GET /b"]


def bfs_model(edges, start):
    level, now = {start: 0}, [start]
    while now:
        after = []
        for v in now:
            for a, b in edges:
                if a == v and b not in level:
                    level[b] = level[v] + 1
                    after.append(b)
        now = after
    return level


@pytest.mark.parametrize("edges", [[], [(0, 0)], [(0, 1), (1, 2), (2, 0), (0, 1)], [(3, 4)], [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (5, 6)]])
def test_bfs(spark, edges):
    both = edges + [(b, a) for a, b in edges]
    df = graphs.undirected(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.v: r.level for r in graphs.bfs_levels(df, 0).collect()} == bfs_model(both, 0)
    assert graphs.bfs_count(df, 0).first().visited == len(bfs_model(both, 0))


def rank_model(edges, n, threshold=None, steps=None):
    m = np.zeros((n, n))
    for a, b in edges:
        m[a, b] = 1
    count = (m > 0.5).sum(0)
    m = m / np.where(count == 0, 1, count)
    e, acc, error, k = np.ones(n), np.zeros(n), 1e5, 0
    with np.errstate(all="ignore"):
        while error > threshold if steps is None else k < steps:
            s = acc + m @ e
            new = s / np.sqrt((s * s).sum())
            error = np.sqrt(((new - e) ** 2).sum())
            e = acc = new
            k += 1
        return e / e.sum()


@pytest.mark.parametrize("edges,n", [([(0, 1), (0, 2), (1, 0), (2, 0)], 3), ([(0, 0), (0, 1), (0, 1), (2, 1)], 4), ([(i, (i * 5 + j) % 7) for i in range(7) for j in range(3)], 7)])
def test_rank(spark, edges, n):
    df, nodes = spark.createDataFrame(edges, "src long, dst long"), spark.range(n).withColumnRenamed("id", "v")
    for rows in (graphs.GRAPH_ROWS, 0):  # by one task, and by joins
        got = [r["rank"] for r in graphs.rank(df, nodes, iterations=4, graph_rows=rows).orderBy("v").collect()]
        assert np.allclose(got, rank_model(edges, n, steps=4))
        got = [r["rank"] for r in graphs.rank(df, nodes, threshold=1e-3, graph_rows=rows).orderBy("v").collect()]
        assert np.allclose(got, rank_model(edges, n, threshold=1e-3))


def test_ranks_that_do_not_settle_are_an_error(spark):
    edges, nodes = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2)], "src long, dst long"), spark.range(3).withColumnRenamed("id", "v")
    for rows in (graphs.GRAPH_ROWS, 0):
        with pytest.raises(Exception, match="still over"):
            graphs.rank(edges, nodes, threshold=1e-12, max_iterations=2, graph_rows=rows).collect()


def test_over_a_million_edges_go_by_one_task(spark, monkeypatch):
    """Some 1,500 steps of a graph of that size, each written and read, were more than any run's time."""
    monkeypatch.setattr(graphs, "cut_lineage", None)
    n = 600_000
    nodes = spark.range(n).withColumnRenamed("id", "v")
    edges = nodes.select(F.col("v").alias("src"), F.explode(F.array(*[(F.col("v") * 7 + j) % n for j in range(2)])).alias("dst"))
    rows = graphs.rank(edges, nodes, threshold=1e-3).agg(F.count("*").alias("n"), F.sum("rank").alias("total"), F.max("rank").alias("most")).first()
    assert rows.n == n and math.isclose(rows.total, 1) and math.isclose(rows.most, 1 / n)


@pytest.mark.parametrize("diagonal", [1, 3, 1024])
def test_sums_over_edges_by_diagonals_and_stretches(monkeypatch, diagonal):
    """Hubs, nodes without edges, ends that are no nodes (they count in in-degrees), rows in any order."""
    monkeypatch.setattr(graphs, "DIAGONAL", diagonal)
    draw = np.random.default_rng(diagonal)
    for n in (1, 2, 9, 60):
        pairs = {(int(a), int(b)) for a, b in draw.integers(-1, n + 2, (3 * n, 2))} | {(0, b) for b in range(n)} | {(a, n - 1) for a in range(0, n, 2)}
        ids = draw.permutation(n)
        rows = draw.permutation(sorted(pairs))
        edges = pa.table({"graph_id": [0] * len(rows), "src": rows[:, 0], "dst": rows[:, 1]})
        x = draw.random(n)
        steps = graphs._Steps(edges, pa.table({"graph_id": [0] * n, "v": ids}))
        s, e = np.zeros(n), np.empty(n)
        e[steps.place] = x[ids]
        steps.add(e, s)
        count = Counter(b for _, b in pairs)
        wanted = [sum(x[b] / count[b] for a, b in pairs if a == v and 0 <= b < n) for v in ids]
        assert np.allclose(s[steps.place], wanted)


def test_graphs_end_on_their_own_and_zero_is_nan(spark):
    star = [(0, 1), (0, 2), (1, 0), (2, 0)]
    edges = spark.createDataFrame([(0, a, b) for a, b in star], "graph_id long, src long, dst long")
    nodes = spark.createDataFrame([(0, v) for v in range(3)] + [(1, 0), (1, 1)], "graph_id long, v long")
    edges = edges.unionByName(spark.createDataFrame([(0, 9, 1), (0, 1, 9), (3, 0, 1), (0, None, 1)], "graph_id long, src long, dst long"))  # ends that are no nodes
    for most in (graphs.GRAPH_ROWS, 0):
        rows = graphs.rank_graphs(edges.filter("graph_id = 0 and src < 9 and dst < 9"), nodes, threshold=1e-6, graph_rows=most).collect()
        one = [r["rank"] for r in sorted((r for r in rows if r.graph_id == 0), key=lambda r: r.v)]
        assert np.allclose(one, rank_model(star, 3, threshold=1e-6)) and np.allclose(one, [0.5, 0.25, 0.25])
        assert all(math.isnan(r["rank"]) for r in rows if r.graph_id == 1) and len(rows) == 5
    both = [sorted((r.graph_id, r.v, round(r["rank"], 9)) for r in graphs.rank_graphs(edges, nodes, iterations=3, graph_rows=most).collect() if r.graph_id == 0) for most in (graphs.GRAPH_ROWS, 0)]
    assert both[0] == both[1] and len(both[0]) == 3


def gram_model(spark, folder):
    x = np.array([r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()], np.float64)
    return x.T @ x


def test_queries_factor_all_components(spark, tmp_path):
    from lodestone.plans import catalogue

    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in draw.normal(size=64)]) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = np.linalg.cholesky(gram_model(spark, tmp_path))
    for name in ("cholesky", "cholesky_dense"):
        got = {(r.i, r.j): r.l for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(got) == 64 * 65 // 2 and all(abs(l - wanted[k]) < 1e-5 for k, l in got.items())


def test_gram_of_short_and_missing_vectors(spark):
    frame = spark.createDataFrame([([1.0, 2.0],), ([3.0],), (None,), ([None, 1.0],)], "v array<double>")
    got = {(r.i, r.j): r.a for r in matrices.gram_of_vectors(frame, "v", 2).collect()}
    assert got == {(0, 0): 10.0, (0, 1): 2.0, (1, 0): 2.0, (1, 1): 5.0}


def test_random_matrices_and_vectors(spark):
    cells = generators.random_factor(spark, 6)
    assert cells.count() == 36 and {r.b for r in cells.collect()} <= {float(x) for x in range(1, 11)}
    assert [tuple(r) for r in generators.constant_vector(spark, 3, 1).orderBy("v").collect()] == [(0, 1.0), (1, 1.0), (2, 1.0)]


@pytest.mark.parametrize("n", [1, 2, 6])
def test_cholesky(spark, n):
    a = matrices.gram(generators.arithmetic_factor(spark, n)).withColumn("a", F.col("a") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).cache()
    dense = np.zeros((n, n))
    for r in a.collect():
        dense[r.i, r.j] = r.a
    for lower in (matrices.factor_relational(a, n), matrices.factor_relational(a, n, block=1), matrices.factor_relational(a, n, block=4), matrices.factor_many(a.withColumn("matrix_id", F.lit(1).cast("long"))).drop("matrix_id")):
        got = np.zeros((n, n))
        for r in matrices.densify(lower, n).collect():
            got[r.i, r.j] = r.l
        assert np.allclose(got @ got.T, dense) and np.allclose(np.triu(got, 1), 0)


def test_cholesky_of_indefinite_is_nan(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 1.0)], "i int, j int, a double")
    for block in (1, 2):
        rows = {(r.i, r.j): r.l for r in matrices.factor_relational(a, 2, block).collect()}
        assert rows[0, 0] == 1 and rows[1, 0] == 2 and math.isnan(rows[1, 1])
    dense = {(r.i, r.j): r.l for r in matrices.factor_many(a.withColumn("matrix_id", F.lit(7).cast("long"))).collect()}
    assert dense[0, 0] == 1 and dense[1, 0] == 2 and math.isnan(dense[1, 1])


def test_reports(spark):
    runs = spark.createDataFrame([(1, "a", 2, 1e9), (1, "a", 2, 3e9), (1, "b", 2, None), (2, "a", 4, 5e8)], "size int, program_name string, num_threads int, time double").withColumn("o", F.monotonically_increasing_id())
    assert {(r["size"], r.program_name): r["mean"] for r in reports.mean_runs(runs, ["size", "program_name"]).collect()} == {(1, "a"): 2e9, (2, "a"): 5e8}
    pivot = {r["size"]: (r.a, r.b) for r in reports.first_value_pivot(runs, "size", "program_name", ["a", "b"], "time", "o").collect()}
    assert pivot == {1: ("1.000000", ""), 2: ("0.500000", "")}
    assert reports.split_by_threads(runs, 4)[0].count() == 1
    failed = spark.createDataFrame([(-1.0,), (-1.0,)], "latency double")
    assert tuple(reports.latency_summary(failed).first()) == (None, 0, 2, None)


def test_logs(spark):
    logs = spark.createDataFrame([("x\nPERFDATA,10,serial,1,2,3,400.75\nPERFDATA,9,b,1,1,1,1",), ("nothing",), ("PERFDATA,10,,1,2,3,4",)], "value string")
    first, *others = reports.scan_perf_log(logs).collect()
    assert (first.array_size, first.program_name, first.time) == (10, "serial", 400.75)
    assert all(r.array_size is None and r.time is None for r in others)
    lines = ["serial traversal time: 12 ns", "", "BFS traversal time:  123456789.250000 ns\n", "traversal time: x ns"]
    times = reports.scan_traversal_log(spark.createDataFrame([(t,) for t in lines], "value string")).collect()
    assert [r.time for r in times] == [12.0, None, 123456789.25, None]


def test_sizes_and_small_outputs(spark):
    sizes = spark.createDataFrame([(-1,), (0,), (5,), (10**8 + 1,), (None,)], "n long")
    assert [r.n for r in reports.valid_sizes(sizes, "n", 10**8).collect()] == [5] and reports.valid_sizes(sizes, "n").count() == 2
    assert reports.small_output(sizes, 5) is sizes and reports.small_output(sizes, 101) is None


def test_graph_files(spark, tmp_path):
    (tmp_path / "0.txt").write_text("3\n0 1\n1 2\nEND")
    (tmp_path / "1.txt").write_text("2\n1 1\nEND\n5 5\n")
    (tmp_path / "7.txt").write_text("1\nEND")
    edges, sizes = graph_files.read_graphs(spark, f"file://{tmp_path}", 2)
    assert sorted(map(tuple, edges.collect())) == [(0, 0, 1), (0, 1, 2), (1, 1, 1)]
    assert sorted(map(tuple, sizes.collect())) == [(0, 3), (1, 2)]


def test_result_files(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    rows = spark.createDataFrame([(1, "a", 2, 3, 4, 5.0)], result_files.MEASUREMENT)
    result_files.append_rows(rows, folder)
    result_files.append_rows(rows, folder)
    assert result_files.read_rows(spark, folder, result_files.MEASUREMENT).count() == 2
    pivot = spark.createDataFrame([(20, "", "1.5"), (3, "2.0", "")], "size int, a string, b string")
    result_files.write_pivot(pivot, f"file://{tmp_path}/p", "size")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/p").collect()]
    assert lines == ["size\ta\tb", "3\t2.0\t", "20\t\t1.5"]
    result_files.write_texts(spark.createDataFrame([(1, "x"), (2, "y")], "n int, value string"), f"file://{tmp_path}/t", "n")
    assert spark.read.text(f"file://{tmp_path}/t").count() == 2


def test_generators(spark):
    assert sorted(r.v for r in generators.permutation(spark, 50).collect()) == list(range(50))
    edges = generators.random_multigraph(spark, 20).collect()
    assert all(e.src != e.dst for e in edges)
    from collections import Counter

    degrees = Counter(e.src for e in edges)
    assert all(50 <= degrees[v] for v in range(20)) and len(edges) % 2 == 0
    back = Counter((e.dst, e.src) for e in edges)
    assert back == Counter((e.src, e.dst) for e in edges)
    drawn, nodes = generators.random_three_out(spark, 3, 5, 9)
    assert drawn.count() == 3 * nodes.count()
    assert all(0 <= r.v < 30 for r in generators.uniform_ints(spark, 30).collect())


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "k string").repartition(2).write.parquet(f"{tmp_path}/in")
    assert {r.k: r.n for r in counters.drain_counts(spark, f"{tmp_path}/in", "k").collect()} == {"a": 2, "b": 1}


def test_tasks(spark):
    from lodestone.operators import tasks

    assert tuple(tasks.completed(tasks.run_tasks(spark, 10, lambda i: 1, 3)).first()) == (10, 10.0)
    assert tuple(tasks.completed(tasks.run_tasks(spark, 0, lambda i: 1)).first()) == (0, None)


def test_task_log(spark, tmp_path):
    from lodestone.operators import tasks

    log = tasks.logged_tasks(spark, 10, lambda i: 2 * i, 3).withColumn("line", F.format_string("worker %d task %d", "worker", "task_id"))
    rows = log.collect()
    assert sorted(r.task_id for r in rows) == list(range(10)) and all(r.ended_ns >= r.started_ns and r.result == 2 * r.task_id for r in rows)
    result_files.write_texts(log, f"file://{tmp_path}/log", "worker", "line")
    assert spark.read.text(f"file://{tmp_path}/log").count() == 10


def test_settings(spark, monkeypatch):
    from lodestone.session import setting

    monkeypatch.setenv("WAIT_POLICY", "active")
    assert setting(spark, "WAIT_POLICY") == "active" and setting(spark, "none.such", "x") == "x" and setting(spark, "spark.sql.session.timeZone") == "UTC"


def test_clocks(spark):
    row = spark.createDataFrame([(1, 999_999_999, 3, 1)], "a long, b long, c long, d long").select(fn.elapsed_ns("a", "b", "c", "d").alias("ns")).first()
    assert row.ns == 1_000_000_002


def test_lists(spark):
    edges = spark.createDataFrame([(0, 2), (0, 1), (0, 1), (1, 0)], "src long, dst long")
    lists = graphs.adjacency(edges)
    assert {r.v: r.neighbors for r in lists.collect()} == {0: [1, 1, 2], 1: [0]}
    assert sorted(map(tuple, graphs.edges_of(lists).collect())) == sorted(map(tuple, edges.collect()))


def test_pagerank_threshold_runs_to_its_fixpoint(spark, tmp_path):
    """The registered query over a table of five parts, against the same loop in numpy."""
    from lodestone.plans import catalogue

    n = 5
    spark.range(n).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    m = np.zeros((n, n))
    for a, b in {(i, (i * i + j * i) % n) for i in range(n) for j in range(3)}:
        m[a, b] = 1
    m = m / np.maximum(m.sum(axis=0), 1)
    old, x, acc = np.full(n, np.inf), np.ones(n), np.zeros(n)
    while np.linalg.norm(x - old) > 1e-6:
        s = acc + m @ x
        old, x = x, s / np.linalg.norm(s)
        acc = x
    got = {r.v: r["rank"] for r in catalogue.pagerank_threshold(spark, str(tmp_path)).collect()}
    assert len(got) == n and all(abs(got[i] - x[i] / x.sum()) < 1e-5 for i in range(n))


def test_bit_histogram_has_all_bits_of_the_keys(spark, tmp_path):
    from lodestone.plans import catalogue

    keys = [0, 5, 2**18, 2**40 + 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.k, r.bit): r.n for r in catalogue.bit_histogram(spark, str(tmp_path)).collect()}
    wanted = {(k, b): sum(x >> k & 1 == b for x in keys) for k in range(41) for b in (0, 1)}
    assert got == {k: n for k, n in wanted.items() if n}
