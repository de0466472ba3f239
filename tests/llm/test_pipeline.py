"""Every stage of the pipeline against a brute-force version of it, on all documents of the smallest tables."""

import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def split(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def stages(spark):
    """(rows before, rows after) of each stage, as {doc_id: (text, source)}; the last one's rows after."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, out = docs.columns, {}
    now = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    assert len(now) == docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        assert docs.columns == columns
        rows = docs.collect()
        after = {r.doc_id: (r.text, r.source) for r in rows}
        assert len(after) == len(rows)
        out[name] = (now, after)
        now = after
    out["encoding"] = (now, corpus_pipeline.encode(spark, docs, DATA).collect())
    return out


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(1, "", None, "", 0), (2, None, "en", "a", None)]])
def test_empty_tables_and_nulls(spark, tmp_path, rows):
    """No row is left of either, and nothing fails on the way; a null-ridden row beside good ones changes nothing."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some text of an item"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:  # later stages by themselves, where such rows haven't gone before
        assert stage(spark, docs, str(tmp_path)).count() <= len(rows)


def test_quality(stages):
    before, after = stages["quality rules"]
    failed, hosts = {}, {}
    for i, (text, source) in before.items():
        w = (text or "").encode().split()
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed[i] = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        hosts.setdefault(source or "", []).append(failed[i])
    rates = np.array([np.mean(x) for x in hosts.values()])
    m, noise = rates.mean(), np.mean([1 / len(x) for x in hosts.values()])
    v = (rates.var() - m * (1 - m) * noise) / (1 - noise)
    weight = max(1, min(1e6, m * (1 - m) / v - 1)) if v > 1e-12 else 1e6
    bad = {h for h, x in hosts.items() if (sum(x) + m * weight) / (len(x) + weight) > 0.5}
    assert after == {i: x for i, x in before.items() if not failed[i] and (x[1] or "") not in bad}


def test_near_duplicates(stages):
    """Components of exact similarities of five-word shingle sets, every two documents compared."""
    before, after = stages["near duplicates"]
    sets = {}
    for i, (text, _) in before.items():
        w = split(text)
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and root[i] != root[j] and (not sets[i] | sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert after == {i: before[i] for i in set(root.values())}


def test_repeats(stages):
    before, after = stages["repeats"]
    texts = {i: (x[0] or "").encode() for i, x in before.items()}
    counts = Counter(hash(t[k : k + 200]) for t in texts.values() for k in range(len(t) - 199))
    maybe = {i: [k for k in range(len(t) - 199) if counts[hash(t[k : k + 200])] > 1] for i, t in texts.items()}
    exact = Counter(texts[i][k : k + 200] for i, places in maybe.items() for k in places)
    wanted = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in maybe[i]:
            if exact[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left, k = [], 0
        while k < len(t):  # a character goes if all of its bytes do
            end = k + 1
            while end < len(t) and t[end] & 0xC0 == 0x80:
                end += 1
            if not gone[k:end].all():
                left.append(t[k:end])
            k = end
        kept = b"".join(left).decode()
        if not gone.any() or kept.strip():
            wanted[i] = kept
    assert {i: x[0] or "" for i, x in after.items()} == wanted


def occurs(item, text, budget):
    """Whether item stands in text with at most budget edits (Sellers' algorithm, whole table)."""
    size = len(item) // (budget + 1)
    if not any(item[k * size : (k + 1) * size] in text for k in range(budget + 1)):
        return False  # of budget + 1 pieces, one would stand there untouched
    t, ramp = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    d = np.zeros(len(t) + 1, np.int64)
    for c in item:
        n = d + 1
        n[1:] = np.minimum(n[1:], d[:-1] + (t != c))
        d = np.minimum.accumulate(n - ramp) + ramp
    return d.min() <= budget


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [b" ".join(split(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text]
    budgets = [min(int(0.05 * len(x)), (len(x) - 12) // 12) for x in items]
    assert items and min(map(len, items)) >= 12
    wanted = {i: x for i, x in before.items() if not any(occurs(m, b" ".join(split(x[0])), k) for m, k in zip(items, budgets))}
    assert after == wanted


def test_encoding(stages):
    before, rows = stages["encoding"]
    assert {r.doc_id for r in rows} == set(before) and len(rows) == len(before)
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.ids) and r.n_chars == len(before[r.doc_id][0] or "")
