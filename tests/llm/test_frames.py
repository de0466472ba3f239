"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import os
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_formatting, decontamination, lm_scoring, piece_coding, quality_rules, queries, sharding, simhash_dedup, suffix_dedup, token_counts, url_filters

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __t string, __f0 long, component_id string, kept string, n_bytes string, __host string, shard string"
PROSE = " ".join(f"word{i * i % 97} and{i}" for i in range(120))
ROWS = [
    (1, PROSE, "en", "a", 1),
    (2, PROSE, "en", "a", 1),
    (2, PROSE, "en", "a", 1),
    (3, PROSE.replace("word9 ", "changed "), "en", "b", 1),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n", "en", "b", 3),
    (None, "only a few words here", "en", None, 1),
    (8, "a" * 3000, "en", "c", 3000),
    (9, "ééé 漢字 " * 400, "en", "c", 3000),
    (10, "line one\nline one\nline two\n\n" * 30, "en", "c", 3000),
    (11, "x" + PROSE[50:700] + "y", "en", "c", 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + ("t", 5, "c", "k", "n", "h", "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w]


def without_repeats(rows):
    """(key, bytes, bytes removed, stretches, hash of what is left) of (key, text) rows, by counting all windows."""
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(hash(t[i : i + 200]) for t in texts for i in range(len(t) - 199))
    doubtful = [[i for i in range(len(t) - 199) if counts[hash(t[i : i + 200])] > 1] for t in texts]
    exact = Counter(t[i : i + 200] for t, places in zip(texts, doubtful) for i in places)
    out = []
    for (key, _), t, places in zip(rows, texts, doubtful):
        spans = []
        for i in places:
            if exact[t[i : i + 200]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 200
                else:
                    spans.append([i, i + 200])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        out.append((str(key), len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + t[at:]).hexdigest()))
    return sorted(out)


def found_repeats(docs, **how):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.find_repeats(docs, **how).collect())


def test_suffix_dedup(docs, empty):
    wanted = without_repeats([r[:2] for r in ROWS])
    for hot in (50_000, 1):
        for bits in (64, 0):  # with 0 all segments of a gram share their hash: only bytes tell them
            assert found_repeats(docs, hot=hot, hash_bits=bits) == wanted
    assert suffix_dedup.find_repeats(empty).collect() == []
    left = suffix_dedup.drop_repeats(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {4, 5, 6, None} and suffix_dedup.drop_repeats(empty).count() == 0


def test_larger_sides_are_shuffled(spark, docs, monkeypatch):
    """The ways above the bounds of what is broadcast give the same rows."""
    from lodestone.llm import _shared

    def rows():
        frames = suffix_dedup.find_repeats(docs), suffix_dedup.drop_repeats(docs), simhash_dedup.near_duplicates(docs), simhash_dedup.keep_one(docs), quality_rules.judge_documents(docs), sharding.shard_documents(docs, 2000)
        return [sorted(str(tuple(x for k, x in r.asDict().items() if k not in ("shard", "shard_bytes", "depth"))) for r in f.collect()) for f in frames]

    small = rows()
    for module in (suffix_dedup, simhash_dedup, sharding):
        monkeypatch.setattr(module, "KEY_ROWS", -1)
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", -1)
    assert rows() == small


def test_suffix_dedup_tells_segments_by_their_bytes(spark):
    """One passage in many surroundings, some texts that are the same or nearly so, and many rows of one key and text."""
    rng = np.random.default_rng(17)

    def prose(n):
        return " ".join(f"{x:x}" for x in rng.integers(0, 10**6, n))

    passage, other = prose(60), prose(300)
    rows = [(i, prose(20) + " " + passage[: 150 + 4 * (i % 40)] + " " + prose(20)) for i in range(60)]
    rows += [(100 + i, other[:700] + f" {i % 4} " + other[700:]) for i in range(12)] + [(200, prose(100))] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = without_repeats(rows)
    for hot in (5_000, 30, 3):
        for bits in (64, 1, 0):
            assert found_repeats(frame, hot=hot, hash_bits=bits) == wanted


@pytest.mark.parametrize("hot", [40, 10])
def test_suffix_dedup_of_a_passage_in_most_texts(spark, hot):
    """No row that a task sorts stands for one text: what the texts have in common comes once, with their number."""
    rng = np.random.default_rng(19)

    def noise(n):
        return "".join(chr(x) for x in rng.integers(97, 123, n))

    passage = noise(260)
    rows = [(i, noise(40) + passage + noise(40)) for i in range(80)]
    rows += [(100 + i, noise(30) + noise(7) + passage[:190] + noise(7) + noise(30)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_repeats(frame, hot=hot) == without_repeats(rows)
    wide = [(1, 5, 7 + i, 0, passage.encode(), 1) for i in range(80)]
    bodies = spark.createDataFrame(wide, "__q long, __g long, __c long, __shift int, __bytes binary, __w long")
    answers = suffix_dedup._dealt_answers(bodies, 200, hot).collect()
    assert {(r["__g"], r["__c"], tuple(r["__r"]), bytes(r["__body"])) for r in answers} == {(5, 7 + i, (0, 61), passage.encode()) for i in range(80)} and len(answers) == 80


def test_suffix_dedup_of_groups_too_large_to_sort(spark):
    """Strings of one dealt group that differ at their ends, more than may be sorted together, are counted by window."""
    rng = np.random.default_rng(20)
    shared = bytes(rng.integers(97, 123, 190).astype(np.uint8))
    ends = [bytes(rng.integers(97, 100, 12).astype(np.uint8)) for _ in range(60)]
    rows = [(9, 4, i, 0, e[:6] + shared + e[6:], 1 + i % 2) for i, e in enumerate(ends)]
    bodies = spark.createDataFrame(rows, "__q long, __g long, __c long, __shift int, __bytes binary, __w long")
    found = [{r["__c"]: {w for i in range(0, len(r["__r"]), 2) for w in range(r["__r"][i], r["__r"][i + 1])} for r in suffix_dedup._dealt_answers(bodies, 200, hot).collect()} for hot in (1_000, 5)]
    counts = Counter()
    for r in rows:
        for i in range(3):
            counts[r[4][i : i + 200]] += r[5]
    wanted = {r[2]: {i for i in range(3) if counts[r[4][i : i + 200]] > 1} for r in rows}
    assert found[0] == found[1] == {c: w for c, w in wanted.items() if w}


def test_suffix_dedup_of_very_long_texts(spark):
    """Over a million bytes around one gram, without white space, and a text that holds a part of itself far behind."""
    rng = np.random.default_rng(18)
    run = "".join(chr(x) for x in rng.integers(97, 123, 150_000))
    rows = [(1, "a" * 1_100_000 + "b"), (2, "a" * 400), (3, run + "c" + run[:60_000] + "".join(chr(x) for x in rng.integers(97, 123, 1_100_000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = without_repeats(rows)
    for hot in (5_000, 0):
        assert found_repeats(frame, hot=hot) == wanted


def test_suffix_dedup_merges_copies_before_they_meet(spark, monkeypatch):
    """Copies in many tasks of grams that have few segments: a row for each segment is sorted, not one for each task."""
    rng = np.random.default_rng(22)

    def noise(n):
        return "".join(chr(x) for x in rng.integers(97, 123, n))

    texts = [noise(400) for _ in range(3)]
    rows = [(i, texts[i % 3][: 400 - i % 2]) for i in range(90)] + [(100 + i, noise(250)) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    seen, sort = [], suffix_dedup._sorted_groups

    def counted(bodies, length):
        seen.append(bodies.count())
        return sort(bodies, length)

    monkeypatch.setattr(suffix_dedup, "_sorted_groups", counted)
    assert found_repeats(frame, hot=5_000) == without_repeats(rows)
    plain = seen[-1]
    assert found_repeats(frame, hot=12) == without_repeats(rows)
    assert seen[-1] < plain / 4


@pytest.mark.parametrize("hot", [5_000, 20, 0])
def test_suffix_dedup_of_short_periods(spark, hot):
    """Runs of one character and of short periods, of many lengths and alone, whose grams are hot or not."""
    rng = np.random.default_rng(21)

    def noise(n):
        return "".join(chr(x) for x in rng.integers(97, 123, n))

    rows = [(i, noise(30) + "-" * n + noise(30)) for i, n in enumerate([190, 199, 200, 201, 215, 216, 217, 240, 900, 1_300, 5_000])]
    rows += [(100 + i, noise(20) + unit * (n // len(unit)) + noise(20)) for i, (unit, n) in enumerate([("ab", 230), ("ab", 3_000), ("abcdefg", 2_500), (noise(20), 260), (noise(50), 2_000), (noise(190), 1_500)])]
    rows += [(200, "=" * 201), (201, "+" * 200), (202, noise(300)), (203, "é" * 700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_repeats(frame, hot=hot) == without_repeats(rows)


def test_simhash(docs, empty):
    import xxhash

    prints = []
    for r in ROWS:
        w = words(r[1])
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    reach = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(prints):
            reach[i] = min(reach[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4)
    label = {k: min((ROWS[i][0] for i in range(len(ROWS)) if reach[i] == k and ROWS[i][0] is not None), default=None) for k in reach}
    wanted = sorted((str(r[0]), f"{p:016x}", str(label[k])) for r, p, k in zip(ROWS, prints, reach))
    got = [(str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert sorted(got) == wanted
    assert simhash_dedup.near_duplicates(empty).collect() == []
    left = simhash_dedup.keep_one(docs)
    kept = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and len(kept) == len(set(kept))
    assert {1, 4, 8, None} <= set(kept) and not {2, 3, 5, 6} & set(kept)
    assert simhash_dedup.keep_one(empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Rows of one key, or of none, are kept apart by their texts."""
    other, third = (" ".join(f"{w}{i * i % 89}" for i in range(120)) for w in ("other", "third"))
    rows = [(1, PROSE), (1, other), (1, other), (2, PROSE), (None, third), (None, third), (None, PROSE), (None, other + " more"), (None, "blue " + third[:200]), (3, None), (3, ""), (None, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text or "") for r in simhash_dedup.keep_one(frame).collect()), key=str)
    assert kept == sorted([(1, PROSE), (1, other), (None, third), (None, "blue " + third[:200]), (3, "")], key=str)


def test_large_blocks_are_dealt(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    base = int(draw.integers(0, 2**62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 60, (300, 2))} | {int(x) for x in draw.integers(0, 2**62, 100)})
    frame = spark.createDataFrame([(v, v) for v in values], "__h long, __f0 long")
    from lodestone.llm.components import components

    labels = []
    for size in (4096, 16):
        links = simhash_dedup.link_fingerprints(frame, simhash_dedup.block_masks(4), 4, tile_rows=size)
        labels.append({(r.node, r.root) for r in components(links).collect()})
    assert labels[0] == labels[1] and len(labels[0]) > 200


def test_sharding(spark, docs, empty):
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("text"))
    rows = sharding.shard_documents(many, max_bytes=300).collect()
    total = Counter()
    for r in rows:
        digest = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        assert format(digest, "060b").startswith(r.shard) and r.depth == len(r.shard)
        total[r.shard] += r.n_bytes
    assert len(rows) == 500 and all(total[r.shard] == r.shard_bytes <= 300 for r in rows)
    names = set(total)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    # a shard is only as deep as it must be: with its sibling's subtree it is over the limit
    for name in names - {""}:
        assert sum(b for x, b in total.items() if x.startswith(name[:-1])) > 300
    tight = sharding.shard_documents(docs, max_bytes=2000).collect()
    assert len(tight) == len(ROWS) and {r.doc_id for r in tight if r.oversized} == {8, 9}
    same = spark.range(64).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    assert all(r.shard_bytes <= 300 for r in sharding.shard_documents(same, max_bytes=300).collect())
    assert sharding.shard_documents(empty).collect() == []


def test_shards_of_equal_keys_follow_their_texts(spark):
    """Not the order of the rows: texts of one key go to the same shards however the table is dealt."""
    rows = [(1, f"{i:03} " + "x" * 60) for i in range(100)]
    found = []
    for some in (rows, rows[::-1]):
        frame = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        made = sharding._assigned(frame.withColumn("n", F.substring("text", 1, 3).cast("long")), 500, "doc_id", "text", "n")
        found.append(sorted((r["__n"], r["__p"]) for r in made.collect()))
    assert found[0] == found[1] and len({p for _, p in found[0]}) > 10


def test_shards_deeper_than_the_sql_goes(spark):
    """The SQL stops at 20 bits and has no row for texts that need more; the operator has them all."""
    met, pair = {}, None
    for i in range(100_000):
        other = met.setdefault(hashlib.md5(str(i).encode()).hexdigest()[:5], i)
        if other != i:
            pair = [other, i]
            break
    rows = [(i, "x" * (1 << 15)) for i in range(40)] + [(i, "x" * 40_000) for i in pair]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), max_bytes=1 << 16).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows) and {r.doc_id for r in got if r.depth > 20} == set(pair)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversized"]
    wanted = con.sql(f"SELECT {', '.join(names)} FROM ({sharding.oracle(1 << 16)})").fetchall()
    assert sorted(wanted) == sorted(tuple(r[c] for c in names) for r in got if r.doc_id not in pair)


def test_shards_are_written(spark, docs, empty, tmp_path):
    shards = {r.shard: (r.n_docs, r.n_bytes) for r in sharding.write_shards(docs, f"{tmp_path}/s", 3000).collect()}
    assert len(shards) > 3 and sum(n for n, _ in shards.values()) == len(ROWS)
    for name, (n, size) in shards.items():
        (file,) = (tmp_path / "s" / f"shard_={name}").glob("*.parquet")  # docs has a column of that name
        part = spark.read.parquet(f"file://{file}")
        assert part.columns == docs.columns
        assert part.count() == n and sum(len((r.text or "").encode()) for r in part.collect()) == size
    assert sharding.write_shards(empty, f"{tmp_path}/none").collect() == []


def test_scores(docs, empty):
    tokens = [[*words(r[1]), None] for r in ROWS]
    held = [crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2 for r in ROWS]
    c = Counter(t for x, h in zip(tokens, held) if not h for t in x)
    n, v = sum(c.values()), len(c)
    wanted = sorted((str(r[0]), h, len(x), sum(c[t] > 0 for t in x), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x), 6)) for r, x, h in zip(ROWS, tokens, held))
    rows = lm_scoring.score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == wanted
    assert all(r.score < 0 for r in rows)
    assert lm_scoring.score_documents(empty).collect() == []


def test_token_counts(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(token_counts.RANKS.replace(".tiktoken", ".json"))
    theirs.encode_special_tokens = True
    lengths = sorted(len(theirs.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS)
    assert sorted(r.n_tokens for r in token_counts.document_lengths(docs).collect()) == lengths and lengths[:2] == [0, 0]
    table = token_counts.count_tokens(docs).cache()
    for r in table.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_over == sum(x > r.n_tokens for x in lengths) and r.tokens_over == sum(x for x in lengths if x > r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
    for limit in (0, 1, 7, 512, 10**6):
        assert token_counts.truncated_total(table, limit).first().tokens == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(table, 0.5).first().n_tokens == lengths[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.count_tokens(empty).collect() == [] and token_counts.truncated_total(token_counts.count_tokens(empty), 5).first().tokens == 0


def test_urls(spark):
    urls = ["https://A.example.ORG/en/12?x", "http://example.org/es/", "http://org/", "no host", None, "x://b.com/fr/1#y", "x://com/de/", "x://notexample.org/es/", "x://example.org?q", "://", "http://" + "a." * 500 + "com/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(2, urls[2], "h", "p")], "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host[:20], r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect())
    assert got == [
        (0, "a.example.org", "/en/12", "example.org/en/1", "block"),
        (1, "example.org", "/es/", "example.org/es/", "block"),
        (2, "org", "/", "org/", "allow"),
        (2, "org", "/", "org/", "allow"),
        (3, "", "", None, "allow"),
        (4, "", "", None, "allow"),
        (5, "b.com", "/fr/1", "com/fr/", "allow"),
        (6, "com", "/de/", "com/de/", "block"),
        (7, "notexample.org", "/es/", "org/", "allow"),
        (8, "example.org", "", None, "allow"),
        (9, "", "", None, "allow"),
        (10, ("a." * 500)[:20], "/fr/", "com/fr/", "allow"),
    ]
    assert url_filters.filter_urls(pages.limit(0)).collect() == []
    assert {r.verdict for r in url_filters.filter_urls(pages, rules=[]).collect()} == {"allow"}
    book = spark.createDataFrame([("Example.org", "/en/1", "block"), (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in url_filters.filter_urls(pages, rules=book).collect()} == {i: "block" if i in (0, 5, 6, 10) else "allow" for i in range(11)}
    blank = pages.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"))
    assert {tuple(r) for r in url_filters.filter_urls(blank).collect()} == {(None, "", "", None, "allow")}


def test_chat(spark):
    turns = [
        (0, True, 0, "user", "hi"), (0, True, 0, "user", "hi"), (0, True, 1, "assistant", "good <|im_end|>"), (0, False, 0, "user", "hi"), (0, False, 1, "assistant", "bad"), (0, False, 2, None, None),
        (1, True, 0, "user", "alone"), (None, True, 0, "user", "x"), (2, True, 0, "user", "same"), (2, False, 0, "user", "same"),
    ]
    rows = {r.pair_id: r for r in chat_formatting.format_preferences(spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[0].prompt == "<|im_start|>user\nhi<|im_end|>\n" and rows[0].n_prompt_turns == 1
    assert rows[0].chosen == "<|im_start|>assistant\ngood <| im_end|><|im_end|>\n"
    (span,) = rows[0].chosen_mask
    assert rows[0].chosen[span.start : span.end] == "good <| im_end|><|im_end|>"
    assert rows[0].rejected.endswith("<|im_start|>\n<|im_end|>\n") and len(rows[0].rejected_mask) == 1
    assert rows[1].n_prompt_turns == 0 and rows[1].rejected == "" and rows[1].chosen
    assert rows[2].n_prompt_turns == 1 and rows[2].chosen == rows[2].rejected == ""
    long = [(0, 0, "user", "q" * 2_000_000, "x", "y"), (0, 0, "user", "q" * 2_000_000, "x", "z"), (1, 0, "user", "q" * 2_000_000, "x", "y"), (1, 1, "assistant", "r" * 3_000_000, "x", "y")]
    clashing = spark.createDataFrame(long, "conv_id long, turn long, role string, text string, prompt string, chosen string")
    (pair,) = chat_formatting.format_preferences(chat_formatting.neighbours(clashing)).collect()
    assert pair.n_prompt_turns == 1 and len(pair.prompt) == 2_000_028 and pair.chosen == "" and [tuple(x) for x in pair.rejected_mask] == [(22, 3_000_032)]
    assert chat_formatting.format_preferences(chat_formatting.neighbours(clashing.limit(0))).collect() == []


def test_quality(docs, empty):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.judge_documents(docs).collect()}
    for r in ROWS:
        w = (r[1] or "").split(None)
        w = re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")
        got = rows[r[0], len(w)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (got.word_chars, got.n_repeat_words, got.n_dup_lines) == (sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert got.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality_rules.judge_documents(docs).filter("kept").collect())
    assert quality_rules.judge_documents(empty).collect() == [] and quality_rules.keep_good(empty).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    rows = [(i, "short", "bad") for i in range(50)] + [(100, PROSE, "bad")] + [(200 + i, PROSE + str(i), "good") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judge_documents(frame).filter("kept").collect()}
    assert kept == set(range(200, 250))


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(7, PROSE[300:420]), (8, None), (9, "")], "item_id long, text string")
    got = sorted(str(r.doc_id) for r in decontamination.find_leaks(docs, items).collect())
    assert got == ["1", "11", "2", "2", "3"]
    clean = decontamination.drop_leaking(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {4, 5, 6, None, 8, 9, 10}
    assert decontamination.find_leaks(empty, items).collect() == [] and decontamination.drop_leaking(empty, items).count() == 0
    assert decontamination.drop_leaking(docs, items.limit(0)).count() == len(ROWS)
    several = spark.createDataFrame([(k, PROSE[at : at + 90]) for k, at in (("a", 10), ("b", 200), ("c", 400), (None, 600))], "item_id string, text string")
    whole, parts = (sorted(map(str, decontamination.find_leaks(docs, several, part_bytes=n).collect())) for n in (1 << 20, 100))
    assert whole == parts and len(whole) > 12
    assert sorted(map(str, decontamination.drop_leaking(docs, several, part_bytes=100).collect())) == sorted(map(str, decontamination.drop_leaking(docs, several).collect()))
    assert decontamination.find_leaks(docs, items.limit(0)).collect() == []


def test_pieces(docs, empty):
    if not os.path.exists(piece_coding.MODEL):
        pytest.skip("the model isn't here")
    coded = piece_coding.encode_documents(docs).cache()
    rows = coded.collect()
    assert len(rows) == len(ROWS) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    texts = sorted(r.text for r in piece_coding.decode_documents(coded).collect())
    assert texts == sorted(r[1] or "" for r in ROWS)
    assert piece_coding.encode_documents(empty).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(map(str, (tuple(r) for r in frame.select(*columns).collect())))
    assert got == sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))


@pytest.mark.parametrize("tile_rows", [8, 2048])
def test_keep_one_is_exact_in_large_groups(spark, tile_rows):
    """Two texts and variants of each, some alike to the one, some to neither; both ways of confirming, with and without dealing."""
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 400)] for _ in range(2)]
    texts = []
    for k in range(120):
        words = list(base[k % 2])
        for at in rng.choice(400, int(rng.integers(1, 24)), replace=False):
            words[at] = f"v{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts + texts[:5] + ["", None, "one", "a b c d e"])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sets[i] | sets[j]
            if root[i] != root[j] and (not both or len(sets[i] & sets[j]) / len(both) >= 0.8):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash_dedup.keep_one(docs, tile_rows=tile_rows, link_rows=2 * tile_rows, thin_rows=2 * tile_rows).collect())
    assert len(set(root)) > 5 and kept == sorted(set(root))


def test_keep_one_finds_every_pair_at_the_limit(spark):
    """Pairs of a similarity of exactly 0.8: 400 shingles in common, 50 more on each side; and as many just below it."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(240):
        common, one, two = ([f"w{x}" for x in rng.integers(0, 10**9, n)] for n in (404, 50, 50 + k % 2))
        rows += [(2 * k, " ".join(common + one)), (2 * k + 1, " ".join(common + two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash_dedup.keep_one(docs).collect()}
    assert kept == {i for i, _ in rows if i % 4 != 1}


def test_keep_one_tells_long_texts_with_common_passages(spark):
    """Sets too large for the narrow sketches, connected by passages they share: wide sketches part them, and no pair is lost."""
    rng = np.random.default_rng(19)
    passages = [[f"p{x}" for x in rng.integers(0, 10**6, 150)] for _ in range(3)]
    texts = []
    for k in range(24):
        words = [f"w{x}" for x in rng.integers(0, 10**9, int(rng.integers(2100, 2600)))]
        texts.append(words + passages[k % 3])
        if k % 4 == 0:  # an alike one, and one that is a little too far away
            for edits in (45, 60):
                copy = list(texts[-1])
                for at in np.linspace(3, len(words) - 9, edits).astype(int):
                    copy[at] = f"v{rng.integers(0, 10**9)}"
                texts.append(copy)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    wanted = [i for i, a in enumerate(sets) if not any(len(a & b) / len(a | b) >= 0.8 for b in sets[:i])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    a, b = simhash_dedup.row_hashes("doc_id", "text")
    made = docs.select(a.alias("__h"), "text").mapInArrow(simhash_dedup._described(5, 0.8), "__h long, __f0 long, __f1 long, __n long, __pc long, __p array<long>, __k binary, __w binary").cache()
    from lodestone.llm.components import components

    loose = components(simhash_dedup.link_sets(made, 0.8))
    assert max(r["count"] for r in loose.groupBy("root").count().collect()) > 10
    for rows in (16384, 8):
        finer = components(simhash_dedup.finer_links(made.join(loose.withColumnRenamed("node", "__h"), "__h").select("root", "__h", "__n", "__w"), 0.8, rows))
        assert max(r["count"] for r in finer.groupBy("root").count().collect()) <= 3
        assert sorted(r.doc_id for r in simhash_dedup.keep_one(docs, thin_rows=rows).collect()) == wanted
    assert 6 <= len(texts) - len(wanted) <= 12


def test_set_links_leave_out_no_pair(spark):
    """Every pair that is alike is connected by loose links, dealt into tiles or not."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(40, 61)), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 12)), dtype=np.uint64)])) for _ in range(150)]
    step = -math.log(0.8) * (1 + 1e-6)
    rows = [(i, len(s), int(math.log(len(s)) / step), simhash_dedup.prefix(s, 0.8).astype(np.int64).tolist(), simhash_dedup.sketch(s)) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "__h long, __n long, __pc long, __p array<long>, __k binary")
    from lodestone.llm.components import components

    alike = [(i, j) for i in range(150) for j in range(i) if simhash_dedup.alike(sets[i], sets[j], 0.8)]
    assert len(alike) > 100
    for size in (4096, 8):
        root = {r.node: r.root for r in components(simhash_dedup.link_sets(frame, 0.8, size)).collect()}
        assert all(i in root and root[i] == root[j] for i, j in alike)


def test_score_counts_every_pair(spark):
    """score against a model of all counts, pairs seen once included, at the means of their log2 levels; the filter's false positives aside."""
    rng = np.random.default_rng(13)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 80) % 3000)) for i in range(120)]
    tokens = [[*words(t), None] for _, t in rows]
    held = [crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    single = Counter(t for x, h in zip(tokens, held) if not h for t in x)
    double = Counter(p for x, h in zip(tokens, held) if not h for p in zip(x, x[1:]))
    n, v = sum(single.values()), len(single)
    assert sum(c == 1 for c in double.values()) > 1000

    def levels(counts):
        """What the counts of each level are on average."""
        by = {}
        for c in counts.values():
            by.setdefault(c.bit_length(), []).append(c)
        return {0: 0.0} | {k: sum(x) / len(x) for k, x in by.items()}

    words_at, pairs_at = levels(single), levels(double)

    def score(x):
        out = 0.0
        for k, t in enumerate(x):
            context = words_at[single[x[k - 1]].bit_length()] if k else 0.0
            alone = (words_at[single[t].bit_length()] + 1) / (n + v + 1)
            out += math.log10(0.4 * min(pairs_at[double[x[k - 1], t].bit_length()], context) / context + 0.6 * alone if context else alone)
        return out

    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (lm_scoring.RANGE_BYTES, 500):  # 8 slices, and some 100
        got = {r.doc_id: r.score for r in lm_scoring.score_documents(frame, range_bytes=size).collect()}
        off = [abs(got[i] / score(x) - 1) for (i, _), x in zip(rows, tokens)]
        trained = [o for o, h in zip(off, held) if not h]
        assert np.median(trained) < 1e-9 and max(trained) < 0.02 and np.mean(off) < 0.005 and max(off) < 0.1
    named = frame.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert {(r.doc_id, r.held_out, r.n_known) for r in lm_scoring.score_documents(named).collect()} == {(str(i), h, sum(single[t] > 0 for t in x)) for (i, _), x, h in zip(rows, tokens, held)}
