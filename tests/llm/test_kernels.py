"""The numpy kernels against brute force, without a session."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import decontamination, lm_scoring, piece_coding, simhash_dedup, suffix_dedup
from lodestone.llm.suffix_sorting import suffix_array


def test_suffix_array():
    draw = random.Random(1)
    for _ in range(2000):
        k = draw.choice([1, 2, 3, 8])
        x = [draw.randrange(k) for _ in range(draw.randint(0, 40))]
        assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_repeated_windows():
    draw = random.Random(2)
    for turn in range(200):
        length = draw.choice([20, 24, 40])
        base = bytes(draw.choice(b"abc  \n" if turn % 2 else b"ab ") for _ in range(200))
        bodies = []
        for _ in range(draw.randint(1, 8)):
            start = draw.randrange(100)
            body = bytearray(base[start : start + draw.randint(length, 90)])
            if draw.random() < 0.5:
                body[draw.randrange(len(body))] = draw.choice(b"xyz ")
            bodies.append(bytes(body))
        bodies = list(dict.fromkeys(bodies))
        weights = np.array([draw.choice([1, 1, 1, 2]) for _ in bodies])
        counts = Counter()
        for body, w in zip(bodies, weights):
            counts.update({body[i : i + length]: 0 for i in range(len(body) - length + 1)})
            for i in range(len(body) - length + 1):
                counts[body[i : i + length]] += int(w)
        for every in (1, 3, 16):
            for body, got in zip(bodies, suffix_dedup.repeated_windows(bodies, weights, length, every)):
                assert got.tolist() == [counts[body[i : i + length]] >= 2 for i in range(len(body) - length + 1)]


def test_starts_do_not_depend_on_white_space():
    """Nearly all windows of a text without any have a start of a suffix in them."""
    text = np.random.default_rng(8).integers(33, 127, 200_000).astype(np.uint8).tobytes()
    v = suffix_dedup._eights(np.frombuffer(text, np.uint8))
    starts = ((v * suffix_dedup._ODD) >> np.uint64(40)) % np.uint64(suffix_dedup.EVERY) == 0
    assert abs(starts.mean() * suffix_dedup.EVERY - 1) < 0.1
    before = np.concatenate([[0], np.cumsum(starts)])
    assert np.mean(before[193:] == before[:-193]) < 0.01


def test_least_grams_of_long_texts():
    """Parts meet: the same as all at once, for a text of more than one part, and places of 20 bits and more."""
    draw = np.random.default_rng(9)
    text = np.concatenate([draw.integers(97, 100, 700_000), np.full(600_000, 97)]).astype(np.uint8)
    gram, place = suffix_dedup._least_grams(text, 200)
    assert len(gram) == len(text) - 199 and (place >= np.arange(len(gram))).all() and (place <= np.arange(len(gram)) + 184).all()
    for at in (0, (1 << 19) - 100, (1 << 19) + 5, (1 << 20) + 77, len(gram) - 1):
        one, where = suffix_dedup._least_grams(text[at : at + 200], 200)
        assert (one[0], where[0] + at) == (gram[at], place[at])
    body = text.tobytes()
    dealt = suffix_dedup._deal(5, body, 200)
    assert sum(len(x) - 199 for _, _, x in dealt) == len(gram) and all(body[p : p + len(x)] == x for _, p, x in dealt)


@pytest.mark.parametrize("unit", [b"-", b"ab", b"seven b", b"a stretch of 31 bytes, repeated"])
def test_short_periods_make_few_segments(unit):
    """Whatever a stretch's length, a segment is of bounded size, and what is dealt of it isn't a row for each window."""
    text = b"before " + unit * (40_000 // len(unit)) + b" behind"
    first, number, grams, hashes, _ = suffix_dedup.segments(text, 200)
    assert number.max() <= suffix_dedup.MOST and number.sum() == len(text) - 199 and (first[1:] == (first + number)[:-1]).all()
    longest = int(number.argmax())
    body = text[first[longest] : first[longest] + number[longest] + 199]
    groups: dict[bytes, set[int]] = {}
    dealt = suffix_dedup._deal(int(grams[longest]), body, 200)
    for group, p, part in dealt:
        assert body[p : p + len(part)] == part
        for i in range(len(part) - 199):
            groups.setdefault(part[i : i + 200], set()).add(group)
    assert all(len(x) == 1 for x in groups.values()) and sum(len(x) for _, _, x in dealt) < 20 * len(body)
    if len(unit) < suffix_dedup.CHUNK:
        assert len(dealt) == 1


def test_compare_tiles_finds_every_link():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 2**63, 300).astype(np.uint64)
    near = values[:100] ^ (np.uint64(1) << draw.integers(0, 60, 100).astype(np.uint64))
    values = np.unique(np.concatenate([values, near]))

    def labels(pairs):
        parent = list(range(len(values)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(values))]

    u, v = simhash_dedup.compare_tiles(values, 4, tile=32)
    every = [(i, j) for i in range(len(values)) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= 4]
    assert labels(zip(u.tolist(), v.tolist())) == labels(every)


def test_wide_sketches_fold():
    hashes = np.unique(np.random.default_rng(4).integers(0, 2**63, 5000).astype(np.uint64))
    wide = np.frombuffer(simhash_dedup.sketch(hashes, simhash_dedup.wide_bits(len(hashes))), np.uint64)
    assert len(wide) * 64 == 8192
    assert (simhash_dedup.fold([wide], 16)[0] == np.frombuffer(simhash_dedup.sketch(hashes), np.uint64)).all()


def test_blocks_cover_the_radius():
    masks = [m for (m,) in simhash_dedup.block_masks(4)]
    assert len(masks) == 5 and sum(masks) == 2**64 - 1


def test_bloom_probes_never_undercount():
    grams = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(1, 400)
    levels = lm_scoring._levels(counts)
    bits = lm_scoring.filter_bits(int(levels.sum()))
    flags = np.zeros(bits, bool)
    keys = lm_scoring._kind(grams, True)
    for k in range(1, int(levels.max()) + 1):
        for places in lm_scoring._places(keys[levels >= k], k, bits):
            flags[places] = True
    got = lm_scoring.probe_levels(np.packbits(flags, bitorder="little"), grams, True)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    other = lm_scoring.probe_levels(np.packbits(flags, bitorder="little"), grams + np.uint64(1), True)
    assert (other > 0).mean() < 0.1


def test_probabilities_are_at_most_one_and_sum_to_about_one():
    """Over all words of a small vocabulary and the unknown one, after each known context and after none."""
    draw = np.random.default_rng(6)
    text = draw.zipf(1.5, 4000) % 50
    single, double = np.bincount(text, minlength=50), np.zeros((50, 50), np.int64)
    np.add.at(double, (text[:-1], text[1:]), 1)

    def quantised(counts):
        levels = np.where(counts > 0, lm_scoring._levels(counts), 0)
        return lm_scoring.level_means({k: (int(counts[levels == k].sum()), int((levels == k).sum())) for k in range(1, 49) if (levels == k).any()})[levels]

    q, qq = quantised(single), quantised(double)
    assert math.isclose(q.sum(), 4000) and math.isclose(qq.sum(), 3999)
    n, v = 4000, int((single > 0).sum())
    word = np.append(q, 0.0)  # the last one is unknown
    sums = []
    for context in np.flatnonzero(single):
        p = lm_scoring.model_probability(word[np.append(single > 0, True)], np.full(v + 1, q[context]), np.append(qq[context], 0.0)[np.append(single > 0, True)], n, v)
        assert (p > 0).all() and (p <= 1).all()
        sums.append(p.sum())
    none = lm_scoring.model_probability(word[np.append(single > 0, True)], np.zeros(v + 1), np.zeros(v + 1), n, v)
    assert math.isclose(none.sum(), 1) and abs(np.average(sums, weights=single[single > 0]) - 1) < 0.05 and 0.7 < min(sums) and max(sums) < 1.3
    assert (lm_scoring.model_probability(np.array([0.0, 1e12]), np.zeros(2), np.zeros(2), 0, 0) <= 1).all()


def test_pack():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (lm_scoring.unpack(lm_scoring.pack(x)) == x).all()
    assert len(lm_scoring.unpack(lm_scoring.pack(np.empty(0, np.uint64)))) == 0


def edit_distance(item, text):
    """The least edits of item within text, and where the first occurrence with so many ends."""
    d = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        n = [i]
        for j, x in enumerate(text, 1):
            n.append(min(d[j] + 1, n[j - 1] + 1, d[j - 1] + (c != x)))
        d = n
    return min(d), d.index(min(d))


def test_leaks():
    draw = random.Random(3)
    parts = ["the", "of", "tion", "and", "ing", "ere", "her", "at", "on", "x9", "qu"]

    def prose(n):
        return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(n))

    seen = 0
    for _ in range(15):
        items = [(i, prose(draw.randint(5, 25))) for i in range(6)] + [(99, "tiny"), (98, None), (97, "")]
        held = decontamination.Items(items, 0.08)
        texts = [b""]
        for _ in range(6):
            leak = bytearray(draw.choice(items[:6])[1].encode())
            for _ in range(draw.randint(0, 8)):
                k, what = draw.randrange(len(leak)), draw.randrange(3)
                if what == 0:
                    leak[k] = draw.choice(b"abcxyz")
                elif what == 1:
                    del leak[k]
                else:
                    leak.insert(k, draw.choice(b"abc"))
            texts.append(decontamination.normal(prose(draw.randint(0, 20)) + " " + leak.decode() + "  " + prose(5)))
        got = set(decontamination.scan(held, texts))
        wanted = {(t, 99, 0, x.index(b"tiny") + 4) for t, x in enumerate(texts) if b"tiny" in x}
        for t, x in enumerate(texts):
            for n, i in enumerate(held.ids):
                e, end = edit_distance(held.texts[n].tobytes(), x)
                if e <= held.budget[n]:
                    wanted.add((t, i, e, end))
        assert got == wanted
        seen += len(wanted)
    assert seen > 20


def test_leaks_of_repeated_grams():
    """Items and texts of rules, padding and repeated words: the same as comparing everything, and quick where they are long."""
    draw = random.Random(7)

    def part():
        return draw.choice(["-" * draw.randint(3, 60), "ab " * draw.randint(2, 20), "".join(draw.choice("abc -") for _ in range(draw.randint(3, 40))), "the end of it "])

    seen = loose = 0
    for _ in range(40):
        items = [(i, "".join(part() for _ in range(draw.randint(1, 4)))) for i in range(5)]
        held = decontamination.Items(items, 0.1)
        loose += len(held.loose.keys) > 0
        texts = []
        for _ in range(6):
            leak = bytearray(draw.choice(items)[1].encode())
            for _ in range(draw.randint(0, 4)):
                leak[draw.randrange(len(leak))] = draw.choice(b"abx-")
            texts.append(decontamination.normal(part() + leak.decode() + part()))
        wanted = set()
        for t, x in enumerate(texts):
            for n, i in enumerate(held.ids):
                e, end = edit_distance(held.texts[n].tobytes(), x)
                if e <= held.budget[n]:
                    wanted.add((t, i, e, end))
            wanted |= {(t, i, 0, x.index(y) + len(y)) for i, y in held.short if y in x}
        assert set(decontamination.scan(held, texts)) == wanted
        seen += len(wanted)
    assert seen > 60 and loose > 10
    began = time.perf_counter()
    held = decontamination.Items([(1, "-" * 400), (2, "x" * 399)])
    assert decontamination.scan(held, [b"-" * 1_000_000, b"y" * 1_000_000]) == [(0, 1, 0, 400)]
    assert time.perf_counter() - began < 20


@pytest.fixture(scope="module")
def coder():
    try:
        with open(piece_coding.MODEL, "rb") as file:
            return piece_coding.PieceCoder(file.read())
    except FileNotFoundError:
        pytest.skip("the model isn't here")


def test_pieces_round_trip(coder):
    texts = ["", None, "▁", "▁▁a ▁ b▁", "  x  ", " \n\t　", "漢字かな交じり文", "😀😀 é́", "a" * 3000, "▁ ", " ▁", "The quick brown fox"]
    ids = coder.encode(texts)
    assert coder.decode_all(ids) == [t or "" for t in texts]
    assert [len(x) for x in ids[:2]] == [0, 0]


def test_pieces_are_taken_and_decoded_together(coder, monkeypatch):
    """No call for each piece: only words with a character that no piece covers go one by one; and hashes that share leading bits are told apart."""
    texts = ["plain words of a text, " * 20, "", None, " two  spaces", "a" * 700 + " b"]
    words = sorted({w for t in texts for w in coder.split(t or "") if len(w) <= piece_coding.LONG})
    with open(piece_coding.MODEL, "rb") as file:
        fresh = piece_coding.PieceCoder(file.read())
    with monkeypatch.context() as m:
        m.setattr(fresh, "_take", None)
        fresh.encode_words(words)
        m.setattr(fresh, "decode", None)
        m.setattr(piece_coding, "BLOCK", 7)
        ids = coder.encode(texts)
        assert fresh.decode_all(ids) == [t or "" for t in texts]
        assert fresh.decode_all([]) == []
    assert all(fresh.cache[w] == coder._one_long(w) for w in words)
    for i, key in enumerate(fresh.ids.tolist()):
        if i % 97 == 0:
            name = fresh.names[key]
            found = fresh._probe(fresh._codes([name], len(name)))
            assert found[len(name), len(name) - 1, 0] == i
    assert fresh.shared > 1


def merged(word, scores):
    """Merging by hand: the neighbours whose piece has the greatest score become one, the leftmost of equal ones, until none is left."""
    x = list(word)
    while True:
        ways = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(x, x[1:])) if a + b in scores]
        if not ways:
            return x
        i = -max(ways)[1]
        x[i : i + 2] = [x[i] + x[i + 1]]


def spelt(coder, ids):
    return [coder.byte_of[i] if i in coder.byte_of else coder.names[i] for i in ids]


def test_pieces_are_what_merging_gives(coder):
    draw = random.Random(4)
    words = {"▁" + "".join(draw.choice("etaoinshr漢é\U0001f9ff") for _ in range(draw.randint(1, 14))) for _ in range(1000)}
    words |= {"▁" + x * n for x in ("a", "ab", "-", "=") for n in (5, 16, 17, 40)}
    coder.encode_words(sorted(words))
    for w in words:
        wanted = [y for x in merged(w, coder.merges) for y in ([x] if x in coder.merges else x.encode())]
        assert spelt(coder, np.frombuffer(coder.cache[w], np.int32).tolist()) == wanted
        assert coder._one_long(w) == coder.cache[w]


def test_pieces_are_those_of_the_library(coder):
    """All words of all documents of the smallest tables, and runs without a space that go over a block."""
    sentencepiece = pytest.importorskip("sentencepiece")
    parquet = pytest.importorskip("pyarrow.parquet")
    theirs = sentencepiece.SentencePieceProcessor(model_file=piece_coding.MODEL)
    texts = ["x" * 70_000, "漢字かな" * 20_000, "ab" * 600 + " c", "a  b   c", "\t\n"]
    try:
        texts += [t or "" for t in parquet.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    except FileNotFoundError:
        pass
    assert not any("▁" in t for t in texts)
    assert [x.tolist() for x in coder.encode(texts)] == theirs.encode(texts)


def _message(*fields):
    """A protocol buffer of (number, bytes, float or whole number)."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + np.float32(value).tobytes()
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def _model(pieces, kind, *normaliser):
    rows = [(1, _message((1, p), (2, s))) for p, s in pieces.items()] + [(1, _message((1, f"<0x{i:02X}>"), (2, 0.0), (3, 6))) for i in range(256)]
    return _message(*rows, (2, _message((3, kind))), (3, _message(*normaliser)))


def test_unigram_models_and_normalisers():
    draw = random.Random(5)
    pieces = {"▁": -3.5, "▁a": -2.25}
    while len(pieces) < 60:
        pieces["".join(draw.choice("abcd") for _ in range(draw.randint(1, 4)))] = -draw.randint(4, 64) / 4
    coder = piece_coding.PieceCoder(_model(pieces, 1, (4, 0)))
    for length in (1, 3, 9):
        words = ["▁" * (k % 2) + "".join(draw.choice("abcde") for _ in range(length)) for k in range(80)]
        coder.encode_words(words)
        for w in words:
            best = [0.0] + [-math.inf] * len(w)
            for e in range(1, len(w) + 1):
                best[e] = max([best[s] + pieces[w[s:e]] for s in range(max(0, e - 4), e) if w[s:e] in pieces] + [best[e - 1] + coder.fallback])
            for ids in (coder.cache[w], coder._one_long(w)):
                found = spelt(coder, np.frombuffer(ids, np.int32).tolist())
                assert math.isclose(sum(pieces.get(x, coder.fallback) for x in found), best[-1])
    bare = piece_coding.PieceCoder(_model(pieces, 1, (3, 0), (4, 0)))
    assert bare.decode_all(bare.encode([" ab", "ab", ""])) == [" ab", "ab", ""] and spelt(bare, bare.encode(["a"])[0].tolist())[0] != "▁a"
    for changed in [(4, 1)], [(4, 0), (2, b"map")], [(4, 0), (5, 0)]:
        with pytest.raises(ValueError):
            piece_coding.PieceCoder(_model(pieces, 1, *changed))


def test_filter_grows_with_its_entries():
    """No cap: 12 bits an entry at any number, and so few false positives in a large slice as in a small one."""
    assert all(lm_scoring.filter_bits(n) >= 12 * n for n in (1, 10**6, 10**9, 10**12))
    rng = np.random.default_rng(3)
    wrong = []
    for n in (20_000, 1_000_000):
        grams = rng.integers(0, 2**48, n, dtype=np.uint64)
        slice_ = lm_scoring.make_filter(grams, np.ones(n, np.uint8), True)
        assert lm_scoring.probe_levels(slice_, grams, True).min() >= 1
        wrong.append(np.mean(lm_scoring.probe_levels(slice_, rng.integers(0, 2**48, 200_000, dtype=np.uint64), True) > 0))
    assert max(wrong) < 0.01 and abs(wrong[0] - wrong[1]) < 0.002
