"""Removal of long repeated byte strings by suffix sorting.

A string of `length` bytes that starts at two places or more is removed wherever it stands. Which places can match is
found first, and cheaply: every window of `length` bytes has a least 16-byte gram (by hash), equal windows have equal
least grams, so windows are gathered into segments that share one, and a gram that the corpus has once rules its
segment out. All other segments are sorted, copies included: tasks merge segments of equal bytes, with their number,
before they send them and again where a gram's segments meet, so copies cost a row for each task and are sorted once. Segments
of a gram that stands at over `hot` places are merged over all tasks before they meet, so that no task reads a row for each.

The suffixes of a gram's segments that begin where the next 8 bytes hash to one value in EVERY go into a suffix
array by Lyndon groups (suffix_sorting). Bytes in common with the neighbours give, for each window, the interval of
suffixes that agree with it from its first such start on; windows of one interval with equal bytes before that are the
repeats. Starts depend on bytes alone, so texts without white space have them too; only a window without any (one in 400,
and those of a short period) is told by a hash of its bytes. Every match is confirmed byte by byte.

Segments are told by 64 bits of hash when answers go back to their texts. Where two segments of one gram share them, the
answer brings the bytes it is for, and the text is compared with them.

A gram with more than `hot` distinct segments isn't one task's: its windows are dealt by their distance to the gram, 16
distances at a time, and by all bytes such windows must share. What many segments have in common is sent to its task once,
with the sum of its numbers, and the answer is joined to all of them by its bytes. A dealt group with more than `hot`
distinct strings even so is counted window by window, by the bytes of each, in place of being sorted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import KEY_ROWS, discard, hint_small, lean, materialize, row_hashes, whole_row
from .suffix_sorting import suffix_array

LENGTH = 200
GRAM = 16
HOT = 5_000  # distinct segments sorted together: 180 MB or so (50,000: 1.8 GB)
BLOCK = 1 << 18  # bytes sorted at once, unless one gram's segments are more: 21 MB of arrays, which a core's cache holds best
COMBINE = 32 << 20  # bytes of different segments among which a task merges equal ones before it sends them
CHUNK = 16
#: Windows of one segment at most: those of a short period, which would go on as long as the text does, are cut.
MOST = 1024
SPANS = "array<struct<start:int,end:int>>"

_POS = np.uint64((1 << 20) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What becomes of a gram's segments: sorted as tasks send them, merged over all tasks first, or dealt.
_PLAIN, _MERGED, _DEALT = 0, 1, 2
#: One place in so many is a start of a suffix.
EVERY = 32
#: Windows whose least grams are found at once: places in such a part have 20 bits.
_PART = 1 << 19


def _eights(a: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number; zeros follow the end."""
    b = np.zeros(len(a) + 8, np.uint8)
    b[: len(a)] = a
    return np.ascontiguousarray(sliding_window_view(b, 8)[: len(a)]).view("<u8").ravel()


def _least_grams(a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `length` bytes, the hash (44 bits) and place of its least gram, the leftmost of equal ones."""
    w = length - GRAM + 1
    grams, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for start in range(0, len(a) - length + 1, _PART):
        v = _eights(a[start : start + _PART + length - 1])
        n = len(v) - GRAM + 1
        h = (v[:n] * _ODD) ^ (v[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h = (h & ~_POS) | np.arange(n, dtype=np.uint64)
        padded = np.concatenate([h, np.full(-n % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(padded, 1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        m = n - w + 1
        least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
        grams.append(least >> np.uint64(20))
        places.append((least & _POS).astype(np.int64) + start)
    return np.concatenate(grams), np.concatenate(places)


def segments(text: bytes, length: int, hash_bits: int = 64) -> tuple[np.ndarray, ...]:
    """first window, number of windows, gram, hash of the bytes, whether the gram is least at several places of the segment."""
    gram, place = _least_grams(np.frombuffer(text, np.uint8), length)
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    ends = np.append(first[1:], len(gram))
    if len(gram) and int((ends - first).max()) > MOST:  # cuts are counted from a segment's beginning, so copies are cut alike
        first = np.concatenate([np.arange(p, q, MOST) for p, q in zip(first.tolist(), ends.tolist())])
        ends = np.append(first[1:], len(gram))
    moved = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
    digest, most = xxhash.xxh64_intdigest, (1 << hash_bits) - 1
    hashes = np.array([digest(text[p : q + length - 1]) & most for p, q in zip(first.tolist(), ends.tolist())], np.uint64)
    return first, ends - first, gram[first], hashes, moved[ends - 1] != moved[first]


def _with_place(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with __a and __b, which tell a row by its key and text, and __t, the text."""
    a, b = row_hashes(key, text)
    return docs.select("*", a.alias("__a"), b.alias("__b"), F.coalesce(F.col(text), F.lit("")).alias("__t"))


def _all_segments(rows: DataFrame, length: int, hash_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__a", "__b", "__p", "__n", "__g", "__c", "__self"]
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts: list[tuple[np.ndarray, ...]] = []
            owners: list[int] = []
            size = 0
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                for at in range(0, len(text) - length + 1, _PART):  # a cut between two windows does no harm
                    first, *others = segments(text[at : at + _PART + length - 1], length, hash_bits)
                    parts.append((first + at, *others))
                    owners.append(i)
                    size += len(first)
                if size > 200_000 or parts and i == batch.num_rows - 1:
                    p, n, g, c, s = (np.concatenate(x) for x in zip(*parts))
                    of = np.repeat(owners, [len(x[0]) for x in parts])
                    yield pa.RecordBatch.from_arrays([pa.array(a[of]), pa.array(b[of]), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(s)], names=names)
                    parts, owners, size = [], [], 0

    return rows.select("__a", "__b", "__t").mapInArrow(lean(run), "__a long, __b long, __p int, __n int, __g long, __c long, __self boolean")


def _cut(length: int):
    """Texts with the list of segments wanted of them -> the segments' bytes, each with the group it is sorted in and how often it stood in what was merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int, int, bytes], int] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            columns = [list(x) for x in zip(*held)] or [[] for _ in range(5)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            whole = pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(columns, kinds)], pa.array(list(held.values()), pa.int64())], names=["__q", "__g", "__c", "__shift", "__bytes", "__w"])
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)

        for batch in batches:
            times = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                text = batch.column(0)[i].as_py().encode("utf-8", "surrogatepass")
                for want in batch.column(1)[i].as_py():
                    body = text[want["__p"] : want["__p"] + want["__n"] + length - 1]
                    for group, shift, part in _deal(want["__g"], body, length) if want["__hot"] == _DEALT else [(want["__g"], 0, body)]:
                        key = (group, want["__g"], want["__c"], shift, part)
                        if key in held:
                            held[key] += times[i]
                        else:
                            held[key] = times[i]
                            size += len(part)
                    if size > COMBINE:
                        yield from rows()
                        held, size = {}, 0
        yield from rows()

    return run


def _deal(gram: int, body: bytes, length: int) -> list[tuple[int, int, bytes]]:
    """A segment's windows by 16 distances to the gram: (hash of what such windows share, first window, bytes).

    In a stretch of a short period the gram goes along with the windows, and what they share stays the same: over CHUNK such
    windows are one string, in which windows may be equal.
    """
    _, least = _least_grams(np.frombuffer(body, np.uint8), length)
    distance = least - np.arange(len(least))
    part = distance // CHUNK
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (least[1:] != least[:-1])]))
    found: list[tuple[int, int]] = []
    for p in first.tolist():
        # windows at distances [d, d + CHUNK) all hold the bytes from the farthest's start to the nearest's end
        start = int(least[p]) - int(part[p]) * CHUNK
        shared = body[start : start + length - CHUNK + 1]
        group = xxhash.xxh64_intdigest(shared + bytes([int(part[p])]), gram & 0xFFFFFFFF)
        found.append((group - (1 << 64) if group >> 63 else group, p))
    out, at = [], 0
    while at < len(found):
        group, p = found[at]
        next_ = at + 1
        while next_ < len(found) and found[next_][0] == group:
            next_ += 1
        stops = [x for _, x in found[at + 1 : next_]] + [found[next_][1] if next_ < len(found) else len(least)]
        if stops[-1] - p > CHUNK:
            out.append((group, p, body[p : stops[-1] + length - 1]))
        else:
            out += [(group, x, body[x : y + length - 1]) for x, y in zip([p, *stops], stops)]
        at = next_
    return out


def _common(v: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes in common from places a and b on, `most` at the most. v: the 8 bytes from each place on."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    step = 0
    while len(live):
        live = live[most[live] > step]
        x = v[a[live] + step] ^ v[b[live] + step]
        differ = x != 0
        y = x[differ]
        low = y & (~y + np.uint64(1))
        out[live[differ]] = step + (np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        live = live[~differ]
        step += 8
        out[live] = step
    return np.minimum(out, most)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def repeated_windows(bodies: list[bytes], weights: np.ndarray, length: int, every: int = EVERY) -> list[np.ndarray]:
    """For each of several byte strings, which of its windows of `length` bytes occur twice or more among all of them.

    weights: how many times each string stands in the corpus.
    """
    sizes = np.array([len(x) for x in bodies], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(bodies)
    buf = np.frombuffer(joined, np.uint8)
    v = np.concatenate([_eights(buf), np.zeros(length + 8, np.uint64)])
    of_byte = np.repeat(np.arange(len(bodies)), sizes)

    # a start is told by its 8 bytes; what follows a string's end isn't known
    told = np.arange(len(buf)) + 8 <= offsets[of_byte + 1]
    units = np.flatnonzero((((v[: len(buf)] * _ODD) >> np.uint64(40)) % np.uint64(every) == 0) & told)
    owner = of_byte[units]
    ends = offsets[owner + 1]
    last = np.append(owner[1:] != owner[:-1], True) if len(units) else np.empty(0, bool)
    # a unit goes up to the next start and takes its 8 bytes along, so that none is the beginning of another
    stops = np.where(last, ends, np.append(units[1:], 0) + 8 if len(units) else units)
    names = [joined[a:b] for a, b in zip(units.tolist(), stops.tolist())]
    rank = {x: i for i, x in enumerate(sorted(set(names)), 1)}
    symbols = np.zeros(len(units) + int(last.sum()), np.int64)
    where = np.arange(len(units)) + np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64) if len(units) else units
    symbols[where] = np.fromiter(map(rank.__getitem__, names), np.int64, len(names))
    unit_at = np.full(len(symbols), -1, np.int64)
    unit_at[where] = np.arange(len(units))
    order = unit_at[suffix_array(symbols)]
    order = order[order >= 0]
    place = np.empty(len(units), np.int64)
    place[order] = np.arange(len(order))
    left = ends - units
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        shared[1:] = _common(v, units[a], units[b], np.minimum(np.minimum(left[a], left[b]), length))

    windows = np.flatnonzero(offsets[of_byte + 1] - np.arange(len(buf)) >= length)
    unit = np.searchsorted(units, windows)
    reach = np.full(len(windows), length, np.int64)
    has = unit < len(units)
    reach[has] = units[unit[has]] - windows[has]
    reach[reach > length - 8] = length  # a start that bytes behind the window tell

    powers = _powers(int(_ODD), len(buf) + 1)
    inverse = _powers(pow(int(_ODD), -1, 1 << 64), len(buf) + 1)
    table = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * powers[:-1], out=sums[1:])
    before = (sums[windows + reach] - sums[windows]) * inverse[windows]

    interval = np.zeros(len(windows), np.uint64)
    by_reach = np.argsort(reach.astype(np.uint16 if length < 1 << 16 else np.int64), kind="stable")  # of 16 bits: by digits
    cuts = np.flatnonzero(np.concatenate([[True], reach[by_reach][1:] != reach[by_reach][:-1]])) if len(windows) else []
    for s, e in zip(cuts, [*cuts[1:], len(windows)]):
        some = by_reach[s:e]
        r = int(reach[some[0]])
        if r < length:
            interval[some] = np.cumsum(shared < length - r).astype(np.uint64)[place[unit[some]]]
    key = (before ^ (interval * np.uint64(0xD6E8FEB86659FD93))) * _ODD + reach.astype(np.uint64)
    key ^= key >> np.uint64(32)

    sorted_at = np.argsort(key)
    k = key[sorted_at]
    fresh = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    number = np.cumsum(fresh) - 1
    heads = sorted_at[np.flatnonzero(fresh)]
    total = np.bincount(number, weights[of_byte[windows[sorted_at]]])
    marked = np.zeros(len(windows), bool)
    marked[sorted_at] = total[number] >= 2
    follow = np.flatnonzero(~fresh)
    same = _common(v, windows[sorted_at[follow]], windows[heads[number[follow]]], np.full(len(follow), length))
    if np.any(same < length):  # two hashes met: count this block's windows by their bytes
        counts: dict[bytes, int] = {}
        for w in windows.tolist():
            x = joined[w : w + length]
            counts[x] = counts.get(x, 0) + int(weights[of_byte[w]])
        marked = np.array([counts[joined[w : w + length]] >= 2 for w in windows.tolist()], bool)
    per = np.maximum(sizes - length + 1, 0)
    return np.split(marked, np.cumsum(per)[:-1])


def _runs(flags: np.ndarray) -> list[int]:
    """[start, end, start, end ...] of the true stretches."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def _sort(length: int):
    """Segments in the order of their group -> (__g, __c, __shift, __r, __body): the stretches of repeated windows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], dict[tuple[int, int, int], int]] = {}  # equal bytes of one group are one string
        size, last = 0, None

        def sort() -> pa.RecordBatch:
            found = repeated_windows([body for _, body in held], np.array([sum(x.values()) for x in held.values()], np.int64), length)
            bodies = Counter(name for names in held.values() for name in names)
            rows = [
                (*name, r, body if q != name[0] or bodies[name] > 1 else None)
                for ((q, body), names), f in zip(held.items(), found)
                if f.any()
                for r in [_runs(f)]
                for name in names
            ]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["__g", "__c", "__shift", "__r", "__body"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for q, g, c, shift, body, weight in zip(*cols):
                if q != last and size > BLOCK:
                    yield sort()
                    held, size = {}, 0
                last = q
                if (q, body) not in held:
                    held[q, body] = {}
                    size += len(body)
                mine = held[q, body]
                mine[g, c, shift] = mine.get((g, c, shift), 0) + weight
        if held:
            yield sort()

    return run


def _sorted_groups(bodies: DataFrame, length: int) -> DataFrame:
    dealt = bodies.repartition("__q").sortWithinPartitions("__q")
    return dealt.mapInArrow(lean(_sort(length)), "__g long, __c long, __shift int, __r array<int>, __body binary")


def _dealt_answers(bodies: DataFrame, length: int, hot: int) -> DataFrame:
    """What _sorted_groups() gives, for segments of grams with any number of them: no task holds the segments that share a string."""
    # windows of one dealt string of up to CHUNK are all different, so a group that has but one such string once holds no repeats
    sizes = bodies.groupBy("__q").agg(F.sum("__w").alias("n"), F.max(F.octet_length("__bytes")).alias("most"))
    several = materialize(sizes.filter((F.col("n") > 1) | (F.col("most") > length + CHUNK - 1)).select("__q"), "repeat-several")
    dealt = bodies.join(F.broadcast(several) if several.count() <= KEY_ROWS else several, "__q", "left_semi")
    merged = materialize(dealt.groupBy("__q", "__bytes").agg(F.sum("__w").alias("__w")), "repeat-merged")
    large = materialize(merged.groupBy("__q").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("__q"), "repeat-large")
    n_large = large.count()
    small = merged.join(hint_small(large, n_large), "__q", "left_anti") if n_large else merged
    # a name that isn't the group's, so that answers bring their bytes
    named = small.select("__q", F.bitwise_not("__q").alias("__g"), F.lit(0).cast("long").alias("__c"), F.lit(0).alias("__shift"), "__bytes", "__w")
    found = _sorted_groups(named, length).select(F.bitwise_not("__g").alias("__q"), F.col("__body").alias("__bytes"), "__r")
    if n_large:
        starts = F.explode(F.sequence(F.lit(0), F.octet_length("__bytes") - length)).alias("__at")
        windows = merged.join(hint_small(large, n_large), "__q", "left_semi").select("__q", "__bytes", "__w", starts)
        windows = windows.withColumn("__window", F.substring("__bytes", F.col("__at") + 1, F.lit(length)))
        twice = windows.groupBy("__window").agg(F.sum("__w").alias("n")).filter("n > 1").select("__window")
        each = windows.join(twice, "__window").groupBy("__q", "__bytes").agg(F.collect_list(F.array("__at", F.col("__at") + 1)).alias("r"))
        found = found.unionByName(each.select("__q", "__bytes", F.flatten("r").alias("__r")))
    found = materialize(found.withColumn("__h", F.xxhash64("__bytes")), "repeat-found")
    # a hash will do here, as answers are compared with the texts; segments that several tasks have cut are one
    names = dealt.select("__q", F.xxhash64("__bytes").alias("__h"), "__g", "__c", "__shift").distinct()
    answers = names.join(hint_small(found, found.count()), ["__q", "__h"]).select("__g", "__c", "__shift", "__r", F.col("__bytes").alias("__body"))
    answers = materialize(answers, "repeat-answers")
    for step in (several, merged, large, found):
        discard(step)
    return answers


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, hash_bits: int = 64) -> DataFrame:
    """(__a, __b, __spans, __told): for each row that may have repeats, told by _with_place(), the stretches that removed() takes.

    hash_bits: of the hash that tells segments of one gram; fewer cost time, the result is the same.
    """
    rows = _with_place(docs.select(F.col(key), F.col(text)), key, text).select("__a", "__b", "__t").filter(F.octet_length("__t") >= length)
    found = materialize(_all_segments(rows, length, hash_bits), "repeat-segments")
    grams = found.groupBy("__g").agg(F.count("*").alias("n"), F.max("__self").alias("s")).filter("n > 1 OR s").select("__g")
    grams = materialize(grams, "repeat-grams")
    several = found.join(F.broadcast(grams) if grams.count() <= KEY_ROWS else grams, "__g")
    several = materialize(several, "repeat-several")
    discard(found)
    sizes = several.groupBy("__g", "__c").agg(F.count("*").alias("n")).groupBy("__g").agg(F.count("*").alias("different"), F.sum("n").alias("n"))
    how = F.when(F.col("different") > hot, _DEALT).otherwise(_MERGED).alias("__hot")
    many = materialize(sizes.filter(F.col("n") > hot).select("__g", how), "repeat-hot")
    n_many = many.count()
    known = several.join(hint_small(many, n_many), "__g", "left").withColumn("__hot", F.coalesce("__hot", F.lit(_PLAIN)))
    # rows equal in key and text are one text that stands there several times
    wanted = known.groupBy("__a", "__b").agg(F.count("*").alias("n"), F.collect_set(F.struct("__p", "__n", "__g", "__c", "__hot")).alias("__want"))
    wanted = materialize(wanted.select("__a", "__b", "__want", F.expr("n div size(__want)").alias("__times")), "repeat-wanted")
    discard(several)

    keys = wanted.select("__a", "__b")
    if keys.count() <= KEY_ROWS:  # texts that aren't wanted stay where they are
        rows = rows.join(F.broadcast(keys), ["__a", "__b"], "left_semi")
    if not wanted.filter("__times > 1").isEmpty():
        rows = rows.dropDuplicates(["__a", "__b"])

    texts = rows.join(wanted, ["__a", "__b"]).select("__t", "__want", "__times")
    bodies = texts.mapInArrow(lean(_cut(length)), "__q long, __g long, __c long, __shift int, __bytes binary, __w long")
    common = None
    if n_many:  # texts are moved and cut once for all kinds
        cut = materialize(bodies, "repeat-bodies")
        common = _dealt_answers(cut.filter("__q <> __g"), length, hot)
        bodies = cut.filter("__q = __g")
        merged = many.filter(F.col("__hot") == _MERGED).select(F.col("__g").alias("__q"))
        n_merged = merged.count()
        if n_merged:  # each task has sent such a gram's strings: they are made one before they meet in one task
            merged = hint_small(merged, n_merged)
            once = bodies.join(merged, "__q", "left_semi").groupBy("__q", "__g", "__c", "__shift", "__bytes").agg(F.sum("__w").alias("__w"))
            bodies = bodies.join(merged, "__q", "left_anti").unionByName(once)
    answers = materialize(_sorted_groups(bodies, length), "repeat-answers")
    if common is not None:
        answers = answers.unionByName(common)
        discard(cut)
    asked = wanted.select("__a", "__b", F.explode("__want").alias("x")).select("__a", "__b", "x.__p", "x.__g", "x.__c")
    place = F.col("__p") + F.col("__shift")
    placed = asked.join(answers, ["__g", "__c"]).select("__a", "__b", F.transform("__r", lambda x: x + place).alias("r"), place.alias("at"), F.col("__body").alias("body"))
    told = F.when(F.col("body").isNotNull(), F.struct("r", "at", "body"))
    spans = placed.groupBy("__a", "__b").agg(F.collect_list(F.when(F.col("body").isNull(), F.col("r"))).alias("__spans"), F.collect_list(told).alias("__told"))
    return materialize(spans, "repeat-spans")


def removed(spans: list[list[int]] | None, told: list[dict] | None, text: bytes, length: int) -> list[tuple[int, int]]:
    """Stretches of repeated windows -> maximal stretches of bytes covered by them, in order. Of those that come with their bytes (told), just the ones that the text has there."""
    out: list[tuple[int, int]] = []
    mine = [*(spans or []), *(s["r"] for s in told or [] if text.startswith(s["body"], s["at"]))]
    for start, end in sorted((r[i], r[i + 1] + length - 1) for r in mine for i in range(0, len(r), 2)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, end in spans:
        parts.append(text[at:start])
        at = end
    return b"".join([*parts, text[at:]])


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, hash_bits: int = 64) -> DataFrame:
    """docs with the texts' repeats taken out, all columns kept; rows of which nothing but blanks is left go.

    The stretches are those of find_repeats(), narrowed to whole characters. Texts that lose nothing stay as they are,
    null and empty ones included.
    """
    spans = repeated_spans(docs, key, text, length, hot, hash_bits)
    keys = spans.select("__a", "__b")
    rows = _with_place(docs.select(F.col(key).alias("__k"), F.col(text).alias("__x"), whole_row(docs)), "__k", "__x").select("__a", "__b", "__row")
    whole = None
    if keys.count() <= KEY_ROWS:
        whole = rows.join(F.broadcast(keys), ["__a", "__b"], "left_anti").select("__row.*")
        rows = rows.join(F.broadcast(keys), ["__a", "__b"], "left_semi")
    joined = rows.join(spans, ["__a", "__b"], "left").select("__row.*", F.col("__spans").alias("__spans_of_" + "_".join(docs.columns)), F.col("__told").alias("__told_of_" + "_".join(docs.columns)))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans_of, told_of = (batch.column(i).to_pylist() for i in (at, batch.num_columns - 2, batch.num_columns - 1))
            stay: list[int] = []
            left: list[str | None] = []
            for i, (t, r, x) in enumerate(zip(texts, spans_of, told_of)):
                b = (t or "").encode("utf-8", "surrogatepass")
                cut = removed(r, x, b, length)
                if cut:
                    t = kept_bytes(b, [_whole_characters(b, x) for x in cut]).decode("utf-8", "surrogatepass")
                    if not t.strip():
                        continue
                stay.append(i)
                left.append(t)
            kept = batch.take(pa.array(stay, pa.int32()))
            columns = [pa.array(left, kept.column(at).type) if i == at else kept.column(i) for i in range(kept.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(columns, names=kept.schema.names[:-2])

    made = joined.mapInArrow(lean(run), docs.schema)
    return made if whole is None else made.unionByName(whole)


def _whole_characters(text: bytes, span: tuple[int, int]) -> tuple[int, int]:
    start, end = span
    while start < end and start < len(text) and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, hash_bits: int = 64) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of docs.

    Each byte of a whole text covered by a `length`-byte string that also starts anywhere else, in the same text or
    another, is removed; overlaps count, matches never cross texts, and strings are judged on the input. Null and
    shorter texts lose nothing (null: 0 bytes). Rows equal in key and text are each other's repeats. An empty table
    gives no rows; other columns are ignored. spans: the maximal removed stretches [start, end) in bytes.
    """
    spans = repeated_spans(docs, key, text, length, hot, hash_bits)
    rows = _with_place(docs.select(F.col(key), F.col(text)), key, text).select(F.col(key).alias("__id"), "__a", "__b", "__t")
    keys = spans.select("__a", "__b")
    whole = None
    if keys.count() <= KEY_ROWS:  # only texts that lose something are moved
        whole = rows.join(F.broadcast(keys), ["__a", "__b"], "left_anti").select(
            "__id", F.octet_length("__t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("__t", 256).alias("kept_sha256"), F.array().cast(SPANS).alias("spans")
        )
        rows = rows.join(F.broadcast(keys), ["__a", "__b"], "left_semi")
    joined = rows.join(spans, ["__a", "__b"], "left").select("__id", "__t", "__spans", "__told")
    kind = joined.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        names = ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for i, (r, x) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                t = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                cut = removed(r, x, t, length)
                for column, x in zip(out, (len(t), sum(b - a for a, b in cut), len(cut), sha256(kept_bytes(t, cut)).hexdigest(), [{"start": a, "end": b} for a, b in cut])):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), shape)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=names)

    made = joined.mapInArrow(lean(run), f"__id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {SPANS}")
    return (made if whole is None else made.unionByName(whole)).withColumnRenamed("__id", key)
