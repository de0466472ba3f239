"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m bytes with at most k edits keeps at least (m - q + 1) - k q of the item's q-grams, and
all of them on diagonals (place in the text less place in the item) that lie within k + 1 of each other. Shared q-grams
are therefore counted in bands of 2 (k + 1) diagonals that overlap by half; bands that reach the bound are merged where
they touch and aligned, on their own diagonals only, and kept if the alignment needs k edits at most.

A q-gram that an item holds at over FEW places (of a rule or a padding run) isn't multiplied by them: such q-grams are
taken as shared, which lowers the item's bound by their places, and the others are counted. An item that hardly has others
is looked for on all diagonals that any of its q-grams may stand on, from its last place to its first. Either way no
occurrence is lost.

Texts and items are compared with A-Z lower-cased and white space made single spaces. Items are a stated set of queries:
they are sent to the workers in parts of PART_BYTES of text, and texts are read once for each part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import materialize

Q = 12
EDIT_SHARE = 0.05
BLOCK = 2 << 20
TABLE_BITS = 22
#: Places of one item beyond which a q-gram is taken as shared.
FEW = 8
#: Bytes of items that a worker holds at once (their tables take some 60 times as much), unless one item has more.
PART_BYTES = 4 << 20


def normal(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def _grams(a: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each place on (of zeros after the end)."""
    b = np.zeros(len(a) + 16, np.uint8)
    b[: len(a)] = a
    v = np.ascontiguousarray(sliding_window_view(b, 8)[: len(a) + 8]).view("<u8").ravel()
    h = v[: len(a)] * np.uint64(0x9E3779B97F4A7C15)
    h ^= v[Q - 8 : len(a) + Q - 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class _Grams:
    """Q-grams sorted by their hashes: the item of each, and the first and last place at which it stands there."""

    def __init__(self, rows: list[tuple[np.ndarray, ...]]) -> None:
        grams, *columns = (np.concatenate(c) for c in zip(*rows)) if rows else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        order = np.argsort(grams, kind="stable")
        self.item, self.first, self.last = (c[order] for c in columns)
        self.keys, self.start, self.count = np.unique(grams[order], return_index=True, return_counts=True)

    def met(self, hit: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the texts, row here) of every two that are equal."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        same = self.keys[at] == grams
        hit, at = hit[same], at[same]
        n = self.count[at]
        return np.repeat(hit, n), np.repeat(self.start[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Items:
    """The items' q-grams, sorted, with where they stand; edit budgets and bounds."""

    def __init__(self, items: list[tuple], edit_share: float = EDIT_SHARE) -> None:
        kept = [(i, normal(t)) for i, t in items if t]
        self.short = [(i, t) for i, t in kept if 0 < len(t) < Q]  # without a q-gram: found only as they are
        kept = [(i, t) for i, t in kept if len(t) >= Q]
        self.ids = [i for i, _ in kept]
        self.texts = [np.frombuffer(t, np.uint8) for _, t in kept]
        size = np.array([len(t) for t in self.texts], np.int64)
        # the bound must be one q-gram at least
        self.budget = np.minimum((edit_share * size).astype(np.int64), (size - Q) // Q)
        self.bound = size - Q + 1 - self.budget * Q
        grams = [_grams(t)[: len(t) - Q + 1] for t in self.texts]
        counted: list[tuple[np.ndarray, ...]] = []
        loose: list[tuple[np.ndarray, ...]] = []
        for i, x in enumerate(grams):
            values, first, which, number = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
            frequent = number[which] > FEW
            self.bound[i] -= int(frequent.sum())
            places = np.flatnonzero(~frequent)
            if self.bound[i] > 0:
                counted.append((x[places], np.full(len(places), i), places, places))
            else:  # its other q-grams can't tell it
                last = np.zeros(len(values), np.int64)
                np.maximum.at(last, which, np.arange(len(x)))
                loose.append((values, np.full(len(values), i), first, last))
        self.counted, self.loose = _Grams(counted), _Grams(loose)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        for some in (self.counted, self.loose):
            self.table[some.keys >> np.uint64(64 - TABLE_BITS)] = True


def _merged(low: np.ndarray, high: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [low, high) of each group, those that touch or overlap made one."""
    order = np.lexsort((low, group))
    low, high, group = low[order], high[order], group[order]
    # groups don't mix: each one's ends are lifted over those of the groups before
    lift = (group - group.min()) * (int(high.max()) - int(low.min()) + 2)
    reach = np.maximum.accumulate(high + lift)
    new = np.concatenate([[True], low[1:] + lift[1:] > reach[:-1]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(low)) - 1
    return low[starts], reach[ends] - lift[ends], group[starts]


def _align(text: np.ndarray, start: int, stop: int, item: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """Least edits of the item within text[start:stop], over `width` diagonals from `low` on (of places in text), and the end of that stretch."""
    rows = len(item)
    big = len(item) + width
    met = np.full(width + rows, 256, np.int16)  # the bytes that the diagonals meet, a place further in each row
    first, last = max(low, start), min(low + width + rows, stop)
    if first < last:
        met[first - low : last - low] = text[first:last]
    none = np.where(met == 256, big, 0).astype(np.int32)
    places = np.arange(low, low + width + rows + 1)
    outside = np.where((places < start) | (places > stop), big, 0).astype(np.int32)
    ramp = np.arange(width, dtype=np.int32)
    d = outside[:width].copy()
    for i, c in enumerate(item.tolist()):
        n = np.maximum(d + (met[i : i + width] != c), none[i : i + width])
        np.minimum(n[:-1], d[1:] + 1, out=n[:-1])
        n -= ramp
        np.minimum.accumulate(n, out=n)
        n += ramp
        d = np.maximum(n, outside[i + 1 : i + 1 + width])
    best = int(d.argmin())
    return int(d[best]), low + best + rows


def scan(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(text's number, item's id, edits, end) of each item found in each text; the occurrence with the least edits."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for k, t in enumerate(texts):
        for i, x in items.short:
            at = t.find(x)
            if at >= 0:
                found[k, i] = (0, at + len(x))
    if len(items.ids) and texts:
        joined = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        h = _grams(joined)
        hit = np.flatnonzero(items.table[h >> np.uint64(64 - TABLE_BITS)])
        lows, highs, groups = [], [], []
        place, each = items.counted.met(hit, h[hit])
        if len(place):
            item = items.counted.item[each]
            text = np.searchsorted(starts, place, side="right") - 1
            half = items.budget[item] + 1
            diagonal = place - items.counted.first[each]  # in the joined texts; a text's own are apart from the next one's
            band = diagonal // half
            lowest = int(band.min())
            span = int(band.max()) - lowest + 2
            for shift in (0, 1):
                key = (text * len(items.ids) + item) * span + (band - shift - lowest + 1)
                _, first, number = np.unique(key, return_index=True, return_counts=True)
                full = first[number >= items.bound[item[first]]]
                lows.append((band[full] - shift) * half[full])
                highs.append((band[full] - shift + 2) * half[full])
                groups.append(text[full] * len(items.ids) + item[full])
        place, each = items.loose.met(hit, h[hit])
        if len(place):
            item = items.loose.item[each]
            text = np.searchsorted(starts, place, side="right") - 1
            # an occurrence holds one q-gram at least, at one of its places: on one of these diagonals, or within the budget of it
            lows.append(place - items.loose.last[each] - items.budget[item])
            highs.append(place - items.loose.first[each] + items.budget[item] + 1)
            groups.append(text * len(items.ids) + item)
        if sum(map(len, lows)):
            for low, high, group in zip(*(x.tolist() for x in _merged(*map(np.concatenate, (lows, highs, groups))))):
                t, i = divmod(group, len(items.ids))
                edits, end = _align(joined, int(starts[t]), int(starts[t] + sizes[t]), items.texts[i], low, high - low)
                if edits <= items.budget[i]:
                    found[t, items.ids[i]] = min(found.get((t, items.ids[i]), (edits, end - int(starts[t]))), (edits, end - int(starts[t])))
    return [(t, i, e, end) for (t, i), (e, end) in sorted(found.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def _parts(benchmark: DataFrame, key: str, text: str, part_bytes: int) -> Iterator[list[tuple]]:
    """The items, as many at once as have part_bytes of text, by a hash; one part is held by the driver at a time."""
    rows = benchmark.select(F.col(key).alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    number = max(1, -(-size // part_bytes))
    for n in range(number):
        mine = rows if number == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(number)) == n)
        yield [tuple(r) for r in mine.collect()]


_held: dict[tuple[int, float], Items] = {}


def _items(sent: Broadcast, edit_share: float) -> Items:
    """The tables of one part, made once by each worker; another part's go."""
    name = (sent.value[0], edit_share)
    if name not in _held:
        _held.clear()
        _held[name] = Items(sent.value[1], edit_share)
    return _held[name]


def _send(docs: DataFrame, items: list[tuple]) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().int, items))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edit_share: float = EDIT_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, item_id, edits, end) for each row of docs and item whose text stands in it with at most edit_share of its bytes edited.

    edits: the least number (bytes put in, left out or changed); end: where that occurrence ends, in bytes of the text with
    A-Z lower-cased and white space made single spaces. The budget of items under 2 Q bytes is what the lemma allows, and
    items under Q bytes are found as they are only. Null and empty texts and items have no occurrences. Repeated rows
    return once each; an empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(key).alias("__id"), F.col(text).alias("__t")).filter("__t <> ''")
    kind = source.schema["__id"].dataType.simpleString()
    named, arrow = benchmark.schema[item].dataType.simpleString(), to_arrow_type(benchmark.schema[item].dataType)

    def run(sent: Broadcast):
        def scan_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(sent, edit_share)
            for batch in batches:
                rows: list[tuple] = []
                for start, texts in _blocks(batch.column(1)):
                    rows += [(start + t, i, e, end) for t, i, e, end in scan(items, texts)]
                at, ids, edits, ends = zip(*rows) if rows else ((), (), (), ())
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, arrow), *[pa.array(x, pa.int64()) for x in (edits, ends)]]
                yield pa.RecordBatch.from_arrays(columns, names=["__id", "item_id", "edits", "end"])

        return scan_part

    out = None
    for items in _parts(benchmark, item, item_text, part_bytes):
        mine = source.mapInArrow(run(_send(docs, items)), f"__id {kind}, item_id {named}, edits long, end long")
        out = mine if out is None else out.unionByName(mine)
    return out.withColumnRenamed("__id", key)


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    texts: list[bytes] = []
    size = first = 0
    for i in range(len(column)):
        t = column[i].as_py()
        texts.append(normal(t) if t else b"")
        size += len(texts[-1])
        if size > BLOCK:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", edit_share: float = EDIT_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs in which no item is found by find_leaks(), with all their columns; nothing is shuffled.

    Rows with null and empty texts stay, repeated rows are judged one by one; an empty table, or one without items, stays as
    it is.
    """
    at = docs.columns.index(text)

    def run(sent: Broadcast):
        def scan_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(sent, edit_share)
            for batch in batches:
                bad = {start + row[0] for start, texts in _blocks(batch.column(at)) for row in scan(items, texts)}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64()))

        return scan_part

    out = docs
    for n, items in enumerate(_parts(benchmark, item, item_text, part_bytes)):
        # what one part leaves is written before the next one: else a task would hold the tables of all parts
        out = (materialize(out, "leaks") if n else out).mapInArrow(run(_send(docs, items)), docs.schema)
    return out
