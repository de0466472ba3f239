"""SimHash near-dedup by tiled exact comparison.

Fingerprints are compared tile against tile with numpy's exclusive-or and bit counts. Tiles hold fingerprints of
neighbouring population counts; a pair of tiles whose counts differ by more than the radius has no link and is
skipped.

Which tiles meet: a fingerprint of `bits` bits is cut into radius + 1 blocks, two linked fingerprints agree in one
block at least, and so only fingerprints with an equal block are put into the same tiles. That is exact, moves
radius + 1 copies of each distinct fingerprint whatever the size of the corpus, and spreads the work by key. A block
value that is common beyond TILE members is not one task's: its members are dealt into (population count, salt)
tiles, and pairs of such tiles are keys of their own. Equal fingerprints are one member, so that copies cost nothing.
Each comparison returns a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import KEY_ROWS, hint_small, materialize, row_hashes, whole_row
from .components import components

TILE = 4096
#: What one task confirms together: members, and bytes of their shingle sets.
CONFIRM_ROWS, CONFIRM_BYTES = 1024, 16 << 20
#: Bits of a shingle set's sketch, and the rows of one key up to which all of its pairs are taken at once with other keys'.
SKETCH_BITS, FEW = 1024, 32
#: Members whose wide sketches one task compares.
THIN_ROWS = 16384
SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of `width` words joined by spaces; of the whole sequence if there are fewer; none without words."""
    words = text.lower().split()  # of bytes: A-Z only, and just 0x20 and 0x09-0x0D separate
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are 1 where over half of the hashes have a 1."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(__id, __f0): signed longs holding each text's fingerprint."""
    source = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    kind = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            made = [majority(shingle_hashes(column[i].as_py().encode("utf-8", "surrogatepass"), width)) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["__id", "__f0"])

    return source.mapInArrow(run, f"__id {kind}, __f0 long")


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _join_pairs(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    for a, b in zip(left.tolist(), right.tolist()):
        a, b = _find(parent, a), _find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)


def _join_confirmed(parent: np.ndarray, left: np.ndarray, right: np.ndarray, confirm: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """As _join_pairs, but only pairs that confirm() accepts are joined; pairs already connected aren't asked about. Returns those joined."""
    made = []
    while len(left):
        while np.any(parent[parent] != parent):
            parent[:] = parent[parent]
        apart = parent[left] != parent[right]
        left, right = left[apart], right[apart]
        for x, y in zip(left[:256].tolist(), right[:256].tolist()):
            a, b = _find(parent, x), _find(parent, y)
            if a != b and confirm(x, y):
                parent[max(a, b)] = min(a, b)
                made.append((x, y))
        left, right = left[256:], right[256:]
    return made


def compare_tiles(values: np.ndarray, radius: int, sides: np.ndarray | None = None, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (indices u, v) of the links among values, uint64 of shape (n,).

    sides: 0 or 1 for each value; only links between the two sides count. Tiles are cut in the order of the population
    counts, and tile pairs further apart than the radius are skipped.
    """
    counts = np.bitwise_count(values).astype(np.int64)
    order = np.argsort(counts, kind="stable")
    counts, v = counts[order], values[order]
    s = None if sides is None else sides[order]
    parent = np.arange(len(v))
    for a in range(0, len(v), tile):
        rows, last = v[a : a + tile], counts[min(a + tile, len(v)) - 1]
        for b in range(a, len(v), tile):
            if counts[b] - last > radius:
                break
            near = np.bitwise_count(rows[:, None] ^ v[None, b : b + tile]) <= radius
            if s is not None:
                near &= s[a : a + tile, None] != s[None, b : b + tile]
            x, y = np.nonzero(near)
            x, y = x + a, y + b
            ahead = x < y
            _join_pairs(parent, x[ahead], y[ahead])
    roots = np.array([_find(parent, i) for i in range(len(v))], np.int64)
    child = np.flatnonzero(roots != np.arange(len(v)))
    return order[roots[child]], order[child]


def differ_most(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many elements two sets of these sizes together, alike as asked, have that aren't in both, at most."""
    return np.floor(sizes * (1 - similarity) / (1 + similarity) + 1e-9)


def compare_sets(
    sketches: np.ndarray | list[np.ndarray], sizes: np.ndarray, similarity: float, confirm: Callable[[int, int], bool], sides: np.ndarray | None = None, labels: np.ndarray | None = None, tile: int = 512
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (indices u, v) of the links that confirm() accepts among sets, told by sketch() and number of elements.

    Only pairs that sizes and sketches prove to be less alike aren't asked about, and those already connected. labels:
    sets of one label are connected from the start. Tiles are cut in the order of the sizes. A list of sketches may have
    different widths: two tiles meet at the width of the smallest set.
    """
    order = np.argsort(sizes, kind="stable")
    n, k = sizes[order], [sketches[i] for i in order.tolist()] if isinstance(sketches, list) else sketches[order]
    s = None if sides is None else sides[order]
    parent = np.arange(len(n))
    if labels is not None:
        _, first, label = np.unique(labels[order], return_index=True, return_inverse=True)
        parent = first[label]
    made: list[tuple[int, int]] = []
    for a in range(0, len(n), tile):
        rows, last = fold(k[a : a + tile], len(k[a])), n[min(a + tile, len(n)) - 1]
        for b in range(a, len(n), tile):
            if n[b] * similarity > last + 1e-6:
                break
            others = fold(k[b : b + tile], len(k[a]))
            total = np.zeros((len(rows), len(others)), np.int32)
            for w in range(rows.shape[1]):
                total += np.bitwise_count(rows[:, None, w] ^ others[None, :, w])
            small, big = n[a : a + tile, None], n[None, b : b + tile]  # of pairs in the order of the sizes
            near = (total <= differ_most(small + big, similarity)) & (big * similarity <= small + 1e-6)
            if s is not None:
                near &= s[a : a + tile, None] != s[None, b : b + tile]
            x, y = np.nonzero(near)
            ahead = x + a < y + b
            x, y = x[ahead], y[ahead]
            nearest = np.argsort(total[x, y], kind="stable")
            made += _join_confirmed(parent, x[nearest] + a, y[nearest] + b, lambda i, j: confirm(int(order[i]), int(order[j])))
    pairs = order[np.array(made, np.int64).reshape(-1, 2)]
    return pairs[:, 0], pairs[:, 1]


def block_masks(radius: int, bits: int = 64) -> list[tuple[int]]:
    """radius + 1 blocks of __f0: fingerprints within the radius agree in one at least."""
    blocks = radius + 1
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return [((1 << cuts[i + 1]) - (1 << cuts[i]),) for i in range(blocks)]


def link_fingerprints(values: DataFrame, masks: list[tuple[int, ...]], radius: int, tile_rows: int = TILE) -> DataFrame:
    """Distinct fingerprints (__f0 and any more __f columns, long) -> links (u, v), named by the columns' 64-bit hash __h.

    Pairs that agree in all bits of one of the masks are compared: __f0 may differ in at most `radius` bits. Links are
    spanning forests of what each comparison finds.
    """
    words = sorted(c for c in values.columns if c.startswith("__f"))
    signed = [[m - (1 << 64) if m >> 63 else m for m in mask] for mask in masks]
    table = F.array(*[F.struct(F.lit(i).alias("b"), *[F.lit(m).cast("long").alias(f"m{k}") for k, m in enumerate(mask)]) for i, mask in enumerate(signed)])
    placed = values.select("__h", *words, F.bit_count("__f0").cast("long").alias("__pc"), F.explode(table).alias("__k"))
    placed = placed.select("__h", *words, "__pc", "__k.b", F.xxhash64("__k.b", *[F.col(w).bitwiseAND(F.col(f"__k.m{k}")) for k, w in enumerate(words)]).alias("x"))
    sizes = materialize(placed.groupBy("b", "x", "__pc").agg(F.count("*").alias("__n")), "simhash-sizes")
    large = materialize(sizes.groupBy("b", "x").agg(F.sum("__n").alias("__all")).filter(F.col("__all") > tile_rows).select("b", "x"), "simhash-large")

    zero = F.lit(0)
    single = placed
    if not large.isEmpty():
        # a large key's tiles are (population count, salt), numbered t; g is how many salts a count has
        tiles = sizes.join(large, ["b", "x"]).select("b", "x", "__pc", F.ceil(F.col("__n") / tile_rows).cast("long").alias("g"))
        mine = placed.join(tiles, ["b", "x", "__pc"]).withColumn("t", F.col("__pc") * (1 << 32) + F.pmod(F.xxhash64("__h"), F.col("g")))
        others = tiles.groupBy("b", "x").agg(F.collect_list(F.struct(F.col("__pc").alias("oc"), "g")).alias("os"))  # at most 65 counts
        met = mine.drop("g").join(others, ["b", "x"]).select("b", "x", "__h", *words, "__pc", "t", F.explode("os").alias("o"))
        met = met.filter(F.abs(F.col("o.oc") - F.col("__pc")) <= radius)
        met = met.select("b", "x", "__h", *words, "t", F.explode(F.expr("transform(sequence(0L, o.g - 1), i -> o.oc * 4294967296 + i)")).alias("u"))
        several = met.select("b", "x", F.least("t", "u").alias("p"), F.greatest("t", "u").alias("q"), F.when(F.col("t") <= F.col("u"), 0).otherwise(1).alias("side"), "__h", *words)
        single = placed.join(large, ["b", "x"], "left_anti")
        single = single.select("b", "x", zero.cast("long").alias("p"), zero.cast("long").alias("q"), zero.alias("side"), "__h", *words).unionByName(several)
    else:
        single = single.select("b", "x", zero.cast("long").alias("p"), zero.cast("long").alias("q"), zero.alias("side"), "__h", *words)

    def links(parts: list[np.ndarray], several_tiles: bool) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        f = rows[:, 2:].view(np.uint64)
        u, v = compare_tiles(np.ascontiguousarray(f[:, 0]), radius, sides=rows[:, 0] if several_tiles else None)
        return pa.RecordBatch.from_arrays([pa.array(rows[u, 1]), pa.array(rows[v, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (b, x, p, q): those of a tile pair are consecutive."""
        kept: list[np.ndarray] = []
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]
            key, body = np.stack(cols[:4], axis=1), np.stack(cols[4:], axis=1)
            new = (np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1).tolist()
            for start, end in zip([0, *new], [*new, len(key)]):
                pair = tuple(key[start].tolist())
                if pair != last:
                    if sum(map(len, kept)) > 1:
                        yield links(kept, last[2] != last[3])
                    kept = []
                last = pair
                kept.append(body[start:end])
        if sum(map(len, kept)) > 1:
            yield links(kept, last[2] != last[3])

    dealt = single.repartition("b", "x", "p", "q").sortWithinPartitions("b", "x", "p", "q")
    return dealt.mapInArrow(run, "u long, v long")


def sketch(hashes: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The parities of how many of a set's hashes fall into each of `bits` cells: no two sets differ in fewer elements than their sketches in bits."""
    cells = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bits, minlength=bits)
    return np.packbits(cells & 1).tobytes()


def wide_bits(size: int) -> int:
    """So many cells that sets which have nothing to do with each other differ in a quarter of their elements at least: over what those alike may."""
    return max(SKETCH_BITS, 1 << (max(1, size) - 1).bit_length())


def fold(sketches: np.ndarray | list[np.ndarray], words: int) -> np.ndarray:
    """Sketches of 64-bit words at a smaller width: the cells that fall together are added."""
    if isinstance(sketches, list):
        return np.stack([x if len(x) == words else np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in sketches])
    return sketches


def prefix(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's sorted hashes, so many that sets alike as asked have one of them in common: the least of all they share."""
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def _described(width: int, similarity: float):
    """Rows that end with a text -> the same with, in its place, 128 bits that tell its shingle set, the set's size, class, prefix, sketch and wide sketch.

    Sets alike as asked are of the same class of sizes, or of neighbouring ones.
    """
    step = -math.log(similarity) * (1 + 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = batch.column(batch.num_columns - 1), []
            for i in range(batch.num_rows):
                h = np.unique(shingle_hashes(texts[i].as_py().encode("utf-8", "surrogatepass"), width))
                whole = h.tobytes()
                made.append((xxhash.xxh64_intdigest(whole, 0), xxhash.xxh64_intdigest(whole, 1), len(h), int(math.log(max(1, len(h))) / step), prefix(h, similarity).view(np.int64), sketch(h), sketch(h, wide_bits(len(h)))))
            f0, f1, n, c, p, k, w = zip(*made) if made else [()] * 7
            arrays = [*batch.columns[:-1], *[pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f0, f1)], pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.list_(pa.int64())), pa.array(k, pa.binary()), pa.array(w, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "__f0", "__f1", "__n", "__pc", "__p", "__k", "__w"])

    return run


def _sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def link_sets(groups: DataFrame, similarity: float, tile_rows: int = TILE) -> DataFrame:
    """Sets (__h, __n, __pc, __p, __k of _described()) -> loose links (u, v), whose components hold all pairs that are alike.

    Sets alike as asked have an element of their prefixes in common, so sets meet by those; of the pairs that meet, those
    which sizes and sketches don't rule out are linked, or connected by a spanning forest. An element that over tile_rows
    sets meet by is dealt into (class of sizes, salt) tiles, and pairs of such tiles are keys of their own.
    """
    placed = groups.select("__h", F.explode("__p").alias("x"))
    shared = materialize(placed.groupBy("x").agg(F.count("*").alias("m")).filter("m > 1"), "simhash-shared")
    met = placed.join(shared, "x").join(groups.select("__h", "__n", "__pc", "__k"), "__h")
    zero = F.lit(0).cast("long")
    columns = ["x", "p", "q", "side", "__h", "__n", "__k"]
    single = met.filter(F.col("m") <= tile_rows).withColumns({"p": zero, "q": zero, "side": F.lit(0)}).select(*columns)
    if not shared.filter(F.col("m") > tile_rows).isEmpty():
        large = materialize(met.filter(F.col("m") > tile_rows).select("x", "__h", "__n", "__pc", "__k"), "simhash-large")
        tiles = large.groupBy("x", "__pc").agg(F.ceil(F.count("*") / tile_rows).cast("long").alias("g"))
        mine = large.join(tiles, ["x", "__pc"]).withColumn("t", F.col("__pc") * (1 << 32) + F.pmod(F.xxhash64("__h"), F.col("g"))).drop("g")
        others = tiles.select("x", F.explode(F.array(F.col("__pc") - 1, "__pc", F.col("__pc") + 1)).alias("__pc"), F.col("__pc").alias("oc"), "g")
        dealt = mine.join(others, ["x", "__pc"]).withColumn("u", F.explode(F.expr("transform(sequence(0L, g - 1), i -> oc * 4294967296 + i)")))
        dealt = dealt.withColumns({"p": F.least("t", "u"), "q": F.greatest("t", "u"), "side": F.when(F.col("t") <= F.col("u"), 0).otherwise(1)})
        single = single.unionByName(dealt.select(*columns))

    def links(key: np.ndarray, side: np.ndarray, h: np.ndarray, n: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
        found = [(np.empty(0, np.int64),) * 2]
        few = ends - starts <= FEW
        left = np.repeat(np.where(few, ends, 0), ends - starts)  # where the rows of a key end, if there are few
        sided = key[:, 1] != key[:, 2]
        for d in range(1, FEW):  # all pairs of few rows, of many keys at once
            u = np.flatnonzero(np.arange(len(key)) + d < left)
            if not len(u):
                break
            v = u + d
            near = np.minimum(n[u], n[v]) + 1e-6 >= similarity * np.maximum(n[u], n[v])
            near &= ~sided[u] | (side[u] != side[v])
            u, v = u[near], v[near]
            near = np.bitwise_count(k[u] ^ k[v]).sum(axis=1, dtype=np.int64) <= differ_most(n[u] + n[v], similarity)
            found.append((u[near], v[near]))
        for a, b in zip(starts[~few].tolist(), ends[~few].tolist()):
            u, v = compare_sets(k[a:b], n[a:b], similarity, lambda i, j: True, side[a:b] if sided[a] else None)
            found.append((u + a, v + a))
        u, v = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([h[u], h[v]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (x, p, q): those of one key are consecutive, and the last key's wait for the next batch."""
        waiting: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]
            rows = (np.stack(cols[:3], axis=1), *cols[3:], _sketches(batch.column(6).to_pylist()))
            if waiting and (rows[0][-1] == waiting[0][0][-1]).all():
                waiting.append(rows)
                continue
            rows = tuple(np.concatenate(x) for x in zip(*waiting, rows))
            cut = int(np.flatnonzero(np.any(rows[0] != rows[0][-1], axis=1))[-1]) + 1 if np.any(rows[0][0] != rows[0][-1]) else 0
            if cut:
                yield from links(*(x[:cut] for x in rows))
            waiting = [tuple(x[cut:] for x in rows)]
        if waiting:
            yield from links(*(np.concatenate(x) for x in zip(*waiting)))

    return single.repartition("x", "p", "q").sortWithinPartitions("x", "p", "q").mapInArrow(run, "u long, v long")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the given Jaccard similarity or more; empty ones are equal."""
    small, big = (a, b) if len(a) < len(b) else (b, a)
    if not len(big):
        return True
    if len(small) / len(big) < similarity:
        return False
    same = int(np.count_nonzero(big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small))
    return same / (len(a) + len(b) - same) >= similarity


def _confirm(similarity: float):
    """Members in the order of (root, p, q), those of a tile pair together -> the links confirmed by their shingle sets."""

    def links(held: dict[int, tuple], several: bool) -> pa.RecordBatch:
        names, rows = list(held), list(held.values())
        sets = [np.frombuffer(r[-1], np.uint64) for r in rows]
        sides, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
        u, v = compare_sets([np.frombuffer(r[2], np.uint64) for r in rows], np.array([len(x) for x in sets]), similarity, lambda i, j: alike(sets[i], sets[j], similarity), sides if several else None, labels)
        h = np.array(names, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h[u]), pa.array(h[v])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        last: tuple | None = None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for root, p, q, h, *row in zip(*cols):
                if (root, p, q) != last:
                    if len(held) > 1:
                        yield links(held, last[1] != last[2])
                    held, last = {}, (root, p, q)
                held[h] = tuple(row)
        if len(held) > 1:
            yield links(held, last[1] != last[2])

    return run


def _compared(similarity: float):
    """Members in the order of (root, p, q), those of a tile pair together -> a spanning forest of the pairs that sizes and wide sketches don't rule out."""

    def links(rows: list[tuple], several: bool) -> pa.RecordBatch:
        h, sides, n, w = zip(*rows)
        u, v = compare_sets([np.frombuffer(x, np.uint64) for x in w], np.array(n), similarity, lambda i, j: True, np.array(sides) if several else None)
        names = np.array(h, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last: tuple | None = None
        for batch in batches:
            for root, p, q, *row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if (root, p, q) != last:
                    if len(held) > 1:
                        yield links(held, last[1] != last[2])
                    held, last = [], (root, p, q)
                held.append(tuple(row))
        if len(held) > 1:
            yield links(held, last[1] != last[2])

    return run


def finer_links(linked: DataFrame, similarity: float, tile_rows: int = THIN_ROWS) -> DataFrame:
    """Members (root, __h, __n, __w) of loose components -> links (u, v) that connect all pairs of one component which wide sketches don't rule out.

    SKETCH_BITS can't tell sets of 2,000 elements and more, which then are one loose component if they have passages in
    common; wide sketches can. They take an eighth of a byte for each element, in tiles as elsewhere: a component costs its
    members' sketches times its tiles, and its pairs of like size.
    """
    sizes = linked.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum(F.octet_length("__w")) / CONFIRM_BYTES)).cast("long").alias("g"))
    large = materialize(sizes.filter("g > 1"), "simhash-wide")
    dealt = linked.join(hint_small(large, large.count()), "root", "left").withColumn("g", F.coalesce("g", F.lit(1).cast("long")))
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("__h"), "g")).withColumn("o", F.explode(F.expr("sequence(0L, g - 1)")))
    dealt = dealt.select("root", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), "__h", F.when(F.col("t") <= F.col("o"), 0).otherwise(1).alias("side"), "__n", "__w")
    return dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(_compared(similarity), "u long, v long")


def _sets(width: int):
    """Rows that end with a text -> the same with the number of its distinct shingles, and their sorted hashes, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, made = 0, 0, []
            texts = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                made.append(np.unique(shingle_hashes(texts[i].as_py().encode("utf-8", "surrogatepass"), width)))
                size += made[-1].nbytes
                if size > CONFIRM_BYTES or i == batch.num_rows - 1:
                    kept = batch.slice(start, len(made)).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())], names=[*batch.schema.names[:-1], "__n", "__s"])
                    start, size, made = i + 1, 0, []

    return run


def confirm_links(links: DataFrame, groups: DataFrame, rows: DataFrame, width: int, similarity: float, tile_rows: int = CONFIRM_ROWS, thin_rows: int = THIN_ROWS) -> DataFrame:
    """Of loose links (u, v) among groups (__h, __n, __w, __least with __a and __b), those that hold for the texts of rows (__a, __b, __t).

    Only members of a loose component meet, and of those only what wide sketches leave connected. Each brings its shingle set
    once to a task, in which pairs that sizes and sketches don't rule out are taken nearest first, those not yet connected are compared by their sets, and so a component of copies is
    confirmed by as many comparisons as it has members. A component of over tile_rows members (or CONFIRM_BYTES) is
    dealt into tiles, each with the same few more members, so that what is alike is connected over them; then only
    members outside its largest confirmed part meet the rest, tile by tile. No pair of members that may be alike is left out.
    """
    loose = components(links).withColumnRenamed("node", "__h")
    linked = materialize(groups.join(loose, "__h").select("root", "__h", "__n", "__w", "__least.__a", "__least.__b"), "simhash-loose")
    finer = components(finer_links(linked.select("root", "__h", "__n", "__w"), similarity, thin_rows)).withColumnRenamed("node", "__h")
    linked = materialize(linked.drop("root", "__n").join(finer, "__h"), "simhash-linked")
    if linked.count() <= KEY_ROWS:  # texts that aren't wanted stay where they are
        rows = rows.join(F.broadcast(linked.select("__a", "__b")), ["__a", "__b"], "left_semi")
    texts = linked.join(rows.dropDuplicates(["__a", "__b"]), ["__a", "__b"]).select("root", "__h", "__w", "__t")
    members = materialize(texts.mapInArrow(_sets(width), "root long, __h long, __w binary, __n long, __s binary"), "simhash-members")

    def tiles(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / tile_rows), F.ceil(size * 8 / CONFIRM_BYTES)).cast("long")

    def meet(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("root", "p", "q", "__h", "side", "label", "__w", "__s")
        return dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(_confirm(similarity), "u long, v long")

    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("__n").alias("size"))
    large = materialize(sizes.select("root", tiles(F.col("n"), F.col("size")).alias("g"), F.ceil(F.col("n") / 32).alias("few")).filter("g > 1"), "simhash-large")
    zero = F.lit(0).cast("long")
    first = members.select("*", F.lit(0).alias("side"), F.col("__h").alias("label"))
    number = large.count()
    if not number:
        return meet(first.select("*", zero.alias("p"), zero.alias("q")))

    own = F.pmod(F.xxhash64("__h"), F.coalesce("g", F.lit(1)))
    everywhere = F.expr("g is not null and pmod(xxhash64(__h, 1), few) = 0")
    placed = first.join(hint_small(large, number), "root", "left").withColumn("p", F.explode(F.when(everywhere, F.expr("sequence(0L, g - 1)")).otherwise(F.array(own))))
    found = materialize(meet(placed.withColumn("q", F.col("p"))), "simhash-confirmed")

    parts = components(found).select(F.col("node").alias("__h"), F.col("root").alias("part"))
    few = hint_small(large.select("root"), number)
    labelled = members.select("root", "__h", "__n").join(few, "root").join(parts, "__h", "left").select("root", "__h", "__n", F.coalesce("part", "__h").alias("label"))
    labelled = materialize(labelled, "simhash-parts")
    by_part = labelled.groupBy("root", "label").agg(F.count("*").alias("n"), F.sum("__n").alias("size"))
    most = F.max(F.struct("n", "size", "label"))
    plan = by_part.groupBy("root").agg(most.alias("most"), (F.sum("n") - F.max("n")).alias("n"), F.sum("size").alias("size"))
    plan = plan.filter("n > 0").select("root", F.col("most.label").alias("main"), tiles(F.col("most.n"), F.col("most.size")).alias("gm"), tiles(F.col("n"), F.col("size") - F.col("most.size")).alias("go"))
    plan = materialize(plan, "simhash-rest")
    rest = members.join(hint_small(plan, number), "root").join(labelled.select("__h", "label"), "__h")
    # tiles of the others are 0 .. go - 1, those of the main part follow; others meet all tiles, the main part those of the others
    other = F.col("label") != F.col("main")
    t = F.when(other, F.pmod(F.xxhash64("__h"), "go")).otherwise(F.col("go") + F.pmod(F.xxhash64("__h"), "gm"))
    u = F.explode(F.expr("sequence(0L, if(label <> main, go + gm, go) - 1)"))
    rest = rest.withColumn("t", t).withColumn("u", u)
    rest = rest.select("*", F.least("t", "u").alias("p"), F.greatest("t", "u").alias("q"), F.when(F.col("t") <= F.col("u"), 0).otherwise(1).alias("side"))
    return found.unionByName(meet(rest))


def _grouped(marked: DataFrame, words: list[str], least: Column, links: Callable[[DataFrame], DataFrame], carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(words, __root) of every distinct fingerprint, and (__root, __c) with the least value of `least`, an aggregate's argument, in each component.

    carry: columns that are the same for equal fingerprints, for links().
    """
    groups = marked.groupBy(*words).agg(F.min(least).alias("__least"), *[F.first(c).alias(c) for c in carry])
    groups = materialize(groups.withColumn("__h", F.col(words[0]) if len(words) == 1 else F.xxhash64(*words)), "simhash-groups")
    roots = materialize(components(links(groups)), "simhash-roots")
    placed = groups.join(roots.withColumnRenamed("node", "__h"), "__h", "left").withColumn("__root", F.coalesce("root", "__h"))
    return placed.select(*words, "__root"), placed.groupBy("__root").agg(F.min("__least").alias("__c"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) of every row of docs.

    fingerprint: 16 lowercase hex digits, over all whole-text shingles of `width` words, repeats included; zero for null
    and blank texts, which are linked like any other. component_id: the smallest key reachable over links of at most
    `radius` differing bits, itself included; null keys are passed over (null if all are null). Repeated rows return
    once each; an empty table gives no rows; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, key, text, width), "simhash")
    placed, named = _grouped(marked, ["__f0"], F.col("__id"), lambda groups: link_fingerprints(groups.select("__h", "__f0"), block_masks(radius), radius))
    joined = marked.join(placed.join(named, "__root").select("__f0", "__c"), "__f0")
    return joined.select(F.col("__id").alias(key), F.lower(F.lpad(F.hex("__f0"), 16, "0")).alias("fingerprint"), F.col("__c").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, tile_rows: int = CONFIRM_ROWS, link_rows: int = TILE, thin_rows: int = THIN_ROWS) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest key stays, whole.

    Texts are linked if their sets of `width`-word shingles have the given similarity (Jaccard) or more, and groups are
    what links connect. No pair is left out: candidates have one of the first (1 - similarity) of their sorted shingle
    hashes in common, as all sets so alike do, and each is then confirmed by the sets themselves. Sets equal in 128 bits
    of hash are taken for one, shingles are told by 64. Texts without a word are alike. Every group keeps just one row:
    rows without a key come after all others, rows of one key are told apart by a hash of their texts, and of rows equal
    in key and text any one stands for all. An empty table gives no rows.
    """
    a, b = row_hashes(key, text)
    texts = docs.select(a.alias("__a"), b.alias("__b"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    source = docs.select(F.col(key).alias("__id"), a.alias("__a"), b.alias("__b"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    kind = source.schema["__id"].dataType.simpleString()
    described = source.mapInArrow(_described(width, similarity), f"__id {kind}, __a long, __b long, __f0 long, __f1 long, __n long, __pc long, __p array<long>, __k binary, __w binary")
    marked = materialize(described, "simhash")
    first = F.struct(F.col("__id").isNull().alias("blank"), "__id", "__a", "__b")

    def links(groups: DataFrame) -> DataFrame:
        loose = link_sets(groups, similarity, link_rows)
        return confirm_links(loose, groups, texts, width, similarity, tile_rows, thin_rows)

    _, named = _grouped(marked, ["__f0", "__f1"], first, links, carry=("__n", "__pc", "__p", "__k", "__w"))
    stay = materialize(named.select("__c.__a", "__c.__b"), "simhash-stay")
    rows = docs.select(a.alias("__a"), b.alias("__b"), whole_row(docs))
    # made distinct by the join's own keys, before the columns are taken apart: texts are shuffled once
    return rows.join(stay, ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"]).select("__row.*")
