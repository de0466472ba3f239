"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised to 1, 2, 4, 8 ...: an n-gram of quantised level k is put into a Bloom
filter k times, once with each of the numbers 1 to k, so a lookup probes with 1, 2, 3 ... until one is missing and
gets the level back without a count's ever being stored. A level stands for the mean of the counts that have it, so that
estimates add up to what was counted. Probabilities interpolate the pair's estimate with the word's.

Texts are tokenised once. Every chunk of texts (CHUNK_BYTES at most, unless one text is longer) keeps a sorted list of
its distinct token hashes and its texts as indices into that list; what is shuffled are, for each chunk and hash
range, packed arrays of hashes and counts, so a token costs bytes, not a row, and a frequent word is no larger a key
than a rare one. Ranges are merged with numpy; exact counts go back to the chunks the same way.

The filter grows with the corpus, at BITS_PER_ENTRY bits an entry, so it isn't broadcast whole: it is never in one place.
Each hash range has a slice of its own, made and probed by the task that counts the range, and the levels found go back
to the chunks. There is a range for every RANGE_BYTES of text, MIN_RANGES at least, whatever the session's settings: a
task holds one range's hashes, which don't grow with the corpus. Chunks times ranges are the most rows that are shuffled;
beyond some 10 TB, where that is a row for each pair of tokens, both sizes should be raised with the executors' memory.

Tokens are told by 64 bits of hash and pairs by 48: among a billion distinct tokens some pair of tokens shares a hash
with a probability of 3 %, and would be counted together.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

CHUNK_BYTES = 16 << 20
RANGE_BYTES, MIN_RANGES = 16 << 20, 8
FOLDS, HELD = 7, 2
PAIR_WEIGHT = 0.4
BITS_PER_ENTRY = 12
PROBES = 4
LEVELS = 48
_END = 0x5BD1E9955BD1E995  # the hash of the token that ends a text
_PAIR_BITS = 48
_DOCS, _WORDS, _PAIRS = 0, 1, 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(64 - _PAIR_BITS)


def pack(sorted_values: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte by byte of their places, so that compression finds the zeros."""
    d = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64)


def _merge(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    return v[heads], np.add.reduceat(c, heads) if len(heads) else c


def _seconds(lengths: np.ndarray) -> np.ndarray:
    """The places of all tokens but the first of each text."""
    later = np.ones(int(lengths.sum()), bool)
    later[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
    return np.flatnonzero(later)


class _Chunk:
    """Texts gathered until CHUNK_BYTES, then turned into packed rows."""

    def __init__(self, kind: pa.DataType) -> None:
        self.kind = kind
        self.ids: dict[bytes, int] = {}
        self.keys: list = []
        self.held: list[bool] = []
        self.tokens: list[np.ndarray] = []
        self.bytes = 0

    def add(self, key: object, text: bytes) -> None:
        words = text.lower().split()  # of bytes: A-Z only, and just 0x20 and 0x09-0x0D separate
        ids = self.ids
        for w in words:
            if w not in ids:
                ids[w] = len(ids)
        self.tokens.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.keys.append(key)
        self.held.append(crc32(b"" if key is None else str(key).encode()) % FOLDS == HELD)
        self.bytes += len(text)

    def rows(self, chunk: int, ranges: int) -> pa.RecordBatch:
        digest = xxhash.xxh64_intdigest
        raw = np.array([digest(w) for w in self.ids] + [_END], np.uint64)
        hashes, place = np.unique(raw, return_inverse=True)
        lengths = np.array([len(t) + 1 for t in self.tokens], np.int64)
        flat = np.concatenate([x for t in self.tokens for x in (t, np.array([len(raw) - 1], np.int32))])
        flat = place[flat].astype(np.int32)
        trained = np.repeat(~np.array(self.held, bool), lengths)
        counts = np.bincount(flat[trained], minlength=len(hashes)).astype(np.int64)
        at = _seconds(lengths)
        pairs, which = np.unique(_pair(hashes[flat[at - 1]], hashes[flat[at]]), return_inverse=True)
        pair_counts = np.bincount(which[trained[at]], minlength=len(pairs))  # 0 for those of held-out texts only

        out: list[list] = [[] for _ in range(7)]

        def row(kind: int, part: int, a: bytes, b: bytes, keys: list | None = None, held: list | None = None) -> None:
            for column, x in zip(out, (kind, chunk, part, a, b, keys, held)):
                column.append(x)

        end = np.cumsum(lengths)
        first = 0
        while first < len(lengths):  # documents in pieces of a few MB
            last = max(first + 1, int(np.searchsorted(end, end[first] + (1 << 20))))
            row(_DOCS, 0, flat[end[first] - lengths[first] : end[last - 1]].astype("<i4").tobytes(), lengths[first:last].astype("<i8").tobytes(), self.keys[first:last], self.held[first:last])
            first = last
        for kind, values, number, bits in ((_WORDS, hashes, counts, 64), (_PAIRS, pairs, pair_counts, _PAIR_BITS)):
            cuts = np.searchsorted(values, np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64))
            for part, (v, c) in enumerate(zip(np.split(values, cuts), np.split(number, cuts))):
                if len(v):
                    row(kind, part, pack(v), c.astype("<i4").tobytes())
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(self.kind), pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["kind", "chunk", "part", "a", "b", "keys", "held"])


def _tokenize(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, chunk = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            chunk = chunk or _Chunk(batch.schema.field(0).type)
            keys = batch.column(0).to_pylist()
            texts = batch.column(1)
            for i, key in enumerate(keys):
                chunk.add(key, texts[i].as_py().encode("utf-8", "surrogatepass"))
                if chunk.bytes >= CHUNK_BYTES:
                    yield chunk.rows((task << 24) + number, ranges)
                    number, chunk = number + 1, _Chunk(chunk.kind)
        if chunk and chunk.keys:
            yield chunk.rows((task << 24) + number, ranges)

    return run


_COUNTED = "kind int, chunk long, part int, a binary, b binary, c binary, n long, v long"


def _count(kind: int):
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All chunks' hashes of one range -> each chunk's, in their order, with the levels that the range's slice of the filter has for them.

        Words also get their counts in the whole corpus. A row for each level, with chunk = -level, has the sum of the counts
        and the number of the range's n-grams at that level.
        """
        chunks, values, counts, part = [], [], [], 0
        for batch in group:
            for row in batch.to_pylist():
                part = row["part"]
                chunks.append(row["chunk"])
                values.append(unpack(row["a"]))
                counts.append(np.frombuffer(row["b"], "<i4").astype(np.int64))
        v, c = _merge(values, counts)
        seen = c > 0
        levels = _levels(c[seen])
        found = probe_levels(make_filter(v[seen], levels, kind == _PAIRS), v, kind == _PAIRS).astype(np.uint8)
        rows: list[dict] = [{"kind": kind, "chunk": -int(k), "part": part, "n": int(c[seen][levels == k].sum()), "v": int((levels == k).sum())} for k in np.unique(levels)]
        for chunk, x in zip(chunks, values):
            at = np.searchsorted(v, x)
            row = {"kind": kind, "chunk": chunk, "part": part, "c": found[at].tobytes(), "n": 0, "v": 0}
            rows.append(row | {"a": pack(x), "b": c[at].astype("<i8").tobytes()} if kind == _WORDS else row)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(("kind", "chunk", "part", "a", "b", "c", "n", "v"), kinds))))

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 from 2 on, 3 from 4 on, 4 from 8 on ..."""
    return np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))), LEVELS).astype(np.uint8)


def _kind(grams: np.ndarray, pairs: bool) -> np.ndarray:
    """Words and pairs as keys of one filter."""
    return _mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5 if pairs else 0x3C3C3C3C3C3C3C3C))


def _places(keys: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """The PROBES places of a key at a level."""
    x = _mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    y = _mix(x) | np.uint64(1)
    return [(x + np.uint64(i) * y) % np.uint64(bits) for i in range(PROBES)]


def filter_bits(entries: int) -> int:
    """BITS_PER_ENTRY for each, whatever their number, in whole words of 64."""
    return -(-max(1, entries * BITS_PER_ENTRY) // 64) * 64


def make_filter(grams: np.ndarray, levels: np.ndarray, pairs: bool) -> np.ndarray:
    """A slice of the filter: every gram at its levels from 1 on."""
    bits = filter_bits(int(levels.sum(dtype=np.int64)))
    flags, keys = np.zeros(bits, bool), _kind(grams, pairs)
    for k in range(1, int(levels.max(initial=0)) + 1):
        for p in _places(keys[levels >= k], k, bits):
            flags[p] = True
    return np.packbits(flags, bitorder="little")


def probe_levels(filter_: np.ndarray, grams: np.ndarray, pairs: bool) -> np.ndarray:
    """Levels by membership: the one before the first that is missing; 0 if the first is."""
    keys = _kind(grams, pairs)
    level = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    k = 1
    while len(live) and k <= LEVELS:
        there = np.ones(len(live), bool)
        for p in _places(keys[live], k, len(filter_) * 8):
            there &= (filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0
        live = live[there]
        level[live] = k
        k += 1
    return level


def level_means(sums: dict[int, tuple[int, int]]) -> np.ndarray:
    """What each level from 0 on stands for: the mean of the counts that have it, from {level: (sum of counts, n-grams)}.

    A level that only a false positive can give stands for the middle of its counts.
    """
    level = np.arange(LEVELS + 1)
    out = np.where(level == 0, 0.0, 1.5 * np.exp2(level - 1.0) - 0.5)
    for k, (total, number) in sums.items():
        out[k] = total / number
    return out


def model_probability(word: np.ndarray, context: np.ndarray, pair: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    """Interpolation of the pair's relative frequency and the word's, which is add-one smoothed; the word's alone where the context is unknown."""
    single = np.minimum(word + 1, tokens + 1) / (tokens + distinct + 1)
    both = np.minimum(pair, context) / np.maximum(context, 1)
    return np.where(context > 0, PAIR_WEIGHT * both + (1 - PAIR_WEIGHT) * single, single)


def _score(tokens: int, distinct: int, means: dict[int, np.ndarray]):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        """One chunk: bounded by CHUNK_BYTES of text."""
        names, made = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], []
        ranges = sorted(((r["kind"], r["part"], r["a"], r["b"], r["c"]) for r in counts.to_pylist()), key=lambda r: r[:2])
        words = [r[2:] for r in ranges if r[0] == _WORDS]
        hashes = np.concatenate([unpack(a) for a, _, _ in words] or [np.empty(0, np.uint64)])
        exact = np.concatenate([np.frombuffer(b, "<i8") for _, b, _ in words] or [np.empty(0, np.int64)])
        base = np.log10((exact + 1) / (tokens + distinct + 1))
        word, paired = (means[kind][np.concatenate([np.frombuffer(r[4], np.uint8) for r in ranges if r[0] == kind] or [np.empty(0, np.uint8)])] for kind in (_WORDS, _PAIRS))
        rows = [row for batch in docs.to_batches() for row in batch.to_pylist()]
        texts = [(np.frombuffer(row["a"], "<i4"), np.frombuffer(row["b"], "<i8")) for row in rows]
        later = [_seconds(lengths) for _, lengths in texts]
        grams = [_pair(hashes[flat[at - 1]], hashes[flat[at]]) for (flat, _), at in zip(texts, later)]
        known = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)  # as counted: the levels come in this order
        for row, (flat, lengths), at, gram in zip(rows, texts, later, grams):
            heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            pair, context = np.zeros(len(flat)), np.zeros(len(flat))  # a text's first token has no context
            pair[at], context[at] = paired[np.searchsorted(known, gram)], word[flat[at - 1]]
            logs = np.log10(model_probability(word[flat], context, pair, tokens, distinct))
            out = [pa.array(row["keys"], docs.schema.field("keys").type.value_type), pa.array(row["held"], pa.bool_()), pa.array(lengths)]
            out += [pa.array(np.add.reduceat((exact > 0).astype(np.int64)[flat], heads)), pa.array(np.full(len(lengths), tokens, np.int64))]
            out += [pa.array(np.add.reduceat(x, heads)) for x in (base[flat], logs)]
            made.append(pa.Table.from_arrays(out, names=names))
        return pa.concat_tables(made)

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Words are runs of other bytes than 0x20 and 0x09-0x0D, with A-Z lower-cased; every text ends with one more token.
    Rows whose key's crc32 mod 7 is 2 are held out, all others train the model. base_score is exact: the sum of log10
    of (c + 1) / (N + V + 1). score is the model's log10 probability. Null and blank texts are one end token; keys are
    whole numbers or texts, null ones hash as the empty string. Repeated rows count and return once each; an empty table
    gives no rows; without training rows N and V are 0 and every probability is 1, the base's too. Other columns are
    ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind_of_key = rows.schema["key"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = max(MIN_RANGES, -(-size // range_bytes))
    shape = f"kind int, chunk long, part int, a binary, b binary, keys array<{kind_of_key}>, held array<boolean>"
    made = materialize(rows.mapInArrow(_tokenize(ranges), shape), "lm-chunks", partition_by="kind")
    parts = {kind: made.filter(F.col("kind") == kind).select("chunk", "part", "a", "b").groupBy("part") for kind in (_WORDS, _PAIRS)}
    counted = materialize(parts[_WORDS].applyInArrow(_count(_WORDS), _COUNTED), "lm-words")
    paired = materialize(parts[_PAIRS].applyInArrow(_count(_PAIRS), _COUNTED), "lm-pairs")
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for kind, frame in ((_WORDS, counted), (_PAIRS, paired)):  # a row for each level
        sums[kind] = {-r.chunk: (r.n, r.v) for r in frame.filter("chunk < 0").groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    tokens, distinct = (sum(x[i] for x in sums[_WORDS].values()) for i in (0, 1))

    texts = made.filter(F.col("kind") == _DOCS).select("chunk", "a", "b", "keys", "held")
    known = counted.unionByName(paired).filter("chunk >= 0").select("kind", "chunk", "part", "a", "b", "c")
    scored = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        _score(tokens, distinct, {kind: level_means(x) for kind, x in sums.items()}), f"key {kind_of_key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumnRenamed("key", key)
