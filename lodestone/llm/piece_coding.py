"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text's spaces become U+2581 and one is put before it, then it is cut before each U+2581 that follows another
character: no piece of the model goes over such a place, so words are independent. The distinct words of a batch are
grouped by length and those of one length advance together, one character at a time: hashes of their substrings probe
the sorted hashes of the pieces, and a vectorised maximum over the pieces that may end at a place keeps where the best
way came from. Hashes have 64 bits; encode_documents() decodes what it has encoded and compares, so two that met would be
seen.

A unigram model's result is the segmentation with the greatest sum of scores. A model made by merging (BPE) has ranks
for scores, and its segmentation is the one in which any two neighbours are what merging leaves of the two together: a
piece may follow another only if merging their joined characters ends in just these two. Of the ways to a place one
alone consists of such steps, it is the result of merging, and the maximum is taken over the steps allowed. Which two
pieces may meet is found by replaying their own merges side by side, and kept for later words.

A character that no piece covers becomes the pieces of its UTF-8 bytes.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _MERGES = 1, 2
#: Words kept with their ids in a worker before it starts anew.
CACHE_WORDS = 600_000
#: Longer words (runs without a space) are coded one by one, BLOCK places at a time, and not kept.
LONG, BLOCK = 512, 1 << 16
#: Slots for pairs of pieces that have been looked at.
PAIR_BITS = 21
_BASE = 0x9E3779B97F4A7C15
_LEADING = 21


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a model file")
        yield number, value


def read_model(model: bytes) -> tuple[list[tuple[str, float, int]], int, bool]:
    """(piece, score, type) in the order of their ids, the kind of model, and whether a space is put before texts, from a model file's protocol buffer.

    A model that changes texts before it cuts them (a map of characters, spaces taken out or kept as they are or put
    behind words) is refused: its pieces wouldn't give the text again.
    """
    pieces, kind, before = [], _UNIGRAM, True
    charsmap, squeeze, escape, behind = b"", True, True, False
    for number, value in _fields(model):
        if number == 1:
            piece, score, type_ = "", 0.0, _NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    type_ = v
            pieces.append((piece, score, type_))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    kind = v
                elif n == 24:
                    behind = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    charsmap = v
                elif n == 3:
                    before = bool(v)
                elif n == 4:
                    squeeze = bool(v)
                elif n == 5:
                    escape = bool(v)
    if charsmap or squeeze or behind or not escape:
        raise ValueError("the model's normaliser changes texts")
    if kind not in (_UNIGRAM, _MERGES):
        raise ValueError("neither a unigram model nor one of merges")
    return pieces, kind, before


class PieceCoder:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes) -> None:
        pieces, kind, self.before = read_model(model)
        self.names = [p for p, _, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == _BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no pieces for bytes")
        if any(k in (_USER, _UNUSED) for _, _, k in pieces):
            raise ValueError("the model has pieces of its user's own, or unused ones")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        self.raw_sizes = np.array([len(x) for x in self.raw], np.int32)
        self.raw_starts = np.cumsum(self.raw_sizes, dtype=np.int64) - self.raw_sizes
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        usable = [(p, i, s) for i, (p, s, k) in enumerate(pieces) if k == _NORMAL and p]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in usable):
            raise ValueError("a piece goes over the start of a word")
        self.longest = max(len(p) for p, _, _ in usable)
        lengths = np.array([len(p) for p, _, _ in usable])
        hashes = np.empty(len(usable), np.uint64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            hashes[at] = self._hashes(self._codes([usable[i][0] for i in at], int(n)), int(n))[:, 0]
        order = np.argsort(hashes, kind="stable")
        self.keys = hashes[order]
        if np.any(self.keys[1:] == self.keys[:-1]):
            raise ValueError("two pieces share a hash")
        # most substrings are no piece: a table of the hashes' leading bits tells nearly all of them before they are looked up
        leading = (self.keys >> np.uint64(64 - _LEADING)).astype(np.int64)
        self.leading = np.zeros(1 << _LEADING, bool)
        self.leading[leading] = True
        self.first = np.zeros(1 << _LEADING, np.int32)  # the first key of those that share leading bits
        self.first[leading[::-1]] = np.arange(len(leading), dtype=np.int32)[::-1]
        self.shared = int(np.unique(leading, return_counts=True)[1].max())
        self.ids = np.array([i for _, i, _ in usable], np.int32)[order]
        self.scores = np.array([s for _, _, s in usable] + [-np.inf])[np.append(order, len(usable))]  # the last one is that of no piece
        self.fallback = float(self.scores[:-1].min()) - 10.0
        self.merges = {p: s for p, _, s in usable} if kind == _MERGES else None
        self.traces: dict[int, tuple | None] = {}
        self.pair_keys = np.full(1 << PAIR_BITS, 2**64 - 1, np.uint64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.cache: dict[str, bytes] = {}  # the ids of a word as little-endian 32-bit numbers

    @staticmethod
    def _codes(words: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)

    @staticmethod
    def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all substrings of `size` characters of each row."""
        h = np.zeros((len(codes), codes.shape[1] - size + 1), np.uint64)
        for i in range(size):
            h = (h + codes[:, i : codes.shape[1] - size + 1 + i] + np.uint64(1)) * np.uint64(_BASE)
            h ^= h >> np.uint64(29)
        return h

    def _probe(self, codes: np.ndarray) -> np.ndarray:
        """(end, size - 1, row): which key the substring of `size` characters that ends there is; -1 if it is no piece."""
        n, length = codes.shape
        out = np.full((length + 1, self.longest, n), -1, np.int32)
        h = np.zeros((n, length), np.uint64)
        for size in range(1, min(self.longest, length) + 1):
            # one character more than the step before, for all starts at once
            h = (h[:, : length - size + 1] + codes[:, size - 1 :] + np.uint64(1)) * np.uint64(_BASE)
            h ^= h >> np.uint64(29)
            row, start = np.nonzero(self.leading[h >> np.uint64(64 - _LEADING)])
            found = h[row, start]
            at = self.first[found >> np.uint64(64 - _LEADING)]
            same = self.keys[at] == found
            for _ in range(1, self.shared):
                other = np.flatnonzero(~same)
                if not len(other):
                    break
                at[other] = np.minimum(at[other] + 1, len(self.keys) - 1)
                same[other] = self.keys[at[other]] == found[other]
            out[start[same] + size, size - 1, row[same]] = at[same]
        return out

    def _trace(self, key: int) -> tuple[str, str, list[tuple[float, str]], list[tuple[float, str]]] | None:
        """How merging makes a piece of its characters: first and last one, and of each merge its score and what the last
        (and the first) symbol is after it. None if merging ends otherwise."""
        if key not in self.traces:
            merges, symbols = self.merges, list(self.names[self.ids[key]])
            first, last = symbols[0], symbols[-1]
            ends: list[tuple[float, str]] = []
            starts: list[tuple[float, str]] = []
            while len(symbols) > 1:
                score, at = max((merges.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
                if score == -np.inf:
                    break
                symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
                ends.append((score, symbols[-1]))
                starts.append((score, symbols[0]))
            self.traces[key] = (first, last, starts, ends) if len(symbols) == 1 else None
        return self.traces[key]

    def _may_meet(self, before: int, key: int) -> bool:
        """Whether merging leaves two pieces as they are next to each other; before < 0: nothing that merges is there."""
        mine = self._trace(key)
        if mine is None or before < 0:
            return mine is not None
        _, x, _, left = self._trace(before)
        y, _, right, _ = mine
        i = j = 0
        while True:
            over = self.merges.get(x + y, -np.inf)
            a = left[i][0] if i < len(left) else -np.inf
            b = right[j][0] if j < len(right) else -np.inf
            if over > a and over >= b:  # of equal scores the leftmost merge comes first
                return False
            if a == b == -np.inf:
                return True
            if a >= b:
                x, i = left[i][1], i + 1
            else:
                y, j = right[j][1], j + 1

    def _allowed(self, before: np.ndarray, key: np.ndarray) -> np.ndarray:
        """_may_meet() of many pairs."""
        code = (before + 1).astype(np.uint64) * np.uint64(len(self.keys)) + key.astype(np.uint64)
        slot = (code * np.uint64(_BASE)) >> np.uint64(64 - PAIR_BITS)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != code)
        if len(new):
            _, first, which = np.unique(code[new], return_index=True, return_inverse=True)
            first = new[first]
            fits = np.fromiter(map(self._may_meet, before[first].tolist(), key[first].tolist()), bool, len(first))
            out[new] = fits[which]
            # pairs that share a slot: the last one stays, key and answer alike
            self.pair_keys[slot[first]] = code[first]
            self.pair_fits[slot[first]] = fits
            mixed = self.pair_keys[slot[first]] != code[first]
            if mixed.any():
                self.pair_keys[slot[first][mixed]] = 2**64 - 1
        return out

    def _equal_length(self, words: list[str], length: int) -> list[bytes]:
        """Words of one length, all a character further at each step."""
        n = len(words)
        found = self._probe(self._codes(words, length))
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        last = np.full((length + 1, n), -1, np.int32)
        rows = np.arange(n)
        for end in range(1, length + 1):
            sizes = min(self.longest, end)
            key = found[end, :sizes]
            before = last[end - sizes : end][::-1]
            way = best[end - sizes : end][::-1] + self.scores[key]
            if self.merges is not None:
                size, row = np.nonzero(key >= 0)
                way[size, row] = np.where(self._allowed(before[size, row], key[size, row]), way[size, row], -np.inf)
            size = way.argmax(axis=0)
            most = way[size, rows]
            lone = most == -np.inf  # a character as bytes: always possible
            best[end] = np.where(lone, best[end - 1] + self.fallback, most)
            back[end] = end - 1 - np.where(lone, 0, size)
            last[end] = np.where(lone, -1, key[size, rows])
        # the way back, a step of all words at a time; a word's pieces fill its row from the right
        pieces = np.full((n, length), -1, np.int32)
        lone = np.zeros(n, bool)
        where, column = np.full(n, length), length
        while len(rows):
            column -= 1
            at = where[rows]
            key = last[at, rows]
            pieces[rows, column] = self.ids[key]
            lone[rows[key < 0]] = True
            where[rows] = back[at, rows]
            rows = rows[where[rows] > 0]
        pieces = pieces[:, column:]
        used = pieces >= 0
        ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
        flat = pieces[used].astype("<i4").tobytes()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for r in np.flatnonzero(lone).tolist():  # a character as bytes is several ids
            taken: list[int] = []
            at = length
            while at:
                self._take(taken, int(last[at, r]), words[r][back[at, r] : at])
                at = int(back[at, r])
            out[r] = array("i", taken[::-1]).tobytes()
        return out

    def _take(self, taken: list[int], key: int, character: str) -> None:
        """The ids of one step of the way back."""
        if key >= 0:
            taken.append(int(self.ids[key]))
        else:
            taken.extend(self.bytes[x] for x in reversed(self._plain(character)))

    def _one_long(self, word: str) -> bytes:
        """A long run without a space: its substrings are probed all at once, BLOCK places at a time, then each place takes its best way."""
        length, scores = len(word), self.scores
        best, back, last = [0.0] + [-np.inf] * length, [0] * (length + 1), [-1] * (length + 1)
        met: dict[tuple[int, int], bool] = {}
        done = 0
        for stop in range(BLOCK, length + BLOCK, BLOCK):
            start = max(0, stop - BLOCK - self.longest)
            found = self._probe(self._codes([word[start:stop]], len(word[start:stop])))[:, :, 0]
            places, sizes = np.nonzero(found >= 0)
            keys = found[places, sizes]
            for end, size, key, score in zip((places + start).tolist(), (sizes + 1).tolist(), keys.tolist(), scores[keys].tolist()):
                if end <= stop - BLOCK:
                    continue  # a place of the block before
                while done < end - 1:  # places that no piece ends at
                    done += 1
                    if last[done] < 0:
                        best[done], back[done] = best[done - 1] + self.fallback, done - 1
                way = best[end - size] + score
                if last[end] >= 0 and way <= best[end]:
                    continue
                if self.merges is not None:
                    pair = (last[end - size], key)
                    if pair not in met:
                        met[pair] = self._may_meet(*pair)
                    if not met[pair]:
                        continue
                best[end], back[end], last[end] = way, end - size, key
        while done < length:
            done += 1
            if last[done] < 0:
                best[done], back[done] = best[done - 1] + self.fallback, done - 1
        taken: list[int] = []
        at = length
        while at:
            self._take(taken, last[at], word[back[at] : at])
            at = back[at]
        return array("i", taken[::-1]).tobytes()

    @staticmethod
    def _plain(character: str) -> bytes:
        return (" " if character == SPACE else character).encode("utf-8", "surrogatepass")

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of words into the cache."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            if length > LONG:
                self.cache.update((w, self._one_long(w)) for w in group)
                continue
            step = max(1, BLOCK // length)
            for i in range(0, len(group), step):
                self.cache.update(zip(group[i : i + step], self._equal_length(group[i : i + step], length)))

    def split(self, text: str) -> list[str]:
        """The words of a text; U+2581 itself, which can't be told from a space, is kept apart as bytes by encode()."""
        return _CUT.findall(SPACE * self.before + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and empty ones."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        literal = array("i", [self.bytes[x] for x in SPACE.encode()]).tobytes()
        parts: list[list[list[str]]] = []
        seen: set[str] = set()
        for text in texts:
            mine = []
            for k, part in enumerate((text or "").split(SPACE)):
                # after a U+2581 the text goes on without a space of its own
                mine.append(self.split(part) if k == 0 else _CUT.findall(part.replace(" ", SPACE)))
            if text and text.startswith(SPACE) and self.before:
                mine[0] = [SPACE]
            for words in mine:
                seen.update(words)
            parts.append(mine)
        self.encode_words(list(seen.difference(self.cache)))
        of, out = self.cache.__getitem__, []
        for mine in parts:
            ids = literal.join(b"".join(map(of, words)) for words in mine)
            out.append(np.frombuffer(ids, np.int32))
        for word in seen:
            if len(word) > LONG:
                self.cache.pop(word, None)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put in front goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if self.before and text.startswith(" ") else text

    def _decode_some(self, batch: list[np.ndarray]) -> Iterator[str]:
        ids = np.concatenate(batch)
        sizes, blocks = self.raw_sizes[ids], []
        for at in range(0, len(ids), BLOCK):
            size = sizes[at : at + BLOCK]
            ends = np.cumsum(size, dtype=np.int64)
            blocks.append(self.raw_bytes[np.arange(ends[-1]) + np.repeat(self.raw_starts[ids[at : at + BLOCK]] - ends + size, size)].tobytes())
        joined, start, first = b"".join(blocks), 0, 0
        for x in batch:
            end = start + int(sizes[first : first + len(x)].sum(dtype=np.int64))
            space = self.before and joined[start : min(start + 1, end)] == b" "
            yield joined[start + space : end].decode("utf-8", "surrogatepass")
            start, first = end, first + len(x)

    def decode_all(self, batch: list[np.ndarray]) -> list[str]:
        """decode() of each: the bytes of many ids, some 16 * BLOCK or one text's, are gathered together."""
        counts, out, at = np.cumsum([len(x) for x in batch], dtype=np.int64), [], 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(counts, counts[at] - len(batch[at]) + 16 * BLOCK, "right")))
            out.extend(self._decode_some(batch[at:stop]))
            at = stop
        return out


_coders: dict[int, PieceCoder] = {}


def _coder(sent, name: int) -> PieceCoder:
    """One coder for each worker and model."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = PieceCoder(sent.value)
    return _coders[name]


def _send(spark, path: str):
    """A model file's bytes for every worker. A file over 64 MB is refused."""
    with open(path, "rb") as file:
        data = file.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError("the model file is over 64 MB")
    return spark.sparkContext.broadcast(data), crc32(data)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, step: int = 1000) -> DataFrame:
    """(key, n_tokens, ids, n_chars, round_trip) of every row of docs.

    ids: the pieces of the whole text; none for null and empty ones. round_trip: whether decoding the ids gives the text
    again, byte by byte (null and empty: true). Repeated rows return once each; an empty table gives no rows; other
    columns are ignored.
    """
    sent, name = _send(docs.sparkSession, model)
    source = docs.select(F.col(key).alias("__id"), F.col(text).alias("__t"))
    kind = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent, name)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = part.column(1).to_pylist()
                ids = coder.encode(texts)
                same = [a == (b or "") for a, b in zip(coder.decode_all(ids), texts)]
                lengths = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids or [np.empty(0, np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat, pa.int32()))
                columns = [part.column(0), pa.array(lengths), lists, pa.array([len(t or "") for t in texts], pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=["__id", "n_tokens", "ids", "n_chars", "round_trip"])
        coder.cache = {}  # the worker lives on for other tasks

    return source.mapInArrow(run, f"__id {kind}, n_tokens long, ids array<int>, n_chars long, round_trip boolean").withColumnRenamed("__id", key)


def decode_documents(coded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text) of rows with piece ids; null and empty ids give the empty text. Repeated rows return once each, an empty table gives no rows, other columns are ignored."""
    sent, name = _send(coded.sparkSession, model)
    source = coded.select(F.col(key).alias("__id"), F.col(ids).alias("__i"))
    kind = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent, name)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["__id", "text"])

    return source.mapInArrow(run, f"__id {kind}, text string").withColumnRenamed("__id", key)
