"""Byte-level BPE: length-bucketed padded numpy matrices, one merge per row and round.

Texts are split by the tokenizer's pattern.  Distinct pieces that no earlier batch has met go, by byte length, into
padded matrices of token ids.  In each round every row merges its leftmost pair of least rank; pairs are looked up in a
hash table, rows shift left over the merged place, and finished rows leave the matrix.  A piece longer than
``LONG`` bytes (a row of its own would cost the square of its length) is merged by the same rule with a heap.

Defined results: a null text counts as empty and has no tokens; other columns are carried through where the caller
asks for them; repeated rows give repeated rows; an empty table gives an empty table.  The cache of pieces is
cleared at ``CACHE`` entries, so memory does not grow with the vocabulary of the corpus.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 256
CACHE = 400_000
#: Pieces that are held at once while a text is encoded.
BLOCK = 200_000
#: Code points of the texts whose pieces are held together; a longer text is encoded by blocks.
TEXT = 1_000_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, 4 * len(left))))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            at = (self._slot(keys[todo]) + self.probes) & (size - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.keys[at] == -1
            self.keys[at[first]] = keys[todo[first]]
            self.values[at[first]] = merged[todo[first]]
            todo = todo[~first]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where a pair does not merge (or an id is negative)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at, out = self._slot(keys), np.full(keys.shape, NONE, np.int32)
        for probe in range(self.probes):
            here = (at + probe) & (len(self.keys) - 1)
            hit = self.keys[here] == keys
            out[hit] = self.values[here[hit]]
        return out


class Tokenizer:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.pattern, self.cache = ranks, regex.compile(pattern), {}
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        self.pairs = PairTable(*np.array(pairs, np.int64).T) if pairs else PairTable(*np.zeros((3, 0), np.int64))

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the ids of pieces into the cache, bucket by bucket."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            buckets.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, rows in buckets.items():
            if width > LONG:
                for piece, raw in rows:
                    self.cache[piece] = np.array(self._heap(raw), "<u4").tobytes()
                continue
            step = max(1, 2_000_000 // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for (piece, _), ids in zip(part, self._matrix([r for _, r in part], width), strict=True):
                    self.cache[piece] = ids

    def _matrix(self, raws: list[bytes], width: int) -> list[bytes]:
        length = np.fromiter(map(len, raws), np.int64, len(raws))
        ids = np.full((len(raws), width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        rank = np.full((len(raws), width), NONE, np.int32)  # of the pair that begins at each place; the last has none
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rows, out, cols = np.arange(len(raws)), [b""] * len(raws), np.arange(width)
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            ended = best == NONE
            if ended.any():
                for row, line, n in zip(rows[ended], ids[ended], length[ended], strict=True):
                    out[row] = line[:n].astype("<u4").tobytes()
                live = ~ended
                rows, ids, rank, length, at, best = rows[live], ids[live], rank[live], length[live], at[live], best[live]
                if not len(rows):
                    break
            width = int(length.max())
            n, cols = np.arange(len(rows)), np.arange(width)
            ids[n, at] = best
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            length = length - 1
            ids[n, length], rank[n, length] = -1, NONE
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            rank[n, at] = np.where(at + 1 < length, self.pairs.find(ids[n, at], ids[n, after]), NONE)
            rank[n, before] = np.where(at > 0, self.pairs.find(ids[n, before], ids[n, at]), rank[n, before])
        return out

    def _heap(self, raw: bytes) -> list[int]:
        """The same rule for one long piece: least rank first, then leftmost."""
        ids = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n, get = len(ids), self.ranks.get
        ends = list(range(1, n + 1))
        before, alive = list(range(-1, n - 1)), [True] * n
        after = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            alive[j], ids[i], ends[i] = False, rank, end
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(raw[i : ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if (p := before[i]) >= 0 and (r := get(raw[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return [ids[i] for i in range(n) if alive[i]]

    def encode_blocks(self, text: str) -> Iterator[bytes]:
        """Ids of one text as little-endian unsigned 32-bit integers, a block of pieces at a time."""
        found = (m.group() for m in self.pattern.finditer(text))
        while pieces := list(islice(found, BLOCK)):
            self.known(pieces)
            yield b"".join(map(self.cache.__getitem__, pieces))

    def encode_texts(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """For each text the blocks of its ids; new pieces of neighbouring short texts are merged together."""
        k = 0
        while k < len(texts):
            group, chars = [], 0
            while k < len(texts) and len(group) < 512 and (not group or chars + len(texts[k]) <= TEXT):
                group.append(texts[k])
                chars += len(texts[k])
                k += 1
            if chars > TEXT:
                yield self.encode_blocks(group[0])
                continue
            pieces = [self.pattern.findall(x) for x in group]
            self.known({p for own in pieces for p in own})
            for own in pieces:
                yield iter((b"".join(map(self.cache.__getitem__, own)),))

    def known(self, pieces: Iterable[str]) -> None:
        new = {p for p in pieces if p not in self.cache}
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set(pieces)
        if new:
            self.learn(new)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per worker process."""
    return Tokenizer(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): the ids of each text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            ids = [b"".join(x) for x in t.encode_texts(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return _input(df, key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, raw binary): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], [key, "raw"])

    return df.select(key, "ids").mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, raw binary")


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            counts, ids_sha, raw_sha = [], [], []
            for blocks in t.encode_texts(batch.column(1).to_pylist()):
                a, b, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in blocks:
                    a.update(ids)
                    b.update(t.decode(ids))
                    n += len(ids) // 4
                counts.append(n)
                ids_sha.append(a.hexdigest())
                raw_sha.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(df, key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

