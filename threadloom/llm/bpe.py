"""Byte-level BPE encoding and decoding.

Pieces of the split pattern are grouped by length into padded numpy matrices. In each round every row merges its
leftmost pair of minimum rank; pairs are looked up in an open-addressed hash table, and a compaction closes the gap.
Rows without a mergeable pair leave the matrix. Pieces over ``MATRIX_BYTES`` bytes, where a row a round would cost the
square of the length, go through a heap that merges in the same order.

Cases: null text counts as empty; an empty text has no ids and decodes to nothing; a null id is kept; repeated rows
each give a row; other columns of the input are not read. A text is never cut.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mapped

MATRIX_BYTES = 256
#: Cells of a matrix at most; bytes of pieces and ids that a worker remembers, about; texts and characters that are encoded together at most, but for one text.
MATRIX_CELLS, REMEMBERED_BYTES = 1 << 19, 32 << 20
BATCH_TEXTS, BATCH_CHARS = 256, 1 << 21
NO_RANK = np.iinfo(np.int32).max


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (about 1 MB, bounded by the vocabulary), to be shipped with the tasks."""
    with open(path, "rb") as f:
        return f.read()


class PairTable:
    """(left id, right id) -> rank of their concatenation, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NO_RANK where the pair has none or a side is padding (-1)."""
        shape, padding = left.shape, ((left < 0) | (right < 0)).ravel()
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(keys.shape, NO_RANK, np.int32)
        open_ = np.flatnonzero(~padding)
        at = self._slot(keys[open_])
        while len(open_):
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out.reshape(shape)


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.pairs = PairTable(self.ranks_of)
        self.byte_ids = np.array([self.ranks_of[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks_of.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in self.ranks_of.items():
            self.bytes_of[rank] = token
        self.decimal_of = [str(i) for i in range(size)]
        self.split = regex.compile(pattern).findall
        self.memory: dict[str, tuple[int, ...]] = {}
        self.held, self.most = 0, REMEMBERED_BYTES

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; pieces not yet known are merged together, a matrix for each length bucket. Long pieces are not remembered."""
        if self.held > self.most:
            self.memory.clear()
            self.held = 0
        pieces = [self.split(t) for t in texts]
        long = self._learn({p for ps in pieces for p in ps} - self.memory.keys())
        known = ChainMap(long, self.memory).__getitem__ if long else self.memory.__getitem__
        for ps in pieces:
            yield list(chain.from_iterable(map(known, ps)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Remembers the ids of the pieces, but for those over MATRIX_BYTES, which it returns."""
        long: dict[str, tuple[int, ...]] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.ranks_of.get(raw)
            if whole is not None:
                self.memory[p] = (whole,)
            elif len(raw) > MATRIX_BYTES:
                long[p] = tuple(self._merge_long(raw))
            else:
                buckets.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
        for width, rows in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for (p, _), ids in zip(part, self._merge_matrix([r for _, r in part], width), strict=True):
                    self.memory[p] = ids
                    self.held += 200 + len(p) + 8 * len(ids)
        return long

    def _merge_matrix(self, rows: list[bytes], width: int) -> list[tuple[int, ...]]:
        lengths = np.array([len(r) for r in rows])
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[flat], -1).astype(np.int32)
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        out: list[tuple[int, ...]] = [()] * len(rows)
        at = np.arange(len(rows))
        while len(at):
            if not ranks.shape[1]:
                best = np.full(len(at), NO_RANK, np.int32)
            else:
                left = ranks.argmin(1)
                best = ranks[np.arange(len(at)), left]
            done = best == NO_RANK
            if done.any():
                for k, row in zip(at[done].tolist(), ids[done], strict=True):
                    out[k] = tuple(row[row >= 0].tolist())
                keep = ~done
                at, ids, ranks = at[keep], ids[keep], ranks[keep]
                if not len(at):
                    break
                left, best = left[keep], best[keep]
            n, w = ids.shape
            r = np.arange(n)
            ids[r, left] = best
            column = np.arange(w - 1)
            ids = np.take_along_axis(ids, column + (column > left[:, None]), 1)
            column = np.arange(w - 2)
            ranks = np.take_along_axis(ranks, column + (column >= left[:, None]), 1)
            for j in (left - 1, left):
                ok = np.flatnonzero((j >= 0) & (j < w - 2))
                if len(ok):
                    ranks[ok, j[ok]] = self.pairs.ranks(ids[ok, j[ok]], ids[ok, j[ok] + 1])
        return out

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list, n log n in its length."""
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)]
        first = self.pairs.ranks(ids[:-1], ids[1:])
        heap = [(int(first[i]), i) for i in np.flatnonzero(first != NO_RANK).tolist()]
        heapq.heapify(heap)
        token: list = ids.tolist()
        n = len(token)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = dict((i, r) for r, i in heap)
        get, bytes_of = self.ranks_of.get, self.bytes_of

        def renew(i: int) -> None:
            j = following[i]
            rank = get(bytes_of[token[i]] + bytes_of[token[j]]) if j < n else None
            if rank is None:
                rank_at.pop(i, None)
            else:
                rank_at[i] = rank
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if rank_at.get(i) != rank:
                continue
            j = following[i]
            token[i], token[j] = rank, None
            rank_at.pop(j, None)
            following[i] = following[j]
            if following[i] < n:
                before[following[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return [t for t in token if t is not None]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The worker's codec for this rank file; built once a worker."""
    key = hashlib.sha1(rank_file).hexdigest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of runs of rows."""
    begin, texts, n = 0, [], 0
    for i, t in enumerate(batch.column(1)):
        texts.append(t.as_py() or "")
        n += len(texts[-1])
        if len(texts) == BATCH_TEXTS or n >= BATCH_CHARS:
            yield batch.column(0).slice(begin, len(texts)), texts
            begin, texts, n = i + 1, [], 0
    if texts:
        yield batch.column(0).slice(begin, len(texts)), texts


def encode_documents(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): token ids of every whole text, without special tokens."""
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern)
        for batch in batches:
            for keys, texts in _texts(batch):
                ids = pa.array(list(own.encode(texts)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, ids], names=[id_col, "ids"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return mapped(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): what the ids stand for; null ids decode to nothing."""
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern)
        for batch in batches:
            raw = pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=[id_col, "bytes"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return mapped(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, bytes binary")


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids again and digests both, in one pass.

    The ids of a text stay in the worker, so that a corpus is checked without moving or storing its ids.
    """
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern)
        own.most = remembered
        decimal = own.decimal_of.__getitem__
        for batch in batches:
            for keys, texts in _texts(batch):
                n, a, b = [], [], []
                for ids in own.encode(texts):
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return mapped(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
