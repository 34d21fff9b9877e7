"""Exact similarity join of sets of 64-bit tokens, by blocks of sets in the shared folder.

1. *Order.* Tokens are counted in ``SLOTS`` slots; a set's tokens stand rarest slot first. Any order that all sets share is right, so a
   slot that several tokens share costs time only.
2. *Blocks.* A task writes the sets it reads as files of about ``BLOCK_TOKENS`` tokens, without a shuffle.
3. *Tiles.* A task compares several blocks with several others. Sets of n and m tokens with a similarity of t share at least
   o = t (n + m) / (1 + t), and so c of their first n - o + c and m - o + c tokens. Those prefixes meet in a table by token and band
   of sizes; pairs that share c are verified on whole sets.

What moves is the sets, once; token matches and candidates stay in the memory of a tile. The work of tiles grows with the square of
the sets that share rare tokens. Blocks are read and written through Arrow's file systems, which must know the shared folder's."""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_folder, stored

SLOTS = 1 << 20
#: Tokens and sets of a block; bits of a block's table; matches that a tile holds at once.
BLOCK_TOKENS, BLOCK_SETS, TABLE_BITS, MATCHES = 3_000_000, 32_768, 21, 1_000_000
#: Ratio of the sizes of a band; runs of blocks at least, blocks of a run at most, tasks at most.
BAND, RUNS, RUN, TASKS = 1.25, 10, 5, 4096

#: Rows of a side of a unit of summed_similarity, and tokens that its counting takes at once.
UNIT, COLUMNS = 512, 2048

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and all values of a list column without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def slot_counts(sets: DataFrame) -> DataFrame:
    """(slot, n) over the tokens of all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(_flat(batch.column(0))[1] & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 65_536):
            part = at[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["slot", "n"])

    return sets.select("tokens").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def write_blocks(sets: DataFrame, counts: str, folder: str) -> DataFrame:
    """(file, sets, tokens) of blocks written from sets (name, tokens); counts is the folder of slot_counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        source, path = _opened(counts)
        found = pq.read_table(path, filesystem=source)
        seen = np.zeros(SLOTS, np.int64)
        seen[found.column("slot").to_numpy()] = found.column("n").to_numpy()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def write() -> pa.RecordBatch:
            names, sizes, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows = np.repeat(np.arange(len(sizes)), sizes)
            # stable, and tokens come sorted: those of one count stay in their own order
            order = np.argsort((rows << 40) + np.minimum(seen[tokens & (SLOTS - 1)], (1 << 40) - 1), kind="stable")
            buffer = io.BytesIO()
            for x in (names, sizes.astype(np.int64), tokens[order]):
                np.save(buffer, x)
            file = f"{uuid.uuid4().hex}.npy"
            with fs.open_output_stream(f"{root}/{file}") as out:
                out.write(buffer.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(names)], pa.int64()), pa.array([len(tokens)], pa.int64())], names=["file", "sets", "tokens"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                sizes, tokens = _flat(part.column(1))
                held.append((part.column(0).to_numpy(), sizes, tokens))
                if sum(len(x[2]) for x in held) >= BLOCK_TOKENS or sum(len(x[1]) for x in held) >= BLOCK_SETS:
                    yield write()
        if held:
            yield write()

    return sets.select("name", "tokens").mapInArrow(run, "file string, sets long, tokens long")


def least_shared(n, m, t: float):
    """Tokens that sets of n and m share at least, at a similarity of t."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def _slot(tokens: np.ndarray, band: np.ndarray | int) -> np.ndarray:
    x = (tokens.view(np.uint64) ^ (np.asarray(band).astype(np.uint64) * _M2)) * _M1
    return ((x ^ (x >> np.uint64(29))) * _M2 >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Block:
    """Sets by row, and the tokens of their longest prefixes with row and place; as a table: those by token and band."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, t: float, common: int):
        self.names, self.sizes, self.tokens = names, sizes, tokens
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.bands = np.floor(np.log(sizes) / math.log(BAND) + 1e-9).astype(np.int64)
        longest = np.minimum(sizes, sizes - least_shared(sizes, np.ceil(t * sizes - 1e-9), t) + common)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), longest)
        self.place = (np.arange(len(self.row)) - np.repeat(np.cumsum(longest) - longest, longest)).astype(np.int32)
        self.token = tokens[self.starts[self.row] + self.place]
        self._table = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each slot starts, and the prefix tokens by slot."""
        if self._table is None:
            slot = _slot(self.token, self.bands[self.row])
            starts = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=1 << TABLE_BITS)))).astype(np.int32)
            self._table = starts, np.argsort(slot, kind="stable").astype(np.int32)
        return self._table


def candidates(a: Block, b: Block, t: float, common: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) that share enough of their prefixes; once a pair where both are one block."""
    starts, order = b.table()
    reach = math.ceil(math.log(1 / t) / math.log(BAND))
    present = np.unique(b.bands)
    probes = []
    for step in range(-reach, reach + 1):
        band = a.bands + step
        low = np.ceil(BAND**band - 1e-6)
        first = np.maximum(low, np.ceil(t * a.sizes - 1e-9))  # the smallest partner
        fits = np.isin(band, present) & (low * t <= a.sizes + 1e-9)
        short = np.where(fits, a.sizes - least_shared(a.sizes, first, t) + common, 0)
        at = np.flatnonzero(a.place < short[a.row])
        slot = _slot(a.token[at], band[a.row[at]])
        count = starts[slot + 1] - starts[slot]
        some = count > 0
        probes.append((at[some], starts[slot[some]], count[some]))
    at, start, count = (np.concatenate(x) for x in zip(*probes, strict=True))
    by_row = np.argsort(a.row[at], kind="stable")
    at, start, count = at[by_row], start[by_row], count[by_row]
    total = np.cumsum(count)
    # whole rows of a at a time
    ends = np.flatnonzero(np.diff(a.row[at], append=-1)) + 1
    i = 0
    while i < len(at):
        within = ends[: np.searchsorted(total[ends - 1], (total[i - 1] if i else 0) + MATCHES, side="right")]
        j = int(within[-1]) if len(within) and within[-1] > i else int(ends[np.searchsorted(ends, i, side="right")])
        n = count[i:j]
        x = np.repeat(at[i:j], n)
        y = order[np.repeat(start[i:j] - (np.cumsum(n) - n), n) + np.arange(len(x))]
        i = j
        same = a.token[x] == b.token[y]
        x, y = x[same], y[same]
        p, q = a.row[x], b.row[y]
        if a is b:
            once = p < q
            x, y, p, q = x[once], y[once], p[once], q[once]
        sp, sq = a.sizes[p], b.sizes[q]
        shared = least_shared(sp, sq, t)
        good = (shared <= np.minimum(sp, sq)) & (a.place[x] < sp - shared + common) & (b.place[y] < sq - shared + common)
        p, q, need = p[good], q[good], np.minimum(shared[good], common)
        code = p.astype(np.int64) * len(b.sizes) + q
        # most pairs share less: those whose slot has too few go before the rest is sorted
        slot = (code.astype(np.uint64) * _M2 >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        often = np.bincount(slot, minlength=1 << TABLE_BITS)[slot] >= need
        pair, where, times = np.unique(code[often], return_index=True, return_counts=True)
        pair = pair[times >= need[often][where]]
        if len(pair):
            yield pair // len(b.sizes), pair % len(b.sizes)


def verified(a: Block, b: Block, p: np.ndarray, q: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows with a similarity of at least t, and it; p comes sorted."""
    shared = np.zeros(len(p), np.int64)
    edges = np.concatenate((np.flatnonzero(np.diff(p, prepend=-1)), [len(p)]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = np.sort(a.tokens[a.starts[p[i]] : a.starts[p[i] + 1]])
        for k in range(i, j, 256):
            parts = [b.tokens[b.starts[r] : b.starts[r + 1]] for r in q[k : min(k + 256, j)].tolist()]
            other = np.concatenate(parts)
            hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
            shared[k : k + len(parts)] = np.add.reduceat(hit, np.cumsum([0, *map(len, parts[:-1])]), dtype=np.int64)
    similarity = shared / (a.sizes[p] + b.sizes[q] - shared)
    good = similarity >= t
    return p[good], q[good], similarity[good]


def runs_of(files: list[tuple[str, int, int]]) -> list[list[list[str]]]:
    """Runs of blocks, of files (file, sets, tokens): small files make a block together."""
    blocks, sets, tokens = [], BLOCK_SETS, BLOCK_TOKENS
    for file, n, m in sorted(files):
        if sets + n > BLOCK_SETS or tokens + m > BLOCK_TOKENS:
            blocks.append([])
            sets = tokens = 0
        blocks[-1].append(file)
        sets, tokens = sets + n, tokens + m
    run = min(RUN, max(1, math.ceil(len(blocks) / RUNS)))
    return [blocks[i : i + run] for i in range(0, len(blocks), run)]


def tile(k: int) -> tuple[int, int]:
    """The runs of tile k: (0, 0), (0, 1), (1, 1), (0, 2), ..."""
    j = (math.isqrt(8 * k + 1) - 1) // 2
    return k - j * (j + 1) // 2, j


def similar_sets(sets: DataFrame, t: float, common: int = 4) -> DataFrame:
    """(x, y, similarity) of names whose sets (name, tokens: sorted, distinct, not empty) have a Jaccard similarity of at least t."""
    spark = sets.sparkSession
    counts, folder = fresh_folder(spark, "slots"), fresh_folder(spark, "blocks")
    slot_counts(sets).write.parquet(counts)
    # a row a block, whatever it holds
    runs = runs_of([tuple(r) for r in stored(write_blocks(sets, counts, folder)).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)

        @lru_cache(RUN + 1)
        def load(files: tuple[str, ...]) -> Block:
            parts = []
            for file in files:
                with fs.open_input_file(f"{root}/{file}") as stream:
                    buffer = io.BytesIO(stream.read())
                parts.append([np.load(buffer) for _ in range(3)])
            return Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), t, common)

        for batch in batches:
            for i, j in map(tile, batch.column(0).to_pylist()):
                for k, left in enumerate(runs[i]):
                    for right in runs[j][k if i == j else 0 :]:
                        a, b = load(tuple(left)), load(tuple(right))
                        for p, q in candidates(a, b, t, common):
                            p, q, similarity = verified(a, b, p, q, t)
                            if len(p):
                                yield pa.RecordBatch.from_arrays([pa.array(a.names[p]), pa.array(b.names[q]), pa.array(similarity)], names=["x", "y", "similarity"])

    n = len(runs) * (len(runs) + 1) // 2
    return stored(spark.range(0, n, 1, max(1, min(n, TASKS))).mapInArrow(run, "x long, y long, similarity double"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of left has in common with each of right."""
    sides = [(np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)) for x in (left, right)]
    known = np.intersect1d(sides[0][1], sides[1][1]) if left is not right else np.unique(sides[0][1])
    found = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(known), COLUMNS):
        part = known[i : i + COLUMNS]
        flags = []
        for (row, token), x in zip(sides, (left, right), strict=True):
            at = np.minimum(np.searchsorted(part, token), len(part) - 1)
            hit = part[at] == token
            flags.append(np.zeros((len(x), len(part)), np.float32))
            flags[-1][row[hit], at[hit]] = 1
        found += flags[0] @ flags[1].T
    return found.astype(np.int64)


def unit_sum(side: np.ndarray, weight: np.ndarray, sets: list[np.ndarray]) -> float:
    """The sum of weighted similarities of the pairs of a unit: of side 2 each two rows, else rows of side 0 with those of side 1."""
    p, q = (np.arange(len(side)),) * 2 if (side == 2).all() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(p) or not len(q):
        return 0.0
    left = [sets[i] for i in p.tolist()]
    right = left if p is q else [sets[i] for i in q.tolist()]
    both = shared_counts(left, right)
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    s = both / (n[:, None] + m - both) * weight[p][:, None] * weight[q]
    return float(np.triu(s, 1).sum() if p is q else s.sum())


def summed_similarity(rows: DataFrame, root: str, units: int) -> DataFrame:
    """(root, s): unit_sum of each unit of rows (root, unit, side, w, tokens); units is about their number."""

    def run(given: pa.Table) -> pa.Table:
        given = given.combine_chunks()
        unit, side, weight = (given.column(c).to_numpy() for c in ("unit", "side", "w"))
        tokens = given.column("tokens").combine_chunks()
        sizes, flat = _flat(tokens)
        sets = np.split(flat, np.cumsum(sizes)[:-1])
        order = np.argsort(unit, kind="stable")
        first, sums = [], []
        for at in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            first.append(int(at[0]))
            sums.append(unit_sum(side[at], weight[at], [sets[i] for i in at.tolist()]))
        return pa.table({root: given.column(root).take(pa.array(first)), "s": pa.array(sums, pa.float64())})

    schema = f"`{root}` {rows.schema[root].dataType.simpleString()}, s double"
    task = F.pmod(F.xxhash64("unit"), F.lit(max(1, math.ceil(units / UNIT)))).alias("task")
    return rows.groupBy(task).applyInArrow(run, schema)
