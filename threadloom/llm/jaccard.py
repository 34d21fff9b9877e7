"""N-gram Jaccard join: which documents link, and the components that the links make.

A document's set is the distinct hashes of its word n-grams. Sets that agree are one node. Two nodes link when the
Jaccard similarity of their sets is at least num / den. Every link between nodes is found by signature trees; keys only say which
nodes meet in one tree:

1. *Groups.* Sets of a similarity of t differ in at most d = n (1 - t) / t elements, n the smaller size. Split by hash into
   k > d parts, they agree in a part whole, so a key a part (its place and the sum of its hashes) brings them together.
   Empty parts have no key; k leaves room for them. A set with more empty parts than that also takes another
   split, and at the last one a key that all such sets share. k comes from a ladder, so that sets of near sizes use the same.
   The blocks of one first node (the hub) are one group.
2. *Signature trees.* A group is dealt to units of about ``UNIT`` rows, the hub in each. A unit builds a tree whose nodes hold
   OR-combined token bitmaps and size ranges; a dual traversal of the tree with itself drops node pairs whose maximum possible overlap is too small.
   Sets are fetched for rows that it leaves, and a second tree on them, with wider bitmaps, names the pairs that are verified. A group of one unit is done.
3. *Hot groups.* Links make components. Where a group of several units still holds rows of different ones, each row outside the
   hub's component meets all rows of the group, in trees of ``APART_UNIT`` rows a side; pairs of one component are skipped.

Every pair that is kept is verified on whole sets. Rows that move grow with the rows of groups; only step 3 takes the product
of a group's rows outside that component and all its rows, over ``APART_UNIT``. Hashes have 64 bits: among N documents about N^2 / 2^65 unequal pairs share a name.

Cases: null or blank texts have an empty set, link with nothing and are their own component; a null doc_id takes no
part and gets a null component; rows of one doc_id are one document; ids are integers; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, unused, written

LADDER, SPLITS = 1.5, 8
#: Rows of a unit, rows and set elements of a task of units, fan-out and leaf size of a tree.
UNIT, TASK_ROWS, TASK_ELEMENTS, FAN, LEAF = 256, 2048, 150_000, 4, 16
#: Rows of a side of a unit of a hot group's open rows.
APART_UNIT = 2048
REMEMBERED = 60_000
#: Nodes whose keys a task remembers to have given.
SEEN = 200_000
#: Ids of a broadcast at most; beyond, texts are fetched by a shuffled join.
BROADCAST_IDS = 1_000_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
_S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible order."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_word_hash = _Words().__getitem__


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words, A-Z in lower case; of all words where they are fewer than n."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_word_hash, words)), np.uint64)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * _M3 + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def name_of(hashes: np.ndarray) -> int:
    """The set's node: 64 bits of all its hashes, signed."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64)))


@lru_cache(100_000)
def parts_for(n: int, num: int, den: int) -> int:
    """Parts that a smaller set of n elements is split into; 0 where only equal sets link."""
    d = n * (den - num) // num
    if d == 0:
        return 0
    best, step, k = (math.inf, d + 1), 0, 0
    while k <= 4 * n:
        k, step = math.ceil(LADDER**step), step + 1
        empty = k * (1 - 1 / k) ** n if k > 1 else 0.0
        room = k - d - 1
        if room < 0:
            continue
        if empty <= 0.1 * (room + 1) or room >= empty + 1.5 * math.sqrt(empty):
            return k
        best = min(best, (empty / (room + 1), k))
    return best[1]  # very small sets: the further splits make up for it


@lru_cache(100_000)
def splits_for(n: int, num: int, den: int) -> tuple[tuple[int, int], ...]:
    """(parts, most empty parts) of each split that a set of n shares with a set no larger."""
    least = -(-n * num // den)
    found: dict[int, int] = {}
    for m in range(least, n + 1):
        if k := parts_for(m, num, den):
            found[k] = k - 1 - m * (den - num) // num
    return tuple(found.items())


def keys_of(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of a set."""
    out = []
    for k, room in splits_for(len(hashes), num, den):
        for turn in range(SPLITS):
            salted = mixed(hashes + np.uint64(turn * 7919 + k)) if turn else hashes
            part = ((salted >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            if turn:
                order = np.argsort(part, kind="stable")
                part, salted = part[order], salted[order]
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(mixed(salted + _M3), starts)
            out.append(mixed(sums ^ mixed(part[starts] + np.uint64((k << 32) + (turn << 24)))))
            if k - len(starts) <= room:
                break
        else:
            out.append(mixed(np.array([k], np.uint64) + _M2))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether the sets' Jaccard similarity is at least num / den."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * common >= num * (len(a) + len(b) - common)


class Tree:
    """A signature tree: levels of nodes from leaves up, each with an OR of bitmaps, a size range and the most excess."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        self.order = np.lexsort((bitmaps[:, 0], sizes))
        self.sizes, self.bitmaps = sizes[self.order], bitmaps[self.order]
        self.excess = self.sizes - np.bitwise_count(self.bitmaps).sum(1, dtype=np.int64)
        starts = np.arange(0, len(sizes), LEAF)
        level = (np.bitwise_or.reduceat(self.bitmaps, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts), np.maximum.reduceat(self.excess, starts))
        self.levels = [level]
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FAN)
            level = (np.bitwise_or.reduceat(level[0], starts), np.minimum.reduceat(level[1], starts), np.maximum.reduceat(level[2], starts), np.maximum.reduceat(level[3], starts))
            self.levels.append(level)

    def children(self, level: int, i: int) -> range:
        return range(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][0])))

    def rows(self, i: int) -> slice:
        return slice(i * LEAF, min((i + 1) * LEAF, len(self.sizes)))


def bitmap_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


def bits_for(n: int) -> int:
    return 1 << max(8, min(16, (4 * n - 1).bit_length()))


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same hashes in fewer bits."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    return bitmap


def may_link(n: int, x: np.ndarray, m: int, y: np.ndarray, num: int, den: int) -> bool:
    """Whether sets of n and m elements with these bitmaps can reach the similarity: a bit that only one has is an element that only it has."""
    size = min(len(x), len(y))
    x, y = folded(x, size), folded(y, size)
    shared = int(np.bitwise_count(x & y).sum())
    most = min(n, m, shared + n - int(np.bitwise_count(x).sum()), shared + m - int(np.bitwise_count(y).sum()))
    return most * (num + den) >= num * (n + m)


def dual_join(left: Tree, right: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of left, rows of right) that may link, in the order of the trees' input, a leaf pair at a time; once a pair where both are one tree."""
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        a, i, b, j = stack.pop()
        if left is right and a == b and i > j:
            continue
        (bits_a, low_a, high_a, over_a), (bits_b, low_b, high_b, over_b) = left.levels[a], right.levels[b]
        if den * high_a[i] < num * low_b[j] or den * high_b[j] < num * low_a[i]:
            continue
        common = int(np.bitwise_count(bits_a[i] & bits_b[j]).sum()) + min(over_a[i], over_b[j])
        most = min(common, high_a[i], high_b[j])
        if most * (num + den) < num * (low_a[i] + low_b[j]):
            continue
        if a == 0 and b == 0:
            x, y = left.rows(i), right.rows(j)
            shared = np.bitwise_count(left.bitmaps[x][:, None] & right.bitmaps[y][None]).sum(2, dtype=np.int64)
            most = np.minimum(shared + np.minimum(left.excess[x][:, None], right.excess[y]), np.minimum(left.sizes[x][:, None], right.sizes[y]))
            p, q = np.nonzero(most * (num + den) >= num * (left.sizes[x][:, None] + right.sizes[y]))
            if len(p):
                yield left.order[x][p], right.order[y][q]
        elif b == 0 or (a >= b and a > 0):
            stack += [(a - 1, c, b, j) for c in left.children(a, i)]
        else:
            stack += [(a, i, b - 1, c) for c in right.children(b, j)]


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def unit_candidates(side: np.ndarray, root: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Whether each row of a unit may link to a row of another component; rows of side 0 meet those of side 1, and of side 2 all."""
    keep = np.zeros(len(side), bool)
    if len(side) == 2:
        keep[:] = root[0] != root[1] and may_link(int(sizes[0]), bitmaps[0], int(sizes[1]), bitmaps[1], num, den)
        return keep
    words = min(map(len, bitmaps))
    bits = np.stack([folded(x, words) for x in bitmaps])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return keep
    one = Tree(sizes[left], bits[left])
    for p, q in dual_join(one, one if len(left) == len(right) == len(side) else Tree(sizes[right], bits[right]), num, den):
        p, q = left[p], right[q]
        apart = root[p] != root[q]
        keep[p[apart]] = keep[q[apart]] = True
    return keep


def unit_links(left: list, right: list, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components, between two lists of (node, root, hashes), or within one list given twice."""
    if not left or not right:
        return []
    most = max(len(x[2]) for x in (*left, *right))
    bits = bits_for(most)
    trees = [Tree(np.array([len(x[2]) for x in side]), np.stack([bitmap_of(x[2], bits) for x in side])) for side in ((left,) if left is right else (left, right))]
    union, found = Union(), []
    for p, q in dual_join(trees[0], trees[-1], num, den):
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            (a, ra, x), (b, rb, y) = left[i], right[j]
            if union.find(ra) != union.find(rb) and linked(x, y, num, den):
                union.join(ra, rb)
                found.append((a, b))
    return found


def document_sets(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, bits): node and the token bitmap are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                nodes = pa.array([name_of(s) if len(s) else None for s in sets], pa.int64())
                bits = pa.array([bitmap_of(s, bits_for(len(s))).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), nodes, bits], names=["doc_id", "n_shingles", "node", "bits"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), run, "doc_id long, n_shingles long, node long, bits binary")


def block_keys(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(key, node): a row a key of each set, equal sets of a task once; from all rows with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                keys, nodes = [], []
                if len(seen) > SEEN:
                    seen.clear()
                for text in batch.column(0).slice(i, 256).to_pylist():
                    s = shingles(text, words)
                    node = name_of(s) if len(s) else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    own = keys_of(s, num, den)
                    keys.append(own)
                    nodes.append(np.full(len(own), node, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return mapped(docs.where("doc_id is not null").select("text"), run, "key long, node long")


def connected(edges: DataFrame, a: str = "node", b: str = "hub") -> DataFrame:
    """(node, root) of every node of the edges, by rounds of hooking to the smallest neighbour and contracting."""
    live = written(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select("v", F.least("v", "m").alias("p"))
        hook = written(hook, "hooks")
        twice = hook.alias("h").join(hook.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p").select("v", F.col("pp").alias("p"))
        hook = written(twice, "hooks")
        to = lambda df, c: df.join(hook.select(F.col("v").alias(c), F.col("p").alias("__p")), c, "left").withColumn(c, F.coalesce("__p", c)).drop("__p")
        labels = hook.select(F.col("v").alias("node"), F.col("p").alias("root")) if labels is None else to(labels, "root")
        labels = written(labels, "labels")
        live = written(to(to(live, "x"), "y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    if labels is None:
        labels = live.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return labels


def with_root(df: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    named = roots.select(F.col("node").alias(column), F.col("root").alias(out))
    return df.join(named, column, "left").withColumn(out, F.coalesce(out, column))


def few(df: DataFrame) -> DataFrame:
    """df, which is written, with a broadcast hint where it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def texts_of(nodes: DataFrame, holders: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes, each from one document that holds its set."""
    ids = written(holders.join(nodes.distinct(), "node", "left_semi").select("node", "doc_id"), "ids")
    return written(docs.join(few(ids), "doc_id").select("node", "text"), "texts")


def named_sets(nodes: list[int], texts: pa.ChunkedArray | pa.Array, words: int) -> dict[int, np.ndarray]:
    """The set of each node, from the rows whose set has its name; a doc_id may have rows of other texts."""
    sets: dict[int, np.ndarray] = {}
    for node, text in zip(nodes, texts, strict=True):
        if node not in sets:
            x = shingles(text.as_py(), words)
            if name_of(x) == node:
                sets[node] = x
    return sets


def _units(rows: pa.Table) -> Iterator[np.ndarray]:
    """Row numbers of each unit of a task."""
    unit = rows.column("unit").to_numpy()
    order = np.argsort(unit, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(unit[order])) + 1) if len(order) else ()


def tree_join(rows: DataFrame, holders: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, hub): links that join components, found by the trees of the units of rows (unit, side, node, root), which is written."""

    def prune(given: pa.Table) -> pa.Table:
        side, root, n = (given.column(c).to_numpy() for c in ("side", "root", "n"))
        bitmaps = [np.frombuffer(x, np.uint64) for x in given.column("bits").to_pylist()]
        keep = np.zeros(len(side), bool)
        for at in _units(given):
            keep[at] = len(at) > 1 and unit_candidates(side[at], root[at], n[at], [bitmaps[i] for i in at.tolist()], num, den)
        return given.select(["unit", "side", "node", "root", "n"]).filter(pa.array(keep))

    def join(given: pa.Table) -> pa.Table:
        nodes, side, root = (given.column(c).to_pylist() for c in ("node", "side", "root"))
        sets = named_sets(nodes, given.column("text"), words)
        found = []
        for at in _units(given):
            held = {nodes[i]: (side[i], (nodes[i], root[i], sets[nodes[i]])) for i in at.tolist() if nodes[i] in sets}.values()
            left = [x for s, x in held if s != 1]
            right = left if all(s == 2 for s, _ in held) else [x for s, x in held if s != 0]
            found += unit_links(left, right, num, den)
        return pa.table({"node": pa.array([x[0] for x in found], pa.int64()), "hub": pa.array([x[1] for x in found], pa.int64())})

    dealt = lambda n: F.pmod(F.xxhash64("unit"), F.lit(max(1, n))).cast("int").alias("task")
    unit = "unit long, side int, node long, root long, n long"
    held = rows.join(holders.select("node", "n", "bits"), "node").select("unit", "side", "node", "root", "n", "bits")
    kept = written(held.groupBy(dealt(math.ceil(rows.count() / TASK_ROWS))).applyInArrow(prune, unit), "kept")
    texts = texts_of(kept.select("node"), holders, docs)
    elements = kept.agg(F.sum("n")).first()[0] or 0
    sized = kept.join(texts, "node").select("unit", "side", "node", "root", "text")
    return written(sized.groupBy(dealt(math.ceil(elements / TASK_ELEMENTS))).applyInArrow(join, "node long, hub long"), "links")


def group_units(groups: DataFrame, hot: DataFrame) -> DataFrame:
    """(unit, side, node, root) of groups (hub, node, root, first): a unit a group, and for hot ones (hub, chunks) several, the first node in each."""
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = groups.join(few(hot), "hub", "left")
    chunk = F.when(F.col("first"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), chunks).cast("int")))
    rows = dealt.select("hub", "node", "root", F.explode(chunk).alias("i"))
    return written(rows.select(F.xxhash64("hub", "i").alias("unit"), F.lit(2).alias("side"), "node", "root"), "units")


def hot_hubs(groups: DataFrame) -> DataFrame:
    sizes = groups.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > UNIT)
    return written(sizes.select("hub", F.ceil(F.col("n") / UNIT).cast("int").alias("chunks")), "hot")


def still_open(groups: DataFrame, hot: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of hot groups that hold several components, with their roots of now."""
    rows = with_root(groups.join(few(hot), "hub").select("hub", "node", "first"), roots, "node", "root")
    apart = rows.groupBy("hub").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("hub")
    return written(rows.join(few(written(apart, "open-hubs")), "hub"), "open")


def first_groups(keyed: DataFrame) -> DataFrame:
    """(hub, node, root, first) of rows (key, node): the blocks of one first node, the hub, are a group."""
    hub = F.min("node").over(Window.partitionBy("key"))
    pairs = keyed.withColumn("hub", hub).where("node <> hub").select("hub", F.explode(F.array("node", "hub")).alias("node")).distinct()
    return written(pairs.select("hub", "node", F.col("node").alias("root"), (F.col("node") == F.col("hub")).alias("first")), "groups")


def apart_units(rows: DataFrame) -> DataFrame:
    """Units in which the rows of open groups (hub, node, root, first) outside their hub's component meet all rows of the group."""
    own = few(written(rows.where("first").select("hub", F.col("root").alias("hub_root")), "hub-roots"))
    rows = rows.join(own, "hub").withColumn("apart", F.col("root") != F.col("hub_root"))
    sizes = rows.groupBy("hub").agg(F.ceil(F.count("*") / APART_UNIT).cast("int").alias("nb"), F.ceil(F.count_if("apart") / APART_UNIT).cast("int").alias("na"))
    rows = rows.join(few(written(sizes, "sizes")), "hub")
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("apart").select("hub", "node", "root", F.lit(0).alias("side"), chunk("na").alias("i"), every("nb").alias("j"))
    right = rows.select("hub", "node", "root", F.lit(1).alias("side"), every("na").alias("i"), chunk("nb").alias("j"))
    return written(left.unionByName(right).select(F.xxhash64("hub", "i", "j").alias("unit"), "side", "node", "root"), "units")


def node_links(docs: DataFrame, holders_of, words: int, num: int, den: int) -> DataFrame | None:
    """(node, hub): edges whose components are those of all links."""
    groups = first_groups(block_keys(docs, words, num, den))
    if groups.isEmpty():
        return None
    holders = holders_of(groups.select("node").distinct())
    hot = hot_hubs(groups)
    links = tree_join(group_units(groups, hot), holders, docs, words, num, den)
    if hot.isEmpty():
        return links
    roots = connected(links)
    edges = roots.select("node", F.col("root").alias("hub"))
    rows = still_open(groups, hot, roots)
    return edges if rows.isEmpty() else edges.unionByName(tree_join(apart_units(rows), holders, docs, words, num, den))


def components(documents: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links reach, its own included."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(document_sets(docs, words), "sets")
    owned = sets.where("doc_id is not null and node is not null")
    by_node = owned.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    edges = node_links(docs, lambda nodes: written(by_node.join(nodes, "node", "left_semi"), "holders"), words, num, den)
    # rows of one id stand together: its sets' components are one
    split = owned.groupBy("doc_id").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    same = written(split.join(owned.select("doc_id", "node"), "doc_id").select("node", "hub").where("node <> hub"), "split-ids")
    edges = same if edges is None else edges.unionByName(same)
    # of a node that is linked or held by several documents: the smallest doc_id of its component
    sizes = owned.groupBy("node").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last"))
    rooted = written(connected(edges).join(sizes.select("node", "own"), "node"), "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("own").alias("least")), "smallest")
    reached = rooted.join(few(smallest), "root").select("node", "least")
    named = sizes.join(reached, "node", "left").where("least is not null or own <> last")
    named = written(named.select("node", F.coalesce("least", "own").alias("component_id")), "components")
    joined = sets.drop("bits").join(few(named), "node", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", found.alias("component_id"))


def one_of_each(documents: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The documents, all columns, without those that link to one of a smaller doc_id, directly or through others.

    Of rows that share a doc_id the first in the order of their text stays; rows without a doc_id all stay."""
    found = components(documents, words, num, den)
    dropped = found.where("component_id < doc_id").select("doc_id").distinct()
    kept = documents.join(dropped, "doc_id", "left_anti")
    again = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    place = unused("__k", kept)
    first = kept.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return kept.join(again, "doc_id", "left_anti").unionByName(first)
