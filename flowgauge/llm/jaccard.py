"""Operator 9: exact Jaccard join of word n-gram sets in a prefix tree.

1. A document becomes the set of 64-bit hashes of its n-grams. Equal sets form a class, so
   copies are never compared with each other.
2. The universe of n-grams is cut into m ranges of the hash. Two sets of a link differ in at
   most D n-grams, so at least m - D ranges agree in full. A class gets a signature for each
   range that isn't empty; with m = D + 1 + e it needs e + 1 agreeing ranges, less its empty
   ones, or it has no partner. This is exact: no pair of a link is lost. m depends on the
   size class of the set; as sizes of a link differ by the threshold at most, a class signs
   for its own size class and the one below.
3. What shares signatures is gathered into clusters (connected components). In a cluster the
   sets, in one global order, are stored in a prefix tree; a probe walks the tree, sharing
   the partial overlap of common prefixes, and leaves a subtree when the n-grams that remain
   on either side can't reach the threshold, or when all of it is already linked with it.
4. A cluster too large for a task is first linked with some of its own sets, the pivots, in
   one pass. What that shows to be one component need not be compared within itself; what is
   left over is dealt in blocks, each of which meets the other left-over blocks and the blocks
   of that component. So a group of near copies costs a few passes, however large it is.
5. Components over the links and the copies give the result.

Nulls and edge cases: without words or text a set is empty and linked with nothing; fewer
words than n make one n-gram; rows with a null doc_id take part, and get the smallest doc_id
of their component (null if it has none); repeated rows are one class; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import delete, map_rows, small_batches, written, written_at
from flowgauge.llm.graph import connected_components

#: N-grams of a block of a cluster: bounds what a task holds.
BLOCK = 250_000
#: Sets with which all of a large cluster is compared.
PIVOTS = 16
#: Signatures, and documents, that a task pools before it gives them on: a signature that very
#: many sets have counts once for so many, which bounds the rows of one signature that meet.
POOL, POOL_ROWS = 1_000_000, 50_000
#: Parts in which signatures are shuffled, one after the other, and the n-grams that are worth a part.
PARTS, PART_GRAMS = 4, 1_000_000
#: Ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Sets of which a task remembers that it has signed them (some 100 bytes each).
SIGNED = 300_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX[2]
    x = (x ^ (x >> np.uint64(27))) * MIX[3]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a whole text's n-grams; A-Z count as a-z."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z, only \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        n = len(words)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * MIX[0] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Levels:
    """Size classes for a threshold of ``percent``, and the ranges of each level."""

    def __init__(self, percent: int):
        if not 0 < percent < 100:
            raise ValueError("percent must lie between 0 and 100")
        self.percent = percent
        first = [1]
        while first[-1] < 1 << 32:
            first.append(first[-1] * 100 // percent + 1)
        self.first = np.array(first, np.int64)
        self.edges: dict[int, np.ndarray] = {}

    def differ(self, k: int) -> int:
        """The most n-grams in which two sets of a link differ, sizes being of class k and k or k+1."""
        largest = int(self.first[k + 1] + self.first[k + 2] - 2)
        return largest * (100 - self.percent) // (100 + self.percent)

    def spare(self, k: int) -> int:
        return max(1, -(-self.differ(k) * 12 // 100))

    def cut(self, k: int) -> np.ndarray:
        """Where the ranges of level k begin, after the first."""
        if k not in self.edges:
            m = self.differ(k) + 1 + self.spare(k)
            self.edges[k] = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
        return self.edges[k]

    def sign(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each level of the set ``s``: how many signatures must agree, and the signatures."""
        own = int(np.searchsorted(self.first, len(s), "right")) - 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(s ^ MIX[1]), dtype=np.uint64)])
        for k in (own, own - 1):
            if k < 0 or not self.differ(k):
                continue
            at = np.concatenate([[0], np.searchsorted(s, self.cut(k), "left"), [len(s)]])
            full = at[1:] > at[:-1]
            empty = len(full) - int(full.sum())
            part = np.arange(len(full), dtype=np.uint64) + np.uint64(k << 32)
            sigs = mixed((sums[at[1:]] - sums[at[:-1]]) ^ mixed(part * MIX[0] + MIX[1]))
            if empty <= self.spare(k):
                yield 1 + self.spare(k) - empty, sigs[full]
            else:  # agreeing ranges may all be empty ones
                yield 1, sigs


def set_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def pooled(owners: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-aggregate signatures: of the owners that share one the first holds it, and the others
    name that one as their peer. Returns for each signature whether it has a peer, the peer, and
    whether it is held for others."""
    _, first, back, count = np.unique(sigs, return_index=True, return_inverse=True, return_counts=True)
    holder = first[back]
    many, own = (count > 1)[back], holder == np.arange(len(sigs))
    return many & ~own, owners[holder], many & own


SIGNED_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, signs array<struct<rule: int, sig: bigint, peer: bigint, held: boolean>>"
SIGN = pa.struct([("rule", pa.int32()), ("sig", pa.int64()), ("peer", pa.int64()), ("held", pa.bool_())])
SIGNED_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_shingles", "h1", "h2")), ("signs", pa.list_(SIGN))])


class Pool:
    """Rows of a task that wait for their signatures to be pooled."""

    def __init__(self):
        self._empty()

    def _empty(self) -> None:
        self.rows: tuple[list, ...] = ([], [], [], [])
        self.sizes: list[int] = []
        self.levels: list[tuple[int, int, np.ndarray]] = []
        self.total = 0

    def add(self, doc_id: int | None, n: int, key: tuple, signs: list[tuple[int, np.ndarray]]) -> None:
        for column, v in zip(self.rows, (doc_id, n, *key), strict=True):
            column.append(v)
        self.levels += [(key[0], need * 2 + k, sigs) for k, (need, sigs) in enumerate(signs)]
        self.sizes.append(sum(len(sigs) for _, sigs in signs))
        self.total += self.sizes[-1]

    def full(self, pool: int) -> bool:
        return self.total >= pool or len(self.sizes) >= POOL_ROWS

    def flush(self) -> pa.RecordBatch:
        lengths = [len(x) for _, _, x in self.levels]
        sigs = np.concatenate([x for _, _, x in self.levels]) if self.levels else np.zeros(0, np.uint64)
        owners, rules = (np.repeat(np.array([x[k] for x in self.levels], kind), lengths) for k, kind in ((0, np.int64), (1, np.int32)))
        has_peer, peer, held = pooled(owners, sigs)
        parts = [pa.array(rules), pa.array(sigs.view(np.int64)), pa.array(peer, mask=~has_peer), pa.array(held)]
        struct = pa.StructArray.from_arrays(parts, fields=list(SIGN))
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.sizes)]), pa.int32())
        columns = [pa.array(c, pa.int64()) for c in self.rows]
        out = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, struct, type=pa.list_(SIGN))], schema=SIGNED_ARROW)
        self._empty()
        return out


def signed_sets(docs: DataFrame, n: int, percent: int, pool: int = POOL) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (the class), and the signatures of classes new to the task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen, wait = Levels(percent), set(), Pool()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text, n)
                key, signs = (None, None), []
                if len(s):
                    key = set_key(s)
                    if key not in seen:
                        if len(seen) >= SIGNED:
                            seen.clear()
                        seen.add(key)
                        signs = list(levels.sign(s))
                wait.add(doc_id, len(s), key, signs)
                if wait.full(pool):
                    yield wait.flush()
        if wait.sizes:
            yield wait.flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SIGNED_SCHEMA)


def candidate_edges(signed: DataFrame) -> DataFrame:
    """(a, b): classes that share a signature, each linked with the smallest class of it or with
    the one that held it in its pool. Classes that share too few signatures to have a partner are
    left out first, but for those that hold a signature for one that stays. Signatures meet in
    parts by their value, so no more than a part of them is in shuffle files at a time."""
    spark, rows = signed.sparkSession, signed.select("h1", F.inline("signs"))
    by_sig = Window.partitionBy("sig")  # at most one row of a signature for each pool
    columns = ["h1", "rule", "sig", "peer"]
    grams = signed.agg(F.sum("n_shingles")).head()[0] or 0
    parts = min(PARTS, max(1, -(-grams // PART_GRAMS)))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)  # as large as without parts, so no more files
    tables = [written_at(rows.where("peer is not null").select(columns), "shared")]
    for k in range(parts):
        part = rows.where("peer is null").where(F.pmod("sig", F.lit(parts)) == k)
        met = part.select("*", F.min("h1").over(by_sig).alias("lo"), F.max("h1").over(by_sig).alias("hi")).where("held or lo <> hi")
        tables.append(written_at(met.select(columns).coalesce(tasks), "shared"))
    shared = reduce(DataFrame.union, [t for t, _ in tables])
    able = shared.groupBy("h1", "rule").agg(F.count("*").alias("n")).where("n >= rule div 2").select("h1", "rule")
    enough = written(shared.join(able, ["h1", "rule"], "left_semi").select("h1", "sig", "peer"), "enough")
    for _, old in tables:
        delete(spark, old)
    hubs = enough.where("peer is not null").select(F.col("peer").alias("h1"), "sig").distinct()
    open_ = enough.where("peer is null").select("h1", "sig").union(hubs)
    least = open_.groupBy("sig").agg(F.min("h1").alias("b"))
    far = open_.join(least, "sig").select(F.col("h1").alias("a"), "b")
    near = enough.where("peer is not null").select(F.col("h1").alias("a"), F.col("peer").alias("b"))
    return far.union(near).where("a <> b").distinct()


class Node:
    """A node of a path-compressed prefix tree; ``same``: all sets below are known to be linked."""

    __slots__ = ("ends", "hi", "kids", "lo", "part", "rep", "run", "same")

    def __init__(self, run: list[int], size: int, rep: int):
        self.run, self.part, self.kids, self.ends = run, frozenset(run), {}, []
        self.lo = self.hi = size
        self.rep, self.same = rep, True


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class PrefixTree:
    """Sets as ascending lists in one global order."""

    def __init__(self, percent: int, forest: Forest):
        self.p, self.forest = percent, forest
        self.root = Node([], 0, 0)
        self.root.lo, self.root.hi, self.empty = 1 << 60, 0, True

    def links(self, xs: list[int], x_set: frozenset, me: int, found: Callable[[int], None]) -> None:
        """Call ``found`` with sets of the tree at or over the threshold, but for those linked with ``me`` already."""
        p, n, find = self.p, len(xs), self.forest.find
        todo = [] if self.empty else [(self.root, 0, 0)]
        while todo:
            node, overlap, depth = todo.pop()
            if node.same and find(node.rep) == find(me):
                continue
            run = node.run
            if run:
                overlap += len(node.part & x_set)
                depth += len(run)
                rest = n - bisect_right(xs, run[-1])
            else:
                rest = n
            size = min(max(depth + rest, node.lo), node.hi)  # the size for which most can remain
            if (overlap + min(rest, size - depth)) * (100 + p) < p * (n + size):
                continue
            if node.ends and overlap * (100 + p) >= p * (n + depth):
                for other in node.ends:
                    found(other)
            todo.extend((kid, overlap, depth) for kid in node.kids.values())

    def add(self, xs: list[int], me: int) -> None:
        find, node, at, n = self.forest.find, self.root, 0, len(xs)
        if self.empty:
            self.root.rep, self.empty = me, False
        while True:
            node.lo, node.hi = min(node.lo, n), max(node.hi, n)
            if node.same and find(node.rep) != find(me):
                node.same = False
            if at == n:
                node.ends.append(me)
                return
            kid = node.kids.get(xs[at])
            if kid is None:
                leaf = Node(xs[at:], n, me)
                leaf.ends.append(me)
                node.kids[xs[at]] = leaf
                return
            run = kid.run
            k = 1
            while k < len(run) and at + k < n and run[k] == xs[at + k]:
                k += 1
            if k < len(run):  # split the run
                top = Node(run[:k], kid.lo, kid.rep)
                top.hi, top.same = kid.hi, kid.same
                kid.run, kid.part = run[k:], frozenset(run[k:])
                top.kids[run[k]] = kid
                node.kids[xs[at]] = top
                kid = top
            node, at = kid, at + k


def join_group(sets: list[np.ndarray], sides: list[int] | None, percent: int, joined: bool = False) -> list[tuple[int, int]]:
    """Links that join all of a group's components: within it, or between sides 0 and 1 if given;
    with ``joined`` side 1 is known to be one component."""
    flat, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(flat))  # common n-grams first: prefixes are shared
    ranked = np.split(rank[back], np.cumsum([len(s) for s in sets])[:-1])
    forest, edges = Forest(len(sets)), []
    tree = PrefixTree(percent, forest)
    if joined:
        ones = [k for k, side in enumerate(sides or []) if side]
        for k in ones[1:]:
            forest.join(ones[0], k)
    order = sorted(range(len(sets)), key=lambda i: (sides[i] if sides else 0, len(sets[i]), i))
    for me in order:
        xs = np.sort(ranked[me]).tolist()

        def found(other: int, me: int = me) -> None:
            if forest.join(me, other):
                edges.append((me, other))

        if not sides or sides[me]:
            tree.links(xs, frozenset(xs), me, found)
        if not sides or not sides[me]:
            tree.add(xs, me)
    return edges


def member_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """h1, cluster, blocks and grams (the set) of ``members`` (first, the smallest doc_id, h1, h2, cluster, blocks)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    side = members.select(F.col("first").alias("doc_id"), "h1", "h2", "cluster", "blocks")
    known = side.where("doc_id is not null")
    if known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    rows = texts.join(known, "doc_id")
    nameless = side.where("doc_id is null").drop("doc_id")
    lost = not nameless.isEmpty()
    if lost:  # classes without any doc_id: found again by their sets
        rows = rows.unionByName(texts.where("doc_id is null").select("doc_id", "text", *(F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "cluster", "blocks"))))

    def make():
        def step(cols):
            out: dict[str, list] = {k: [] for k in ("h1", "h2", "cluster", "blocks", "grams")}
            for t, h1, h2, *rest in zip(cols["text"], cols["h1"], cols["h2"], cols["cluster"], cols["blocks"], strict=True):
                s = shingles(t, n)
                key = set_key(s)
                if h1 is None or key == (h1, h2):
                    for k, v in zip(out, (*key, *rest, s.tobytes()), strict=True):
                        out[k].append(v)
            return out

        return step

    sets = map_rows(rows.select("text", "h1", "h2", "cluster", "blocks"), "h1 long, h2 long, cluster long, blocks long, grams binary", make)
    if lost:
        found = sets.where("cluster is null").select("h1", "h2", "grams").join(nameless, ["h1", "h2"])
        sets = sets.where("cluster is not null").unionByName(found)
    return sets.select("h1", "cluster", "blocks", "grams")


def streamed_groups(dealt: DataFrame, keys: list[str], order: list[str], link: Callable[[tuple, list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what ``link`` makes of each group of equal ``keys``, given the other columns of its
    rows in ``order``, one row for each h1."""
    rest = [c for c in dealt.columns if c not in keys]
    me = rest.index("h1")
    rows = dealt.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def found(out):
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != now:
                    out += link(now, group) if now else []
                    now, group = row[:n], []
                if not group or group[-1][me] != row[n + me]:  # else a repeated row
                    group.append(row[n:])
            yield found(out)
        if now:
            yield found(link(now, group))

    return rows.mapInArrow(run, "a long, b long")


def linked_in_groups(dealt: DataFrame, percent: int) -> DataFrame:
    """Links of sets dealt by cluster, i and j; ``side``: 0, or 1 and 2 for the second of two
    blocks, 2 if that is known to be one component."""

    def link(_, rows):
        if len(rows) < 2:
            return []
        nodes, sets, sides = [r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows], [r[2] for r in rows]
        got = join_group(sets, [int(x > 0) for x in sides] if any(sides) else None, percent, 2 in sides)
        return [(nodes[a], nodes[b]) for a, b in got]

    return streamed_groups(dealt.select("cluster", "i", "j", "h1", "grams", "side"), ["cluster", "i", "j"], ["h1"], link)


def linked_with_pivots(sets: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(cluster, a, b): links of each of ``sets`` (h1, cluster, blocks, grams) with those of them that
    ``pivots`` (cluster, h1) names. Each block of a cluster gets the pivots, and its sets stream past them."""
    whole = sets.join(pivots, ["cluster", "h1"]).dropDuplicates(["h1"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("h1"), "blocks")).withColumn("late", F.lit(1)).unionByName(whole.withColumn("late", F.lit(0)))
    rows = dealt.select("cluster", "block", "late", "h1", "grams").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "late", "h1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for cluster, block, late, h1, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, block) != now:
                    now, known = (cluster, block), []
                s = np.frombuffer(grams, np.uint64)
                if not late:
                    known.append((h1, s))
                    continue
                for other, t in known:
                    if other != h1 and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if both * (100 + percent) >= percent * (len(s) + len(t)):
                            out.append((cluster, h1, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["cluster", "a", "b"])

    return rows.mapInArrow(run, "cluster long, a long, b long")


def with_main_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (h1, cluster, size) with ``main`` for what is known to be one component: the sets
    linked with the pivot that has the most links, and with pivots that share one of those."""
    stars = edges.groupBy("cluster", "b").agg(F.count("*").alias("n"))  # a few pivots a cluster
    best = stars.groupBy("cluster").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    inner = edges.join(best, ["cluster", "b"]).select("cluster", "a").union(best)
    pivots = edges.join(inner, ["cluster", "a"]).select("cluster", "b").union(best).distinct()
    main = edges.join(pivots, ["cluster", "b"]).select(F.col("a").alias("h1")).union(pivots.select(F.col("b").alias("h1"))).distinct()
    return nodes.join(main.withColumn("main", F.lit(True)), "h1", "left").select("h1", "cluster", "size", F.coalesce("main", F.lit(False)).alias("main"))


def large_cluster_edges(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that join all components of clusters of several blocks."""
    sets = written(sets, "large")
    nodes = sets.select("h1", "cluster", (F.length("grams") / 8).cast("long").alias("size"))
    bucket = F.pmod(F.xxhash64("h1"), F.lit(PIVOTS))
    pivots = nodes.groupBy("cluster", bucket).agg(F.min(F.struct(F.xxhash64(F.lit(0), "h1"), "h1")).getField("h1").alias("h1")).select("cluster", "h1")
    edges = written(linked_with_pivots(sets, pivots, percent), "pivots")
    left = written(with_main_component(nodes, edges), "left")
    edges = edges.select("a", "b")
    # blocks of what is left over come first, then those of the largest component
    of = lambda main: F.ceil(F.coalesce(F.sum(F.when(F.col("main") == main, F.col("size"))), F.lit(0)) / block)
    counts = left.groupBy("cluster").agg(of(False).alias("rest"), of(True).alias("own")).where("rest > 0")
    placed = left.join(counts, "cluster").withColumn("at", F.when(F.col("main"), F.col("rest") + F.pmod(F.xxhash64("h1"), F.greatest("own", F.lit(1)))).otherwise(F.pmod(F.xxhash64("h1"), "rest")))
    dealt = sets.drop("cluster").join(placed, "h1")
    last = F.when(F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    i, j = F.least("at", "other"), F.greatest("at", "other")
    side = F.when(i == F.col("at"), 0).when(F.col("main"), 2).otherwise(1)
    return edges.union(linked_in_groups(dealt.select("cluster", i.alias("i"), j.alias("j"), "h1", "grams", side.alias("side")), percent))


def verified_edges(docs: DataFrame, members: DataFrame, n: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links within clusters. ``members``: first (the smallest doc_id), h1, h2, cluster, blocks."""
    small = member_sets(docs, members.where("blocks = 1"), n)
    zero = F.lit(0)
    edges = linked_in_groups(small.select("cluster", zero.alias("i"), zero.alias("j"), "h1", "grams", zero.alias("side")), percent)
    large = members.where("blocks > 1")
    return edges if large.isEmpty() else edges.union(large_cluster_edges(member_sets(docs, large, n), percent, block))


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, block: int = BLOCK, pool: int = POOL) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    full, signed_at = written_at(signed_sets(docs, n, percent, pool), "signed")
    edges = candidate_edges(full)
    signed = written(full.drop("signs"), "signed")  # signatures are needed no more
    delete(docs.sparkSession, signed_at)
    clusters = written(connected_components(edges, "clusters"), "clusters")
    classes = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"), F.count("*").alias("rows"))
    inside = classes.join(clusters.withColumnsRenamed({"node": "h1", "root": "cluster"}), "h1")
    total = inside.groupBy("cluster").agg(F.ceil(F.sum("size") / block).alias("blocks"))
    members = written(inside.join(total, "cluster"), "members")
    links = connected_components(verified_edges(docs, members, n, percent, block), "links")
    linked = classes.join(links.withColumnsRenamed({"node": "h1"}), "h1", "left")
    roots = linked.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    grouped = linked.join(roots, "root", "left").where("rows > 1 or root is not null")
    # a table of its own, so that Spark can split a class of very many copies over tasks
    component = written(grouped.select("h1", "h2", F.coalesce("least", "first").alias("component")), "component")
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(component, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component only the smallest doc_id.

    Of rows with the same doc_id one stays. Rows without doc_id, or without words, stay.
    """
    found = written(ngram_components(docs, n, percent), "near-copies")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    some = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    left = docs.join(some(gone), "doc_id", "left_anti")
    if twice.isEmpty():
        return left.select(docs.columns)
    again = left.join(some(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(some(twice), "doc_id", "left_anti").unionByName(again).select(docs.columns)
