"""Exact top-k inner products by dual-tree search over cover trees of queries and data.

A cover tree's node stands for a set of vectors: its centre is one of them and its radius covers them all. Its children
have farthest-first centres, the first of which is the node's own (nesting); every member is within the children's
covering distance of one of them, and they are at least that far apart (covering, separation), the distances being those
of the data rather than powers of a base. No score between query node Q and data node X can exceed

    Qc.Xc + rQ |Xc| + rX |Qc| + rQ rX

so a pair of nodes is passed over, with all below it, when that is under the worst k-th score of the queries in Q.

1. The upper tree spans queries and data together. It is built on the driver over a sample whose size grows with the
   table up to a bound in memory; every vector descends to one of its leaves, a cell, and the radii are then those of
   all vectors. Cells larger than a block are dealt into blocks; neighbouring cells' queries form a query group.
2. A query group searches one block near by for its first k-th scores, then descends together with the upper tree: its
   own tree on one side, cells on the other. What is left are blocks that can hold a better score.
3. Blocks stand on shelves, neighbours together, and a group goes once to each shelf that holds a block of its own, not
   once to each block. There both trees, now down to their leaves, are descended together, block after block.

Results are exact: the bound is never below a score, and ties with the k-th score are kept. How much is passed over
depends on the data alone; vectors without structure, such as random directions, leave nothing to pass over, and then
every query meets every row, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, fields, partitions

#: Most vectors of a query group and of a block, and most components of either, so that a block is 2 MB at most.
QUERIES, ROWS = 1024, 4096
COMPONENTS = 1 << 18
#: Rows to a cell of the upper tree, sampled vectors to a cell, and most components of the sample (32 MB).
CELL, DRAWN, SAMPLED = 1024, 4, 1 << 22
CHILDREN, LEAF = 8, 128
NONE = -(1 << 63)
#: Components beyond this are left out of the trees' geometry; nodes that hold one are never passed over.
FAR = 1e100
_PARTS = 1 << 20
#: Most blocks of a shelf, which a worker holds at once (64 MB).
SHELF = 32


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact; what does not fit into 64 bits saturates."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if not most:
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        most *= a.shape[1]
    for limit, kind in ((2.0**24, np.float32), (2.0**52, np.float64), (2.0**62, np.int64)):
        if most < limit and (kind is not np.int64 or max(np.abs(a).max(), np.abs(b).max()) < 2.0**62):
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, NONE, -NONE - 1).astype(np.int64)


class Tree:
    """A cover tree over the rows of ``x``, level by level in arrays.

    Node n has the rows ``order[low[n]:high[n]]`` and the children ``kid[n]`` to ``kid_end[n]`` (none: a leaf).
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        g = np.clip(x, -FAR, FAR).astype(np.float64)
        far = (np.abs(x) > FAR).any(axis=1)
        self.order = np.arange(len(x))
        self.low, self.high, self.kid, self.kid_end, self.radius, at = [0], [len(x)], [0], [0], [0.0], [0]
        if len(x):
            at[0] = int(((g - g.mean(axis=0)) ** 2).sum(axis=1).argmin())
            self.radius[0] = float(np.sqrt(((g - g[at[0]]) ** 2).sum(axis=1).max()))
        n = 0
        while n < len(self.low):
            s, e = self.low[n], self.high[n]
            if e - s > leaf and self.radius[n] > 0:
                own = self.order[s:e].copy()
                y = g[own]
                kids = _farthest(y, int(np.flatnonzero(own == at[n])[0]), CHILDREN)
                to = _nearest(y, y[kids])
                to[kids] = np.arange(len(kids))  # a centre is its own, also where floating point can't tell it from another
                gap = np.sqrt(((y - y[kids][to]) ** 2).sum(axis=1))
                many = np.bincount(to, minlength=len(kids))
                if len(kids) > 1:
                    self.order[s:e] = own[np.argsort(to, kind="stable")]
                    self.kid[n] = len(self.low)
                    for k in range(len(kids)):
                        self.low.append(s)
                        s += int(many[k])
                        self.high.append(s)
                        at.append(int(own[kids[k]]))
                        self.radius.append(float(gap[to == k].max()))
                        self.kid.append(0)
                        self.kid_end.append(0)
                    self.kid_end[n] = len(self.low)
            n += 1
        self.low, self.high, self.kid, self.kid_end, self.radius = map(np.array, (self.low, self.high, self.kid, self.kid_end, self.radius))
        for m in np.flatnonzero([far[self.order[s:e]].any() for s, e in zip(self.low, self.high, strict=True)]) if far.any() else ():
            self.radius[m] = np.inf
        self.centre = g[at] if len(x) else np.zeros((1, x.shape[1]))
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.leaf = self.kid == self.kid_end

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.high[node]]

    def upward(self, values: np.ndarray, combine) -> np.ndarray:
        """Values of leaves, carried up: an inner node's is that of its children's combined."""
        out = values.copy()
        for n in np.flatnonzero(~self.leaf)[::-1]:  # children come after their parents
            out[n] = combine(out[self.kid[n] : self.kid_end[n]])
        return out

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf that each vector descends to, nearest child by nearest child, and its distance from the centre."""
        g, at = np.clip(x, -FAR, FAR), np.zeros(len(x), np.int64)
        while len(x) and not self.leaf[at].all():
            for n in np.unique(at[~self.leaf[at]]):
                own = np.flatnonzero(at == n)
                at[own] = self.kid[n] + _nearest(g[own], self.centre[self.kid[n] : self.kid_end[n]])
        gap = np.sqrt(((g - self.centre[at]) ** 2).sum(axis=1))
        return at, np.where((np.abs(x) > FAR).any(axis=1), np.inf, gap)


def _farthest(x: np.ndarray, first: int, n: int) -> np.ndarray:
    """Indices of up to n points, each the farthest from those before it."""
    chosen, gap = [first], ((x - x[first]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def bounds(q: Tree, a: np.ndarray, x: Tree, b: np.ndarray) -> np.ndarray:
    """The largest score that query nodes ``a`` and data nodes ``b`` can have, pair by pair, with room for rounding."""
    out = np.empty(len(a))
    with np.errstate(invalid="ignore", over="ignore"):
        for s in range(0, len(a), 1 << 14):
            i, j = a[s : s + (1 << 14)], b[s : s + (1 << 14)]
            qn, qr, xn, xr = q.norm[i], q.radius[i], x.norm[j], x.radius[j]
            most = np.einsum("ij,ij->i", q.centre[i], x.centre[j]) + qr * xn + qn * xr + qr * xr
            out[s : s + (1 << 14)] = most + 1e-3 + 1e-9 * (np.abs(most) + (qn + qr) * (xn + xr))
    out[np.isnan(out)] = np.inf
    return out


def leaf_pairs(q: Tree, worst: np.ndarray, x: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query leaves, data leaves, bounds): what is left of both trees descended together. worst: by query."""
    least = np.zeros(len(q.low), np.int64)
    for n in np.flatnonzero(q.leaf):
        least[n] = worst[q.rows(n)].min(initial=-NONE - 1)
    least = q.upward(least, np.min)
    a, b, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        limit = bounds(q, a, x, b)
        keep = ~(limit < least[a])
        a, b, limit = a[keep], b[keep], limit[keep]
        end = q.leaf[a] & x.leaf[b]
        found.append((a[end], b[end], limit[end]))
        a, b = a[~end], b[~end]
        first = ~q.leaf[a] & (x.leaf[b] | (q.radius[a] >= x.radius[b]))  # the wider of both nodes is opened
        nodes, kids, ends = np.where(first, a, b), np.where(first, q.kid[a], x.kid[b]), np.where(first, q.kid_end[a], x.kid_end[b])
        many = ends - kids if len(nodes) else np.zeros(0, np.int64)
        opened = np.repeat(kids - np.cumsum(many) + many, many) + np.arange(many.sum())
        a, b, first = np.repeat(a, many), np.repeat(b, many), np.repeat(first, many)
        a, b = np.where(first, opened, a), np.where(first, b, opened)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _best(q: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each query's k highest scores are, ties to the smaller id, then row; and the rank of each."""
    order = np.lexsort((rows, ids, -scores.astype(np.float64), q))
    # Scores that are equal as floating-point numbers, but not as whole ones, are put right here.
    if len(scores) and np.abs(scores).max(initial=0) >= 2**53:
        order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(scores[i]), ids[i], rows[i])), np.int64)
    own = q[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < k], rank[rank < k]


def search(q_rows: np.ndarray, q: np.ndarray, worst: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, q_tree: Tree | None = None, x_tree: Tree | None = None):
    """(queries, data, scores), by place: each query's k best of the block that are not below its ``worst``; its own row is left out."""
    q_tree, x_tree = q_tree or Tree(q), x_tree or Tree(x)
    out = [(np.zeros(0, np.int64),) * 3]
    if not len(q) or not len(x):
        return out[0]
    a, b, limit = leaf_pairs(q_tree, worst, x_tree)
    order = np.lexsort((-limit, a))
    a, b, limit = a[order], b[order], limit[order]
    for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else ():
        queries = q_tree.rows(a[own[0]])
        low = worst[queries].astype(np.int64).copy()
        have = (np.zeros(0, np.int64),) * 3
        step = 2
        # Some leaves at a time, best first, so that the group's worst k-th score soon rules out the rest.
        while len(own):
            now, own = own[:step], own[step:]
            members = np.concatenate([x_tree.rows(n) for n in b[now[~(limit[now] < low.min())]]] or [np.zeros(0, np.int64)])
            if not len(members):
                break
            scores = product(q[queries], x[members])
            i, j = np.nonzero(scores >= low[:, None])
            fine = x_rows[members[j]] != q_rows[queries[i]]
            i, j = i[fine], j[fine]
            have = tuple(np.concatenate(c) for c in zip(have, (i, members[j], scores[i, j]), strict=True))
            best, rank = _best(have[0], x_ids[have[1]], x_rows[have[1]], have[2], k)
            have = tuple(c[best] for c in have)
            full = rank == k - 1
            low[have[0][full]] = np.maximum(low[have[0][full]], have[2][full])
            step *= 2
        out.append((queries[have[0]], have[1], have[2]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def drawn(rows: DataFrame, n: int, most: int, pack) -> list[bytes]:
    """``most`` (or all) of the vectors of ``n`` rows (row, id, v), packed: those with the smallest hashes.

    Only rows below a bound on the hash leave the executors, few more than ``most`` of them. (A sort with a limit sends
    ``most`` rows of every partition to the driver, so that a table of many partitions comes there whole.)
    """
    share = min(1.0, (most + 8 * most**0.5 + 64) / n)
    bound = min(int(share * 2.0**64) - (1 << 63), (1 << 63) - 1)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pack(b.column("v").to_pylist())], names=["h", "v"])

    found = rows.select(F.xxhash64("row", "id").alias("h"), "v").filter(F.col("h") <= bound).mapInArrow(run, fields("h long, v binary"))
    return [bytes(r["v"]) for r in sorted(found.collect(), key=lambda r: r["h"])[:most]]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) for each row where ``queries`` holds.

    Vectors that are null, or hold null, NaN or infinite components, and rows without an id take no part; an empty
    vector counts as zero. Shorter vectors count as ending in zeros. A query's own row is no candidate of its own, but
    other rows with its id are; where ids repeat, each such query row comes back with its own k ranks. Ties go to the
    smaller id. Scores are exact whole numbers; those beyond 64 bits saturate at the ends of the long range and tie
    there, and floor(scale * x) itself ends at the largest double. Fewer candidates than k: all of them. No queries, or
    an empty table: no rows. Extra columns play no part, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession)
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("id").isNotNull())
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("asks")).first()
    if not size["asks"]:
        return nothing
    dim = max(size["dim"], 1)

    def whole(values) -> np.ndarray:
        out = np.zeros((len(values), dim))
        with np.errstate(over="ignore"):
            for i, v in enumerate(values):
                out[i, : len(v)] = np.floor(scale * np.asarray(v, np.float64))
        most = np.finfo(np.float64).max
        return np.clip(out, -most, most)

    def packed(x: np.ndarray) -> pa.Array:
        return pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())

    def matrix(raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dim)

    sampled = max(1, min(DRAWN * -(-size["n"] // CELL), SAMPLED // dim))
    upper = Tree(matrix(drawn(rows, size["n"], sampled, lambda v: packed(whole(v)))), 2 * DRAWN)

    def assign(batches):
        for b in batches:
            x = whole(b.column("v").to_pylist())
            cell, gap = upper.place(x)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), packed(x), b.column("is_query"), pa.array(cell), pa.array(gap, pa.float64())], names=["row", "id", "v", "is_query", "cell", "gap"])

    # Written, so that rows keep their numbers.
    each = scratch.put("vectors", rows.mapInArrow(assign, fields("row long, id long, v binary, is_query boolean, cell long, gap double")))
    count, asks, radius = np.zeros(len(upper.low), np.int64), np.zeros(len(upper.low), np.int64), np.full(len(upper.low), -np.inf)
    for r in each.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("asks"), F.max("gap").alias("radius")).collect():
        count[r["cell"]], asks[r["cell"]], radius[r["cell"]] = r["n"], r["asks"], r["radius"]
    for n in np.flatnonzero(~upper.leaf)[::-1]:
        own = np.arange(upper.kid[n], upper.kid_end[n])
        own = own[count[own] > 0]
        count[n], asks[n] = count[own].sum(), asks[own].sum()
        radius[n] = (np.sqrt(((upper.centre[own] - upper.centre[n]) ** 2).sum(axis=1)) + radius[own]).max(initial=-np.inf)
    upper.radius = np.where(count > 0, radius, 0.0)

    # A cell's blocks; a query group is the highest node with few enough queries, or part of a cell.
    most_rows, most_asks = max(1, min(ROWS, COMPONENTS // dim)), max(1, min(QUERIES, COMPONENTS // dim))
    blocks = -(-count // most_rows)
    # Blocks are numbered in the order of the tree, so that a shelf holds neighbours.
    number = np.zeros(len(count), np.int64)
    leaves = np.flatnonzero(upper.leaf)[np.argsort(upper.low[upper.leaf], kind="stable")]
    number[leaves] = np.cumsum(blocks[leaves]) - blocks[leaves]
    wide = int(min(SHELF, max(1, blocks[leaves].sum() // (2 * partitions(spark)))))
    group, seed_of = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    largest = upper.upward(np.where(upper.leaf, np.arange(len(count)), 0), lambda own: own[count[own].argmax()])
    for n in range(len(count)):  # parents come first
        if not n or not group[n]:
            group[n] = n + 1 if asks[n] <= most_asks or upper.leaf[n] else 0
        own = slice(upper.kid[n], upper.kid_end[n])
        group[own] = group[n]
        # Where to look for the first k-th scores: the largest cell below, if it has rows enough, or else the parent's.
        seed_of[n] = largest[n] if not n or count[largest[n]] > 4 * k else seed_of[n]
        seed_of[own] = seed_of[n]
    parts = np.ones(len(count), np.int64)
    parts[upper.leaf] = np.maximum(1, -(-asks[upper.leaf] // most_asks))
    parts[group != np.arange(1, len(count) + 1)] = 1

    def dealt(batches):
        """Each row's block, and for queries their group; rows of a cell are dealt by their number."""
        for b in batches:
            cell = b.column("cell").to_numpy()
            spread = (b.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (spread % blocks[cell].astype(np.uint64)).astype(np.int64)
            of = (group[cell] - 1) * _PARTS + (spread % parts[group[cell] - 1].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "id", "v", "is_query")], pa.array(cell * _PARTS + part), pa.array((number[cell] + part) // wide), pa.array(of), pa.array(seed_of[group[cell] - 1] * _PARTS)], names=["row", "id", "v", "is_query", "block", "shelf", "of", "seed"])

    placed = each.select("row", "id", "v", "is_query", "cell").mapInArrow(dealt, fields("row long, id long, v binary, is_query boolean, block long, shelf long, of long, seed long"))
    members = F.collect_list(F.struct("row", "id", "v"))

    def stacked(batches):
        for b in batches:
            for i in range(b.num_rows):
                m = b.column("m")[i].values
                own, raw = np.argsort(m.field("row").to_numpy()), m.field("v").to_pylist()
                columns = [m.field(c).to_numpy()[own].astype("<i8").tobytes() for c in ("row", "id")] + [b"".join([raw[k] for k in own])]
                yield pa.RecordBatch.from_arrays([b.column("shelf").slice(i, 1), b.column("block").slice(i, 1), *[pa.array([c], pa.binary()) for c in columns]], names=["shelf", "block", "rows", "ids", "v"])

    blocked = placed.groupBy("shelf", "block").agg(members.alias("m")).select("shelf", "block", "m")
    data = scratch.put("data", blocked.mapInArrow(stacked, fields("shelf long, block long, rows binary, ids binary, v binary")))
    ask = placed.filter("is_query").groupBy("of", "seed").agg(members.alias("q"))

    def unpack(m):
        m = sorted(m, key=lambda r: r["row"])
        return np.array([r["row"] for r in m], np.int64), np.array([r["id"] for r in m], np.int64), matrix([r["v"] for r in m])

    def unstack(b, i):
        rows, ids, v = [np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("rows", "<i8"), ("ids", "<i8"), ("v", "<f8"))]
        return rows, ids, v.reshape(-1, dim)

    def seed(batches):
        for b in batches:
            for i in range(b.num_rows):
                q_rows, q_ids, q = unpack(b.column("q")[i].as_py())
                worst = np.full(len(q), NONE, np.int64)
                if b.column("rows")[i].is_valid:
                    x_rows, x_ids, x = unstack(b, i)
                    at, _, scores = search(q_rows, q, worst, x_rows, x_ids, x, k)
                    full = np.bincount(at, minlength=len(q)) >= k
                    np.minimum.at(least := np.full(len(q), -NONE - 1, np.int64), at, scores)
                    worst[full] = least[full]
                _, cells, _ = leaf_pairs(Tree(q), worst, upper)
                targets: dict[int, list[int]] = {}
                for c in np.unique(cells).tolist():
                    for p in range(blocks[c]):
                        targets.setdefault(int(number[c] + p) // wide, []).append(c * _PARTS + p)
                columns = [[v.tobytes()] for v in (q_rows.astype("<i8"), q_ids.astype("<i8"), q.astype("<f8"), worst.astype("<i8"))]
                shelves = pa.array([[{"shelf": n, "blocks": own} for n, own in targets.items()]], pa.list_(pa.struct([("shelf", pa.int64()), ("blocks", pa.list_(pa.int64()))])))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()) for c in columns], shelves], names=["rows", "ids", "v", "worst", "shelves"])

    first = data.filter(F.col("block") % _PARTS == 0).select(F.col("block").alias("seed"), "rows", "ids", "v")
    seeded = scratch.put("queries", ask.join(first.hint("merge"), "seed", "left").select("q", "rows", "ids", "v").mapInArrow(seed, fields("rows binary, ids binary, v binary, worst binary, shelves array<struct<shelf: long, blocks: array<long>>>")))
    # Dealt by shelf, not by cell, so that a cell with a third of all rows spreads over many tasks; and not joined, since
    # Spark takes the exploded groups for as small as they were and would broadcast all of their copies.
    asked = seeded.select("rows", "ids", "v", "worst", F.explode("shelves").alias("s")).select("s.shelf", F.lit(None).cast("long").alias("block"), "rows", "ids", "v", "worst", "s.blocks")
    held = data.select("shelf", "block", "rows", "ids", "v", F.lit(None).cast("binary").alias("worst"), F.lit(None).cast("array<long>").alias("blocks"))
    met = held.unionByName(asked).repartition(max(partitions(spark), int(blocks[leaves].sum() // wide) // 4), "shelf").sortWithinPartitions("shelf", F.col("block").isNull())

    def meet(batches):
        at_shelf, known = None, {}
        for b in batches:
            for i in range(b.num_rows):
                if (shelf := b.column("shelf")[i].as_py()) != at_shelf:
                    at_shelf, known = shelf, {}
                if (block := b.column("block")[i].as_py()) is not None:  # a shelf's blocks come before its groups
                    own = unstack(b, i)
                    known[block] = *own, Tree(own[2])
                    continue
                q_rows, q_ids, q = unstack(b, i)
                q_tree, low = Tree(q), np.frombuffer(b.column("worst")[i].as_py(), "<i8").copy()
                have = (np.zeros(0, np.int64),) * 4
                for n in b.column("blocks")[i].as_py():
                    if n not in known:  # no row fell to it
                        continue
                    x_rows, x_ids, x, x_tree = known[n]
                    at, to, scores = search(q_rows, q, low, x_rows, x_ids, x, k, q_tree, x_tree)
                    have = tuple(np.concatenate(c) for c in zip(have, (at, x_rows[to], x_ids[to], scores), strict=True))
                    best, place = _best(have[0], have[2], have[1], have[3], k)
                    have = tuple(c[best] for c in have)
                    full = place == k - 1
                    low[have[0][full]] = np.maximum(low[have[0][full]], have[3][full])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_rows[have[0]], q_ids[have[0]], *have[1:])], names=["q_row", "query_id", "row", "vec_id", "score"])

    found = met.select("shelf", "block", "rows", "ids", "v", "worst", "blocks").mapInArrow(meet, fields("q_row long, query_id long, row long, vec_id long, score long"))
    rank = F.row_number().over(W.Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
