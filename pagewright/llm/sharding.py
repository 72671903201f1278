"""K-d tree sharding: equal bytes by recursive splits at distributed weighted medians.

Every row is a point in metadata space (size, id, source, language). The tree starts with one node; each level splits
every node that still holds more than one shard's bytes along the dimension in which it is widest (its range over that
of the whole table) at the weighted median, the weights being bytes. A median is found for all nodes of a level at once
by histograms of the split key that narrow the interval around it; only counts of bins, and at the end a bounded number
of keys, reach the driver. Ties of a dimension are told apart by a hash of the row, so one source or a group of copies
that holds a third of all rows splits like any other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fields, partitions, ranked

#: Bins of a histogram, and rows of an interval that are few enough to be looked at one by one.
BINS, FEW = 1024, 4000
#: Bins, or rows one by one, of all nodes of a level that reach the driver at a time.
MOST = 1 << 20
#: A split key has the dimension's value in its upper bits and a hash of the row in the lower ones.
VALUE_BITS, TIE_BITS = 40, 20


def _points(docs: DataFrame, id_col: str, text_col: str, dimensions: dict[str, Column]) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # The number is fixed by being written: it tells repeated rows apart.
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("row"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in dimensions.items()],
    )


def _medians(counted: Callable, dims: dict[int, int], targets: dict[int, float], low: dict[int, int], high: dict[int, int]) -> dict[int, int]:
    """For each node the key such that the bytes at or below it come closest to the target.

    ``counted(dims, low, high, width)``: rows (node, bin, size, n) of the keys inside each named node's interval. Bins
    and single keys of all nodes together stay below about ``MOST``, so more nodes mean more rounds, not more rows here.
    """
    below = dict.fromkeys(targets, 0)
    found: dict[int, int] = {}
    while open_ := [n for n in targets if n not in found]:
        bins, few = min(BINS, max(16, MOST // len(open_))), min(FEW, max(16, MOST // len(open_)))
        width = {n: max(1, -(-(high[n] - low[n] + 1) // bins)) for n in open_}
        own: dict[int, list] = {n: [] for n in open_}
        for r in counted({n: dims[n] for n in open_}, low, high, width):
            own[r["node"]].append((r["bin"], r["size"], r["n"]))
        small = []
        for n in open_:
            own[n].sort()
            for k, size, rows in own[n]:
                if below[n] + size >= targets[n] or k == own[n][-1][0]:
                    low[n], high[n] = low[n] + k * width[n], min(high[n], low[n] + (k + 1) * width[n] - 1)
                    if low[n] == high[n]:
                        found[n] = low[n] if targets[n] - below[n] > size / 2 else low[n] - 1
                    elif rows <= few:
                        small.append(n)
                    break
                below[n] += size
            if not own[n]:
                found[n] = low[n]
        if small:
            keys: dict[int, dict[int, int]] = {n: {} for n in small}
            for r in counted({n: dims[n] for n in small}, low, high, dict.fromkeys(small, 1)):
                keys[r["node"]][low[r["node"]] + r["bin"]] = r["size"]
            for n, sizes in keys.items():
                total, best = below[n], (abs(targets[n] - below[n]), low[n] - 1)
                for k in sorted(sizes):
                    total += sizes[k]
                    best = min(best, (abs(targets[n] - total), k))
                found[n] = best[1]
    return found


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dimensions: dict[str, Column] | None = None) -> DataFrame:
    """id, size (UTF-8 bytes and one, null text: one), text_crc32, shard and slot of each row.

    ``shards`` leaves, or as many as ``target_bytes`` asks for. ``dimensions``: named numeric columns of the metadata
    space; by default size, id (numeric), and hashes of source and language where the table has them. Shards differ in
    bytes by about one row a level of the tree. Slots number each shard's rows from 0. Null ids and metadata count as
    zero; a text of any length is one row, whole; ties and repeated rows are told apart by a hash of the row and may
    come to different shards; an empty table gives no rows; extra columns play no part, whatever their names.
    """
    kinds = dict(docs.dtypes)
    if dimensions is None:
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        dimensions = {"d_size": F.octet_length(text)}
        if kinds[id_col] in ("bigint", "int", "smallint", "tinyint"):
            dimensions["d_id"] = F.col(f"`{id_col}`")
        for c in ("source", "lang"):
            if c in kinds:
                dimensions[f"d_{c}"] = F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 16))
    names = list(dimensions)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put("points", _points(docs, id_col, text_col, dimensions))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    total = whole["size"] or 0
    leaves = {0: shards or max(1, -(-total // (target_bytes or total or 1)))}
    tie = F.shiftrightunsigned(F.xxhash64("row"), 64 - TIE_BITS)
    scale = {c: ((1 << VALUE_BITS) - 1) / max(whole[f"hi_{c}"] - whole[f"lo_{c}"], 1e-9) if total else 1.0 for c in names}
    key = {c: F.floor((F.col(c) - F.lit(whole[f"lo_{c}"] if total else 0.0)) * F.lit(scale[c])).cast("long") * (1 << TIE_BITS) + tie for c in names}
    points = scratch.put("keys", rows.select("id", "size", "crc", "row", *[key[c].alias(c) for c in names]))
    # By node, for each level: the dimension, the cut, and the number of shards left of the cut (0: no cut). A row finds
    # its node by one look-up a level, however many nodes there are.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    most = leaves[0]

    def by_node(values: dict[int, int], other: int = 0) -> np.ndarray:
        out = np.full(most, other, np.int64)
        out[list(values)] = list(values.values())
        return out

    def placed_in(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The keys, a row for each dimension, and the node of each row of the table."""
        at, node, each = np.stack([b.column(c).to_numpy() for c in names]), np.zeros(b.num_rows, np.int64), np.arange(b.num_rows)
        for dim, cut, step in levels:
            node += np.where(at[dim[node], each] > cut[node], step[node], 0)
        return at, node

    def descend(keep: list[str], only: np.ndarray | None = None) -> DataFrame:
        """The named columns of every row with its node, or of the rows whose nodes are marked in ``only``."""

        def run(batches):
            for b in batches:
                node = placed_in(b)[1]
                found = pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(node.astype(np.int32))], names=[*keep, "node"])
                yield found if only is None else found.filter(pa.array(only[node] > 0))

        schema = T.StructType([*[points.schema[c] for c in keep], *fields("node int")])
        return points.select(*keep, *[c for c in names if c not in keep]).mapInArrow(run, schema)

    def counted(dims: dict[int, int], low: dict[int, int], high: dict[int, int], width: dict[int, int]) -> list:
        """(node, bin, size, n): bytes and rows of the keys in the intervals of the nodes in ``dims``, by bin of a width."""
        dim, wide = by_node(dims), by_node(width, 1)
        least, last = by_node({n: low[n] for n in dims}, 1), by_node({n: high[n] for n in dims}, 0)

        def run(batches):
            for b in batches:
                at, node = placed_in(b)
                key = at[dim[node], np.arange(len(node))]
                inside = np.flatnonzero((key >= least[node]) & (key <= last[node]))
                if not len(inside):
                    continue
                node, size = node[inside], b.column("size").to_numpy()[inside]
                bin_ = (key[inside] - least[node]) // wide[node]
                order = np.lexsort((bin_, node))
                node, bin_, size = node[order], bin_[order], size[order]
                first = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(bin_, prepend=-1) != 0))
                columns = node[first], bin_[first], np.add.reduceat(size, first), np.diff(np.append(first, len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["node", "bin", "size", "n"])

        found = points.select("size", *names).mapInArrow(run, fields("node long, bin long, size long, n long"))
        return found.groupBy("node", "bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()

    while total and any(n > 1 for n in leaves.values()):
        # Nodes are numbered by their first shard, so a leaf's number is its shard.
        split = [n for n, k in leaves.items() if k > 1]
        stats = descend(["size", *names], by_node(dict.fromkeys(split, 1))).groupBy("node").agg(F.sum("size").alias("size"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        stats = {r["node"]: r for r in stats}
        wide = {n: max(names, key=lambda c, r=r: r[f"hi_{c}"] - r[f"lo_{c}"]) for n, r in stats.items()}
        dims = {n: names.index(c) for n, c in wide.items()}
        cuts = _medians(counted, dims, {n: r["size"] * (leaves[n] // 2) / leaves[n] for n, r in stats.items()}, {n: r[f"lo_{wide[n]}"] for n, r in stats.items()}, {n: r[f"hi_{wide[n]}"] for n, r in stats.items()})
        levels.append((by_node(dims), by_node(cuts), by_node({n: leaves[n] // 2 for n in cuts})))
        leaves = {m: j for n, k in leaves.items() for m, j in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, 1),))}
    placed = descend(["id", "size", "crc", "row"]).select("id", "size", "crc", "row", F.col("node").alias("shard"))
    spread = max(partitions(rows.sparkSession), (whole["n"] or 0) // 100_000)
    placed = ranked(placed, ["shard"], ["id", "row"], F.pmod(F.xxhash64("row"), F.lit(spread)), "slot")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
