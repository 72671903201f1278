"""SimHash near-duplicates over a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint of its word shingles; fingerprints that differ in at most ``distance`` bits
link, and linked documents form components. The index has two kinds of nodes:

* Upper nodes factor out shared masked bit patterns. The 64 bits fall into ``distance + 2`` blocks; two fingerprints at
  most ``distance`` apart agree on two whole blocks at least, so each pair of blocks is a mask, and all fingerprints
  that agree under a mask hang below one node. Nodes that hold more than ``node_limit`` fingerprints are split again,
  by masks over the blocks of their remaining bits.
* Below an upper node fingerprints stand in Gray-code order, in leaves of 64. A leaf keeps the bits that all of its
  members share; a whole leaf is passed over once the differences accumulated on those shared bits exceed the limit.

Equal fingerprints are one entry of the index, so copies cost nothing there. Each node returns a spanning forest of its
links (not all pairs), and rounds of star contraction, each cut by a checkpoint, turn the edges into components.

Groups by the similarity of word shingles (``keep_one`` with ``least``) use the same index twice to propose pairs, and
decide exactly. A changed word changes five five-word shingles but one word, so texts whose shingles are 0.8 alike differ
by few bits in a fingerprint of their distinct words. The index finds the fingerprints with a neighbour within ``WIDE``
bits; only those enter it again, each with a sketch of its shingles (two bits of each of 256 minima). A node then returns
the spanning forest of the closest sketches: whatever connects two texts over a chain of pairs that are alike, connects
them in that forest by pairs at least as close. Each of its edges is checked on the whole sets of shingles of both texts,
and only those that are alike link. So nothing is grouped by an estimate; one can only keep a pair from being proposed.
"""

from __future__ import annotations

from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, fields, mixed, parts, pick, prepare, release, word_spans

BITS = 64
LEAF = 64
#: Bits that fingerprints of distinct words may differ by, where a sketch decides.
WIDE = 7
#: Minima of a sketch, and how far below the wanted similarity the estimate of a proposed pair may lie (its deviation is 0.03).
MINIMA, SLACK = 256, 0.06
_MULTIPLY, _ADD = np.split(mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 2)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of one whole text; zero if it has no word."""
    raw = (text or "").encode().translate(_LOWER)
    words = raw.split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts, ends = word_spans(joined)
    last = ends[min(width, len(ends)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts.tolist(), last, strict=False)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long) of each row; null texts count as empty, repeated rows stay."""

    def run(batches):
        release()
        for b in batches:
            found = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, fields(f"id {kind}, fp long"))


def word_fingerprint(words: list[bytes]) -> int:
    """The fingerprint of the distinct words, each once; zero if there is none."""
    if not words:
        return 0
    hashes = np.array([xxh64_intdigest(w, 42) for w in set(words)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """The hashes of the distinct word shingles, ascending (fewer words: the whole sequence; none: none)."""
    if not words:
        return np.zeros(0, np.uint64)
    last = max(1, len(words) - width + 1)
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(last)], np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """Two bits of each of ``MINIMA`` minima over the hashes of shingles (of none: all zero)."""
    if not len(hashes):
        return bytes(MINIMA // 4)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * (_MULTIPLY | np.uint64(1)) + _ADD).min(axis=0), out=least)
    two = mixed(least)
    return np.packbits(np.stack([two & np.uint64(1), two >> np.uint64(1) & np.uint64(1)], axis=1).astype(np.uint8)).tobytes()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, fp long, sketch binary, key string): the words' fingerprint, the shingles' sketch and a digest of their set."""

    def run(batches):
        release()
        for b in batches:
            fps, sketches, keys = [], [], []
            for text in b.column(1).to_pylist():
                words = _words(text)
                own = shingles(words, width)
                fps.append(word_fingerprint(words))
                sketches.append(sketch(own))
                keys.append(md5(own.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, "<u8").view("<i8"), pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.string())], names=["id", "fp", "sketch", "key"])

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, fields(f"id {kind}, fp long, sketch binary, key string"))


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their minima two sketches (rows of words) differ in."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def allowed(least: float) -> int:
    """The minima that two sketches may differ in: shingles that differ still agree in two bits by chance one time in four."""
    return int(MINIMA * 0.75 * (1 - least + SLACK))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def masks(bits: list[int], distance: int) -> list[int]:
    """One mask for each pair of ``distance + 2`` blocks of the given bits."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(bits, distance + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


class Leaves:
    """Codes in Gray order, in leaves that know the bits that all of their members share."""

    def __init__(self, codes: np.ndarray):
        self.codes, n = codes, len(codes)
        first = np.arange(0, n, LEAF)
        self.ones, self.zeros = np.bitwise_and.reduceat(codes, first), np.bitwise_and.reduceat(~codes, first)
        self.free, self.left = np.ones(n, bool), np.diff(np.append(first, n))

    def take(self, places) -> None:
        self.free[places] = False
        np.subtract.at(self.left, np.asarray(places) // LEAF, 1)

    def near(self, x: int, distance: int) -> np.ndarray:
        """The free places within the distance of place x; leaves whose shared bits differ in more are passed over."""
        code = self.codes[x]
        leaves = np.flatnonzero((self.left > 0) & (np.bitwise_count((code & self.zeros) | (~code & self.ones)) <= distance))
        members = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        members = members[members < len(self.codes)]
        members = members[self.free[members]]
        return members[np.bitwise_count(self.codes[members] ^ code) <= distance]


def spanning(codes: np.ndarray, distance: int, sketches: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the codes below one node, that of the closest sketches if there are any: pairs of places."""
    order = np.argsort(gray_rank(codes), kind="stable")
    leaves = Leaves(codes[order])
    a, b = _any_forest(leaves, distance) if sketches is None else _closest_forest(leaves, distance, sketches[order], limit)
    none = np.zeros(0, np.int64)
    return order[np.concatenate([none, *a])], order[np.concatenate([none, *b])]


def _any_forest(leaves: Leaves, distance: int) -> tuple[list, list]:
    a, b = [], []
    for first in range(len(leaves.codes)):
        if not leaves.free[first]:
            continue
        leaves.take([first])
        queue = [first]
        while queue:
            x = queue.pop()
            members = leaves.near(x, distance)
            leaves.take(members)
            a.append(np.full(len(members), x))
            b.append(members)
            queue.extend(members.tolist())
    return a, b


def _closest_forest(leaves: Leaves, distance: int, sketches: np.ndarray, limit: int) -> tuple[list, list]:
    """Each tree grows by the free place whose sketch differs least from one of its own, as long as any differs in ``limit`` at most."""
    n = len(leaves.codes)
    least, parent = np.full(n, MINIMA + 1), np.full(n, -1)
    a, b = [], []
    for first in range(n):
        if not leaves.free[first]:
            continue
        x = first
        while True:
            leaves.take([x])
            least[x] = MINIMA + 1
            if parent[x] >= 0:
                a.append([parent[x]])
                b.append([x])
            members = leaves.near(x, distance)
            found = unlike(sketches[members], sketches[x])
            closer = (found <= limit) & (found < least[members])
            least[members[closer]], parent[members[closer]] = found[closer], x
            x = int(least.argmin())
            if least[x] > limit:
                break
    return a, b


def forest(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct codes below one node."""
    a, b = spanning(codes, distance)
    return codes[a], codes[b]


def node_links(node: np.ndarray, codes: np.ndarray, distance: int, sketches: np.ndarray | None = None, limit: int = 0, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links below each of many nodes, as pairs of places; equal values of ``node`` stand together."""
    cut = np.flatnonzero(np.diff(node)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(node)]])
    size = ends - starts
    a, b = [], []
    few = np.repeat(size <= small, size)
    for step in range(1, min(small, int(size.max(initial=0)))):
        i = np.flatnonzero((node[step:] == node[:-step]) & few[step:])
        i = i[np.bitwise_count(codes[i] ^ codes[i + step]) <= distance]
        if sketches is not None:
            i = i[unlike(sketches[i], sketches[i + step]) <= limit]
        a.append(i)
        b.append(i + step)
    for s, e in zip(starts[size > small].tolist(), ends[size > small].tolist(), strict=True):
        x, y = spanning(codes[s:e], distance, None if sketches is None else sketches[s:e], limit)
        a.append(x + s)
        b.append(y + s)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(codes: DataFrame, distance: int = 4, node_limit: int = 1 << 14, least: float | None = None) -> DataFrame:
    """(u, v): edges that connect all distinct codes ``fp`` within ``distance`` of each other, u > v.

    With ``least``, codes also hold a ``sketch`` and a ``key`` that names both; edges are pairs of keys whose sketches
    agree too. Exact at any size: an upper node over ``node_limit`` is split by masks over its other bits, three levels
    deep; what is then still larger differs in a few bits only, and its leaves pass each other over as wholes.
    """
    spark = codes.sparkSession
    carried = ["fp"] if least is None else ["fp", "key", "sketch"]
    kinds = ", ".join(f"{c} {dict(codes.dtypes)[c]}" for c in carried)
    name, limit = carried[-1 if least is None else 1], 0 if least is None else allowed(least)

    def search(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            node = held.column("node").to_numpy()
            keep = int(np.searchsorted(node == node[-1], True))  # the last node may go on in the next batch
            yield from told(held.slice(0, keep))
            held = held.slice(keep)
        if held is not None:
            yield from told(held)

    def told(t):
        if not t.num_rows:
            return
        sketches = None if least is None else np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(t.num_rows, -1)
        a, b = node_links(t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64), distance, sketches, limit)
        if len(a):
            names = t.column(name).to_numpy()
            a, b = names[a], names[b]
            swap = a < b
            yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b))], names=["u", "v"])

    signed = lambda m: m - (1 << 64) if m >> 63 else m
    # Upper nodes: the mask and the bits under it. A node's number is a hash of both; should two nodes ever share a
    # number, they are searched as one, which finds the same links.
    level = [(m, i) for i, m in enumerate(masks(list(range(BITS)), distance))]
    at = codes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for m, i in level])).alias("n"), *carried)
    at = at.select(F.xxhash64("n.mask", "n.bits").alias("node"), F.col("n.mask").alias("mask"), *carried)
    found, row = None, 24 if least is None else 144  # bytes of an entry
    entries = len(level) * codes.agg(F.count(F.lit(1))).first()[0]
    for depth in range(3):
        sizes = at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node_limit)
        large = sizes.checkpoint() if depth < 2 else None
        below = 0 if large is None else large.agg(F.sum("n")).first()[0] or 0
        many = bool(below)
        small = at.join(large, "node", "left_anti") if many else at
        own = small.select("node", *carried).repartition(parts(spark, row * entries), "node").sortWithinPartitions("node").mapInArrow(search, fields("u {0}, v {0}".format(dict(codes.dtypes)[name])))
        found = own if found is None else found.unionByName(own)
        if not many:
            break
        # One level down: the same codes, by masks over the bits that their node's own mask leaves open.
        lower = {i: [(m | x, i * 100 + k) for k, x in enumerate(masks([b for b in range(BITS) if not m >> b & 1], distance))] for m, i in level}

        def split(batches, lower=lower):
            for b in batches:
                mask = b.column("mask").to_numpy()
                for i in np.unique(mask):
                    own = b.filter(pa.array(mask == i)).select(carried)
                    code = own.column("fp").to_numpy().view(np.uint64)
                    for m, k in lower[int(i)]:
                        under = [pa.array(np.full(len(code), k, np.int32)), pa.array((code & np.uint64(m)).view(np.int64))]
                        yield pa.RecordBatch.from_arrays([*under, *own.columns], names=["mask", "bits", *carried])

        at = at.join(large, "node", "left_semi").select("mask", *carried).mapInArrow(split, fields(f"mask int, bits long, {kinds}"))
        at = at.select(F.xxhash64("mask", "bits").alias("node"), "mask", *carried)
        level = [x for own in lower.values() for x in own]
        entries = below * len(masks(list(range(BITS)), distance))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) reaches, by alternating stars; roots have no row.

    Large stars link a node's larger neighbours to its smallest, small stars its smaller ones; rounds go on until each
    component is a star about its root. Each star is checkpointed, so a lost executor costs half a round at most; what
    else a round needs is made from those two, as every checkpoint writes a file a partition.
    """

    def open_nodes(e: DataFrame) -> int:
        """How many nodes have several roots, or a root that has one itself."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("of")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("own"), F.lit(1).alias("of")))
        ends = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("of").alias("of"))
        return ends.filter((F.col("own") + F.col("of") > 1) & (F.col("own") > 0)).agg(F.count(F.lit(1))).first()[0]

    def beside(near: DataFrame, least: DataFrame) -> DataFrame:
        # By the node's hash too, so that both sides are dealt out for this join and not as the minima were: then a node
        # that a third of all others hang on can be split.
        dealt = F.xxhash64("u").alias("dealt")
        return near.select("*", dealt).join(least.select("*", dealt), ["u", "dealt"])

    edges = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    while open_nodes(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = beside(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(large, least).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


#: Parts that the members of a large component are dealt into where they meet their component's name.
SALTS = 32


def _similar(each: DataFrame, texts: DataFrame, least: float, width: int, node_limit: int) -> DataFrame:
    """(u, v): keys of texts, of rows ``best``, ``fp``, ``sketch``, ``key``, that are proposed and whose sets are alike."""
    codes = each.groupBy("key").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.min("best").alias("best")).checkpoint()
    several = codes.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    near = links(several.select("fp"), WIDE, node_limit)
    near = near.select(F.explode(F.array("u", "v")).alias("fp")).unionByName(several.filter("n > 1").select("fp")).distinct().checkpoint()
    proposed = links(codes.select("fp", "key", "sketch").join(near, "fp", "left_semi").checkpoint(), WIDE, node_limit, least).checkpoint()
    met = proposed.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    return alike(proposed, texts.join(codes.join(met, "key", "left_semi").select("key", "best"), "best").select("key", "text"), least, width)


def alike(pairs: DataFrame, texts: DataFrame, least: float, width: int = 5) -> DataFrame:
    """Of the pairs (u, v) of keys those whose texts' sets of word shingles are ``least`` alike or more (Jaccard), exactly.

    ``texts``: key, text; rows of one key have the same set. Sets are sorted hashes of 64 bits, and travel to the pairs.
    """

    def sets(batches):
        for b in batches:
            found = [shingles(_words(t), width).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.binary())], names=["key", "own"])

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                keep.append(not either or both / either >= least)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    scratch = Scratch(pairs.sparkSession)
    own = scratch.put("sets", texts.mapInArrow(sets, fields("key string, own binary")).groupBy("key").agg(F.first("own").alias("own")))
    both = pairs.join(own.select(F.col("key").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("key").alias("v"), F.col("own").alias("b")), "v")
    found = both.select("u", "v", "a", "b").mapInArrow(compare, fields("u string, v string")).checkpoint()
    scratch.drop("sets")
    return found


def _named(each: DataFrame, distance: int, node_limit: int, edges: DataFrame | None = None) -> DataFrame:
    """(fp, best): of each fingerprint the smallest ``best`` among the rows of its component. each: fp, best.

    ``edges`` (u, v) links fingerprints, or any other names in their place; without it those within ``distance`` link.

    Only components of several fingerprints are joined, and their members by root and salt, so that a component that
    holds a third of all fingerprints meets its name in many tasks.
    """
    codes = each.groupBy("fp").agg(F.min("best").alias("best")).checkpoint()
    roots = components(links(codes.select("fp"), distance, node_limit) if edges is None else edges).withColumnsRenamed({"node": "fp"})
    named = codes.join(roots, "fp", "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    named = named.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))).checkpoint()
    names = named.groupBy("root").agg(F.min("best").alias("name"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    names = names.select("root", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return named.join(names, ["root", "salt"], "left").select("fp", F.coalesce("name", "best").alias("best"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, node_limit: int = 1 << 14) -> DataFrame:
    """Each row's id, ``fp`` (long) and ``component_id``: the smallest id reachable over links, its own included.

    Null texts are empty; texts without a word have fingerprint zero and link like any other; texts of any length are
    hashed whole; rows with a null id get a component too but name one only if it has no other; repeated rows each come
    back; equal ids need no tie-break, as the name is an id; an empty table gives an empty result. Extra columns play
    no part, whatever their names.
    """
    prepare(docs.sparkSession)
    each = fingerprints(docs, id_col, text_col, width).checkpoint()
    named = _named(each.select("fp", F.struct(F.col("id").isNull().alias("none"), "id").alias("best")), distance, node_limit)
    return each.join(named, "fp").select(F.col("id").alias(id_col), "fp", F.col("best.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, node_limit: int = 1 << 14, least: float | None = None) -> DataFrame:
    """One row of each component, all columns: that with the smallest id, null ids last.

    Rows with that same id are told apart by a 128-bit key of their texts, the smallest wins; of rows with the same id
    and the same text any one stays. So ids may repeat, and no two rows that stay are within ``distance``.

    With ``least``, texts link not by ``distance`` but where the sets of their shingles of ``width`` words are ``least``
    alike or more (Jaccard), exactly; so every row that goes has a partner of that similarity. Texts without a word are
    alike, and alike to no other. Which pairs are compared is up to the index: texts whose distinct words' fingerprints
    differ in more than ``WIDE`` bits, or whose sketches seem further apart than ``SLACK``, may be passed over.

    Null texts are empty; texts of any length count whole; ids may be null or repeat; of ties the smallest key wins; an
    empty table gives an empty result; extra columns are kept, whatever their names.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))
    texts, edges = docs.select(key.alias("best"), F.col(f"`{text_col}`").alias("text")), None
    if least is None:
        each = fingerprints(texts, "best", "text", width).withColumnRenamed("id", "best").checkpoint()
    else:
        each = sketched(texts, "best", "text", width).withColumnRenamed("id", "best").checkpoint()
        edges = _similar(each, texts, least, width, 8 * node_limit)  # 28 entries a code here, so splits cost more than large nodes
        each = each.select("best", F.col("key").alias("fp"))
    # A name is the key of the row that stays, so the names of all components are the rows to keep.
    chosen = _named(each, distance, node_limit, edges).select("best").distinct()
    several = each.groupBy("best").agg(F.count(F.lit(1)).alias("n"))
    chosen = chosen.join(several, "best").select("best", (F.col("n") > 1).alias("again")).checkpoint()
    # The row's own columns travel in a struct, so that their names clash with nothing.
    rows = docs.select(key.alias("best"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(chosen, "best")
    once = rows.filter("NOT again").select("row")
    if chosen.filter("again").take(1):
        once = once.unionByName(rows.filter("again").groupBy("best").agg(F.first("row").alias("row")).select("row"))
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
