"""Source divergence audit by systolic rotation: how far each source's words are from every other source of its language.

Counting. Tasks count terms and documents by (language, source) as they read, so a source that holds a third of all rows
sends one row a term and task. The terms of a language that are kept fall into slices by their hash, and are numbered
within a slice; a source's counts in a slice are one compressed sparse vector.

Rotation. The sources of a language are dealt to seats, a few to each. A seat's vectors of a slice are one block, and the
blocks stay where they are: partitioned by language, slice and seat, and kept. At home every two sources of a seat meet.
Then come the rounds of a round-robin tournament (one seat stands still, the others turn), in which each seat meets one
other, every two seats exactly once: of each meeting the block with the larger seat number travels to the partition of
the smaller, and both directions are evaluated there. So a round moves half the vectors, once, and a task holds two
blocks. Values of slices add up. At home a heap of each source also ranks its terms against the language's own.

Arithmetic is exact: numbers below 2**63, and where a count is too large for that, long division in steps of 1000.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, fields, partitions, pick, prepare

#: Everything but letters is a blank, A-Z become a-z; bytes of other scripts stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Terms that a task counts before it sends them on.
HELD = 400_000
#: Terms of a slice, until there are so many slices; sources of a seat, on average.
SLICE, SLICES, SEAT = 4096, 256, 8
#: Copies of the one row of a language where many rows meet it.
SALTS = 32
#: Terms of a block that are evaluated at once.
STEP = 1 << 13
ONE = 1_000_000_000


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text): counts by task; each group also has a row with term ''."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def told():
            for (lang, source), (n, rows) in held.items():
                n[b""] = 0
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(pa.array(np.zeros(len(terms), np.int64))), pa.array([source]).take(pa.array(np.zeros(len(terms), np.int64))), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([rows[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = (text or "").encode().translate(_TERMS).split()
                n, rows = held[lang or "", source or ""]
                n.update(words)
                rows.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from told()
        yield from told()

    return docs.mapInArrow(run, fields("lang string, source string, term string, n long, docs long"))


def _beside(many: DataFrame, one: DataFrame, salt: Column) -> DataFrame:
    """Join the one row of each language to its many rows, which are dealt into parts, as a language may hold most of them."""
    parts = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(parts, ["lang", "_salt"]).drop("_salt")


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), exactly; total is at least count + 1."""
    rest = counts.astype(np.int64) + 1
    if rest.max(initial=0) < (1 << 62) // ONE:
        return 1 + rest * ONE // total
    whole = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // total
        rest %= total
    return 1 + whole


def differences(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over terms of floor((p-q)**2 / q), and of floor((p-q)**2 / p), for one row p against all rows q."""
    square = p - q
    square *= square
    return (square // q).sum(axis=1), (square // p).sum(axis=1)


def _packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    order = np.argsort(numbers)
    return zlib.compress(np.diff(numbers[order], prepend=0).astype("<u4").tobytes() + counts[order].astype("<i8").tobytes(), 1)


def _unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(vector)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64), np.frombuffer(raw, "<i8", n, 4 * n)


class Block:
    """The sources of a seat in one slice: counts of its terms, as far as they occur."""

    def __init__(self, members: list[dict], vectors: list[dict] | None, size: int, kept: int):
        self.sources, self.size = [m["source"] for m in members], size
        self.totals = np.array([m["total"] + kept for m in members], np.int64)[:, None]
        self.vectors = {v["source"]: _unpacked(v["vector"]) for v in vectors or ()}

    def shares(self, first: int) -> np.ndarray:
        """Of each source the shares of STEP terms."""
        found = np.zeros((len(self.sources), min(STEP, self.size - first)), np.int64)
        for k, source in enumerate(self.sources):
            if source in self.vectors:
                numbers, counts = self.vectors[source]
                s, e = np.searchsorted(numbers, (first, first + found.shape[1]))
                found[k, numbers[s:e] - first] = counts[s:e]
        return shares(found, self.totals)


def meet(a: Block, b: Block | None, told: dict[tuple[str, str], int]) -> None:
    """Both directions of all pairs of sources of two blocks, or of one block with itself, added to ``told``."""
    rows, others = len(a.sources), len((b or a).sources)
    forth, back = np.zeros((2, rows, others), np.int64)
    for first in range(0, a.size, STEP):
        p = a.shares(first)
        q = p if b is None else b.shares(first)
        for k in range(rows):
            start = k + 1 if b is None else 0
            x, y = differences(p[k], q[start:])
            forth[k, start:] += x
            back[k, start:] += y
    for k, one in enumerate(a.sources):
        for m in range(k + 1 if b is None else 0, others):
            other = (b or a).sources[m]
            told[one, other] = told.get((one, other), 0) + int(forth[k, m])
            told[other, one] = told.get((other, one), 0) + int(back[k, m])


def best_terms(a: Block, terms: list[bytes], language: np.ndarray, top: int):
    """(source, term, value) of each source's terms that are more frequent there than in the language, the best ``top``."""
    for k, source in enumerate(a.sources):
        if source not in a.vectors:
            continue
        numbers, counts = a.vectors[source]
        p, q = shares(counts, int(a.totals[k, 0])), language[numbers]
        over = np.flatnonzero(p > q)
        value = (p[over] - q[over]) ** 2 // q[over]
        heap = heapq.nsmallest(top, zip((-value).tolist(), [terms[i] for i in numbers[over].tolist()], strict=True))
        yield from ((source, term, -v) for v, term in heap)


def partner(seat: Column, seats: Column, turn: int) -> Column:
    """Whom a seat meets in a turn of the tournament, null if nobody: the last seat stands still, the others turn.

    With an odd number of seats one more is thought of; who would meet it, rests.
    """
    even = seats + seats % 2
    other = F.pmod(F.lit(turn) - seat, even - 1)
    other = F.when(seat == even - 1, F.pmod(F.lit(turn) * (even / 2).cast("int"), even - 1)).when(other == seat, even - 1).otherwise(other)
    return F.when((F.lit(turn) < even - 1) & (other < seats), other)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, slice_terms: int = SLICE, seat_sources: int = SEAT) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from each other source of the language, and the leading terms.

    With p and q shares of 10**9 (add-one smoothed over the language's kept terms, those in ``least_docs`` documents or
    more), the divergence of p from q at a term is floor((p-q)**2 / q). Part ``pair``: item is each other source, value
    the sum over all kept terms, all ranks. Part ``term``: item is each term that occurs in the source and is more
    frequent there than in the language, the best ``top``. Ranks go by falling value, then by item (bytes of UTF-8).

    Null texts, languages and sources are ''; texts of any length are counted whole; repeated rows count each. Every
    (lang, source) that occurs has its pairs, also without a term; where a language keeps none, values are 0. An empty
    table gives an empty result. Extra columns play no part, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    counts = count_terms(pick(docs, lang=lang_col, source=source_col, text=text_col))
    counts = scratch.put("counts", counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = scratch.put("kept", kept.select("lang", "term", "lang_n"))

    # One row a language: what it keeps, and how many slices and seats it has.
    groups = counts.filter("term = ''").select("lang", "source")
    languages = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    languages = languages.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.greatest(F.lit(1), F.ceil(F.col("sources") / seat_sources)).cast("int").alias("seats"))
    languages = languages.withColumn("slices", F.greatest(F.lit(1), F.least(F.lit(SLICES), F.ceil(F.col("kept") / slice_terms))).cast("int"))
    languages = scratch.put("languages", languages)
    seat = F.pmod(F.xxhash64("source"), F.col("seats")).cast("int").alias("seat")

    # Terms, numbered within their slices, and what a slice has: its terms and their counts in the language.
    numbered = _beside(kept, languages.select("lang", "slices", "seats"), F.col("term")).withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    numbered = numbered.withColumn("number", F.row_number().over(W.Window.partitionBy("lang", "slice").orderBy("term")) - 1)
    numbered = scratch.put("numbered", numbered.select("lang", "term", "slice", "number", "seats", "lang_n"))

    def listed(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("number").to_numpy())
        table = table.take(pa.array(order))
        terms = zlib.compress("\n".join(table.column("term").to_pylist()).encode(), 1)
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([terms], pa.binary()), pa.array([zlib.compress(table.column("lang_n").to_numpy().astype("<i8").tobytes(), 1)], pa.binary()), pa.array([len(order)], pa.int64())], names=["lang", "slice", "terms", "lang_counts", "size"])

    dictionary = scratch.put("dictionary", numbered.groupBy("lang", "slice").applyInArrow(listed, "lang string, slice int, terms binary, lang_counts binary, size long"))

    # Blocks: the vectors of a seat in a slice.
    own = counts.filter("term != ''").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]).select("lang", "slice", seat, "source", "number", "n")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        sources, number, n = table.column("source").combine_chunks().dictionary_encode(), table.column("number").to_numpy(), table.column("n").to_numpy()
        code = sources.indices.to_numpy()
        vectors = [{"source": s, "vector": _packed(number[at], n[at]), "total": int(n[at].sum())} for k, s in enumerate(sources.dictionary.to_pylist()) for at in [np.flatnonzero(code == k)]]
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), pa.array([vectors], pa.list_(pa.struct([("source", pa.string()), ("vector", pa.binary()), ("total", pa.int64())])))], names=["lang", "slice", "seat", "vectors"])

    blocks = own.groupBy("lang", "slice", "seat").applyInArrow(pack, "lang string, slice int, seat int, vectors array<struct<source:string,vector:binary,total:long>>")
    blocks = scratch.put("blocks", blocks)
    totals = blocks.select("lang", F.explode("vectors").alias("v")).groupBy("lang", F.col("v.source").alias("source")).agg(F.sum("v.total").alias("total"))
    members = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    members = _beside(members, languages, F.col("source")).groupBy("lang", seat, "seats", "slices", "kept", "lang_total").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("members"))
    resident = members.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).join(blocks, ["lang", "slice", "seat"], "left")
    resident = resident.join(dictionary.select("lang", "slice", "size"), ["lang", "slice"], "left")
    columns = ["lang", "slice", "seat", "seats", "kept", "lang_total", "members", "vectors"]
    resident = resident.select(*columns, F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    resident = resident.repartition(partitions(spark), "lang", "slice", "seat").persist(StorageLevel.DISK_ONLY)

    result = fields("lang string, source string, part string, item string, value long")

    def rows(told: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told, strict=True), [pa.string()] * 4 + [pa.int64()], strict=True)], names=result.names)

    def pairs(sums):
        return [(lang, one, "pair", other, v) for lang, told in sums.items() for (one, other), v in told.items()]

    def at_home(batches):
        sums: dict[str, dict] = defaultdict(dict)
        for b in batches:
            for r in b.to_pylist():
                block = Block(r["members"], r["vectors"], r["size"], r["kept"])
                meet(block, None, sums[r["lang"]])
                if r["vectors"]:
                    language = shares(np.frombuffer(zlib.decompress(r["lang_counts"]), "<i8"), r["lang_total"] + r["kept"])
                    found = [(r["lang"], source, "term", term.decode(), v) for source, term, v in best_terms(block, zlib.decompress(r["terms"]).split(b"\n"), language, top)]
                    if found:
                        yield rows(found)
        if told := pairs(sums):
            yield rows(told)

    def on_a_visit(batches):
        sums: dict[str, dict] = defaultdict(dict)
        for b in batches:
            for r in b.to_pylist():
                meet(Block(r["members"], r["vectors"], r["size"], r["kept"]), Block(r["their_members"], r["their_vectors"], r["size"], r["kept"]), sums[r["lang"]])
        if told := pairs(sums):
            yield rows(told)

    found = scratch.put("home", resident.join(dictionary.select("lang", "slice", "terms", "lang_counts"), ["lang", "slice"], "left").mapInArrow(at_home, result))
    most = languages.agg(F.max("seats")).first()[0] or 0
    for turn in range(most + most % 2 - 1 if most > 1 else 0):
        visitor = resident.withColumn("at", partner(F.col("seat"), F.col("seats"), turn)).filter("at < seat")
        visitor = visitor.select("lang", "slice", F.col("at").alias("seat"), F.col("members").alias("their_members"), F.col("vectors").alias("their_vectors"))
        met = resident.join(visitor, ["lang", "slice", "seat"]).mapInArrow(on_a_visit, result)
        found = found.unionByName(scratch.put(f"turn{turn}", met))
    resident.unpersist()
    scratch.drop("counts", "kept", "numbered", "dictionary", "blocks", "languages")

    order = W.Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    summed = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    leading = found.filter("part = 'term'")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (summed, leading)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
