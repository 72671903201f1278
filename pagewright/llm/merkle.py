"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words.

A text is cut into sections at blank lines and headings, sections into paragraphs at newlines, paragraphs into leaves.
A leaf is a run of words that ends where the last word's hash says so (content decides, so an edit moves no other
leaf); short paragraphs have one leaf a word. Leaves hold all bytes of the text, white space included. A leaf's digest
(128 bits, XXH3) is of its bytes, every other node's hash (SHA-256) of its children's, from the leaves to the root. So
equal roots mean equal texts, and comparing two trees from the root down passes over equal branches and ends at the
leaves that differ, which locate the edit.

Likeness is the share of bytes below nodes that both trees have, twice the shared mass over both masses.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import fields, parts, prepare, word_hashes, word_spans

#: Paragraphs of up to so many words have a leaf for every word; longer ones cut at one word hash in CUT, or at LONGEST.
FINE, CUT, LONGEST = 24, 3, 16
_HEADING = re.compile(rb"\s*#{1,6}\s")
_LABEL = {"paragraph": b"\1", "section": b"\2", "root": b"\3"}


def _hash(kind: str, *parts: bytes) -> bytes:
    return hashlib.sha256(_LABEL[kind] + b"".join(parts)).digest()


class Tree:
    """root (bytes); sections: [(hash, [(paragraph hash, first byte, end byte)])]; leaves: first byte and digest of each."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode()
        lines = self.raw.split(b"\n")
        # The newline belongs to the line it ends, so no two texts have the same paragraphs.
        starts = np.cumsum([0, *[len(line) + 1 for line in lines[:-1]]])
        self.begins = _leaves(self.raw, starts)
        edges = [*self.begins.tolist(), len(self.raw)]
        self.digests = b"".join([xxh3_128_digest(self.raw[s:e]) for s, e in zip(edges, edges[1:], strict=False)])
        at = [*(16 * np.searchsorted(self.begins, starts)).tolist(), len(self.digests)]
        stops = [*starts[1:].tolist(), len(self.raw)]
        self.sections: list[tuple[bytes, list[tuple[bytes, int, int]]]] = []
        own: list[tuple[bytes, int, int]] = []
        blank = False
        for k, (line, start, stop) in enumerate(zip(lines, starts.tolist(), stops, strict=True)):
            if own and (blank or _HEADING.match(line)):
                self._close(own)
                own = []
            blank = not line.strip()
            own.append((_hash("paragraph", self.digests[at[k] : at[k + 1]]), start, stop))
        self._close(own)
        self.root = _hash("root", *[h for h, _ in self.sections])

    def _close(self, own: list[tuple[bytes, int, int]]) -> None:
        self.sections.append((_hash("section", *[h for h, _, _ in own]), own))

    def leaves(self, paragraphs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests (their first half), first and end bytes of the leaves in some paragraphs (byte spans)."""
        low = np.searchsorted(self.begins, [s for s, _ in paragraphs])
        # The last line of a text may be empty; its one leaf is then as well.
        high = np.maximum(np.searchsorted(self.begins, [e for _, e in paragraphs]), low + 1)
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.frombuffer(self.digests, "<u8")[0::2][at], self.begins[at], np.append(self.begins[1:], len(self.raw))[at]


def _leaves(raw: bytes, lines: np.ndarray) -> np.ndarray:
    """First byte of each leaf: those of the lines, and those of words at which a line is cut."""
    words = word_hashes(raw)
    if not len(words):
        return lines
    begins, _ = word_spans(raw)
    line = np.searchsorted(lines, begins, side="right") - 1
    new = np.diff(line, prepend=-1) > 0
    many = np.bincount(line, minlength=len(lines))[line]
    cut = new | (many <= FINE)
    cut[1:] |= words[:-1] % np.uint64(CUT) == 0
    first = np.flatnonzero(cut)
    since = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    return np.union1d(lines, begins[(since % LONGEST == 0) & ~new])


def _shared(a: list[tuple], b: list[tuple]) -> tuple[float, list[tuple], list[tuple]]:
    """Mass below children with equal hashes (each matched once), and the children left on either side."""
    there: dict[bytes, int] = {}
    for x in b:
        there[x[0]] = there.get(x[0], 0) + 1
    mass, left, used = 0.0, [], {}
    for x in a:
        if there.get(x[0], 0) > used.get(x[0], 0):
            used[x[0]] = used.get(x[0], 0) + 1
            mass += x[-1] - x[-2]
        else:
            left.append(x)
    rest = []
    for x in b:
        if used.get(x[0], 0):
            used[x[0]] -= 1
        else:
            rest.append(x)
    return mass, left, rest


def _span(section: tuple[bytes, list]) -> tuple:
    return section[0], section[1], section[1][0][1], section[1][-1][2]


def differing(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]], list[tuple[int, int]]]:
    """Bytes below equal branches, and the byte spans of the paragraphs that differ, in either tree."""
    if a.root == b.root:
        return float(len(a.raw)), [], []
    mass, x, y = _shared([_span(s) for s in a.sections], [_span(s) for s in b.sections])
    more, x, y = _shared([p for s in x for p in s[1]], [p for s in y for p in s[1]])
    return mass + more, [(s, e) for _, s, e in x], [(s, e) for _, s, e in y]


def compared(a: Tree, b: Tree) -> tuple[float, int | None, int | None]:
    """Likeness, and the first and end byte in ``a`` between which all of its leaves lie that ``b`` lacks (None: none)."""
    if a.root == b.root:
        return 1.0, None, None
    mass, x, y = differing(a, b)
    start, end = None, None
    if x:
        (h, s, e), k = a.leaves(x), b.leaves(y)[0] if y else np.zeros(0, np.uint64)
        codes, at = np.unique(np.concatenate([h, k]), return_inverse=True)
        there = np.bincount(at[len(h) :], minlength=len(codes))
        own = at[: len(h)]
        order = np.argsort(own, kind="stable")
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order])
        here = rank < there[own]
        mass += float((e - s)[here].sum())
        if not here.all():
            start, end = int(s[~here].min()), int(e[~here].max())
    return min(1.0, 2 * mass / max(1, len(a.raw) + len(b.raw))), start, end


def likeness(a: Tree, b: Tree) -> float:
    """0 to 1; 1 for equal texts, two empty ones included."""
    return compared(a, b)[0]


def edited(text: str, other: str) -> str:
    """The text with its last quarter (code points) replaced by the start of the other one."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, root of its tree, and how it compares with its edited text and with the next document.

    ``edit_start`` and ``edit_end``: the places (code points) between which the text has all leaves that its edited text
    lacks; null if it lacks none. Null texts are empty; the next document is the next by (id, text), null ids first,
    after the last the first (a single document is its own successor); ties of both are equal rows. Texts of any length
    are fingerprinted whole. Repeated rows each come back; an empty table gives no rows; extra columns play no part.

    Rows are dealt by ranges of ids, cut at approximate quantiles, so that each range holds about as many. The first
    row of each range also goes, marked ``extra``, to the end of the range before it (that of the first to the last),
    so every row meets its successor in one sorted pass. Only the cuts and each range's smallest id, a fixed number of
    ids, are on the driver; texts are shuffled once.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    n = parts(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], min(20 * n, 1_000_000)).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))

    def dealt(batches):
        """Adds each row's bucket: how many cuts are at or below its id; null ids in the first."""
        for b in batches:
            at = [0 if i is None else bisect_right(cuts, i) for i in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at, pa.int64())], names=["id", "bucket"])

    heads = {r["bucket"]: (r["least"], r["nulls"]) for r in rows.select("id").mapInArrow(dealt, fields(f"id {kind}, bucket long")).groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    first_of = {b: None if nulls else least for b, (least, nulls) in heads.items()}

    def twice(batches):
        """Each row in its bucket; the rows with the smallest id of a bucket also at the end of the one before."""
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = part.column("id").to_pylist()
                own = [0 if i is None else bisect_right(cuts, i) for i in ids]
                more = [k for k, (i, o) in enumerate(zip(ids, own, strict=True)) if i == first_of[o]]
                take = pa.array(list(range(len(ids))) + more, pa.int64())
                bucket = own + [before[own[k]] for k in more]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([False] * len(ids) + [True] * len(more)), part.column("id").take(take), part.column("text").take(take)], names=["bucket", "extra", "id", "text"])

    def walk(batches):
        out: list[tuple] = []
        held = None  # (bucket, id, text, tree): the row that waits for its successor
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("bucket", "extra", "id", "text")]
            for bucket, extra, i, text in zip(*columns, strict=True):
                if held is not None and held[0] == bucket:
                    tree = Tree(text)
                    out.append(record(held, text, tree))
                    held = None if extra else (bucket, i, text, tree)
                elif not extra:
                    held = (bucket, i, text, Tree(text))
                if len(out) >= 1000:
                    yield told(out)
                    out = []
        yield told(out)

    def record(held, text, tree):
        _, i, own, mine = held
        changed = edited(own, text)
        other = Tree(changed)
        near, start, end = compared(mine, other)
        place = lambda k: None if k is None else len(mine.raw[:k].decode())
        return i, len(own), hashlib.sha256(other.raw).hexdigest(), mine.root.hex(), other.root.hex(), near, likeness(mine, tree), place(start), place(end)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_start", "edit_end"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def told(out):
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], ids_type), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    ids_type = to_arrow_type(rows.schema["id"].dataType)
    placed = rows.mapInArrow(twice, fields(f"bucket long, extra boolean, id {kind}, text string"))
    # A range to a partition, by its number: hashes of so few values would leave some partitions several and others none.
    placed = placed.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "extra", F.asc_nulls_first("id"), "text")
    return placed.mapInArrow(walk, fields(f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long, edit_end long"))
