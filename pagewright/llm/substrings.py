"""Repeated passages by De Bruijn compaction.

A passage is repeated where a window of ``width`` consecutive words occurs elsewhere too, in another document or in
its own. Windows are edges of a word-level De Bruijn graph. The graph is never laid out edge by edge:

1. Each window has an anchor, the leftmost smallest k-mer hash in it. Consecutive windows with the same anchor are one
   path segment. Equal windows have equal anchors, so all places of an edge meet under its anchor; that other windows
   may meet there too costs work and changes no result.
2. Spark joins compact the graph: an anchor that occurs once carries no repeated edge; if all its segments are the same
   words they are one nonbranching path, and all its windows repeat. Neither is looked into further.
3. Segments whose anchor branches are resolved window by window: their windows are read again at the source coordinates
   (text key, word position), and those whose words occur twice repeat.

Segments and windows are the same only if the 128-bit digests (XXH3) of their bytes are, taken of the words themselves
as they stand at the source coordinates; no sum of word hashes decides. Windows covered by either kind are merged into
spans and the words below them are removed. Results depend on the text alone, so spans hang on a 128-bit key of the
text rather than on ids, and repeated or null ids do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import WORDS, Rolling, Scratch, fields, prepare, release, word_hashes, word_spans

#: Words of an anchor k-mer.
ANCHOR = 6
_KEYS = "k1 long, k2 long, "


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost smallest of each ``width`` consecutive values stands, by doubling."""
    at, value, have = np.arange(len(x)), x, 1
    while have < width:
        step = min(have, width - have)
        left = value[:-step] <= value[step:]
        at, value = np.where(left, at[:-step], at[step:]), np.minimum(value[:-step], value[step:])
        have += step
    return at


class Words:
    """The words of one text, one space apart, and digests of stretches of them."""

    def __init__(self, raw: bytes):
        self.raw = b" ".join(raw.split())
        self.starts, self.ends = word_spans(self.raw)

    def __len__(self) -> int:
        return len(self.starts)

    def digests(self, first: np.ndarray, many: np.ndarray | int) -> np.ndarray:
        """(n, 2): the 128-bit digest of the bytes of ``many`` words from each ``first`` on."""
        if not len(first):
            return np.zeros((0, 2), np.int64)
        raw, spans = self.raw, zip(self.starts[first].tolist(), self.ends[first + many - 1].tolist(), strict=True)
        return np.frombuffer(b"".join([xxh3_128_digest(raw[s:e]) for s, e in spans]), "<i8").reshape(-1, 2)


def segments(raw: bytes, width: int) -> tuple[np.ndarray, ...]:
    """Path segments of one text: first window, number of windows, anchor hash, digest of all the segment's words."""
    words = Words(raw)
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    k = min(ANCHOR, width)
    hashes = word_hashes(words.raw)
    at = np.arange(len(words) - k + 1)
    kmers = Rolling(hashes, WORDS).of(at, at + k)
    place = leftmost_least(kmers, width - k + 1)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    many = np.diff(np.append(first, n))
    return first, many, kmers[place[first]], words.digests(first, many + width - 1)


def _slices(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)})


def _batch(keys: pa.RecordBatch, row: list[np.ndarray], **columns: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.concatenate(row))
    return pa.RecordBatch.from_arrays([keys.column("k1").take(at), keys.column("k2").take(at), *map(pa.array, columns.values())], names=["k1", "k2", *columns])


def repeated(docs: DataFrame, text_col: str = "text", width: int = 35) -> DataFrame:
    """(k1, k2, spans): for each text with repeated windows, [first window, number of windows]s, in no order."""
    scratch = Scratch(docs.sparkSession)
    texts = _keyed(docs.select(F.col(f"`{text_col}`").alias("_text")), "_text").select("k1", "k2", F.coalesce("_text", F.lit("")).alias("text"))

    def cut(batches):
        release()
        for b in batches:
            for part in _slices(b):
                found = [segments(t.encode(), width) for t in part.column("text").to_pylist()]
                row = [np.full(len(x[0]), i) for i, x in enumerate(found)]
                first, many, anchor, words = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _batch(part, row, start=first.astype(np.int32), n=many.astype(np.int32), anchor=anchor.view(np.int64), d1=words[:, 0].copy(), d2=words[:, 1].copy())

    each = scratch.put("segments", texts.mapInArrow(cut, fields(_KEYS + "start int, n int, anchor long, d1 long, d2 long")))
    anchors = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), *[f(d).alias(f"{f.__name__}_{d}") for d in ("d1", "d2") for f in (F.min, F.max)])
    # Written, not joined on the fly: then both sides of the join are plain shuffles, and a hot anchor can be split.
    anchors = scratch.put("anchors", anchors.filter("c > 1").select("anchor", ((F.col("min_d1") != F.col("max_d1")) | (F.col("min_d2") != F.col("max_d2"))).alias("branching")))
    hit = each.join(anchors, "anchor").select("k1", "k2", F.struct("start", "n", "branching").alias("s"))
    # Copies of a text have the same segments: they merge into one set before they are dealt out.
    hit = scratch.put("hits", hit.groupBy("k1", "k2").agg(F.collect_set("s").alias("s")))
    del each, anchors
    scratch.drop("segments", "anchors")

    whole = hit.select("k1", "k2", F.filter("s", lambda s: ~s["branching"]).alias("s"))
    open_ = hit.select("k1", "k2", F.filter("s", lambda s: s["branching"]).alias("s")).filter(F.size("s") > 0)

    def windows(batches):
        for b in batches:
            for part in _slices(b):
                row, pos, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
                for i, (t, s) in enumerate(zip(part.column("text").to_pylist(), part.column("s").to_pylist(), strict=True)):
                    at = np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in s])
                    row.append(np.full(len(at), i))
                    pos.append(at)
                    found.append(Words(t.encode()).digests(at, width))
                own = np.concatenate(found)
                yield _batch(part, row, pos=np.concatenate(pos).astype(np.int32), w1=own[:, 0].copy(), w2=own[:, 1].copy())

    at = scratch.put("windows", texts.join(open_, ["k1", "k2"]).mapInArrow(windows, fields(_KEYS + "pos int, w1 long, w2 long")))
    scratch.drop()
    twice = scratch.put("twice", at.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w1", "w2"))
    single = at.join(twice, ["w1", "w2"]).select("k1", "k2", F.struct(F.col("pos").alias("start"), F.lit(1).alias("n")).alias("s"))
    whole = whole.select("k1", "k2", F.explode("s").alias("s")).select("k1", "k2", F.struct("s.start", "s.n").alias("s"))
    spans = scratch.put("spans", whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_set("s").alias("spans")))
    del hit, whole, open_, at, twice, single
    scratch.drop("hits", "windows", "twice")
    return spans


def clean(raw: bytes, spans: list[dict] | None, width: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one space."""
    words = raw.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.subtract.at(edge, [s["start"] + s["n"] + width - 1 for s in spans], 1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return len(words), len(words) - len(kept), b" ".join([words[i] for i in kept])


def remove_repeated(docs: DataFrame, text_col: str = "text", width: int = 35, digest: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (or ``kept_sha256`` if ``digest``).

    Null texts count as empty and keep nothing; texts shorter than a window keep all words; texts of any length are
    read whole, a slice of a batch at a time; every copy of a repeated passage goes, so ties need no rule, and whole
    copies of texts go as well. Repeated rows each come back; an empty table gives no rows. Columns of ``docs`` that
    have the name of a new one are replaced; no other name plays a part.
    """
    prepare(docs.sparkSession)
    new = ["n_words", "n_removed", "kept_sha256" if digest else "kept_text"]
    own = [c for c in docs.columns if c not in new and not (digest and c == text_col)]
    spans = repeated(docs, text_col, width)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text_col}`").alias("_text")) if own else docs.select(F.struct(F.lit(0).alias("_")).alias("row"), F.col(f"`{text_col}`").alias("_text"))
    rows = _keyed(packed, "_text").join(spans, ["k1", "k2"], "left").select("row", F.col("_text").alias("text"), "spans")

    def apply(batches):
        for b in batches:
            for part in _slices(b):
                out = [clean((t or "").encode(), s, width) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)]
                kept = [hashlib.sha256(k).hexdigest() if digest else k.decode() for _, _, k in out]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(kept, pa.string())], names=["row", *new])

    schema = T.StructType([rows.schema["row"], *fields(f"{new[0]} long, {new[1]} long, {new[2]} string")])
    done = rows.mapInArrow(apply, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in own], *new)
