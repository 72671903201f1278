"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised, ended with a separator and, if longer than the capacity, cut. How pieces combine depends only
on how many there are of each length (at most ``capacity`` counts, whatever the corpus), so the plan is made on the
driver from that histogram. An index holds the available lengths by themselves and by the sums of two and of three;
looking up the gap that a long piece leaves gives a combination that fills it exactly, which is used as often as the
counts allow; what is left goes by best fit. The plan says, for the r-th piece of each length, its sequence and offset;
ranks are made in two levels over all rows.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, own, partitions, pick, prepare, ranked

CAPACITY, SEPARATOR = 2048, 0
#: Chunks, and parts of chunks, whose ids a worker remembers at a time (about 200 bytes each).
CHUNKS, PARTS = 300_000, 400_000


#: How the vocabulary file splits lower-cased text, and the letters for which Python and the tokenizer
#: agree on normal form and lower case, so that a chunk may be split here; other chunks are left to the tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"[\x21-\x7E\u00C0-\u00FF\u0152\u0153\u2018-\u201F\u2026]*"


def little(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit numbers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else np.array(ids, "<u4").tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def _splits_as_expected(tokenizer) -> bool:
    """Whether the file's own normalizer and pre-tokenizer are the ones that SPLIT and the lower case stand for."""
    import json

    own = json.loads(tokenizer.to_str())
    found = json.dumps([own["normalizer"], own["pre_tokenizer"]])
    return json.dumps(SPLIT)[1:-1] in found and "Lowercase" in found and "ByteLevel" in found


class _Parts(dict):
    """ids of parts that the pre-tokenizer leaves whole, by the tokenizer's model."""

    def __init__(self, tokenizer):
        self.tokenize, self.letters = tokenizer.model.tokenize, byte_letters()

    def __missing__(self, part: str) -> bytes:
        self[part] = ids = little([t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.letters))])
        return ids


class _Chunks(dict):
    """ids of chunks between spaces: of their parts, or where those aren't certain, by the whole tokenizer."""

    def __init__(self, tokenizer):
        import re

        import regex

        self.encode, self.parts = tokenizer.encode, _Parts(tokenizer)
        self.special = re.compile("|".join(map(re.escape, (x.content for x in tokenizer.get_added_tokens_decoder().values()))) or r"(?!)").search
        self.split, self.plain = regex.compile(SPLIT).findall, re.compile(PLAIN).fullmatch

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            ids = self.parts[chunk.lower()]
        elif self.plain(chunk) and not self.special(chunk):
            ids = b"".join(map(self.parts.__getitem__, self.split(chunk.lower())))
        else:
            ids = little(self.encode(chunk, add_special_tokens=False).ids)
        self[chunk] = ids
        return ids


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit numbers, by the tokenizer's own model.

    The vocabulary's pre-tokenizer drops white space and never crosses it, so a text's ids are those of its chunks
    between spaces and newlines, and a chunk's are those of its parts. Chunks and parts are encoded once as long as
    they are remembered.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.whole = None if _splits_as_expected(tokenizer) else tokenizer
        self.chunks = _Chunks(tokenizer)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        for known, most in ((self.chunks, CHUNKS), (self.chunks.parts, PARTS)):
            if len(known) > most:
                known.clear()
        if self.whole is not None:
            return [little(e.ids) for e in self.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        get = self.chunks.__getitem__
        return [b"".join(map(get, (t or "").replace("\n", " ").split(" "))) for t in texts]


def encoder(path: str) -> Encoder:
    """The worker's own; what it remembers lasts from task to task."""
    return own(("packing", path), lambda: Encoder(path))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): null texts are empty, so every row has its separator at least."""

    def run(batches):
        own_encoder = encoder(path)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, texts = b.column(0).slice(at, 256), b.column(1).slice(at, 256).to_pylist()
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids_of in enumerate(own_encoder.encode(texts)):
                    ids_of += end
                    for i, s in enumerate(range(0, len(ids_of), 4 * capacity)):
                        part = ids_of[s : s + 4 * capacity]
                        row.append(k)
                        piece.append(i)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, fields(f"id {kind}, piece int, start long, length long, ids_crc32 long"))


class Sums:
    """Which one, two or three available lengths add up to a total, looked up by the total.

    Pairs stand under their sum, the most uneven first. A triple stands under its sum as a largest length and the sum
    of the other two, under which its pairs are found; so the index of three takes no more room than that of two.
    Counts only fall, so what has run out is passed over once and for all.
    """

    def __init__(self, left: list[int]):
        self.left = left
        have = np.flatnonzero(left)
        low, high = (have[i] for i in np.triu_indices(len(have)))
        fits = low + high < len(left)
        low, total = low[fits], (low + high)[fits]
        order = np.lexsort((low, total))
        self.low = low[order].tolist()
        sums, first = np.unique(total[order], return_index=True)
        self.pairs = {t: [s, e] for t, s, e in zip(sums.tolist(), first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True)}
        self.largest = have[::-1].tolist()
        self.triples: dict[int, int] = {}

    def _enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def _pair(self, total: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths with that sum, beside those that are used."""
        span = self.pairs.get(total)
        if span is None:
            return None
        while span[0] < span[1] and not self._enough((total - self.low[span[0]], self.low[span[0]])):
            span[0] += 1
        for k in range(*span):
            pair = (total - self.low[k], self.low[k])
            if self._enough((*used, *pair)):
                return pair
        return None

    def _triple(self, total: int, used: tuple[int, ...]) -> tuple[int, int, int] | None:
        passed = True
        for k in range(self.triples.get(total, 0), len(self.largest)):
            x = self.largest[k]
            # Out for good: too long, used up, or no pair to go with it.
            out = x > total - 2 or not self.left[x] or self._pair(total - x, (x,)) is None
            if not out:
                passed = False
                if pair := self._pair(total - x, (*used, x)):
                    return (x, *pair)
            elif passed:
                self.triples[total] = k + 1
        return None

    def fill(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """Available lengths that fill the gap exactly, beside those used: one, or else two, or else three."""
        if self._enough((*used, gap)):
            return (gap,)
        return self._pair(gap, used) or self._triple(gap, used)


class Plan:
    """Where the r-th piece of each length goes. ``slots[length]``: (first rank, first sequence, offset), by rank."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.slots: dict[int, list[tuple[int, int, int]]] = {}
        self.left = [counts.get(length, 0) for length in range(capacity + 1)]
        self._used = [0] * (capacity + 1)
        self._open: dict[int, list[tuple[int, int]]] = {}  # gap: [(first sequence, how many)]
        self._exact()
        self._best_fit()

    def _take(self, length: int, n: int, first: int, offset: int) -> None:
        self.slots.setdefault(length, []).append((self._used[length], first, offset))
        self._used[length] += n
        self.left[length] -= n

    def _exact(self) -> None:
        sums = Sums(self.left)
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                gap = self.capacity - length
                filled = sums.fill(gap, (length,)) if gap else ()
                if filled is None:
                    break
                lengths = sorted((length, *filled), reverse=True)
                n = min(self.left[x] // lengths.count(x) for x in lengths)
                offset = 0
                for x in lengths:
                    self._take(x, n, self.sequences, offset)
                    offset += x
                self.sequences += n

    def _best_fit(self) -> None:
        gaps: list[int] = []
        for length in range(self.capacity, 0, -1):
            while (n := self.left[length]) > 0:
                if (k := bisect_left(gaps, length)) < len(gaps):  # the smallest gap that holds it
                    gap = gaps[k]
                    first, many = self._open[gap].pop()
                    n = min(n, many)
                    if many > n:
                        self._open[gap].append((first + n, many - n))
                    elif not self._open[gap]:
                        del gaps[k], self._open[gap]
                else:  # as many to a new sequence as it takes
                    gap = self.capacity
                    each = min(gap // length, n)
                    many = n // each
                    first = self.sequences
                    self.sequences += many
                    for i in range(each):
                        self._take(length, many, first, i * length)
                    self._leave(gaps, gap - each * length, first, many)
                    continue
                self._take(length, n, first, self.capacity - gap)
                self._leave(gaps, gap - length, first, n)

    def _leave(self, gaps: list[int], gap: int, first: int, n: int) -> None:
        if gap > 0:
            if gap not in self._open:
                insort(gaps, gap)
            self._open.setdefault(gap, []).append((first, n))

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in self.slots.items()}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset``; repeated rows are packed as often as they come.

    Null and empty texts are their separator alone; texts of any length are encoded whole and only longer ones are cut.
    Pieces of the same length are alike to the plan: which of them goes where follows from their ids. An empty table
    gives no pieces; extra columns play no part, whatever their names. Sequences are at most ``capacity`` long and
    their offsets have no gaps.
    """
    spark = prepare(docs.sparkSession)
    cut = pieces(docs, path, id_col, text_col, capacity).checkpoint()
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity).tables()
    spread = max(8, partitions(spark), sum(counts.values()) // 100_000)
    each = ranked(cut, ["length"], ["id", "piece", "ids_crc32"], F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(spread)))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                ranks, first, at = plan[int(x)]
                k = np.searchsorted(ranks, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = first[k] + rank[rows] - ranks[k], at[k]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_col]
    return each.mapInArrow(place, fields(f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
