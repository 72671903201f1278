"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text becomes a lattice: every vocabulary piece that matches at a position is an edge with a weight that falls with its
rank. Forward filtering sums, for each position, the weights of all ways to reach it; backward sampling then draws
edges from the end to the start in proportion, so a segmentation comes up with exactly its share of the total weight.
Draws come from a counter-based generator keyed by the row's key, so the same row always gets the same segmentation,
on any executor and in any order.

The lattice falls apart between units, which are runs of letters or of other characters with the space marks before
them; where a piece of the vocabulary can cross the border of two, they are one unit, so every piece takes part.
Each distinct unit has a small lattice of its own, filtered once
and remembered, and backward sampling runs for all units of a text at once. Characters without a piece, and literal
space marks in the text, are spelled in the vocabulary's byte pieces. Nothing is normalised and no space is added, so
decoding gives back the text byte for byte.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import WORDS, Rolling, fields, mixed, pick, prepare

MARK = "▁"
#: Units whose lattices a worker remembers, of eight characters each on average; a full memory is begun anew.
REMEMBERED = 400_000
OTHER = 0x110000
#: A unit of letters or of other characters.
UNIT = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*(?:[^\w{MARK}]|[\d_])+|{MARK}+")


class Grown:
    """An array that grows at its end; ``a`` has room to spare."""

    def __init__(self, kind):
        self.a, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            more = np.zeros(max(self.n + len(x), 2 * len(self.a)), self.a.dtype)
            more[: self.n] = self.a[: self.n]
            self.a = more
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


class Lattices:
    """Filtered lattices of units, laid out so that the last edges of many units are drawn at once.

    Every (unit, end position) is a state; ``first`` says where its edges begin, ``cum`` holds their running shares,
    ``back`` the states they come from and ``piece`` their pieces (-1 - code point for one spelled in bytes).
    """

    def __init__(self, model_path: str, temperature: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = [p.replace(MARK, " ").encode() for p in pieces]
        self.byte = np.full(256, -1, np.int64)
        plain = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                value = int(p[3:-1], 16)
                self.byte[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
        if (self.byte < 0).any():
            raise ValueError("lossless encoding needs a vocabulary with byte pieces")
        #: Pairs of characters at which a piece crosses the border of two units.
        self.crossed = {a[-1] + b[0] for i in plain for own in [UNIT.findall(pieces[i])] for a, b in zip(own, own[1:], strict=False)}
        # Scores of byte-pair vocabularies are ranks, so ranks serve as weights: rank ** (-1 / temperature).
        plain.sort(key=lambda i: (-model.get_score(i), i))
        size = np.array([len(pieces[i]) for i in plain])
        end = np.cumsum(size)
        hashes = Rolling(_codes("".join(pieces[i] for i in plain)), WORDS).of(end - size, end)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain)[order]
        self.weights = ((np.arange(len(plain)) + 1.0) ** (-1.0 / temperature))[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.longest = int(size.max())
        self.spelled = (n + 1.0) ** (-2.0 / temperature)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str | None, int] = {}
        # 32 bits each: the shares of edges then differ from the exact ones by 1e-7 at most.
        self.base, self.size, self.first, self.back, self.piece = (Grown(np.int32) for _ in range(5))
        self.cum = Grown(np.float32)

    def learn(self, units: set[str | None]) -> None:
        """Filter the lattices of units that are not known yet. None stands for a literal space mark."""
        new = [u for u in units if u not in self.known]
        if not new:
            return
        if len(self.known) > REMEMBERED or self.first.n > 8 * REMEMBERED:
            self._clear()
            new = list(units)
        # States stand where characters do, after one slot for each unit's start.
        size = np.array([1 if u is None else len(u) for u in new])
        base = np.cumsum(size + 1) - size - 1
        codes = _codes("".join(["\0" + (MARK if u is None else u) for u in new]))
        codes[[b + 1 for b, u in zip(base.tolist(), new, strict=True) if u is None]] += OTHER
        codes[base] = 2 * OTHER
        depth = np.arange(len(codes)) - np.repeat(base, size + 1)
        rolling = Rolling(codes, WORDS)
        state, length, piece, weight = [], [], [], []
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(depth >= n)
            if not len(at):
                break
            h = rolling.of(at + 1 - n, at + 1)
            some = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[some], h[some]
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[k] == h
            at, k = at[hit], k[hit]
            state.append(at)
            length.append(np.full(len(at), n))
            piece.append(self.ids[k])
            weight.append(self.weights[k])
            if n == 1:  # what has no piece is spelled, so every state is reached
                bare = depth > 0
                bare[at] = False
                at = np.flatnonzero(bare)
                state.append(at)
                length.append(np.ones(len(at), np.int64))
                piece.append(-1 - (codes[at].astype(np.int64) % OTHER))
                weight.append(np.full(len(at), self.spelled))
        state, length, piece, weight = map(np.concatenate, (state, length, piece, weight))
        order = np.lexsort((length, state, depth[state]))
        state, length, piece, weight = state[order], length[order], piece[order], weight[order]
        back, cum = state - length, np.empty(len(state))
        total = np.zeros(len(codes))
        total[base] = 1.0
        first = np.zeros(len(codes), np.int64)
        cuts = np.searchsorted(depth[state], np.arange(1, int(size.max()) + 2))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if s == e:
                continue
            own, w = state[s:e], total[back[s:e]] * weight[s:e]
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            sums, at = np.add.reduceat(w, begin), own[begin]
            many = np.diff(np.append(begin, e - s))
            running = np.cumsum(w / np.repeat(sums, many))
            cum[s:e] = running - np.repeat(running[begin] - w[begin] / sums, many)
            cum[s + begin + many - 1] = 2.0  # the last edge takes what rounding leaves
            total[at], first[at] = sums, s + begin
            for x in at[sums < 1e-120]:  # only ratios within a unit count
                total[x - min(int(depth[x]), self.longest) : x + 1] *= 1e120
        states, edges = self.first.n, self.cum.n
        self.known.update(zip(new, range(self.base.n, self.base.n + len(new)), strict=True))
        for own, values in ((self.base, base + states), (self.size, size), (self.first, first + edges), (self.cum, cum), (self.piece, piece), (self.back, back + states)):
            own.add(values)

    def sample(self, rows: list[list[str | None]], keys: list[int]) -> list[np.ndarray]:
        """For each row of known units the ids of one sampled segmentation. A row's draws depend on its key alone."""
        many = np.array([len(r) for r in rows])
        known = self.known
        at = np.array([known[u] for r in rows for u in r], np.int64)
        number = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        key = mixed(np.repeat(np.array(keys, np.uint64), many) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first, cum, back, piece = self.first.a, self.cum.a, self.back.a, self.piece.a
        start = self.base.a[at]
        state = start + self.size.a[at]
        active, drawn, step = np.arange(len(at)), [], 0
        while len(active):
            u = (mixed(key[active] + np.uint64(step * 0xD6E8FEB86659FD93 % 2**64)) >> np.uint64(11)) * 2.0**-53
            edge = first[state[active]]
            more = np.flatnonzero(u >= cum[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= cum[edge[more]]]
            drawn.append((active, piece[edge]))
            now = back[edge]
            state[active] = now
            active = active[now > start[active]]
            step += 1
        # Step s drew the s-th piece from the end of its unit.
        pieces = np.zeros(len(at), np.int64)
        for a, _ in drawn:
            pieces[a] += 1
        place = np.cumsum(pieces) - 1
        ids = np.empty(int(pieces.sum()), np.int64)
        for s, (a, p) in enumerate(drawn):
            ids[place[a] - s] = p
        ends = np.concatenate([[0], np.cumsum(pieces)])[np.cumsum(many)]
        out = []
        for own in np.split(ids, ends[:-1]) if len(rows) else []:
            if len(own) and own.min() < 0:
                spelled: list[int] = []
                for p in own.tolist():
                    spelled += [p] if p >= 0 else self.byte[list(chr(-1 - p).encode())].tolist()
                own = np.array(spelled)
            out.append(own)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


def units(text: str | None, crossed: set[str] | frozenset[str] = frozenset()) -> list[str | None]:
    """The units of a text, spaces as marks; None for each mark that the text itself holds. No unit ends between two
    characters that are a pair of ``crossed``."""
    out: list[str | None] = []
    for i, part in enumerate((text or "").split(MARK)):
        if i:
            out.append(None)
        part = part.replace(" ", MARK)
        own = UNIT.findall(part)
        if any(pair in part for pair in crossed):
            starts = [0, *(k for k in range(1, len(own)) if own[k - 1][-1] + own[k][0] not in crossed), len(own)]
            own = ["".join(own[s:e]) for s, e in zip(starts, starts[1:], strict=False)]
        out += own
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def lattices(path: str, temperature: float) -> Lattices:
    return common.own(("pieces", path, temperature), lambda: Lattices(path, temperature))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", temperature: float = 0.5, seed: int = 0, digest: bool = False) -> DataFrame:
    """id and ``ids`` of each row's sampled segmentation; with ``digest``, counts and checksums in place of the ids.

    ``temperature``: towards 0 the best-ranked pieces always win, larger values spread the draws. The generator's key is
    made of the seed and the id alone. Null and empty texts give no ids; rows with equal ids and texts give equal
    segmentations. With ``digest``: n_chars, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_crc32
    (of the decoded text's UTF-8) and lossless (whether decoding gave back the text).

    Texts of any length are segmented whole. Repeated rows each come back. An empty table gives no rows. Extra columns play
    no part, whatever their names.
    """
    prepare(docs.sparkSession)

    def run(batches):
        own = lattices(path, temperature)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = part.column("text").to_pylist()
                cut = [units(t, own.crossed) for t in texts]
                own.learn({u for c in cut for u in c})
                found = own.sample(cut, [k & (2**64 - 1) for k in part.column("key").to_pylist()])
                if not digest:
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tolist() for x in found], pa.list_(pa.int32()))], names=[id_col, "ids"])
                    continue
                back = [own.decode(x.tolist()) for x in found]
                raw = [(t or "").encode() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in back], pa.int64()), pa.array([x == y for x, y in zip(back, raw, strict=True)])],
                    names=[id_col, "n_chars", "n_pieces", "ids_crc32", "decoded_crc32", "lossless"],
                )

    kind = dict(docs.dtypes)[id_col]
    rows = pick(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64(F.lit(seed), F.col("id").cast("string")))
    more = "n_chars long, n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean" if digest else "ids array<int>"
    return rows.mapInArrow(run, fields(f"`{id_col}` {kind}, {more}"))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", temperature: float = 0.5) -> DataFrame:
    """id and the text that the ids spell; null ids give a null text."""
    prepare(encoded.sparkSession)

    def run(batches):
        own = lattices(path, temperature)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if x is None else own.decode(x).decode(errors="replace") for x in b.column("ids").to_pylist()], pa.string())], names=[id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return pick(encoded, id=id_col, ids=ids_col).mapInArrow(run, fields(f"`{id_col}` {kind}, text string"))
