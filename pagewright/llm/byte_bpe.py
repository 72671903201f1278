"""Byte-level BPE by a finite-state transducer that is determinised as texts ask for it, and streaming decoding.

Compiling. Of every token it is known which merge made it, so its right and left edge have a history: which token stood
at the edge from which rank on. Two tokens stay apart side by side exactly if at no time the two edges of that time make
a token of a rank that comes before the next merge on either side (at equal ranks the leftmost goes first). A sequence of
tokens is the result of the merges exactly if all neighbours in it stay apart, so the merges become a local rule, and
every prefix of a text has exactly one such sequence.

Running. The machine reads bytes. A hypothesis is the last token of the sequence of some prefix and the beginning of the
token that is being read (a node of a prefix tree over the vocabulary). A state is the set of hypotheses that are alive;
its moves are worked out when first needed and remembered. A move says which token ends at the byte in the sequence that
ends there, so a sequence is read off backwards from its end. A hypothesis dies where no token goes on, so all that are
alive began at most one longest token back: what their sequences have in common is settled, whatever follows, and is
emitted at the end of a match or after a window of bytes, so that the machine holds no more than a window.

Decoding is a machine as well. Its state is the bytes of an unfinished UTF-8 sequence (three at most); a token takes it
to the code points that are finished and the next state, so texts come out token by token and never half a character.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fields, own, pick, prepare

#: States of the machine, and matches of the pattern, that a worker remembers; a full memory is begun anew.
STATES, REMEMBERED = 120_000, 500_000
#: Matches of up to so many bytes are remembered, and run side by side, so many at a time; longer ones run alone.
SHORT, TOGETHER = 48, 2048
#: Bytes after which the machine emits what is settled; more than twice the longest token.
WINDOW = 1 << 12
NEVER = 1 << 62
NODE_BITS = 32
NODE = (1 << NODE_BITS) - 1
#: The code points of Unicode's property White_Space, for which ``\s`` stands in the pattern.
WHITE = r"\t\n\x0B\f\r \x85\xA0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """The local rule that the merges of a vocabulary come to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelt = {rank: token for token, rank in ranks.items()}
        # The tokens that stand at an edge one after another. A token's rank is also that of the merge that makes it.
        self.left: dict[int, tuple[int, ...]] = {}
        self.right: dict[int, tuple[int, ...]] = {}
        self._apart: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if len(token) == 1:
                self.left[rank] = self.right[rank] = (rank,)
                continue
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a in self.right and b in self.left and self._first_merge(a, b) == (rank, True):
                    self.left[rank], self.right[rank] = (*self.left[a], rank), (*self.right[b], rank)
                    break
        # A token that no merges lead to (none in published vocabularies) stays out, as its letters never come to it.

    def _first_merge(self, a: int, b: int) -> tuple[int | None, bool]:
        """The first merge across the border of two tokens, and whether both were whole by then."""
        x, y, i, j = self.right[a], self.left[b], 0, 0
        while True:
            rank = self.ranks.get(self.spelt[x[i]] + self.spelt[y[j]], NEVER)
            next_x = x[i + 1] if i + 1 < len(x) else NEVER
            next_y = y[j + 1] if j + 1 < len(y) else NEVER
            if rank < next_x and rank <= next_y and rank != NEVER:
                return rank, next_x == next_y == NEVER
            if next_x == next_y == NEVER:
                return None, True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > 2 * STATES:
                self._apart.clear()
            self._apart[key] = found = self._first_merge(a, b)[0] is None
        return found


class Transducer:
    """Bytes of one match of the pattern in, ids as little-endian unsigned 32-bit numbers out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.child: dict[int, int] = {}  # node << 8 | byte: node
        self.token, self.depth = [-1], [0]  # of each node of the prefix tree: the token it spells, how many bytes it has
        inner = {0}
        for token, rank in ranks.items():
            if rank not in self.merges.left:
                continue
            node = 0
            for byte in token:
                inner.add(node)
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]
            self.token[node] = rank
        self.inner = [node in inner for node in range(len(self.token))]
        self.length = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.lengths = self.length.tolist().__getitem__
        self.forget()

    def forget(self) -> None:
        """Only the start is left: one hypothesis, after no token, at the root of the prefix tree."""
        # A hypothesis is one number: 1 + the last token (0 if there is none) and the node.
        self.numbers: dict[tuple[int, ...], int] = {(0,): 0}
        self.states: list[tuple[int, ...]] = [(0,)]
        # Moves by state and byte, -1 where they aren't known yet; only bytes that have come up have a column.
        self.column, self.columns = np.full(256, -1, np.int16), 0
        self.next, self.ends = (np.full((1 << 10, 32), -1, np.int32) for _ in range(2))

    def _room(self) -> None:
        rows, columns = self.next.shape
        more = (2 * rows if len(self.states) >= rows else rows, columns + 32 if self.columns > columns else columns)
        if more != (rows, columns):
            for name in ("next", "ends"):
                grown = np.full(more, -1, np.int32)
                grown[:rows, :columns] = getattr(self, name)
                setattr(self, name, grown)

    def _columns(self, raw: np.ndarray) -> np.ndarray:
        """The columns of bytes."""
        for byte in np.flatnonzero((np.bincount(raw, minlength=256) > 0) & (self.column < 0)):
            self.column[byte], self.columns = self.columns, self.columns + 1
            self._room()
        return self.column[raw]

    def _move(self, number: int, byte: int) -> None:
        """Work out where a byte leads: the next state, and the token that ends here in the sequence that ends here."""
        alive, ended, child, tokens, inner = [], -1, self.child.get, self.token, self.inner
        for hypothesis in self.states[number]:
            node = child((hypothesis & NODE) << 8 | byte)
            if node is None:
                continue
            token, before = tokens[node], hypothesis >> NODE_BITS
            # One token at most ends here, as a prefix has one sequence.
            if ended < 0 <= token and (not before or self.merges.apart(before - 1, token)):
                ended = token
            if inner[node]:
                alive.append(before << NODE_BITS | node)
        if ended < 0:
            raise ValueError("the vocabulary does not spell every byte")
        alive.append((ended + 1) << NODE_BITS)
        state = tuple(alive)
        following = self.numbers.setdefault(state, len(self.states))
        if following == len(self.states):
            self.states.append(state)
            self._room()
        self.next[number, self.column[byte]], self.ends[number, self.column[byte]] = following, ended

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens before a place, last first."""
        found = []
        while at > 0:
            found.append(ends[at - 1])
            at -= self.lengths(ends[at - 1])
        return found

    def _settled(self, ends: list[int], state: int) -> list[int]:
        """The tokens that all hypotheses alive have in common."""
        ways = [self._back(ends, len(ends) - self.depth[x & NODE])[::-1] for x in self.states[state]]
        n = 0
        while all(n < len(w) and w[n] == ways[0][n] for w in ways):
            n += 1
        return ways[0][:n]

    def run(self, raw: bytes) -> bytes:
        """One match of any length."""
        if len(self.states) > STATES:
            self.forget()
        state, ends, out = 0, [], []
        for at in range(0, len(raw), WINDOW):
            if at:  # what is settled need not be held any longer
                settled = self._settled(ends, state)
                out += settled
                del ends[: sum(map(self.lengths, settled))]
            part = raw[at : at + WINDOW]
            for byte, column in zip(part, self._columns(np.frombuffer(part, np.uint8)).tolist(), strict=True):
                if self.next[state, column] < 0:
                    self._move(state, byte)
                ends.append(int(self.ends[state, column]))
                state = int(self.next[state, column])
        out += self._back(ends, len(ends))[::-1]
        return np.array(out, "<u4").tobytes()

    def run_side_by_side(self, raws: list[bytes]) -> list[bytes]:
        """Many short matches, not empty: all go on by a byte at each step, then all are read off backwards."""
        if len(self.states) > STATES:
            self.forget()
        raws_order = np.argsort([-len(r) for r in raws], kind="stable")
        size = np.array([len(r) for r in raws])[raws_order]
        flat = self._columns(np.frombuffer(b"".join([raws[k] for k in raws_order]), np.uint8))
        row, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        columns, ends = np.zeros((2, len(size), size[0]), np.int32)
        columns[row, np.arange(len(flat)) - first[row]] = flat
        bytes_of = np.argsort(self.column)[256 - self.columns :]
        state = np.zeros(len(size), np.int32)
        for k in range(size[0]):
            on = int(np.searchsorted(-size, -k))  # those longer than k
            at, column = state[:on], columns[:on, k]
            found = self.next[at, column]
            if len(unknown := np.flatnonzero(found < 0)):
                for key in np.unique(at[unknown].astype(np.int64) << 8 | bytes_of[column[unknown]]).tolist():
                    self._move(key >> 8, key & 255)
                found = self.next[at, column]
            ends[:on, k] = self.ends[at, column]
            state[:on] = found
        place, left, rows, tokens = size.copy(), np.arange(len(size)), [], []
        while len(left):
            token = ends[left, place[left] - 1]
            rows.append(left)
            tokens.append(token)
            place[left] -= self.length[token]
            left = left[place[left] > 0]
        rows, tokens = np.concatenate(rows), np.concatenate(tokens)
        order = np.lexsort((-np.arange(len(rows)), rows))
        ids = tokens[order].astype("<u4").tobytes()
        stop = 4 * np.cumsum(np.bincount(rows, minlength=len(size)))
        out: list[bytes] = [b""] * len(raws)
        for k, s, e in zip(raws_order.tolist(), [0, *stop.tolist()], stop.tolist(), strict=False):
            out[k] = ids[s:e]
        return out


class Encoder(dict):
    """ids of matches of the pattern, remembered; a text's ids are those of its matches."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.machine = Transducer(self.ranks)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.split(t or "") for t in texts]
        new = [(match, match.encode()) for match in set(chain.from_iterable(cut)) if match not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = [(match, match.encode()) for match in set(chain.from_iterable(cut))]
        short = []
        for match, raw in new:
            if (whole := self.ranks.get(raw)) is not None:
                self[match] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.append((match, raw))
            else:
                self[match] = self.machine.run(raw)
        for at in range(0, len(short), TOGETHER):
            matches, raws = zip(*short[at : at + TOGETHER], strict=True)
            self.update(zip(matches, self.machine.run_side_by_side(raws), strict=True))
        found = [b"".join(map(self.__getitem__, c)) for c in cut]
        for match, raw in new:
            if len(raw) > SHORT:
                del self[match]
        return found


#: How UTF-8 goes on after a first byte: how many bytes follow, and the range of the first of these.
_FOLLOW = {b: (0, 0, 0) for b in range(0x80)} | {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)}
_FOLLOW |= {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


def utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """One byte: the text that is finished by it, and the unfinished bytes. What can't go on is U+FFFD."""
    if held:
        more, low, high = _FOLLOW[held[0]]
        if len(held) > 1:
            low, high = 0x80, 0xBF
        if low <= byte <= high:
            held += bytes([byte])
            return (held.decode(), b"") if len(held) > more else ("", held)
        text, rest = utf8_step(b"", byte)
        return "\ufffd" + text, rest
    if byte not in _FOLLOW:
        return "\ufffd", b""
    return ("", bytes([byte])) if _FOLLOW[byte][0] else (chr(byte), b"")


class Decoder(dict):
    """Moves of the UTF-8 machine by whole tokens: (unfinished bytes, id) to (finished text, unfinished bytes)."""

    def __init__(self, path: str):
        self.spelt = {rank: token for token, rank in read_ranks(path).items()}
        # Between characters most tokens lead back there; their texts are looked up without the machine.
        self.whole = np.zeros(max(self.spelt, default=0) + 1, bool)
        self.text = [""] * len(self.whole)
        for i in self.spelt:
            self.text[i], held = self[b"", i]
            self.whole[i] = not held
        self.clear()

    def __missing__(self, key: tuple[bytes, int]) -> tuple[str, bytes]:
        held, text = key[0], ""
        for byte in self.spelt[key[1]]:
            more, held = utf8_step(held, byte)
            text += more
        self[key] = move = text, held
        return move

    def stream(self, ids: np.ndarray):
        """The text, bit by bit, as its ids come; bytes that are left unfinished at the end are U+FFFD."""
        if len(self) > STATES:
            self.clear()
        held, at, numbers = b"", 0, ids.tolist()
        for k in np.flatnonzero(~self.whole[ids]).tolist():
            if k < at:
                continue
            yield "".join(map(self.text.__getitem__, numbers[at:k]))
            at = k
            while at == k or held and at < len(numbers):
                text, held = self[held, numbers[at]]
                yield text
                at += 1
        yield "".join(map(self.text.__getitem__, numbers[at:]))
        if held:
            yield "\ufffd"

    def decode(self, ids) -> str:
        return "".join(self.stream(np.asarray(ids, np.int64)))


def _own(kind, *args):
    """The worker's own machine; what it remembers lasts from task to task."""
    return own(("byte_bpe", kind.__name__, *args), lambda: kind(*args))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, packed: bool = False, decoded: bool = False) -> DataFrame:
    """id and ``ids`` (array of int; with ``packed`` binary, little-endian unsigned 32-bit numbers) of each row's text.

    The result is that of merging each match of the pattern separately, without special tokens; a match that is a token
    as a whole is that token. Null and empty texts have no ids; texts of any length are read whole, and so are matches;
    ties between merges of one rank go to the leftmost; repeated rows each come back; an empty table gives an empty
    result. Ids of documents may be null or repeat. Extra columns play no part, whatever their names. With ``decoded``
    the ids are decoded again as they come, and their text is one more column.
    """
    import public_tokenizers

    prepare(docs.sparkSession)
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches):
        encoder, back = _own(Encoder, path, pattern), _own(Decoder, path) if decoded else None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = encoder.encode(part.column("text").to_pylist())
                if packed:
                    ids = pa.array(found, pa.binary())
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                columns = {id_col: part.column("id"), "ids": ids}
                if decoded:
                    columns["decoded"] = pa.array([back.decode(np.frombuffer(x, "<u4")) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = dict(docs.dtypes)[id_col]
    more = f"ids {'binary' if packed else 'array<int>'}" + (", decoded string" if decoded else "")
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, fields(f"`{id_col}` {kind}, {more}"))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """id, ids and the text that they spell; ids as ``encode`` gives them, in either form.

    Null ids give a null text, no ids an empty one. Bytes that are no UTF-8, as where a sequence of ids was cut inside a
    character, come out as U+FFFD, one for each longest beginning of a character. An id outside the vocabulary fails.
    Repeated rows each come back; an empty table gives an empty result; extra columns play no part.
    """
    prepare(encoded.sparkSession)
    kinds = dict(encoded.dtypes)
    packed = kinds[ids_col] == "binary"

    def run(batches):
        decoder = _own(Decoder, path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part.column("ids").to_pylist()
                texts = [None if x is None else decoder.decode(np.frombuffer(x, "<u4") if packed else x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(texts, pa.string())], names=[id_col, ids_col, text_col])

    return pick(encoded, id=id_col, ids=ids_col).mapInArrow(run, fields(f"`{id_col}` {kinds[id_col]}, `{ids_col}` {kinds[ids_col]}, `{text_col}` string"))
