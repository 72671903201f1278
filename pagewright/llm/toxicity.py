"""Toxicity by weak supervision.

1. Candidate voters are mined from labelled training rows: whole words (lexicon voters), and word beginnings of four and
   six letters that occur once or at least twice (pattern voters), by how much more often toxic texts hold them. Two
   more patterns vote for "clean": no lexicon voter and no pattern voter fires.
2. A generative label model takes each voter's vote as drawn given the hidden class. Expectation maximisation, begun at
   the labels' rates, estimates how often each voter votes in each class; the correlation of every two voters
   within the classes (given the posterior) divides the weight of voters that only repeat one another.
3. A linear classifier (logistic, on presence of the mined words and beginnings and the number of different ones) is
   trained on the posterior labels, and scores every whole text.

Fitting uses a bounded sample of labelled rows (``max_rows``); only votes travel to the driver. Scores depend on the
text alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, pick, prepare, release

MAX_ROWS = 24_000
SURE = 16.0
#: A voter occurs so many times as often among toxic texts as among clean ones. How sure a difference is grows with the
#: rows, so that alone would let in any common word whose rates differ by a little.
LIFT = 3.0
#: The best so many grams are voters also below SURE, for labels that are too few for any to be that sure.
FEW = 40
#: Values of votes that are made floating-point at once.
BLOCK = 1 << 22
STEMS = (4, 6)
_WORD = re.compile(r"[^\W\d_]+")


def stems(words: dict[str, int]) -> dict[str, int]:
    """How often each beginning of words occurs."""
    found: dict[str, int] = {}
    for w, n in words.items():
        for k in STEMS:
            if len(w) >= k:
                found[w[:k]] = found.get(w[:k], 0) + n
    return found


def grams(text: str | None) -> set[str]:
    """Words (``w:``), word beginnings (``s:``) and beginnings that occur twice or more (``d:``), lower-cased."""
    words = Counter(_WORD.findall((text or "").lower()))
    found = {f"w:{w}" for w in words}
    for s, n in stems(words).items():
        found.add(f"s:{s}")
        if n > 1:
            found.add(f"d:{s}")
    return found


def _either(starts: list[str], depth: int = 4) -> str:
    """A pattern for any of the beginnings, by their first letters, so that a word meets few of them."""
    if "" in starts or not depth:
        return "" if "" in starts else f"(?:{'|'.join(map(re.escape, starts))})"
    by: dict[str, list[str]] = {}
    for v in starts:
        by.setdefault(v[0], []).append(v[1:])
    return f"(?:{'|'.join(re.escape(c) + _either(rest, depth - 1) for c, rest in by.items())})"


class Matcher:
    """Which voters fire in a text."""

    def __init__(self, voters: list[str]):
        self.at = {v: i for i, v in enumerate(voters)}
        starts = sorted({v[2:] for v in voters})
        # Finds the few words that matter; what fires is then looked up exactly.
        self.pattern = re.compile(rf"(?<![^\W\d_]){_either(starts)}[^\W\d_]*") if starts else None

    def fired(self, text: str | None) -> list[int]:
        if not text or self.pattern is None:
            return []
        words = Counter(self.pattern.findall(text.lower()))
        found = {self.at.get(f"w:{w}") for w in words}
        for s, n in stems(words).items():
            found.add(self.at.get(f"s:{s}"))
            if n > 1:
                found.add(self.at.get(f"d:{s}"))
        return sorted(found - {None})


def _parts(x: np.ndarray) -> list[slice]:
    """Row blocks of about BLOCK values, so that many voters don't need all votes as floating-point numbers."""
    step = max(1, BLOCK // max(x.shape[1], 1))
    return [slice(s, s + step) for s in range(0, len(x), step)]


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w"""
    return np.concatenate([np.zeros((0, *w.shape[1:]), np.float32), *[x[s].astype(np.float32, copy=False) @ w for s in _parts(x)]])


def _back(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x.T @ r"""
    return sum((x[s].T.astype(np.float32, copy=False) @ r[s] for s in _parts(x)), np.zeros((x.shape[1], *r.shape[1:]), np.float32))


def label_model(votes: np.ndarray, counts: np.ndarray, rows: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class a row, vote rates (2, voters), and each voter's weight against its correlates.

    ``counts`` and ``rows``: votes and rows by labelled class. They anchor the rates, as much as all rows together do,
    so that the hidden classes stay the ones asked for.
    """
    v = votes
    n = len(v)
    # How often two voters fire together; with it a round's cost doesn't grow with the rows times the pairs of voters.
    both = sum(((c := v[s].astype(np.float32)).T @ c for s in _parts(v)), np.zeros((v.shape[1], v.shape[1]), np.float32))
    anchor = (counts + 0.5) / (rows[:, None] + 1.0)
    prior = float(np.clip(rows[1] / max(rows.sum(), 1), 1e-3, 1 - 1e-3))
    rate, post, weight = anchor, np.full(n, prior, np.float32), np.ones(v.shape[1], np.float32)
    for _ in range(rounds):
        # A voter that does not fire abstains; that nothing fires is what the two clean voters are for.
        odds = np.log(rate[1] / rate[0]) * weight
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + _times(v, odds.astype(np.float32)), -30, 30)))
        moved, post = float(np.abs(new - post).max(initial=0)), new.astype(np.float32)
        parts = np.stack([1 - post, post], axis=1)
        voted = _back(v, parts).astype(np.float64)
        own = (voted.T + 0.5) / (parts.sum(axis=0)[:, None] + 1.0)
        rate = np.clip(0.5 * anchor + 0.5 * own, 1e-6, 1 - 1e-6)
        # Correlation within the classes: what the voters still share once the class is known.
        inner = parts.astype(np.float64).T @ parts
        # The covariance of v - parts @ own, some voters at a time.
        cov = lambda s: (both[s] - voted[s] @ own - own[:, s].T @ voted.T + own[:, s].T @ inner @ own) / max(n, 1)
        scale = np.sqrt(np.clip((np.diag(both) - 2 * (voted * own.T).sum(axis=1) + (own * (inner @ own)).sum(axis=0)) / max(n, 1), 1e-9, None))
        for s in _parts(both):
            linked = np.clip(np.abs(cov(s) / np.outer(scale[s], scale)), 0, 1)
            linked[np.arange(len(linked)), np.arange(len(linked)) + s.start] = 1
            weight[s] = 1 / np.where(linked > 0.5, linked, 0).sum(axis=1)
        if moved < 1e-4:
            break
    return post, rate, weight


def logistic(x: np.ndarray, more: np.ndarray, target: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) fitted to soft labels by accelerated gradient descent; classes weigh the same.

    ``x``: what fires, 0 or 1; ``more``: further columns.
    """
    width = x.shape[1]
    x = x.astype(np.float32) if x.size <= 4 * BLOCK else x
    more = np.hstack([more, np.ones((len(x), 1))]).astype(np.float32)
    share = np.where(target > 0.5, 0.5 / max(target.sum(), 1e-6), 0.5 / max((1 - target).sum(), 1e-6)).astype(np.float32)
    w, last = np.zeros(width + more.shape[1], np.float32), np.zeros(width + more.shape[1], np.float32)
    step = 4.0 / max(float((share * (x.sum(axis=1, dtype=np.float32) + (more * more).sum(axis=1))).sum()), 1e-6)
    for k in range(rounds):
        ahead = w + np.float32(k / (k + 3)) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(_times(x, ahead[:width]) + more @ ahead[width:], -30, 30)))
        off = (share * (p - target)).astype(np.float32)
        slope = np.concatenate([_back(x, off), more.T @ off]) + np.float32(l2) * ahead
        last, w = w, ahead - np.float32(step) * slope
    return w


class Model:
    def __init__(self, voters: list[str], weights: np.ndarray | None):
        self.matcher, self.weights = Matcher(voters), weights

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        fired = self.matcher.fired(text)
        total = float(self.weights[fired].sum() + self.weights[-2] * np.log1p(len(fired)) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, train: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learn from rows where ``train`` holds and the label is 0 or 1.

    Of ids with several labels the largest counts; null ids and labels teach nothing. Copies of a text count once, whatever
    their ids. Texts of any length are read whole. Without labels of both kinds, as on empty tables, the model scores
    every text 0. Extra columns play no part.
    """
    spark = prepare(docs.sparkSession)
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = docs.filter(train).select(F.col(f"`{id_col}`").alias("id"))
    labelled = ids.join(marks, "id").distinct()
    n = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(n) != {0, 1}:
        return Model([], None)
    draw = F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1_000_000))
    part = {y: min(1.0, max_rows / 2 / n[y]) for y in n}
    drawn = labelled.filter(F.when(F.col("y") == 1, draw < int(part[1] * 1_000_000) + 1).otherwise(draw < int(part[0] * 1_000_000) + 1))
    # About max_rows ids by the counts above, so they may go to every executor; the texts stay where they are.
    rows = docs.filter(train).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(drawn), "id").select("y", "text")
    # Copies would lend weight to whatever words their text has.
    rows = rows.dropDuplicates(["y", "text"]).checkpoint()

    def mine(batches):
        release()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                seen: dict[str, list[int]] = {}
                for y, t in zip(b.column("y").slice(at, 500).to_pylist(), b.column("text").slice(at, 500).to_pylist(), strict=True):
                    for g in grams(t):
                        seen.setdefault(g, [0, 0])[y] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["g", "n0", "n1"])

    total = {0: 0, 1: 0} | {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total[0] or not total[1]:
        return Model([], None)
    counts = rows.mapInArrow(mine, fields("g string, n0 long, n1 long")).groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # How sure it is that toxic texts hold the gram more often: rows times the divergence of its own rate of toxic texts
    # from the overall one. SURE is past what chance gives the best of millions of grams.
    n1, all_, base = F.col("n1"), F.col("n0") + F.col("n1"), total[1] / (total[0] + total[1])
    p = (n1 + 0.01) / (all_ + 0.02)
    sure = all_ * (p * F.log(p / base) + (1 - p) * F.log((1 - p) / (1 - base)))
    lift = (n1 + 0.5) / (total[1] + 1) / ((F.col("n0") + 0.5) / (total[0] + 1))
    found = counts.filter(n1 >= 2).withColumn("sure", sure).filter((p > base) & (lift >= LIFT) & (F.col("sure") > 2)).checkpoint()
    # Every such gram past the bound, and the FEW best of them in any case.
    best = {r["g"]: r["sure"] for part in (found.filter(F.col("sure") > SURE), found.orderBy(F.desc("sure"), "g").limit(FEW)) for r in part.select("g", "sure").collect()}
    if not best:
        return Model([], None)
    voters = sorted(best, key=lambda g: (-best[g], g))
    matcher = Matcher(voters)

    def vote(batches):
        for b in batches:
            found = [np.array(matcher.fired(t), "<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(found, pa.binary())], names=["y", "fired"])

    # Bounded for certain, in an order, so that the same rows count each time.
    sample = rows.mapInArrow(vote, fields("y int, fired binary")).orderBy(F.xxhash64("fired"), "fired", "y").limit(2 * max_rows).collect()
    sample.sort(key=lambda r: (r["y"], r["fired"]))
    fires = np.zeros((len(sample), len(voters)), np.uint8)
    for i, r in enumerate(sample):
        fires[i, np.frombuffer(r["fired"], "<u4")] = 1
    lexicon = np.array([v[0] == "w" for v in voters])
    quiet = np.stack([~fires[:, lexicon].any(axis=1), ~fires[:, ~lexicon].any(axis=1)], axis=1).astype(np.uint8)
    votes = np.hstack([fires, quiet])
    y = np.array([r["y"] for r in sample])
    counts1 = np.stack([votes[y == k].sum(axis=0) for k in (0, 1)])
    post, _, _ = label_model(votes, counts1, np.array([(y == 0).sum(), (y == 1).sum()]))
    return Model(voters, logistic(fires, np.log1p(fires.sum(axis=1, keepdims=True)), post))


def scored(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and score of each row; null and empty texts get the score of a text in which no voter fires.

    Texts of any length are read whole. Equal texts score equal, so repeated rows and ties do too; each row comes back. An
    empty table gives no rows. Extra columns play no part, whatever their names.
    """
    prepare(docs.sparkSession)

    def run(batches):
        release()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([model.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=[id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, fields(f"`{id_col}` {kind}, score double"))


def harmless(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, all columns, that score below the threshold."""
    at = docs.columns.index(text_col)
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
