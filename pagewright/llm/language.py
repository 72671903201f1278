"""Language identification by hierarchical discrimination.

A linear machine first predicts the language family; within it, one-versus-one linear support vector machines separate
the closely related languages. Features are hashed counts of byte 1- to 4-grams of the whole lower-cased text, letters
only, words kept apart by one space; roots of the counts, scaled to length one.

The machines are fitted on the driver on a bounded sample of labelled rows (``max_rows`` in all, evenly over languages,
drawn by a hash); only their sparse features travel there. Prediction reads whole texts, batch by batch, with the
weights (one vector a machine) in the task's closure.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, pick, prepare, release

DIM_BITS = 12
MAX_ROWS = 4000
UNKNOWN = "und"
#: Least score of a language that counts as told: the machines of both steps hold together more likely than not.
LEAST = 0.5
#: ISO 639-1 codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn ur pa mr gu ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv mg",
    "dravidian": "ta te kn ml",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[\W\d_]+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
#: Bytes hashed at a time, so that a very long text needs no more memory than this.
_PART = 1 << 20


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().partition("-")[0], lang)


def features(text: str | None) -> np.ndarray:
    """Unit vector of a text; zeros if it has no letter."""
    dim = 1 << DIM_BITS
    counts = np.zeros(dim, np.int64)
    raw = np.frombuffer(f" {_GAP.sub(' ', (text or '').lower()).strip()} ".encode(), np.uint8)
    for at in range(0, len(raw), _PART):
        a = raw[at : at + _PART + 3].astype(np.uint64)
        h = np.zeros(len(a), np.uint64)
        for n in range(1, min(4, len(a)) + 1):
            h = (h[:-1] if n > 1 else h) * _ODD[1] + (a[n - 1 :] + np.uint64(n)) * _ODD[0]
            own = h[:_PART]
            counts += np.bincount((((own ^ (own >> np.uint64(29))) * _ODD[2]) >> np.uint64(64 - DIM_BITS)).astype(np.int64), minlength=dim)
    x = np.sqrt(counts).astype(np.float32)
    return x / max(np.linalg.norm(x), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for y in {-1, 1}: dual coordinate descent on the squared hinge."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    w, bias, alpha = np.zeros(d, np.float32), 0.0, np.zeros(n)
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * n / 2
    soft = 0.5 / (cost * share)
    norm = (x * x).sum(axis=1) + 1.0
    for _ in range(rounds):
        for i in rng.permutation(n):
            slope = y[i] * (float(x[i] @ w) + bias) - 1 + soft[i] * alpha[i]
            new = max(alpha[i] - slope / (norm[i] + soft[i]), 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                alpha[i] = new
    return w, bias


class Model:
    """``top`` has one machine a family, ``pairs`` one for each two languages of a family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        kinds = np.array([family(v) for v in langs])
        self.families = {f: sorted(set(langs[kinds == f])) for f in sorted(set(kinds))}
        names = list(self.families)
        tops = [svm(x, np.where(kinds == f, 1, -1)) for f in names] if len(names) > 1 else [(np.zeros(x.shape[1], np.float32), 0.0)] * len(names)
        self.pairs = [(a, b) for own in self.families.values() for a, b in combinations(own, 2)]
        machines = []
        for a, b in self.pairs:
            rows = (langs == a) | (langs == b)
            machines.append(svm(x[rows], np.where(langs[rows] == a, 1, -1)))
        self.weights = np.array([w for w, _ in tops + machines], np.float32)
        self.biases = np.array([b for _, b in tops + machines], np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language, and how sure both steps are of it (0 to 1)."""
        margin = self.weights @ x + self.biases
        sure = 1 / (1 + np.exp(-3.0 * margin))
        names = list(self.families)
        top = int(margin[: len(names)].argmax())
        score = float(sure[top] / max(sure[: len(names)].sum(), 1e-9)) if len(names) > 1 else 1.0
        own = self.families[names[top]]
        votes, least = dict.fromkeys(own, 0.0), dict.fromkeys(own, 1.0)
        for k, (a, b) in enumerate(self.pairs, len(names)):
            if a in votes:
                p = float(sure[k])
                for lang, q in ((a, p), (b, 1 - p)):
                    votes[lang] += (q > 0.5) + q / 1000
                    least[lang] = min(least[lang], q)
        best = max(own, key=lambda v: (votes[v], v))
        return best, score * least[best]


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model | None:
    """The model, learned from rows where ``train`` holds, language is not null and the text has a letter.

    A language with fewer rows than its share of ``max_rows`` gives all of them. None if there is no such row (an empty
    table included). Should the draw run high, the rows with the smallest draws count.
    """
    rows = docs.filter(train).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(F.col(f"`{id_col}`"), F.lit("sample")).alias("draw")).filter("lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = max(1, max_rows // len(counts))
    keep = F.lit(False)
    for lang, n in counts.items():
        part = min(1.0, 1.2 * share / n + 10 / n)
        keep = keep | ((F.col("lang") == lang) & (F.pmod("draw", F.lit(1_000_000)) < int(part * 1_000_000) + 1))

    def run(batches):
        release()
        for b in batches:
            out = []
            for text, lang, draw in zip(*[b.column(c).to_pylist() for c in ("text", "lang", "draw")], strict=True):
                if text and _LETTER.search(text):
                    x = features(text)
                    at = np.flatnonzero(x)
                    out.append((draw, lang, at.astype("<u2").tobytes(), x[at].astype("<f2").tobytes()))
            kinds = {"draw": pa.int64(), "lang": pa.string(), "at": pa.binary(), "x": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    # Bounded for certain, also where the draw runs high or ids repeat; in an order, so that the same rows count each time.
    drawn = rows.filter(keep).select("draw", "text", "lang").mapInArrow(run, fields("draw long, lang string, at binary, x binary"))
    found = drawn.orderBy(F.pmod("draw", F.lit(1_000_000)), "lang", "at", "x").limit(2 * max_rows + 20 * len(counts)).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["at"], r["x"]))
    x = np.zeros((len(found), 1 << DIM_BITS), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], "<f2")
    return Model(x, np.array([r["lang"] for r in found]))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred, score for each row.

    ``und`` with score 0 where the text is null or without a letter, or where no model could be fitted. Long texts count
    whole, a part at a time. Machines that are level go to the language that comes first by name among families and
    last among votes. Repeated rows each come back; an empty table gives no rows; extra columns play no part.
    """
    prepare(docs.sparkSession)

    def run(batches):
        release()
        for b in batches:
            lang, score = [], []
            for t in b.column("text").to_pylist():
                best = (UNKNOWN, 0.0) if model is None or not t or not _LETTER.search(t) else model.predict(features(t))
                lang.append(best[0])
                score.append(best[1])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, fields(f"`{id_col}` {kind}, lang_pred string, score double"))


def known(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", wanted: tuple[str, ...] | None = None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted language is a wanted one and surely enough told.

    A row goes if its text is null or has no letter, if the prediction's score is below ``least`` (texts in a language
    or script that was not learned, texts of two languages in about equal parts, letters without words, and texts of a
    few letters), or if the language is none of ``wanted`` (None: all that were learned). Where nothing could be learned
    no language can be told, so then only the letter decides. Long texts count whole; repeated rows share one fate, so
    there are no ties; an empty table gives no rows; other columns come back as they are, whatever their names.
    """
    prepare(docs.sparkSession)
    model = fit(docs, train, text_col, lang_col, id_col)
    schema, at = docs.schema, docs.columns.index(text_col)

    def stays(text: str | None) -> bool:
        if not text or not _LETTER.search(text):
            return False
        if model is None:
            return True
        lang, score = model.predict(features(text))
        return score >= least and (wanted is None or lang in wanted)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([stays(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
