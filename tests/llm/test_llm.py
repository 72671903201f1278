"""The training-data operators against brute force, round trips and held-out rows, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import language, licenses, merkle, packing, pieces, queries, sharding, simhash, substrings, topk, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(name):
    return queries._vocabulary(name)


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


CLASHING = ["fp", "row", "id", "k1", "k2", "size", "bucket", "node", "shard", "spans", "own", "w", "key", "start", "length", "n_words", "component_id", "label", "draw"]
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
AWKWARD = [(1, "The quick brown fox jumps over the lazy dog"), (1, "The quick brown fox jumps over the lazy dog"), (None, "no id here at all"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (7, "x"), (8, "…—… 123 !!!"), (9, "Under the MIT License under the MIT License"), (-4, "ÀÉ ▁ \0 日本")]


@pytest.fixture(scope="module")
def awkward(spark):
    own = spark.createDataFrame([(i, t, "en" if i != 7 else None, None) for i, t in AWKWARD], "doc_id long, text string, lang string, source string")
    return own.selectExpr("*", *[f"'z' AS `{c}`" for c in CLASHING])


def results(spark, docs):
    """Every operator that takes documents, by name."""
    labels = spark.createDataFrame([(1, 0), (3, 1), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    every = F.lit(True)
    return {
        "toxicity": toxicity.scored(docs, toxicity.fit(docs, labels, every)),
        "licenses": licenses.scan(docs),
        "merkle": merkle.fingerprints(docs),
        "sharding": sharding.shard(docs, shards=4),
        "pieces": pieces.encode(docs, vocabulary("piece_bpe_32k.model"), digest=True),
        "language": language.predict(docs, language.fit(docs, every)),
        "packing": packing.pack(docs, vocabulary("word_bpe_49k.json")),
        "simhash": simhash.near_duplicates(docs),
        "substrings": substrings.remove_repeated(docs, digest=True),
    }


def test_awkward_rows(spark, awkward):
    found = {k: v.collect() for k, v in results(spark, awkward).items()}
    for name, own in found.items():
        assert Counter(r["doc_id"] for r in own if name != "packing" or r["piece"] == 0) == Counter(i for i, _ in AWKWARD), name
    assert {(r["doc_id"], r["lang_pred"]) for r in found["language"] if r["doc_id"] in (2, 3, 4, 8)} == {(i, "und") for i in (2, 3, 4, 8)}
    assert all(r["lossless"] for r in found["pieces"])
    assert {r["component_id"] for r in found["simhash"] if r["doc_id"] in (2, 3, 4)} == {2} and {r["component_id"] for r in found["simhash"] if r["doc_id"] in (5, 6)} == {5}
    assert {(r["doc_id"], r["n_removed"]) for r in found["substrings"] if r["n_removed"]} == {(5, 40_000), (6, 40_000)}
    assert {(r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in found["licenses"] if r["doc_id"] == 9} == {(2, 0, 4, "mit")}
    slots = defaultdict(list)
    for r in found["sharding"]:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in found["merkle"])
    assert all(0 <= r["score"] <= 1 for r in found["toxicity"])
    sequences = defaultdict(list)
    for r in found["packing"]:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    check_sequences(sequences)


def test_empty_table(spark, awkward):
    for name, own in results(spark, awkward.limit(0)).items():
        assert own.collect() == [], name
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 20 == 0).collect() == []


def test_keep_one_and_stages(spark, awkward):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, None, 2, 5, 7, 8, 9, -4])
    known = language.known(awkward, F.lit(True), least=0.0)
    assert known.columns == awkward.columns and {r["doc_id"] for r in known.collect()} == {1, None, 5, 6, 7, 9, -4}
    nothing = language.known(awkward, F.lit(False))
    assert {r["doc_id"] for r in nothing.collect()} == {1, None, 5, 6, 7, 9, -4}
    assert toxicity.harmless(awkward, toxicity.Model([], None)).count() == len(AWKWARD)


def test_keep_one_by_row(spark):
    a, b = "alpha beta gamma delta epsilon", "one two three four five six seven"
    table = lambda rows: spark.createDataFrame([(i, t, f"n{k}", f"o{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _id string, best string")
    ids = lambda rows: sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(table(rows)).collect())
    assert ids([(3, b), (5, a), (5, b)]) == [(3, b), (5, a)]
    assert ids([(5, a), (5, b), (5, a), (5, b)]) == [(5, a), (5, b)]
    assert [r["text"] for r in simhash.keep_one(table([(None, a), (None, a), (None, b), (2, a)])).orderBy("text").collect()] == [a, b]
    one = simhash.keep_one(table([(3, b)])).collect()[0]
    assert (one["_id"], one["best"]) == ("n0", "o0")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(table([(None, a), (None, b), (2, a)])).collect()}
    assert got == {(None, 2), (None, None), (2, 2)}


def test_many_near_copies_share_one_component(spark):
    codes = [0] + [1 << k for k in range(60)] + [(1 << k) | (1 << 63) for k in range(60)]
    each = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, 100 + k) for k, c in enumerate(codes)], "fp long, best long")
    simhash.prepare(spark)
    assert {r["best"] for r in simhash._named(each, 4, 1 << 14).collect()} == {100} and simhash._named(each, 4, 1 << 14).count() == len(codes)


#: The contract's phrases, word by word.
PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def brute_licenses(text):
    """Base phrases by looking at every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, v) for p, v in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in places}))


def test_licenses_base_phrases(spark):
    texts = ["MIT License", "under the MIT License", "the mit license under the mit license x", "under mit license", "Apache License, Version 2.0; CC-BY-NC cc by nc", "under the under the mit license"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [brute_licenses(t) for t in texts]
    assert [r["labels"] for r in got] == ["mit", "mit", "mit", "mit", "apache-2,cc-by-nc", "mit"]


def test_licenses_whole_texts_and_order(spark):
    isc = licenses.TEXTS["isc"]
    words = re.findall("[a-z0-9]+", isc.lower())
    less = " ".join(words[:20] + words[22:])
    mixed = " ".join(words[k + 1 - 2 * (k % 2)] for k in range(len(words) - len(words) % 2))
    back = " ".join(w for k in range(len(words) - 2, -1, -2) for w in words[k : k + 2])
    docs = [(1, isc), (2, less), (3, mixed), (4, back), *[(10 + k, t) for k, t in enumerate(licenses.TEXTS.values())]]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["isc", "isc", "", ""] and [got[10 + k] for k in range(len(licenses.TEXTS))] == list(licenses.TEXTS)
    assert all(2 <= t.count(" ") + 1 <= licenses.LONGEST + 1 for _, t, _, _ in licenses.templates())


def test_licenses(spark, rows):
    got = {r["doc_id"]: r for r in queries.op2_license_scan(spark, SF).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    more = spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3."), (2, "this work is now licensed under the gnu general public license version 3"), (3, "under the license")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(more).collect()}
    assert got[1]["labels"] == got[2]["labels"] == "gpl-3" and got[1]["score"] == 1.0 and got[3]["labels"] == ""
    assert [(s["label"], s["first_word"], s["last_word"]) for s in got[1]["spans"]] == [("gpl-3", 0, 11)]


def brute_likeness(x, y):
    """Shared bytes, section by section, then paragraph by paragraph, then leaf by leaf, from the texts themselves."""
    from pagewright.llm.common import word_hashes

    def nodes(text):
        sections, own = [], []
        lines = [line + "\n" for line in text.split("\n")]
        lines[-1] = lines[-1][:-1]
        for k, line in enumerate(lines):
            if own and (not own[-1].strip() or re.match(r"\s*#{1,6}\s", line, re.A)):
                sections.append(tuple(own))
                own = []
            own.append(line)
        return [*sections, tuple(own)]

    def leaves(line):
        raw = line.encode()
        at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        cuts, since = [0], 0
        for k, (a, h) in enumerate(zip(at, [None, *word_hashes(raw)[:-1].tolist()], strict=True)):
            since += 1
            if k and (len(at) <= merkle.FINE or h % merkle.CUT == 0 or since == merkle.LONGEST):
                cuts.append(a)
            if not k or cuts[-1] == a:
                since = 0
        return [raw[s:e] for s, e in zip(cuts, [*cuts[1:], len(raw)], strict=True)]

    if x == y:
        return 1.0
    size = lambda v: len("".join(v).encode()) if isinstance(v, tuple) else len(v.encode()) if isinstance(v, str) else len(v)
    mass, one, two = 0, Counter(nodes(x)), Counter(nodes(y))
    for down in (lambda s: list(s), leaves, None):
        mass += sum(n * size(v) for v, n in (one & two).items())
        one, two = one - two, two - one
        if down:
            one, two = (Counter(v for s, n in c.items() for v in down(s) * n) for c in (one, two))
    return 2 * mass / (len(x.encode()) + len(y.encode()))


def test_merkle(spark, rows):
    got = {r["doc_id"]: r for r in queries.op3_merkle_fingerprints(spark, SF).collect()}
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + other[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (merkle.Tree(t).root.hex(), merkle.Tree(edited).root.hex())
        assert abs(r["near_edited"] - brute_likeness(t, edited)) < 1e-9 and abs(r["near_next"] - brute_likeness(t, other)) < 1e-9
        if r["edit_start"] is not None:  # what the edit left alone lies before the first changed leaf, save part of one
            assert 0 <= r["edit_start"] < r["edit_end"] <= len(t)
    assert len({t for _, t in rows}) == len({r["fingerprint"] for r in got.values()})
    long = [r for r in got.values() if r["n_chars"] > 200]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.98 * len(long)


def test_merkle_locates_edits():
    a, b = merkle.Tree("# One\nalpha beta\n\n# Two\ngamma delta\n"), merkle.Tree("# One\nalpha beta\n\n# Two\ngamma DELTA\n")
    _, left, right = merkle.differing(a, b)
    assert [a.raw[s:e] for s, e in left] == [b"gamma delta\n"] and [b.raw[s:e] for s, e in right] == [b"gamma DELTA\n"]
    near, start, end = merkle.compared(a, b)
    assert a.raw[start:end] == b"delta\n" and 0.8 < near < 1
    assert a.sections[1][0] != b.sections[1][0] and a.sections[0][0] == b.sections[0][0]
    assert merkle.likeness(merkle.Tree(""), merkle.Tree(None)) == 1.0 and merkle.likeness(merkle.Tree("a"), merkle.Tree("")) == 0.0


def test_sharding(spark, rows):
    got = queries.op4_kd_sharding(spark, SF).collect()
    by = Counter()
    for r in got:
        by[r["shard"]] += r["size"]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    assert set(by) == set(range(16))
    largest = max(len(t.encode()) for _, t in rows)
    assert max(by.values()) - min(by.values()) <= largest
    same = spark.range(3000).select((F.col("id") * 0 + 1).alias("doc_id"), F.lit("all the same text").alias("text"))
    assert {r["count"] for r in sharding.shard(same, shards=3).groupBy("shard").count().collect()} == {1000}


@pytest.mark.parametrize("shards", [16, 7])
def test_sharding_is_a_k_d_tree(spark, shards):
    """Every split is along the widest dimension, at the row that brings the bytes closest to their share."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    point = docs.select("doc_id", "doc_id", (F.octet_length("text")).alias("size"), *[F.pmod(F.xxhash64(c), F.lit(1 << 16)).alias(c) for c in ("source", "lang")])
    points = {r[0]: np.array(r[1:], float) for r in point.collect()}
    span = np.ptp(np.array(list(points.values())), axis=0)
    span[span == 0] = 1
    got = sharding.shard(docs, shards=shards).collect()
    size, leaf = {r["doc_id"]: r["size"] for r in got}, {r["doc_id"]: r["shard"] for r in got}

    def check(first, n):
        if n == 1:
            return 1
        own = [i for i in points if first <= leaf[i] < first + n]
        left, right = [i for i in own if leaf[i] < first + n // 2], [i for i in own if leaf[i] >= first + n // 2]
        x = np.array([points[i] for i in own])
        wide = np.ptp(x, axis=0) / span
        dims = [d for d in range(4) if wide[d] > wide.max() - 1e-5 and max(points[i][d] for i in left) <= min(points[i][d] for i in right)]
        assert dims
        off = sum(size[i] for i in left) - sum(size[i] for i in own) * (n // 2) / n
        # The rows at the cut: of those with the boundary's values, one more or less would not come closer.
        edge = max(size[i] for d in dims for i in own if points[i][d] in (max(points[j][d] for j in left), min(points[j][d] for j in right)))
        assert abs(off) <= edge / 2
        return check(first, n // 2) + check(first + n // 2, n - n // 2)

    assert check(0, shards) == shards


def test_sharding_with_few_bins(spark, monkeypatch):
    """Many nodes share the bins and rows that may reach the driver; the tree stays the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cut = lambda: sorted((r["doc_id"], r["shard"]) for r in sharding.shard(docs, shards=24).collect())
    whole = cut()
    monkeypatch.setattr(sharding, "MOST", 64)
    assert cut() == whole


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 8)), np.tile(rng.normal(size=8), (150, 1))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (1080, [0.5]), (None, [1.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    fine = [(i, np.array((v + [0.0] * 8)[:8])) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    whole = np.array([np.floor(64 * np.float64(v)) for _, v in fine]).astype(np.int64)
    ids = np.array([i for i, _ in fine])
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[q]
        order = [j for j in np.lexsort((ids, -scores)) if j != q][:20]
        want |= {(int(ids[q]), k + 1, int(ids[j]), int(scores[j])) for k, j in enumerate(order)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    few = topk.top_k(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_top_k_rows_ids_and_huge_components(spark):
    values = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (0, None), (3, [0.25, 1.0]), (5, [1e200, 0.0]), (20, [-1e200, 1e308]), (7, []), (40, [float(2**40), 1.0]), (9, [float(2**30), -3.0])]
    table = spark.createDataFrame([(i, v, True, "z", 7) for i, v in values], "vec_id long, embedding array<double>, _is_query boolean, id string, row int")
    got = sorted((tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, k=4).collect()), key=str)
    most = np.finfo(np.float64).max
    fine = [(i, [int(max(-most, min(most, float(np.floor(64 * np.float64(c)))))) for c in (v + [0.0, 0.0])[:2]]) for i, v in values if v is not None]
    want = []
    for a, (i, q) in enumerate(fine):
        if i % 20 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True)))), j, b) for b, (j, v) in enumerate(fine) if b != a)
            want += [(i, k + 1, j, -s) for k, (s, j, _) in enumerate(scores[:4])]
    assert got == sorted(want, key=str) and len(got) == 16


def test_top_k_passes_over_far_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 6)) * 50
    x = (centres[:, None] + rng.normal(size=(30, 400, 6)) * 0.5).reshape(-1, 6)
    tree = topk.Tree(np.floor(64 * x))
    q = np.floor(64 * x[:100])
    worst = np.sort(q @ np.floor(64 * x).T, axis=1)[:, -20].astype(np.int64)
    _, b, _ = topk.leaf_pairs(topk.Tree(q), worst, tree)
    assert len(set(b.tolist())) < tree.leaf.sum() / 4
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 200 == 0, k=5).collect()}
    whole, want = np.floor(64 * x).astype(np.int64), set()
    for i in range(0, len(x), 200):
        scores = whole @ whole[i]
        want |= {(i, k + 1, int(j), int(scores[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(len(x)), -scores)) if j != i][:5])}
    assert got == want


def test_top_k_on_table(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in table]), np.floor(64 * np.array([v for _, v in table], np.float64)).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        want |= {(int(ids[q]), k + 1, int(ids[j]), int(scores[j])) for k, j in enumerate([j for j in np.lexsort((ids, -scores)) if j != q][:20])}
    assert {tuple(r) for r in queries.op5_exact_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()} == want


def test_top_k_sends_little_to_the_driver(spark):
    """Many partitions, and queries that meet many blocks: neither the draw nor copies of the queries come to the driver."""
    table = spark.range(0, 20_000, 1, 64).selectExpr("id AS vec_id", "transform(sequence(1, 64), x -> CAST(hash(id, x) / 2147483648.0 AS float)) AS embedding")
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        assert topk.top_k(table, F.col("vec_id") % 5 == 0).count() == 4_000 * 20
    finally:
        conf.set("spark.driver.maxResultSize", before)


def test_top_k_shelves_of_many_blocks(spark):
    """Blocks that share a shelf, some without a row, and equal scores across them."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.integers(-2, 3, size=(9_000, 64)), np.tile(rng.integers(-2, 3, size=64), (9_000, 1))])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(float).tolist())], "vec_id long, embedding array<double>")
    got, want, whole = {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 600 == 0, k=7).collect()}, set(), 64 * x
    for i in range(0, len(x), 600):
        scores = whole @ whole[i]
        want |= {(i, k + 1, int(j), int(scores[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(len(x)), -scores)) if j != i][:7])}
    assert got == want


def test_pieces_round_trip(spark, rows):
    path = vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, "▁ ▁\0x\n  hello  world\r\n日本 ×² ²."), (-4, "é" * 100 + "x" * 130)], "doc_id long, text string")
    encoded = pieces.encode(docs, path)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, path).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    again = {r["doc_id"]: r["ids"] for r in pieces.encode(docs.repartition(5), path).collect()}
    assert again == {r["doc_id"]: r["ids"] for r in encoded.collect()}
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, path, seed=1).collect()}
    assert sum(other[i] != again[i] for i, _ in rows) > len(rows) / 2


def test_pieces_are_drawn_by_weight():
    own = pieces.Lattices(vocabulary("piece_bpe_32k.model"), 0.5)
    unit = pieces.MARK + "then"
    own.learn({unit})
    seen = Counter(tuple(x.tolist()) for x in own.sample([[unit]] * 20_000, list(range(20_000))))
    weight = {own.bytes[i].decode(errors="ignore").replace(" ", pieces.MARK): (int(i), float(w)) for i, w in zip(own.ids, own.weights, strict=True)}

    def ways(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                for rest, w in ways(s[k:]):
                    yield (weight[s[:k]][0], *rest), weight[s[:k]][1] * w

    every = dict(ways(unit))
    total = sum(every.values())
    assert all(abs(seen[s] / 20_000 - w / total) < 0.02 for s, w in every.items())


def test_every_piece_can_be_drawn():
    from sentencepiece import SentencePieceProcessor

    path = vocabulary("piece_bpe_32k.model")
    own, model = pieces.Lattices(path, 0.5), SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    assert set(plain) == set(own.ids.tolist())
    # Each piece lies within one unit wherever it stands: alone, in a long run, between words and in punctuation.
    for i in plain:
        p = model.id_to_piece(i).replace(pieces.MARK, " ")
        for text, at in ((p, 0), ("a" * 46 + p, 46), ("x" + p + "y", 1), ("-" * 47 + p, 47)):
            ends = np.cumsum([len(u) for u in pieces.units(text, own.crossed)])
            assert not ((ends > at) & (ends < at + len(p))).any(), (p, text)
    for text, piece in (("a\n" + " " * 4 + "b", pieces.MARK * 3), ("x².", "².")):
        cut = pieces.units(text, own.crossed)
        own.learn(set(cut))
        seen = own.sample([cut] * 5000, list(range(5000)))
        assert any(model.piece_to_id(piece) in x.tolist() for x in seen)
        assert {own.decode(x.tolist()).decode() for x in seen} == {text}


def test_language(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert language.family("en") == language.family("de") != language.family("fr") and language.family("xx") == "xx"


def test_language_stage_rejects(spark, rows):
    foreign = ["Tämä on suomenkielinen lause joka ei ole mukana opetuksessa lainkaan", "これは日本語の文章です", "Это русский текст который не был в обучении", "asdkjfh qwekjh zxcmnb qwe asdlkj zxmnc", "0a9f 88bc deadbeef", "123 456", None, ""]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(foreign)], docs.schema)
    got = language.known(docs.unionByName(more), F.lit(True)).collect()
    assert not [r["doc_id"] for r in got if r["doc_id"] < 0]
    assert len(got) >= 0.99 * docs.count()
    score = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()}
    assert {r["doc_id"] for r in got} == {i for i, (lang, s) in score.items() if lang != "und" and s >= language.LEAST}
    english = {r["doc_id"] for r in language.known(docs, F.lit(True), wanted=("en",)).collect()}
    assert english == {i for i, (lang, s) in score.items() if lang == "en" and s >= language.LEAST}


def test_toxicity(spark):
    mark = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.1").collect()
    held = [(r["score"], r["predicted"], mark[r["doc_id"]]) for r in got if r["held_out"] and mark.get(r["doc_id"]) is not None]
    assert all(p == int(s >= 0.5) for s, p, _ in held)
    assert np.mean([p == y for _, p, y in held]) > 0.95
    assert np.mean([p for _, p, y in held if y]) > 0.75


def test_toxicity_keeps_rare_words_of_large_vocabularies(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{letters[i % 26]}{letters[i // 26]}zqxk" for i in range(100)]
    often, rare = words[:70], words[70:]
    toxic = [f"{w} n{k} {w} thing" for w in often for k in range(20)] + [f"{w} n{k} thing" for w in rare for k in range(12)]
    texts = [(t, 1) for t in toxic] + [(f"plain m{k} thing", 0) for k in range(4 * len(toxic))]
    docs = spark.createDataFrame([(i, re.sub(r"\d", lambda m: letters[int(m[0])], t)) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert [w for w in words if model.score(f"a new {w} here") < 0.5] == [] and model.score("a new thing here") < 0.5
    assert {f"w:{w}" for w in words} <= set(model.matcher.at)


def test_toxicity_leaves_common_words_alone(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"{a}{b}rn" for a in "bcdfghkl" for b in "aeiou"])
    texts = [(" ".join([*words[rng.random(40) < (0.5, 0.56)[y]], *(["zqxk"] if y else [])]), y) for y in (0, 1) for _ in range(4000)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int"), F.lit(True))
    # Sure as the difference of the common words is, it is small: none of them is a voter.
    assert {v[2:] for v in model.matcher.at} == {"zqxk"}
    assert model.score(" ".join(words)) < 0.5 <= model.score(f"{words[0]} zqxk")


def test_label_model_finds_weak_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    votes = np.stack([rng.random(4000) < np.where(y, a, b) for a, b in ((0.8, 0.02), (0.6, 0.05), (0.3, 0.3))] + [rng.random(4000) < np.where(y, 0.1, 0.9)], axis=1).astype(np.uint8)
    votes = np.hstack([votes, votes[:, :1]])  # the first voter twice
    counts = np.stack([votes[y == k].sum(axis=0) for k in (0, 1)])
    post, rate, weight = toxicity.label_model(votes, counts, np.array([(~y).sum(), y.sum()]))
    assert np.mean((post > 0.5) == y) > 0.95 and abs(rate[1][0] - 0.8) < 0.1
    assert weight[0] < 0.6 and weight[1] > 0.9


def check_sequences(sequences, capacity=2048):
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = queries.op8_best_fit_packing(spark, SF).collect()
    sequences, own = defaultdict(list), defaultdict(dict)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        own[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    check_sequences(sequences)
    total = 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        assert own[i] == {k: (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    assert len(sequences) <= np.ceil(total / 2048) * 1.02 + 1


def test_index_of_sums_finds_what_there_is():
    rng = np.random.default_rng(8)
    for _ in range(60):
        left = [0, *rng.integers(0, 3, 24).tolist()]
        sums = packing.Sums(left)
        for _ in range(30):
            x = int(rng.integers(1, 25))
            gap = 24 - x
            if not left[x] or not gap:
                continue
            own = Counter({k: n for k, n in enumerate(left) if n}) - Counter([x])
            have = sorted(own.elements())
            ways = [(a,) for a in have if a == gap] or [(a, b) for i, a in enumerate(have) for b in have[:i] if a + b == gap]
            ways = ways or [(a, b, c) for i, a in enumerate(have) for j, b in enumerate(have[:i]) for c in have[:j] if a + b + c == gap]
            found = sums.fill(gap, (x,))
            assert (found is None) == (not ways) and (found is None or (len(found) == len(ways[0]) and sum(found) == gap and not Counter(found) - own))
            for v in (x, *(found or ())):  # counts only fall
                left[v] -= 1


def test_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    texts = ["Don't <|endoftext|>x  I'll\x1cA b café 'S 12 İ Σας ΟΔΟΣ", "x''s ''t 3's é É ﬁ ½ ①x “Hi”…", "a<|startoftext|> <|endof text|>", "", None, "日本語　テキスト"]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert packing.Encoder(path).encode(texts) == want


@pytest.mark.parametrize("counts", [{}, {2048: 3}, {1: 5000}, {1500: 4, 548: 2, 300: 4, 248: 4, 100: 7}, {1025: 10}, {700: 9, 648: 3}])
def test_plan(counts):
    plan = packing.Plan(dict(counts))
    sequences = defaultdict(list)
    for length, (ranks, first, offset) in plan.tables().items():
        ends = [*ranks[1:].tolist(), counts[length]]
        for r, f, o, e in zip(ranks.tolist(), first.tolist(), offset.tolist(), ends, strict=True):
            for k in range(e - r):
                sequences[f + k].append((o, length))
    assert Counter(n for s in sequences.values() for _, n in s) == Counter(counts)
    check_sequences(sequences)
    assert len(sequences) == plan.sequences


def brute_components(rows, width=4, distance=4):
    fps = {}
    for i, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        import xxhash

        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + width]).encode(), 42) for k in range(max(1, len(words) - width + 1))] if words else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, f"{fps[i]:016x}", find(i)) for i in ids}


def test_components_write_few_checkpoints(spark):
    simhash.prepare(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)

    def found(pairs):
        before = set(folder.glob("rdd-*"))
        edges = spark.createDataFrame(pairs, "u long, v long")
        roots = [(r["node"], r["root"]) for r in simhash.components(edges).collect()]
        assert len(roots) == len(dict(roots))
        return dict(roots), len(set(folder.glob("rdd-*")) - before)

    def least(pairs):
        root = {x: x for p in pairs for x in p}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return {x: r for x, r in root.items() if x != r}

    pairs = [(2 * k + 1, 2 * k) for k in range(50)]
    star = [(k, 0) for k in range(1, 100)]
    assert found([]) == ({}, 1) and found(pairs) == (least(pairs), 1) and found(star + [(0, 5), (7, 7)]) == (least(star), 1)
    # Many roots of one node, and a chain, which halves each round; a round writes two tables.
    for far in ([(100, k) for k in range(100)], [(k + 1, k) for k in range(40)]):
        roots, written = found(far + [(500, 400)])
        assert roots == least(far + [(500, 400)]) and written % 2 == 1 and written <= 13
    rng = np.random.default_rng(3)
    mixed = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    assert found(mixed)[0] == least(mixed)


def test_simhash(spark, rows):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op9_simhash_near_dedup(spark, SF).collect()}
    assert got == brute_components(rows)


def test_simhash_splits_large_nodes(spark):
    rng = np.random.default_rng(1)
    codes = {0}
    for _ in range(300):  # a chain of near fingerprints and single ones
        codes.add(int(rng.choice(list(codes))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    codes |= {int(x) for x in rng.integers(0, 2**63, 200)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "fp long").repartition(3)
    simhash.prepare(spark)
    roots = [dict((r["node"], r["root"]) for r in simhash.components(simhash.links(table, node_limit=n)).collect()) for n in (1 << 14, 20)]
    pairs = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    least = {c: c for c in signed}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    linked = {c for p in pairs for c in p}
    assert roots[0] == roots[1] == {c: least[c] for c in linked if least[c] != c}


def brute_substrings(rows, width=35):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return Counter(out)


def test_substrings(spark, rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op10_substring_dedup(spark, SF).collect())
    assert got == brute_substrings(rows)


def test_substrings_at_the_edges(spark):
    rng = np.random.default_rng(5)
    free = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    common = free(60)
    texts = [free(20) + common + free(30), common[3:50], common[:34], free(5) + common[10:45], ["a"] * 36, ["b"] * 35, ["c"] * 34, free(35), []]
    texts += [texts[7], [*common[:20], "x", *common[21:]], ["p", "q"] * 30]
    # Words for which sums of powers modulo 2**64 are equal (Thue and Morse): only the words themselves tell them apart.
    odd = ["".join("ab"[(k.bit_count() + f) % 2] for k in range(2048)) for f in (0, 1)]
    more = free(40)
    texts += [[*more[:20], odd[0], *more[20:]], [*more[:20], odd[1], *more[20:]]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = substrings.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string"), digest=True).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_substrings(docs)


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "SimHash near-dedup", "substring dedup", "best-fit packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs.columns
    stages = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stages.append(stage(spark, stages[-1], SF).checkpoint())
        if name != names[-1]:
            assert stages[-1].columns == want and [str(f.dataType) for f in stages[-1].schema] == [str(f.dataType) for f in docs.schema]
    texts = [[(r["doc_id"], r["text"]) for r in s.orderBy("doc_id").collect()] for s in stages[:5]]
    model = language.fit(docs, F.lit(True))
    told = {r["doc_id"] for r in language.predict(docs, model).filter("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert texts[1] == [(i, t) for i, t in texts[0] if i in told]
    assert set(texts[2]) <= set(texts[1]) and len(texts[2]) > 0.8 * len(texts[1])
    missed = check_similar_groups(dict(texts[2]), {i for i, _ in texts[3]})
    assert len(missed) <= 0.05 * (len(texts[2]) - len(texts[3]))
    gone = {i: (n, sha) for i, _, n, sha in brute_substrings(texts[3])}
    for (i, before), (j, after) in zip(texts[3], texts[4], strict=True):
        assert i == j and (after == before if not gone[i][0] else hashlib.sha256(after.encode()).hexdigest() == gone[i][1])
    packed = {tuple(r) for r in stages[5].select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert packed == {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert {i for i, *_ in packed} == {i for i, _ in texts[4]}


@pytest.mark.parametrize("rows", [None, 0])
def test_stages_on_awkward_rows(spark, awkward, rows):
    import corpus_pipeline

    docs = awkward if rows is None else awkward.limit(rows)
    clash = ["_id", "best", "again", "n_removed", "kept_text", "_text", "text_"]
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).selectExpr("*", *[f"'z' AS `{c}`" for c in clash])
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        if name != "best-fit packing":
            assert docs.columns == names, name
            assert all(r[c] == "z" for r in docs.collect() for c in CLASHING + clash), name
    if rows is None:
        # 2, 3, 4 and 8 hold no letter; 1 and 5/6 are copies; the long text, once alone, repeats itself. All labels are
        # English here, so every text with a letter is.
        assert Counter(r["doc_id"] for r in docs.filter("piece = 0").collect()) == Counter([1, None, 5, 7, 9, -4])
    else:
        assert docs.collect() == []


def shingles_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(texts, least=0.8):
    """{(i, j): similarity} of all pairs of texts that are alike, by the sets of their five-word shingles."""
    sets = {i: shingles_of(t or "") for i, t in texts.items()}
    holders = defaultdict(list)
    for i, own in sets.items():
        for x in own or [None]:
            holders[x].append(i)
    found = {}
    for i, own in sets.items():
        shared = Counter(j for x in own or [None] for j in holders[x] if j < i)
        for j, n in shared.items():
            similarity = n / (len(own) + len(sets[j]) - n) if own else 1.0
            if similarity >= least:
                found[j, i] = similarity
    return found


def check_similar_groups(texts, kept):
    """All that went has a partner that is alike and a smaller id to go for; the ids that should have gone and did not."""
    pairs = similar_pairs(texts)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    with_partner = {i for p in pairs for i in p}
    gone = set(texts) - kept
    assert gone <= with_partner and all(find(i) != i for i in gone)
    return {i for i in texts if find(i) != i} - gone


def test_keep_one_by_similarity(spark):
    """Altered copies in families: groups by brute-force similarity are met, and nothing without a partner goes."""
    draw = random.Random(3)
    vocabulary_ = [f"w{draw.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for k in range(120):
        words = [draw.choice(vocabulary_) for _ in range(draw.choice((9, 60, 200, 900)))]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 5):
            other = list(words)
            for _ in range(draw.randrange(1, 1 + max(1, len(words) // (30, 60, 9, 40)[c - 1]))):
                other[draw.randrange(len(other))] = draw.choice(vocabulary_)
            rows.append((10 * k + c, " ".join(other)))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), width=5, least=0.8).collect()}
    missed = check_similar_groups(dict(rows), kept)
    assert len(rows) - len(kept) > 100 and len(missed) <= 0.05 * (len(rows) - len(kept))


def test_recall_in_every_band(spark):
    """Pairs at 0.7 to 1: of those alike by 0.8 or more nine in ten are found in every band of 0.05, of the others none."""
    draw = random.Random(8)
    rows, pairs = [], []
    for k in range(700):
        words = [f"x{draw.randrange(5000)}" for _ in range(draw.choice((80, 300, 700)))]
        other = list(words)
        for _ in range(max(1, round(len(words) * draw.uniform(0.001, 0.035)))):
            other[draw.randrange(len(other))] = f"x{draw.randrange(5000)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = shingles_of(rows[-2][1]), shingles_of(rows[-1][1])
        pairs.append(len(a & b) / len(a | b))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), width=5, least=0.8).collect()}
    bands = defaultdict(Counter)
    for k, similarity in enumerate(pairs):
        assert 2 * k in kept
        bands[int(similarity * 20)][2 * k + 1 not in kept] += 1
    assert all(not n[True] for b, n in bands.items() if b < 16)
    assert all(sum(bands[b].values()) > 40 and bands[b][True] >= 0.9 * sum(bands[b].values()) for b in range(16, 20)), bands


def test_family_about_one_text(spark):
    """Variants alike to one text but not to each other all go for it, in whatever order they meet."""
    draw = random.Random(9)
    words = [f"y{draw.randrange(10**5)}" for _ in range(400)]
    rows = []
    for k in range(90):
        other = list(words)
        for _ in range(6):
            other[draw.randrange(len(other))] = f"y{draw.randrange(10**5)}"
        rows.append((k + 1, " ".join(other)))
    rows.append((0, " ".join(words)))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), width=5, least=0.8).collect()}
    missed = check_similar_groups(dict(rows), kept)
    assert len(kept) <= 0.1 * len(rows) and len(missed) <= 0.05 * len(rows)


def test_keep_one_by_similarity_awkward(spark, awkward):
    kept = simhash.keep_one(awkward, width=5, least=0.8)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, None, 2, 5, 7, 8, 9, -4])
    assert simhash.keep_one(awkward.limit(0), width=5, least=0.8).collect() == []


def test_similarity_splits_large_nodes(spark):
    """Texts of the same words in other orders share a fingerprint but are not alike; their copies with one more word are."""
    draw = random.Random(5)
    words = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(12):
        draw.shuffle(words)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1 << 14, 2):
        assert sorted(r["doc_id"] for r in simhash.keep_one(table, width=5, least=0.8, node_limit=n).collect()) == list(range(0, 24, 2))
