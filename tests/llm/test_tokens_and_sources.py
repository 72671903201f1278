"""Byte-level BPE, fill-in-the-middle and source divergence against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import byte_bpe, divergence, infill, queries

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASHING = ["ids", "decoded", "marked", "escaped", "n", "form", "low", "high", "prefix", "term", "slice", "seat", "members", "part", "item", "value", "rank", "id"]
AWKWARD = [(1, "The quick brown fox"), (1, "The quick brown fox"), (None, "no id at all"), (2, None), (3, ""), (4, " \n\t "), (5, " ".join(f"w{i % 977}" for i in range(40_000))), (6, "a" * 100_000), (7, "\x01\x02d\x02e\x02\x01"), (8, "x <P> y"), (-4, "ÀÉ ▁ \0 日本 🤖🏽 <S <M"), (9, "<" * 50 + "P<S<M")]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"] or "", r["lang"] or "", r["source"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    own = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "web") for k, (i, t) in enumerate(AWKWARD)], "doc_id long, text string, lang string, source string")
    return own.selectExpr("*", *[f"'z' AS `{c}`" for c in CLASHING])


def plain_bpe(name):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(name)), special_tokens={})


# ---- byte-level BPE ----


def brute_bpe(texts):
    plain = plain_bpe("byte_bpe_50k.tiktoken")
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        yield i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_query(spark, rows):
    got = Counter(tuple(r) for r in queries.op11_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == Counter(brute_bpe((i, t) for i, t, *_ in rows))


def test_bpe_on_awkward_rows(spark, awkward):
    plain = plain_bpe("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(awkward, BPE)
    want = Counter((i, tuple(plain.encode_ordinary(t or ""))) for i, t in AWKWARD)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    for packed in (False, True):
        back = byte_bpe.decode(byte_bpe.encode(awkward, BPE, packed=packed), BPE)
        assert Counter((r["doc_id"], r["decoded"]) for r in back.collect()) == Counter((i, t or "") for i, t in AWKWARD)
    assert Counter((r["doc_id"], r["decoded"]) for r in byte_bpe.encode(awkward, BPE, decoded=True).collect()) == Counter((i, t or "") for i, t in AWKWARD)
    assert byte_bpe.encode(awkward.limit(0), BPE, decoded=True).collect() == [] and byte_bpe.decode(encoded.limit(0), BPE).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {(r["doc_id"], r["decoded"]) for r in byte_bpe.decode(nulls, BPE).collect()} == {(1, None), (2, "")}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_machine_equals_merging(name):
    own, plain, draw = byte_bpe.Encoder(public_tokenizers.path(name), public_tokenizers.PATTERN), plain_bpe(name), random.Random(1)
    spelt = list(own.ranks)
    texts = [" " * k for k in range(300)] + ["-" * k + "\n" * k for k in range(0, 300, 7)] + ["ab" * 3000, "a" * 9001, "\t" * 5000]
    texts += [chr(c) + "x " + chr(c) * 2 for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += [b"".join(draw.choice(spelt) for _ in range(5)).decode(errors="replace") for _ in range(3000)]
    texts += ["".join(draw.choice("aeiourstn thé'") for _ in range(draw.randrange(90))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == plain.encode_ordinary_batch(texts, num_threads=1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=25), st.lists(st.text("abc", max_size=24), max_size=12))
def test_machine_on_any_vocabulary(merges, texts):
    """Small vocabularies as training leaves them (each token made of two before it), small windows; merging step by step."""
    ranks, made = {bytes([b]): b for b in range(256)}, [b"a", b"b", b"c"]
    for x, y in merges:
        token = made[x % len(made)] + made[y % len(made)]
        if token not in ranks:
            ranks[token] = len(ranks)
            made.append(token)

    def merged(raw):
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while True:
            found = [(ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
            if not found:
                return [ranks[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    machine = byte_bpe.Transducer(ranks)
    raws = [t.encode() for t in texts if t]
    want = [np.array(merged(r), "<u4").tobytes() for r in raws]
    assert [machine.run(r) for r in raws] == want
    if raws:
        assert machine.run_side_by_side(raws) == want
    window, byte_bpe.WINDOW = byte_bpe.WINDOW, 13
    try:
        assert [machine.run(r * 5) for r in raws] == [np.array(merged(r * 5), "<u4").tobytes() for r in raws]
    finally:
        byte_bpe.WINDOW = window


def test_memories_begin_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 20)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    own, plain = byte_bpe.Encoder(BPE, public_tokenizers.PATTERN), plain_bpe("byte_bpe_50k.tiktoken")
    texts = [f"wörd{k} ünd zzyzx{k * k}" for k in range(60)]
    assert [np.frombuffer(own.encode([t])[0], "<u4").tolist() for t in texts] == [plain.encode_ordinary(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 5))
def test_streaming_decode(raw, step):
    """Any bytes, token by token: as a decoder that sees all at once, and never half a character on the way."""
    own = byte_bpe.Decoder(BPE)
    ids = [own_id[raw[k : k + 1]] for own_id in [byte_bpe.read_ranks(BPE)] for k in range(len(raw))]
    pieces = list(own.stream(np.array(ids, np.int64)))
    assert "".join(pieces) == raw.decode(errors="replace")


# ---- fill in the middle ----


def brute_infill(i, text):
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_infill_query(spark, rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {tuple(r) for r in queries.op12_infill(spark, SF).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()}
    want = {(*x[:5], sha(x[5]), sha(t)) for i, t, *_ in rows for x in [brute_infill(i, t)]}
    assert got == want and {x[2] for x in want} == {"plain", "psm", "spm"}


def test_infill_on_awkward_rows(spark, awkward):
    draw = random.Random(2)
    more = [(100 + k, "".join(draw.choice("\x01\x02de<PSM>\n🤖é") for _ in range(draw.randrange(40)))) for k in range(400)]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    made = infill.transform(docs.selectExpr("*", *[f"'z' AS `{c}`" for c in CLASHING]))
    found = made.withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    texts = AWKWARD + more
    assert Counter(tuple(r)[:6] for r in found) == Counter(brute_infill(i, t or "") for i, t in texts)
    assert Counter((r["doc_id"], r["restored"]) for r in found) == Counter((i, t or "") for i, t in texts)
    assert infill.transform(docs.limit(0)).collect() == []


def test_infill_runs_without_python(spark, awkward):
    plan = infill.transform(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- source divergence ----


def brute_divergence(rows, least_docs=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= least_docs) for lang, c in docs.items()}
    share = lambda c, lang: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept[lang]) + len(kept[lang])) for t in kept[lang]}
    p = {g: share(c, g[0]) for g, c in counts.items()}
    out = []
    for lang, source in counts:
        own, whole = p[lang, source], share(sum((counts[g] for g in counts if g[0] == lang), Counter()), lang)
        f = lambda q, t, own=own: (own[t] - q[t]) ** 2 // q[t]
        pairs = sorted((-sum(f(p[g], t) for t in kept[lang]), g[1].encode(), g[1]) for g in counts if g[0] == lang and g[1] != source)
        terms = sorted((-f(whole, t), t.encode(), t) for t in kept[lang] if counts[lang, source][t] and own[t] > whole[t])
        out += [(lang, source, "pair", x, -v, k + 1) for k, (v, _, x) in enumerate(pairs)] + [(lang, source, "term", x, -v, k + 1) for k, (v, _, x) in enumerate(terms[:top])]
    return Counter(out)


def found_divergence(df):
    return Counter(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_query(spark, rows):
    assert found_divergence(queries.op13_source_divergence(spark, SF)) == brute_divergence([r[1:] for r in rows])


@pytest.mark.parametrize(("slice_terms", "seat_sources"), [(7, 1), (1000, 3)])
def test_divergence_over_many_seats(spark, slice_terms, seat_sources):
    """Few terms to a slice, few sources to a seat, one language with an even and one with an odd number of seats."""
    draw = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgéß日" for b in "aeiou"] + ["Zz", "zz", "1", "x1y"]
    rows = []
    for k in range(160):
        lang = draw.choice(["en", "en", "de", None])
        source = draw.choice(["big"] * 6 + [f"s{draw.randrange(9 if lang == 'en' else 6)}", None])
        rows.append((k, " ".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randrange(25))) if k % 17 else None, lang, source))
    rows += [(200, "alone here", "xx", "one"), (201, None, "xx", "two"), (202, "", "yy", "three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = found_divergence(divergence.audit(docs, top=5, slice_terms=slice_terms, seat_sources=seat_sources))
    assert got == brute_divergence([r[1:] for r in rows], top=5)
    assert got["xx", "one", "pair", "two", 0, 1] == 1


def test_divergence_on_awkward_rows(spark, awkward):
    rows = [(t, None if k % 3 else "en", None if k % 4 else "web") for k, (_, t) in enumerate(AWKWARD)]
    assert found_divergence(divergence.audit(awkward)) == brute_divergence(rows)
    assert found_divergence(divergence.audit(awkward, least_docs=1)) == brute_divergence(rows, least_docs=1)
    assert divergence.audit(awkward.limit(0)).collect() == []


def test_shares_are_exact():
    for count, total in [(0, 1), (5, 7), (4 * 10**9, 10**10), (3 * 10**12 + 7, 10**13 + 1), (9 * 10**14, 10**15 + 3)]:
        assert divergence.shares(np.array([count, 0]), total).tolist() == [1 + 10**9 * (count + 1) // total, 1 + 10**9 // total]


@pytest.mark.parametrize("seats", range(2, 10))
def test_every_two_seats_meet_once(spark, seats):
    turns = seats + seats % 2 - 1
    own = spark.range(seats).select(F.col("id").cast("int").alias("seat"), F.lit(seats).alias("seats"))
    met = Counter()
    for turn in range(turns):
        pairs = {r["seat"]: r["p"] for r in own.select("seat", divergence.partner(F.col("seat"), F.col("seats"), turn).alias("p")).collect()}
        assert all(p is None or pairs[p] == s and p != s for s, p in pairs.items())
        met.update((s, p) for s, p in pairs.items() if p is not None and p < s)
    assert len(met) == math.comb(seats, 2) and set(met.values()) == {1}
