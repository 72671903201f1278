"""Properties of the parts that need no Spark."""

from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import merkle, packing, simhash, substrings, topk
from pagewright.llm.common import WORDS, Rolling, word_spans

TEXT = st.text(alphabet="ab \n\t#é", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_every_piece_is_packed_once(counts):
    plan = packing.Plan(dict(counts), capacity=64)
    sequences = defaultdict(list)
    for length, (ranks, first, offset) in plan.tables().items():
        for r, f, o, e in zip(ranks.tolist(), first.tolist(), offset.tolist(), [*ranks[1:].tolist(), counts[length]], strict=True):
            for k in range(e - r):
                sequences[f + k].append((o, length))
    assert Counter(n for s in sequences.values() for _, n in s) == Counter(counts)
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    # Best fit never leaves two sequences that would fit into one.
    fill = sorted(sum(n for _, n in s) for s in sequences.values())
    assert len(fill) < 2 or fill[0] + fill[1] > 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150, unique=True), st.lists(st.tuples(st.integers(0, 149), st.integers(0, 63)), max_size=60))
def test_forest_keeps_all_links(codes, near):
    own = set(codes)
    for i, bit in near:
        own.add(codes[i % len(codes)] ^ (1 << bit))
    codes = np.array(sorted(own), np.uint64)

    def parts(edges):
        root = {int(c): int(c) for c in codes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        groups = defaultdict(set)
        for c in root:
            groups[find(c)].add(c)
        return {frozenset(g) for g in groups.values()}

    every = [(int(a), int(b)) for a in codes for b in codes if a < b and (int(a) ^ int(b)).bit_count() <= 4]
    a, b = simhash.forest(codes, 4)
    found = list(zip(a.tolist(), b.tolist(), strict=True))
    assert all((x ^ y).bit_count() <= 4 for x, y in found) and parts(found) == parts(every) and len(found) <= len(codes) - 1


def test_gray_order_changes_one_bit_a_step():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 60))
def test_leftmost_least(values, width):
    width = min(width, len(values))
    x = np.array(values, np.uint64)
    want = [s + int(np.argmin(x[s : s + width])) for s in range(len(x) - width + 1)]
    assert substrings.leftmost_least(x, width).tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 10))
def test_equal_stretches_have_equal_hashes(values, width):
    width = min(width, len(values))
    at = np.arange(len(values) - width + 1)
    h = Rolling(np.array(values, np.uint64), WORDS).of(at, at + width)
    stretches = [tuple(values[s : s + width]) for s in at]
    assert len(set(zip(h.tolist(), stretches, strict=True))) == len(set(stretches)) == len(set(h.tolist()))


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_word_spans(text):
    raw = text.encode()
    starts, ends = word_spans(raw)
    assert [raw[s:e] for s, e in zip(starts, ends, strict=True)] == raw.split()


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT)
def test_trees_tell_texts_apart(a, b):
    x, y = merkle.Tree(a), merkle.Tree(b)
    assert (x.root == y.root) == (a == b)
    near = merkle.likeness(x, y)
    assert 0 <= near <= 1 and abs(near - merkle.likeness(y, x)) < 1e-9 and (near == 1 or a != b)
    mass, left, right = merkle.differing(x, y)
    assert mass + sum(e - s for s, e in left) == len(x.raw) and mass + sum(e - s for s, e in right) == len(y.raw)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 30), st.sampled_from([1, 40, 10**9, 10**18, 10**150]))
def test_dual_tree_search_is_exact(seed, n, k, size):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(n, 5)) * size)
    x[rng.random(n) < 0.3] = x[0]
    x[rng.random(n) < 0.5] /= size
    x = np.floor(x)
    ids = rng.permutation(n)[:n].astype(np.int64) // 2  # every id twice
    rows = np.arange(n) * 3
    at = np.flatnonzero(rng.random(n) < 0.2)
    found = topk.search(rows[at], x[at], np.full(len(at), topk.NONE, np.int64), rows, ids, x, k, topk.Tree(x[at], 8), topk.Tree(x, 8))
    got = set(zip(*[f.tolist() for f in found], strict=True))
    want = set()
    for i, r in enumerate(at):
        scores = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x[r], y, strict=True)))) for y in x]
        order = sorted((j for j in range(n) if j != r), key=lambda j: (-scores[j], ids[j], j))
        want |= {(i, j, scores[j]) for j in order[:k]}
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(2, 20))
def test_cover_trees_cover_nest_and_separate(seed, n, leaf):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(n, 3)) * 20)
    tree = topk.Tree(x, leaf)
    assert sorted(tree.order.tolist()) == list(range(n))
    for node in range(len(tree.low)):
        own, kids = x[tree.rows(node)], np.arange(tree.kid[node], tree.kid_end[node])
        assert np.sqrt(((own - tree.centre[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
        if len(kids):
            assert sorted(np.concatenate([tree.rows(c) for c in kids])) == sorted(tree.rows(node))
            gaps = np.sqrt(((tree.centre[kids][:, None] - tree.centre[kids][None]) ** 2).sum(axis=2))
            assert (tree.centre[kids[0]] == tree.centre[node]).all() and gaps[np.triu_indices(len(kids), 1)].min() + 1e-9 >= tree.radius[kids].max()
        else:
            assert len(own) <= leaf or tree.radius[node] == 0
    assert set(tree.place(x)[0].tolist()) <= set(np.flatnonzero(tree.leaf).tolist())
