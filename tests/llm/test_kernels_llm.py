import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldlark.llm import decontamination as D
from fieldlark.llm import near_dedup as N
from fieldlark.llm import packing as P
from fieldlark.llm import sharding as S
from fieldlark.llm import toxicity as X
from fieldlark.llm.blocks import blocks, ragged
from fieldlark.llm.pieces import Pieces, tokenizer_path

ODD = st.text(alphabet=st.sampled_from(list(" \n\t\x0b\x1c\x85\xa0abCD'.,!1éẸ́́ßΣς각<|> ")), max_size=60)


@given(st.lists(ODD, max_size=20))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    want = [(i, w.lower()) for i, t in enumerate(texts) for w in t.encode().split()]
    got, seen = [], {}
    for b in blocks(pa.array(texts, pa.string()), 40):
        for k, d in enumerate(b.doc_of_word()):
            w = b.word(k).lower()
            got.append((b.first + int(d), w))
            assert seen.setdefault(w, b.hashes[k]) == b.hashes[k]
    assert got == want and len(set(seen.values())) == len(seen)


@pytest.fixture(scope="module")
def memo():
    return Pieces(tokenizer_path())


@given(st.lists(st.one_of(ODD, st.sampled_from(["a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|> x", "don't WE'RE"])), max_size=12))
@settings(max_examples=60, deadline=None)
def test_pieces_are_the_library_s(memo, texts):
    want = [e.ids for e in memo.tokenizer.encode_batch(texts, add_special_tokens=False)]
    counts, ids = [], []
    for b in blocks(pa.array(texts, pa.string()), 64):
        counts += np.bincount(b.doc_of_word(), weights=memo.tokens(b)[0], minlength=b.n).astype(int).tolist()
        ids += memo.tokens(b)[1].tolist()
    assert counts == [len(w) for w in want] and ids == [i for w in want for i in w]


def test_memo_is_bounded(memo, monkeypatch):
    monkeypatch.setattr("fieldlark.llm.pieces.MEMO_WORDS", 50)
    texts = [f"w{i}x w{i % 40} y{i}" for i in range(200)]
    got = [n for b in blocks(pa.array(texts), 256) for n in np.bincount(b.doc_of_word(), weights=memo.tokens(b)[0], minlength=b.n).astype(int)]
    assert got == [len(e.ids) for e in memo.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_least(seed):
    rng = random.Random(seed)
    gaps = [rng.randint(1, 7) for _ in range(rng.randint(1, 10))]
    at = np.cumsum([0, *gaps])
    pen = np.array([0, *(rng.choice([0, 1, 3]) for _ in gaps)])
    pen[-1] = 0

    def least(j):
        return 0 if j == 0 else min(least(i) + 8 - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= 8)

    cuts = P.best_cuts(at, pen, 8)
    assert cuts[0] == 0 and cuts[-1] == len(at) - 1
    assert sum(8 - (at[j] - at[i]) + pen[j] for i, j in zip(cuts[:-1], cuts[1:])) == least(len(at) - 1)


def test_ragged():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_communication_matrix():
    rows = [7, 0, 30, 1, 13]
    m = S.communication_matrix(rows, 4, 3)
    assert m.sum(1).tolist() == rows and m.sum(0).max() - m.sum(0).min() <= 1
    mean = np.mean([S.communication_matrix([10, 30], 2, s)[0] for s in range(400)], axis=0)
    assert abs(mean - 5).max() < 0.25
    rng = np.random.default_rng(1)
    big = [S.hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 750) < 3


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    for n in (20, 200, 2000):
        for share in (0.6, 0.8, 0.95):
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            k = int(n * (1 - share) / (1 + share))
            a, b = np.unique(both[: n - k]), np.unique(both[k:])
            f = N.small_signature if n <= 200 else N.large_signature
            same = (f(a) == f(b)).mean()
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs(N.estimate(same, len(a), len(b)) - true) < 5 * np.sqrt(0.25 * (1 / N.BUCKETS + 1 / n))
    assert (N.large_signature(both[:3]) == N.large_signature(both[:3][::-1])).all()


def test_shingles():
    (b,) = blocks(pa.array(["A b  c", "a B\nc", "a", "", "b a", "a b a b a"]))
    s = N.shingle_sets(b, 2)
    assert [len(x) for x in s] == [2, 2, 1, 0, 1, 2]
    assert (s[0] == s[1]).all() and N.set_hash(s[0]) == N.set_hash(s[1]) != N.set_hash(s[5])


def levenshtein_in(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance_and_recall():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 60))).encode()) for i in range(120)]
    index = D.Index(items, 0.2)
    for _ in range(200):
        k = rng.randrange(len(items))
        text = rng.choices(vocab, k=rng.randint(0, 30)) + [w.decode() for w in items[k][1].split()][: rng.randint(1, 60)]
        (b,) = blocks(pa.array([" ".join(text)]))
        h = D.normal_hashes(b)
        assert index.distance(k, h)[0] == levenshtein_in(index.words[k].tolist(), h.tolist())
    for edits, least in ((0.0, 1.0), (0.1, 0.95), (0.18, 0.9)):
        texts = []
        for _, t in items:
            w = t.decode().split()
            for _ in range(int(len(w) * edits)):
                p = rng.randrange(len(w))
                w[p : p + rng.choice((0, 1))] = rng.choice(([], [rng.choice(vocab)]))
            texts.append(" ".join(rng.choices(vocab, k=50) + w + rng.choices(vocab, k=50)))
        found = {(b.first + d, i) for b in blocks(pa.array(texts)) for d, i, *_ in index.leaks(b)}
        assert sum((k, k) in found for k in range(len(items))) / len(items) >= least


@pytest.mark.parametrize("where", ["random", "start", "middle", "end"])
@pytest.mark.parametrize("size", [90, 100, 200, 400])
def test_recall_of_long_items(size, where):
    rng = random.Random(size)
    items = [(k, " ".join(rng.choices([f"w{i}" for i in range(3000)], k=size)).encode()) for k in range(60)]
    index, texts, n = D.Index(items, 0.2), [], int(size * 0.19)
    for _, t in items:
        w = t.decode().split()
        a = {"start": 0, "middle": (size - n) // 2, "end": size - n}.get(where)
        for p in rng.sample(range(size), n) if a is None else range(a, a + n):
            w[p] = rng.choice(("", f"new{rng.random()}", f"{w[p]} more{rng.random()}"))
        texts.append(" ".join([*(f"f{rng.randrange(5000)}" for _ in range(rng.randint(20, 60))), *w, "and the rest"]))
    found = {(b.first + d, i) for b in blocks(pa.array(texts)) for d, i, *_ in index.leaks(b)}
    assert sum((k, k) in found for k in range(len(items))) / len(items) >= 0.97


def test_nearest_is_exact():
    rng = np.random.default_rng(7)
    e = rng.random((700, 30)) * (rng.random((700, 30)) < 0.15)
    e = e[e.any(1)]
    e /= np.sqrt((e * e).sum(1, keepdims=True))
    label = rng.integers(0, 2, len(e))
    index = X.make_index([(np.flatnonzero(r), r[r > 0]) for r in e], label, np.arange(len(e)), 30, 7)
    assert sorted(index.ids.tolist()) == list(range(len(e))) and (index.label == label[index.ids]).all()
    e = e[index.ids]
    for _ in range(200):
        t = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        w = rng.random(len(t))
        at, cosine = index.nearest(t, w)
        every = e[:, t] @ w
        order = np.lexsort((np.arange(len(e)), -every))[:7]
        order = order[every[order] > 0]
        assert np.allclose(cosine, every[order]) and (at == order).all()


def test_cased_vocabulary_is_refused():
    from fieldlark.llm import pieces as P

    cased = [n for n in sorted(os.listdir(os.path.dirname(P.tokenizer_path()))) if n.endswith(".json") and n != P.DEFAULT_TOKENIZER]
    refused = 0
    for n in cased:
        try:
            P.Pieces(P.tokenizer_path(n))
        except ValueError:
            refused += 1
    assert refused or not cased
