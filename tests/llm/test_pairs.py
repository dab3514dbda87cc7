"""op1 and op5 against brute force: links, classes, hot groups, awkward rows."""

import collections
import random
import re

import numpy as np
import pytest

from lectio.llm import op01_near_vectors, op05_jaccard_join
from lectio.llm.components import components
from llm_documents import documents  # noqa: F401

LOWER = {c: c + 32 for c in range(65, 91)}


def classes(n, links):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def corpus(seed):
    """Random texts of all sizes, exact copies, chains of edits, and a passage that many share."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choices(words, k=60))
    texts = [None, "", "  \t ", "A", "a", "a b", "A  B", "é" * 20000, "one two three four five", "ONE two three\nfour five"]
    texts += [f"{' '.join(r.choices(words, k=r.randint(5, 60)))} {passage}" for _ in range(60)]
    for size in [6, 9, 12, 20, 30, 45, 80, 130, 300, 900]:
        for _ in range(6):
            w = r.choices(words, k=size)
            texts += [" ".join(w)] * 2
            for _ in range(6):  # a chain: each differs from the one before by some words at its ends
                w = w[max(1, size // r.choice([8, 12, 20, 40])):] + r.choices(words, k=r.choice([0, 1, max(1, size // 25)]))
                texts.append(" ".join(w))
    base = r.choices(words, k=200)
    for _ in range(150):  # a large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("tile", [1024, 40])
def test_jaccard_classes(spark, documents, monkeypatch, tile):
    monkeypatch.setattr(op05_jaccard_join, "TILE", tile)
    texts = corpus(tile)
    got = {r.doc_id: r for r in op05_jaccard_join.jaccard_classes(documents(texts).repartition(7)).collect()}
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * (both := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    assert len(links) > 2000
    want = classes(range(len(texts)), links)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert {i: r.component_id for i, r in got.items()} == want


def test_pigeonhole_signatures():
    """Sets that link share a signature in the band of the smaller one, whatever the sizes."""
    rng = np.random.default_rng(5)
    limits = op05_jaccard_join.bands(top=3000)
    plans = [op05_jaccard_join.allocate(a, b, 1e5) for a, b in limits]
    lows = np.array([a for a, _ in limits])
    for _ in range(600):
        n = int(rng.integers(4, 500))
        whole = rng.integers(0, 1 << 53, 2 * n, dtype=np.int64).astype(np.uint64)
        a = np.unique(whole[:n])
        drop, add = rng.integers(0, n // 8 + 2), rng.integers(0, n // 8 + 2)
        b = np.unique(np.concatenate([a[drop:], whole[n: n + add]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        flat, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        band = int(np.searchsorted(lows, min(len(a), len(b)), side="right") - 1)
        sig, row = op05_jaccard_join.signatures(flat, first, np.array([0, 1]), band, plans[band])
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (len(a), len(b), both)


def test_sketches_never_overestimate():
    rng = np.random.default_rng(2)
    for size in (1, 3, 200, 256, 257, 600, 3000):
        whole = rng.integers(0, 1 << 53, 2 * size, dtype=np.int64).astype(np.uint64)
        a = np.unique(whole[:size])
        for cut in (0, size // 9, size // 2, size):
            b = np.unique(np.concatenate([a[cut:], whole[size: size + cut // 2 + 1]]))
            drawn = op05_jaccard_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            off = int(op05_jaccard_join.apart(drawn[:1], drawn[1:])[0])
            assert off <= len(np.setxor1d(a, b)) and (cut < size or size < 200 or off > (len(a) + len(b)) / 9)


def test_one_of_each_judges_texts_that_share_an_id(spark, documents):
    a, b, near = "a b c d e f g h", "q w e r t y u i", " ".join(f"w{i}" for i in range(60))
    rows = [(5, a), (5, b), (2, b), (5, b), (7, near), (7, near + " x"), (7, near + " x"), (9, near + " x"), (4, None), (4, ""), (4, None), (None, a), (None, a), (3, a.upper()), (3, a.upper() + " ")]
    docs = documents([t for _, t in rows], ids=[i for i, _ in rows]).selectExpr("*", "1 as gone", "2 as twice", "'y' as set_hash", "3 as first_text", "4 as of")
    out = op05_jaccard_join.one_of_each(docs)
    got = sorted(((r.doc_id or -1), r.text or "") for r in out.collect())
    assert out.columns == docs.columns
    # b stays with id 2, a with id 3 (its smaller text), of the near texts one of id 7, all without words or id
    assert got[:2] == [(-1, a)] * 2 and got[2:7] == [(2, b), (3, a.upper()), (4, ""), (4, ""), got[6]]
    assert got[6] in [(7, near), (7, near + " x")] and len(got) == 7


def test_one_of_each(spark, documents):
    texts = ["a b c d e f g"] * 3 + [None, None, "q w e r t y u", "  "]
    out = op05_jaccard_join.one_of_each(documents(texts, ids=[5, 2, 2, 7, None, 9, 1]))
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 2, 7, 9]
    assert op05_jaccard_join.jaccard_classes(documents([])).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(3, 900), (900, 3), (4, 4), (None, 5)]
    links += [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(350)]
    got = {x.vertex: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = classes({x for e in real for x in e}, real)
    assert got == want


@pytest.mark.parametrize("block", [2048, 64])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(op01_near_vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 700)] + rng.normal(size=(700, 24)) * rng.choice([0.02, 0.18, 0.3], 700)[:, None]
    x[600:660] = x[5]  # equal vectors
    x[660] = x[5] * 2
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    awkward = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] + [1.0] * 23), (1005, [1.0, 0.0]), (1006, [2.0, 0.0]), (None, rows[0][1]), rows[3]]
    frame = spark.createDataFrame(rows + awkward, "vec_id long, embedding array<double>").selectExpr("*", "'x' as n_links", "1 as class")
    got = op01_near_vectors.near_vectors(frame.repartition(5)).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    links = [tuple(e) for e in np.argwhere(hit).tolist()] + [(1005, 1006)]
    degree = collections.Counter(a for a, _ in np.argwhere(hit).tolist()) + collections.Counter([1005, 1006])
    want = classes([i for i, _ in rows] + [i for i, _ in awkward[:7]], links)
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(rows) + len(awkward) and set(by_id) == set(want)
    for i, c in want.items():
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (degree[i], c, c == i), i
    assert op01_near_vectors.near_vectors(frame.limit(0)).count() == 0
