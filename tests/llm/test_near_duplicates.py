import itertools
import random
from collections import Counter

import numpy as np

from ledgerloom.llm import dart_minhash as D

from .helpers import AWKWARD, docs


def brute(rows, threshold=0.8):
    """Classes by comparing all pairs of texts."""
    cache = D.WordHashes()
    known = {i: t for i, t, _ in rows if i is not None}
    sets = {i: D.weighted_set(t, cache, 5) for i, t in known.items() if t is not None}
    parent = {i: i for i in known}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if known[a] == known[b] or D.similarity(sets[a], sets[b]) >= threshold:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in known}


def test_awkward_rows(spark):
    out = D.near_duplicates(docs(spark, AWKWARD)).collect()
    assert {r.doc_id: r.class_id for r in out} == brute(AWKWARD)
    assert Counter(r.doc_id for r in out) == Counter(i for i, _, _ in AWKWARD if i is not None)


def test_empty_table(spark):
    assert D.near_duplicates(docs(spark, [])).count() == 0


def test_chains_and_a_large_bucket(spark):
    """Copies with edits of their own, more than a bucket compares pair by pair, around one original."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(100, " ".join(words), "en")]
    for i in range(60):
        w = list(words)
        for at in rng.sample(range(200), 3):
            w[at] = f"x{i}x{at}"
        rows.append((i, " ".join(w), "en"))
    rows += [(500 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(80)), "en") for i in range(30)]
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in D.near_duplicates(docs(spark, rows)).collect()}
    assert got == want
    assert len({want[i] for i in range(60)}) == 1


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = (D.sketch(ids, w, np.zeros(300, dtype=np.int64), 1, 4096)[0] for w in (wa, wb))
    assert abs((a == b).mean() - want) < 0.04


def test_sets_sketched_together_equal_sets_sketched_alone():
    rng = np.random.default_rng(2)
    sizes = [1, 3, 40, 700]
    parts = [(rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(1, 9, n).astype(float)) for n in sizes]
    owner = np.repeat(np.arange(4), sizes)
    both = D.sketch(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), owner, 4, 96)
    for k, (i, w) in enumerate(parts):
        assert (both[k] == D.sketch(i, w, np.zeros(len(i), dtype=np.int64), 1, 96)[0]).all()


def test_several_texts_under_one_id(spark):
    """Rows of a doc_id are one document: what resembles any of its texts is linked, and each text is compared."""
    rng = random.Random(5)
    a, b, c = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abc")
    rows = [(1, a, "en"), (1, b, "en"), (2, a + " x", "en"), (3, b + " y", "en"), (4, c, "en"), (5, c + " z", "en"), (1, None, "en"), (6, None, "en"), (7, b, "en")]
    out = D.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in out) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 1)]


def test_smallest_id_names_a_class_whatever_the_order(spark):
    """Class ids are doc_ids, not the numbers of texts."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(1000 - 3 * i - k, t + " more" * k, "en") for i, t in enumerate(texts) for k in range(3)]
    rows += [(2000 + i, texts[i], "en") for i in range(5)]
    got = {r.doc_id: r.class_id for r in D.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_hot_keys_give_the_same_classes(spark, monkeypatch):
    """Buckets and hubs over the bound, joined by broadcast, and more of them than are broadcast."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(40):
        w = list(words)
        for at in rng.sample(range(150), 2):
            w[at] = f"x{i}x{at}"
        rows.append((i, " ".join(w), "en"))
    rows += [(100 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50)), "en") for i in range(20)]
    want = brute(rows)
    for hot, most in ((3, 500_000), (3, 2)):
        monkeypatch.setattr(D, "HOT", hot)
        monkeypatch.setattr(D, "MOST_HOT", most)
        assert {r.doc_id: r.class_id for r in D.near_duplicates(docs(spark, rows)).collect()} == want
