import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.word_bpe import WordBpe

from .helpers import AWKWARD, SF, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]
    return [ids[k : k + 2048] for k in range(0, len(ids), 2048)]


def check(spark, rows):
    out = packing.best_fit_packing(docs(spark, rows)).collect()
    want = sorted((-1 if i is None else i, k, 2048 * k, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for i, t, _ in rows for k, p in enumerate(expected(t)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(r.length for r in out)


def test_awkward_rows(spark):
    check(spark, AWKWARD)
    assert packing.best_fit_packing(docs(spark, [])).count() == 0


def test_special_spellings_and_marks(spark):
    texts = ["a <|endoftext|> b", "x''s 's'll I'M", "tab\tnew\r\nline", "Ünïcödé × ÷ ß Ÿ", "\x1c sep \x85 \xa0", "ªº µ ¼"]
    check(spark, [(i, t, None) for i, t in enumerate(texts)])


def test_few_sequences(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    bins, tokens = check(spark, [(r.doc_id, r.text, r.lang) for r in frame.collect()])
    assert bins <= -(-tokens // 2048) * 1.02 + 1


def test_every_capacity_holds():
    rng = np.random.default_rng(0)
    length = np.sort(rng.integers(1, 100, 500))[::-1].astype(float)
    sizes = np.column_stack([length, np.ones(500), length**2])
    for rule in ("norm", "dot"):
        capacity = np.array([200.0, 5.0, 9000.0])
        bins, offsets = packing.best_fit(sizes[length**2 <= 9000], capacity, np.array([1.0, 0.2, 0.5]), rule)
        for b in np.unique(bins):
            assert (sizes[length**2 <= 9000][bins == b].sum(axis=0) <= capacity).all()


def test_cache_that_overflows():
    small, large = WordBpe(PATH, most=3), WordBpe(PATH)
    assert small.ids("one two three four five one") == large.ids("one two three four five one")
    texts = ["one two", None, "\x1c odd \x85", "x" * 5000 + " z1z1 " * 40, "“smart” – don’t", "a <|ENDOFTEXT|> b", ""]
    assert small.ids_of(texts) == [large.ids(t) for t in texts] == [np.array(expected(t)[0][:-1] if len(expected(t)) == 1 else sum(expected(t), [])[:-1], dtype="<u4").tobytes() for t in texts]


def one_by_one(sizes, capacity, weights, rule):
    """Best fit as it is told: each piece looks at every open sequence."""
    bins, left, used = [], [], []
    for size in sizes:
        best = None
        for b, room in enumerate(left):
            if (room >= size).all():
                rest = room - size
                score = -(room * weights / capacity * (size * weights / capacity)).sum() if rule == "dot" else ((rest * weights / capacity) ** 2).sum()
                if best is None or score < best[0]:
                    best = (score, b)
        if best is None:
            left.append(capacity.copy())
            used.append(0)
            best = (0, len(left) - 1)
        b = best[1]
        left[b] = left[b] - size
        bins.append((b, used[b]))
        used[b] += int(size[0])
    return bins


def test_like_one_by_one():
    """Small pieces, so that each of the three capacities turns pieces away; and ties."""
    rng = np.random.default_rng(3)
    for capacity in ([256, 512, 1.25 * 256**2], [256, 3, 1e9], [256, 512, 256.0**2]):
        for rule in ("norm", "dot"):
            length = np.sort(np.concatenate([rng.integers(1, 256, 150), rng.integers(1, 9, 150), np.full(40, 64)]))[::-1].astype(float)
            sizes, room, weights = packing.sizes_of(length), np.array(capacity, dtype=float), np.array(packing.WEIGHTS)
            bins, offsets = packing.best_fit(sizes, room, weights, rule)
            assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == one_by_one(sizes, room, weights, rule)


def test_documents_and_attention_bind():
    """At the registered values: tiny documents alone are bound by their number, beside a long one by attention."""
    room, weights = np.array([packing.SEQUENCE, packing.DOCUMENTS, 1.25 * packing.SEQUENCE**2]), np.array(packing.WEIGHTS)
    bins, _ = packing.best_fit(packing.sizes_of(np.full(2048, 1.0)), room, weights)
    assert np.bincount(bins).max() == packing.DOCUMENTS == 256
    sizes = packing.sizes_of(np.array([1900.0] + [1.0] * 148))
    bins, _ = packing.best_fit(sizes, room, weights)
    assert np.bincount(bins)[0] == 1 + 320 - 15**2  # 320 tiles of attention, 225 of them the long one's
    assert np.bincount(packing.best_fit(sizes, room * [1, 1, 2], weights)[0]).max() == 149
