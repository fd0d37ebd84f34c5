from ledgerloom.llm import containment as C
from ledgerloom.llm.common import WordHashes, shingle_hashes, word_hashes

from .helpers import AWKWARD, BASE, LONG, docs


def brute(rows, items, threshold=0.8):
    cache = WordHashes()
    out = set()
    sets = [(i, {*shingle_hashes(word_hashes(t, cache), whole_if_short=False).tolist()}) for i, t, _ in rows if i is not None]
    for item, text in items:
        s = {*shingle_hashes(word_hashes(text, cache), whole_if_short=False).tolist()}
        out |= {(i, item, len(s & d), len(s)) for i, d in sets if s and len(s & d) >= threshold * len(s)}
    return out


def test_whole_parted_and_scattered_items(spark):
    words = BASE.split()
    items = [
        (1, " ".join(words[10:60])), (2, " ".join(words[:5])), (3, "nothing of this stands anywhere here"), (4, None), (5, "too short"), (6, ""),
        (7, " ".join(LONG.split()[20_000:20_030] + ["oddly"])), (8, " ".join(words[10:60])), (9, LONG), (10, " ".join(words[:20] + words[60:80])),
    ]
    scattered = " ".join(words[10:35] + ["filler"] * 300 + words[31:60])
    rows = [*AWKWARD, (20, scattered, "en"), (21, "before " * 50 + " ".join(words[10:60]).upper() + " after" * 50, "en")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 3):
        got = {(r.doc_id, r.item_id, r.shared, r.shingles) for r in C.contained_items(docs(spark, rows), frame, block_items=block).collect()}
        assert got == brute(rows, items)
    assert C.contained_items(docs(spark, rows), frame.where("false")).count() == 0
    assert C.contained_items(docs(spark, []), frame).count() == 0


def test_short_items(spark):
    """Items under five words: phrases of a document, and whole documents in the filter; repeated items too."""
    rows = [(1, "Is it a Cat? yes", "en"), (2, "yes", "en"), (3, "a cat yes", "en"), (4, "no words of that", "en"), (5, "cat a", "en"), (None, "Yes!", "en")]
    items = [(1, "a cat"), (2, "yes"), (3, "A cat."), (4, "is it a cat"), (5, "..."), *[(6, "a cat yes")] * 4]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 2):
        got = sorted((r.doc_id, r.item_id, r.shared, r.shingles) for r in C.contained_items(docs(spark, rows), frame, block_items=block).collect())
        assert got == sorted([(1, i, 1, 1) for i in (1, 2, 3, 4)] + [(1, 6, 1, 1)] * 4 + [(2, 2, 1, 1)] + [(3, i, 1, 1) for i in (1, 2, 3)] + [(3, 6, 1, 1)] * 4)
        left = C.without_contained(docs(spark, rows), frame, block_items=block).collect()
        assert sorted(r.doc_id or 0 for r in left) == [1, 4, 5]
