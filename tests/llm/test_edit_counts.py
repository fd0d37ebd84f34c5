import random

from ledgerloom.llm import edit_counts as E

from .helpers import AWKWARD, docs


def brute(text, edits):
    for start, remove, insert in edits:
        start = max(0, min(start, len(text)))
        text = text[:start] + insert + text[min(len(text), start + max(0, remove)) :]
    return text


def test_random_edits_equal_full_recounts():
    count = E.Counter(E.vocabulary_path())
    rng = random.Random(4)
    pieces = ["word ", " two  spaces", "\n\nline", "a", "'s", "don't ", "12 34", "…", " ", "漢字 ", "x" * 40, ""]
    for _ in range(150):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 120)))
        tree = E.Tree.build(text, count, leaf=16)
        for _ in range(8):
            start, remove, insert = rng.randrange(0, len(text) + 3), rng.choice([0, 1, 5, 40]), "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 2, 30])))
            want = brute(text, [(start, remove, insert)])
            text, _ = tree.edit(text, start, remove, insert, count, leaf=16)
            assert text == want
            assert (tree.tokens[1], tree.chars[1]) == (count(text), len(text))
            assert all(tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1] for i in range(1, tree.size))


def test_tables(spark):
    count = E.Counter(E.vocabulary_path())
    logs = {1: [(3, 10, "new text "), (0, 0, "a")], 4: [(0, 0, "lost")], 5: [(0, 5, "into nothing")], 10: [(100_000, 7, " middle "), (10**9, 1, " end")], 99: [(0, 0, "nobody")]}
    edits = spark.createDataFrame([(d, k, *e) for d, es in logs.items() for k, e in enumerate(es)] + [(7, 0, None, None, None)], "doc_id long, seq int, start long, remove long, insert string")
    state = E.build_state(docs(spark, AWKWARD))
    out = E.apply_edits(E.with_edits(state, edits)).collect()
    assert len(out) == len(AWKWARD)
    texts = {i: t for i, t, _ in AWKWARD}
    for r in out:
        old = texts[r.doc_id]
        new = None if old is None else brute(old, logs.get(r.doc_id, []))
        assert (r.text, r.tokens_before, r.tokens_after) == (new, count(old or ""), count(new or ""))
    assert max(r.encoded_chars for r in out if r.doc_id == 10) < 10_000
    assert E.build_state(docs(spark, [])).count() == 0


def test_texts_without_spaces_have_many_leaves():
    """Cuts between letters and marks: counts still add up, and an edit re-encodes its neighbourhood alone."""
    count = E.Counter(E.vocabulary_path())
    rng = random.Random(5)
    for piece in ("漢字テスト、次の文。", "path/to/file_name.txt\n", "don't,I'll;we've's\t", "a1b2_c3²½"):
        text = "".join(piece[rng.randrange(len(piece)) :] for _ in range(2000))
        parts = E.runs(text)
        assert "".join(parts) == text and len(parts) > 5 and sum(map(count, parts)) == count(text)
        tree = E.Tree.build(text, count)
        new, encoded = tree.edit(text, 5000, 10, "new 1, text's", count)
        assert tree.tokens[1] == count(new) and encoded < 5 * E.LEAF
