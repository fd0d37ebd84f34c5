"""The filter audit against all 120 orders applied one after another."""

import random
import re
from itertools import permutations

from ledgerloom.llm import filter_audit

from .helpers import AWKWARD, docs


def fails(rows):
    """The filters that each (doc_id, text, part) fails, in plain Python."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        out.append({k for k, v in bad.items() if v})
    return out


def by_hand(rows, quality, toxic):
    out = set()
    bad = fails(rows)
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, bad[k]) for k, (i, _, p) in enumerate(rows) if (p or "") == part]
        fair, steps = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fair[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), sum(f in b for _, b in mine) - len(gone), sum(b == {f} for _, b in mine), sum(i in quality for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out |= {(*s, fair[s[1][s[2] - 1]]) for s in steps}
    return out


def some_rows(seed=3, n=240):
    rng = random.Random(seed)
    words = ["plain", "Word", "UPPER", "a#b", "x", "nächst", "50%", " glued ", "漢字"]
    texts = [rng.choice([" ", "\t", "\n", "\x0b", "\x1c"]).join(rng.choice(words[: rng.randint(1, 9)]) + (str(k) if rng.random() < 0.7 else "") for k in range(rng.randint(0, 90))) for _ in range(60)]
    return [(rng.choice([k, k, rng.randint(0, 40), None]), rng.choice([*texts, None, ""]), rng.choice(["web", "book", "", None])) for k in range(n)]


def test_equals_all_orders(spark):
    rows = some_rows()
    labels = [(k, k % 3 == 0, k % 4 == 0) for k in range(0, 240, 2)] + [(2, True, None), (2, None, True), (None, True, True)]
    table = spark.createDataFrame([(a, None if b is None else int(b), None if c is None else int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_interactions(spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, n long, mask string"), table).collect()
    quality, toxic = {a for a, b, _ in labels if b and a is not None}, {a for a, _, c in labels if c and a is not None}
    assert len(got) == 3 * 600
    assert {tuple(r) for r in got} == by_hand(rows, quality, toxic)


def test_awkward_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs(spark, AWKWARD)
    got = filter_audit.filter_interactions(table, none).collect()
    assert {tuple(r) for r in got} == by_hand([(i, t, "s") for i, t, _ in AWKWARD], set(), set())
    assert filter_audit.filter_interactions(table.limit(0), none).count() == 0


def test_polynomial_is_the_game():
    rng = random.Random(1)
    counts = {m: rng.randint(0, 50) for m in range(32)}
    poly = filter_audit.polynomial(counts, 5)
    for on in range(32):
        assert filter_audit.corner(poly, on) == sum(c for m, c in counts.items() if m & on)
    assert sum(filter_audit.shapley(poly, i) for i in range(5)) == filter_audit.corner(poly, 31)
