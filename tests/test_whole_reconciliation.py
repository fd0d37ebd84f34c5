"""Rules and reports over the whole reconciliation, against loops over its pairs and the drafts of each rule."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom import queries as Q
from ledgerloom.operators import matching
from ledgerloom.plans import adapters

SF = "/root/testdata/sf0.001"
ONE_BY_ONE = ("whole_rule_r1", "whole_rule_r2", "whole_rule_r3", "rule_r4", "rule_r5", "rule_r6", "rule_r7", "rule_r8")


@pytest.fixture(scope="module")
def taken(spark):
    """Register row -> portal row, the greedy choice in a loop over equal and fuzzy pairs."""
    v = adapters.views(spark, SF)
    portal = matching.comparable(v["portal"])
    pairs = matching.number_pairs(v["books"], portal).unionByName(matching.fuzzy_pairs(v["books"], portal)).where(F.col("score") >= matching.SCORE_FLOOR)
    left, right = {}, set()
    for p in sorted(pairs.select("l_id", "r_id", "score").collect(), key=lambda p: (-p.score, p.l_id, p.r_id)):
        if p.l_id not in left and p.r_id not in right:
            left[p.l_id] = p.r_id
            right.add(p.r_id)
    return left


@pytest.fixture(scope="module")
def drafts(spark):
    found = {name: Q.QUERIES[name](spark, SF).collect() for name in ONE_BY_ONE}
    return [r for rows in found.values() for r in rows]


def test_coverage_and_r1_count_mistyped_numbers_as_matched(spark, taken):
    books = adapters.views(spark, SF)["books"].collect()
    total, matched = Counter((b.company_id, b.period) for b in books), Counter((b.company_id, b.period) for b in books if b.id in taken)
    got = {(r.company_id, r.period): (r.matched, r.total) for r in Q.QUERIES["whole_coverage_by_period"](spark, SF).collect()}
    assert got == {k: (matched[k], n) for k, n in total.items()}
    numbers = {(b.company_id, b.supplier_gstin, b.norm_invoice_no) for b in books if b.id in taken}
    lone = [b for b in books if b.id not in taken and (b.company_id, b.supplier_gstin, b.norm_invoice_no) not in numbers]
    r1 = Q.QUERIES["whole_rule_r1"](spark, SF).collect()
    assert sorted((r.company_id, r.period, r.headline) for r in r1) == sorted((b.company_id, b.period, b.cgst + b.sgst + b.igst + b.cess) for b in lone)
    assert len(r1) < Q.QUERIES["exact_rule_r1"](spark, SF).count()


def test_r2_compares_fuzzy_pairs_too(spark, taken):
    v = adapters.views(spark, SF)
    books, portal = {b.id: b for b in v["books"].collect()}, {p.id: p for p in v["portal"].collect()}
    off = [(books[b], portal[p]) for b, p in taken.items() if any(abs(books[b][a] - portal[p][a]) > 100 for a in matching.AMOUNTS)]
    got = sorted((r.company_id, r.period, r.headline) for r in Q.QUERIES["whole_rule_r2"](spark, SF).collect())
    assert got == sorted((b.company_id, b.period, abs(b.taxable - p.taxable)) for b, p in off)


def test_reports_count_the_findings_of_all_rules(spark, drafts):
    assert {"R1", "R4", "R5", "R6", "R8"} <= {d.rule_code for d in drafts}
    by_month, by_company = defaultdict(list), defaultdict(list)
    for d in drafts:
        by_month[d.company_id, d.period].append(d)
        by_company[d.company_id].append(d)
    months = {(r.company_id, r.period): r for r in Q.QUERIES["whole_range_report"](spark, SF).collect()}
    assert set(by_month) <= set(months)
    for k, r in months.items():
        n = Counter(d.severity for d in by_month[k])
        assert (r.n_high, r.n_medium, r.n_low, r.headline) == (n["high"], n["medium"], n["low"], sum(d.headline for d in by_month[k]))
    for r in Q.QUERIES["whole_range_totals"](spark, SF).collect():
        mine = by_company[r.company_id]
        assert (r.n_high, r.headline) == (sum(d.severity == "high" for d in mine), sum(d.headline for d in mine))
    for r in Q.QUERIES["whole_firm_dashboard"](spark, SF).collect():
        mine = by_company[r.company_id]
        assert (r.n_open, r.n_high, r.exposure) == (len(mine), sum(d.severity == "high" for d in mine), sum(d.headline for d in mine if d.rule_code == "R1"))
    weight = {"high": 1, "medium": 2, "low": 3, "info": 4}
    top = defaultdict(list)
    for r in sorted(Q.QUERIES["whole_topk_findings"](spark, SF).collect(), key=lambda r: r.rank):
        top[r.company_id].append((r.rule_code, r.risk_key, r.period))
    for c, mine in by_company.items():
        want = sorted(mine, key=lambda d: (weight[d.severity], -d.headline, d.rule_code, d.risk_key, d.period))[:40]
        assert top[c] == [(d.rule_code, d.risk_key, d.period) for d in want]
