"""Registry, runner, evidence and ageing, on small tables and against loops."""

import datetime
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import inbox, rules, runner
from ledgerloom.plans import adapters, evaluation, reports

SF = "/root/testdata/sf0.001"


def test_registry_turns_rules_on_and_off(spark):
    table = runner.registry(spark)
    assert set(runner.enabled(table)) == {"R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8"}
    changed = table.withColumn("enabled", F.col("code") == "R6").withColumn("thresholds", F.create_map(F.lit("min_credit_inr"), F.lit(7.0))).union(spark.createDataFrame([("R99", "gst", "NEW", True, {})], table.schema))
    assert runner.enabled(changed) == {"R6": {"min_credit_inr": 7.0}}
    assert "R99" in {r.code for r in runner.skipped(changed).collect()}


def test_run_retires_what_is_gone_and_keeps_decisions(spark):
    v = adapters.views(spark, SF)
    found = runner.run_rules(v, {"R4": {}, "R13": {}}, "2001-09-01")
    assert found.groupBy("company_id", "period", "risk_key").count().where("count > 1").count() == 0
    old = found.withColumn("status", F.when(F.col("rule_code") == "R4", "claim").otherwise("open")).withColumn("explanation", F.lit("said"))
    again = rules.upsert(old, runner.run_rules(v, {"R4": {}}, "2001-09-01"), [c for c, *_ in rules.REGISTRY])
    assert {(r.rule_code, r.status, r.explanation) for r in again.collect()} == {("R4", "claim", "said")}
    assert again.count() == found.where("rule_code = 'R4'").count()
    with pytest.raises(Exception, match="no such status"):
        runner.set_status(old, old.limit(1).select("company_id", "period", "risk_key", F.lit("maybe").alias("status"), F.lit(1).alias("at"))).collect()


def test_evidence_and_texts(spark):
    v = adapters.views(spark, SF)
    found = runner.run_rules(v, {c: rules.THRESHOLDS[c] for c in ("R1", "R2", "R4", "R6")}, "2001-09-01")
    assert found.where("calculation is null or size(metrics) = 0").count() == 0
    rows = runner.evidence_rows(found, v["sources"])
    assert rows.where("document is null or source_row is null").count() == 0
    assert {(r.rule_code, r.n) for r in rows.groupBy("rule_code", "risk_key", "period", "company_id").agg(F.count("*").alias("n")).collect()} == {("R1", 1), ("R2", 2), ("R4", 1), ("R6", 1)}


def test_ageing_equals_a_loop(spark):
    """All periods of all companies against receipts that pay the oldest sales first, in a loop; prepayments too."""
    rows = []
    for k in range(400):
        party, day = k % 7, date(2020, 1, 1) + timedelta(days=(k * 37) % 500)
        rows.append((k, party % 2, day.isoformat()[:7], "Receipt" if k % 3 == 0 else "Sales", day, None if k % 29 == 0 else party, None if k % 3 == 0 else 100 + k % 50, 90 + k % 70 if k % 3 == 0 else None))
    ledger = spark.createDataFrame(rows, "id long, company_id int, period string, voucher_type string, entry_date date, party_id long, debit long, credit long")
    periods = ledger.select("company_id", "period").distinct()
    want = {}
    for c, p in {(r[1], r[2]) for r in rows}:
        end = (date(int(p[:4]), int(p[5:]), 28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
        paid, total, aged, any_ = defaultdict(int), 0, 0, False
        mine = sorted((r for r in rows if r[1] == c and r[5] is not None and r[4] <= end), key=lambda r: (r[4], r[0]))
        for r in mine:
            paid[r[5]] += r[7] or 0
        for r in mine:
            if r[3] == "Sales":
                any_ = True
                used = min(r[6], paid[r[5]])
                paid[r[5]] -= used
                total += r[6] - used
                aged += r[6] - used if (end - r[4]).days > 90 else 0
        if any_:
            want[c, p] = (total, aged)
    got = {(r.company_id, r.period): (r.total, r.aged) for r in rules.ageing(ledger, periods, 90).collect()}
    assert got == want
    items = rules.open_items(ledger, periods).groupBy("company_id", "period").agg(F.sum("open").alias("t"), F.sum(F.when(F.col("age") > 90, F.col("open")).otherwise(0)).alias("a"))
    assert {(r.company_id, r.period): (r.t, r.a) for r in items.collect()} == want


def test_scores_are_exact_and_probable_is_told(spark):
    from ledgerloom.operators import matching

    day = date(2026, 8, 5)
    row = lambda p, g, no, d, t: {f"{p}_{k}": v for k, v in {"id": 1, "period": "2026-08", "supplier_gstin": g, "norm_invoice_no": no, "invoice_date": d, "taxable": t, "cgst": 0, "sgst": 0, "igst": 0, "cess": 0}.items()}
    cases = [
        (row("l", "G", "", day, 10000) | row("r", "G", "", day, 10000), 700, "partial"),  # blank numbers: 450 + 0 + 150 + 100
        (row("l", "G", "7", day, 10000) | row("r", "H", "7", day, 10000), 550, "probable"),
        (row("l", "G", "7", day, 10000) | row("r", "G", "7", day, 20000) | {"r_cgst": 500}, 850, "value_mismatch"),
        (row("l", "G", "7", day, 30000) | row("r", "G", "7", day, 29900), 1000, "exact"),  # 999.5 goes to the even thousand
        (row("l", "G", "7", day, 300) | row("r", "G", "8", date(2026, 9, 20), 450), 525, "fuzzy"),
    ]
    frame = spark.createDataFrame([c | {"company_id": 1, "number_ratio": 0.0, "nth": i} for i, (c, *_) in enumerate(cases)])
    got = {r.nth: (r.score_milli, r.category) for r in matching.scored(frame).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_evaluation_credits_footprints(spark):
    planted = spark.createDataFrame(
        [(0, 1, "late payment", "R5", "2026-01", "2026-02", "k", False), (1, 1, "lost", "R1", "2026-01", None, "gone", False), (2, 1, "hit", "R1", "2026-01", None, "here", False), (3, 1, "ims", "R10", "2026-01", None, "x", True)],
        "defect long, company_id int, defect_type string, rule_code string, period string, landing_period string, risk_key string, extended boolean",
    )
    findings = spark.createDataFrame([(1, "2026-02", "R5", "k", 5), (1, "2026-01", "R1", "here", 1), (1, "2026-01", "R1", "other", 2), (1, "2026-01", "R4b", "u", 2), (1, "2026-01", "R10", "x", 2)], "company_id int, period string, rule_code string, risk_key string, headline long")
    r = evaluation.summary(planted, findings).first()
    assert (r.planted, r.detected, r.missed, r.recall, r.row_findings, r.precision, r.period_detected, r.unscored) == (3, 2, 1, 0.667, 2, 0.5, 1, 1)
    assert [x.risk_key for x in evaluation.false_positives(planted, findings).collect()] == ["other"]
    assert [(x.defect, x.found_in) for x in evaluation.outcomes(planted, findings).where("defect = 0").collect()] == [(0, "2026-02")]
    assert evaluation.extended(planted, findings, ["R10"]).first().recall == 1.0 and evaluation.extended(planted, findings, []).first().recall is None


def test_report_helpers(spark, tmp_path):
    found = spark.createDataFrame([(1, "2026-01", "R1", "a", 5, {"sec_16_4_deadline": "2026-11-30"}), (1, "2026-02", "R1", "b", None, {"sec_16_4_deadline": "2027-11-30"})], "company_id int, period string, rule_code string, risk_key string, headline long, metrics map<string,string>")
    assert [r.so_far for r in reports.running_headlines(found).orderBy("period").collect()] == [5, 5]
    assert {r.deadline: r.findings for r in reports.by_deadline(found).collect()} == {"2026-11-30": 1, "2027-11-30": 1}
    inbox_rows = inbox.pending_allowed(F.col("d"), F.col("a"), F.col("w"))
    frame = spark.createDataFrame([("invoice", False, None, True), ("credit_note", False, None, False), ("invoice", True, "downward", False), ("invoice", True, "upward", True)], "d string, a boolean, w string, want boolean")
    assert frame.where(inbox_rows != F.col("want")).count() == 0
    planted = spark.createDataFrame([(0, 1, "k", "R1", "2026-01", None, "a", False)], "defect long, company_id int, defect_type string, rule_code string, period string, landing_period string, risk_key string, extended boolean")
    evaluation.write_report(planted, found, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().by_defect_type[0].detected == 1


def test_worst_parties_equal_single_sales(spark):
    """The parties with most aged at a period's end, against the open sales themselves; some periods didn't fire."""
    rng = random.Random(5)
    days = [datetime.date(2025, 1, 1) + datetime.timedelta(days=9 * k) for k in range(50)]
    rows = [(1 + i % 2, rng.randrange(9), i, rng.choice(days), *(("Sales", 100 * rng.randrange(1, 9), None) if rng.random() < 0.6 else ("Receipt", None, 100 * rng.randrange(1, 9)))) for i in range(300)]
    ledger = spark.createDataFrame(rows, "company_id int, party_id bigint, id bigint, entry_date date, voucher_type string, debit bigint, credit bigint")
    fired = spark.createDataFrame([(c, f"2025-{m:02}") for c in (1, 2) for m in (3, 6, 7, 11, 12)] + [(3, "2025-06")], "company_id int, period string")
    aged = {}
    for r in rules.open_items(ledger, fired).where("age > 90").collect():
        of = aged.setdefault((r["company_id"], r["period"]), {})
        of[r["party_id"]] = of.get(r["party_id"], 0) + r["open"]
    want = {k: [p for _, p in sorted((-x, p) for p, x in of.items() if x > 0)[:5]] for k, of in aged.items()}
    got = {(r["company_id"], r["period"]): [e["record_id"] for e in r["worst"]] for r in rules.worst_parties(ledger, fired, 90).collect()}
    assert got == {k: parties for k, parties in want.items() if parties}
    assert len(got) > 5
