"""Registered queries on rules, evidence, reports and evaluation."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import AS_OF, inr_sql, number_sql, register
from .functions import dates, text
from .operators import inbox as inbox_ops
from .operators import matching, rules, runner
from .plans import evaluation, nightly, reports
from .plans.adapters import ALL_INVOICES
from .plans.twins import BANK_STATE, DRAFTS, NUMBERED, PCT, REC, WHOLE
from .sources import lines

BASE = ("company_id", "period", "rule_code", "risk_key", "severity", "headline")
FS = DRAFTS + ", fs AS (SELECT *, CASE WHEN abs(headline) % 7 = 0 THEN 'resolved' ELSE 'open' END AS status FROM fo)"
FIRMS = "firms AS (SELECT r_regionkey AS firm_id, r_name AS name FROM region), companies AS (SELECT DISTINCT CAST(n_nationkey % 5 AS INT) AS company_id, first(n_name) OVER (PARTITION BY n_nationkey % 5 ORDER BY n_nationkey) AS name, CAST(n_nationkey % 5 AS INT) AS firm_id FROM nation)"
START, END = "1998-01", "1999-12"


def with_pct(found: DataFrame) -> DataFrame:
    return found.select(*BASE, F.col("pct").cast("double").alias("pct"))


def with_status(found: DataFrame) -> DataFrame:
    """Every seventh headline is taken as resolved."""
    return found.withColumn("status", F.when(F.abs("headline") % 7 == 0, "resolved").otherwise("open"))


def gst_matches(v) -> DataFrame:
    return matching.stored(matching.reconcile(v["books"], v["portal"]))


def bank_states(v) -> DataFrame:
    return matching.stored(matching.reconcile_bank(v["bank"], v["ledger"]))


def drafts(v, evidence: bool = True, everything: bool = False, gst: DataFrame | None = None, paid: DataFrame | None = None) -> DataFrame:
    table = runner.registry(v.spark)
    return runner.run_rules(v, runner.enabled(table.withColumn("enabled", F.lit(True)) if everything else table), AS_OF, evidence, gst, paid)


def findings(v, gst: DataFrame | None = None, paid: DataFrame | None = None) -> DataFrame:
    return with_status(drafts(v, evidence=False, gst=gst, paid=paid))


def companies(v) -> DataFrame:
    first = v["nation"].groupBy((F.col("n_nationkey") % 5).cast("int").alias("company_id")).agg(F.min_by("n_name", "n_nationkey").alias("name"))
    return first.withColumn("firm_id", F.col("company_id"))


def of_lines(v, paid: DataFrame) -> DataFrame:
    """The matches of bank lines with the lines' periods."""
    return paid.where("left_type = 'bank_txn'").join(v["bank"].select(F.col("id").alias("left_id"), "period"), "left_id")


@register("SELECT company_id, period, rule_code, risk_key, severity, headline, pct FROM fo", DRAFTS)
def run_rules(v):
    """Every rule that the default registry turns on."""
    return with_pct(drafts(v, evidence=False))


@register("SELECT company_id, period, rule_code, risk_key, severity, headline, pct FROM fa", DRAFTS)
def run_rules_all(v):
    """Every rule, as if a reviewer had turned all on."""
    return with_pct(drafts(v, evidence=False, everything=True))


@register("""SELECT code, title, count(fa.rule_code) AS unseen FROM (VALUES ('R4b', 'REVERSAL_RECLAIMABLE'), ('R9', 'IMS_ACTION_REQUIRED'), ('R10', 'IMS_RECOMMEND_REJECT'), ('R11', 'GSTR2B_STALE'), ('R12', 'FILING_CHAIN_BLOCKED'), ('R13', 'BLOCKED_CREDIT_17_5')) t(code, title)
LEFT JOIN fa ON rule_code = code GROUP BY 1, 2""", DRAFTS)  # fmt: skip
def rules_skipped(v):
    """The rules that are off, and how many findings nobody sees for that."""
    table = runner.registry(v.spark)
    found = runner.run_rules(v, runner.enabled(table.withColumn("enabled", ~F.col("enabled"))), AS_OF, False)
    unseen = found.groupBy(F.col("rule_code").alias("code")).agg(F.count("*").alias("unseen"))
    return runner.skipped(table).join(unseen, "code", "left").select("code", "title", F.coalesce("unseen", F.lit(0)).alias("unseen"))


@register("SELECT company_id, period, rule_code, risk_key, severity, headline FROM fa WHERE rule_code = 'R4' AND severity = 'high' OR rule_code = 'R6' AND headline >= 20000000", DRAFTS)
def run_rules_thresholds(v):
    """Rules as a registry table says that leaves two on and raises a threshold."""
    table = runner.registry(v.spark).where("code in ('R4', 'R6')").withColumn("thresholds", F.when(F.col("code") == "R6", F.create_map(F.lit("min_credit_inr"), F.lit(200_000.0))))
    return runner.run_rules(v, runner.enabled(table), AS_OF).where("rule_code = 'R6' or severity = 'high'").select(*BASE)


@register("SELECT ev.company_id, ev.period, rule_code, risk_key, nth, ev.record_type, ev.record_id, document, source_row FROM ev LEFT JOIN sources s ON s.record_type = ev.record_type AND s.record_id = ev.record_id", DRAFTS)
def findings_evidence(v):
    rows = runner.evidence_rows(drafts(v, everything=True), v["sources"])
    return rows.select("company_id", "period", "rule_code", "risk_key", "nth", "record_type", "record_id", "document", "source_row")


@register("SELECT rule_code, severity, count(*) AS findings, CAST(sum(headline) AS BIGINT) AS headline FROM fa GROUP BY 1, 2", DRAFTS)
def rule_tallies(v):
    return runner.tallies(drafts(v, evidence=False, everything=True))


@register(f"""SELECT company_id, period, 'R4:' || supplier_gstin || ':' || norm_invoice_no AS risk_key, 'the statement reverses ' || {inr_sql('reversal')} AS calculation,
'invoice_date: ' || CAST(invoice_date AS VARCHAR) || chr(10) || 'invoice_no: ' || norm_invoice_no || chr(10) || 'reversal_amount: ' || CAST(reversal AS VARCHAR) || chr(10) || 'reverse_by: ' || CAST(make_date(CASE WHEN month(invoice_date) >= 4 THEN year(invoice_date) ELSE year(invoice_date) - 1 END + 1, 11, 30) AS VARCHAR)
  || chr(10) || 'supplier_gstin: ' || supplier_gstin AS facts FROM portal WHERE reversal > 0 AND supplier_gstin IS NOT NULL""")  # fmt: skip
def findings_text(v):
    """The arithmetic and the facts of reversals, as a reader sees them."""
    found = rules.r4_reversal(v["portal"].where("supplier_gstin is not null"), AS_OF)
    facts = text.facts_text(F.map_filter("metrics", lambda k, x: k != "days_to_reversal_deadline"))
    return found.select("company_id", "period", "risk_key", "calculation", facts.alias("facts"))


@register("SELECT company_id, period, 'R4' || ' (' || CASE WHEN date_diff('day', DATE '2001-09-01', make_date(CASE WHEN month(invoice_date) >= 4 THEN year(invoice_date) ELSE year(invoice_date) - 1 END + 1, 11, 30)) <= 60 THEN 'high' ELSE 'medium' END || '): the statement reverses ' || " + inr_sql("reversal") + " || '. Reverse it.' AS explanation FROM portal WHERE reversal > 0", texts=ALL_INVOICES)
def findings_explained(v):
    found = rules.r4_reversal(v["portal"], AS_OF)
    return found.select("company_id", "period", text.plain_explanation(F.col("rule_code"), F.col("severity"), F.col("calculation"), F.lit("Reverse it.")).alias("explanation"))


CARDS = FS + f""", cg AS (SELECT company_id, period, count(*) FILTER (WHERE status = 'matched') AS gst_matched, count(*) AS gst_total FROM st GROUP BY 1, 2),
cb AS (SELECT b.company_id, b.period, count(*) FILTER (WHERE m.status = 'matched') AS bank_matched, count(*) AS bank_total FROM bm m JOIN bank b ON b.id = m.left_id WHERE m.left_type = 'bank_txn' GROUP BY 1, 2),
cf AS (SELECT company_id, period, sum(headline) FILTER (WHERE rule_code = 'R1') AS itc_at_risk, sum(headline) FILTER (WHERE rule_code = 'R2') AS itc_mismatch, sum(headline) FILTER (WHERE rule_code = 'R4') AS itc_reversal_37a, sum(headline) FILTER (WHERE rule_code = 'R5') AS bank_variance,
  sum(headline) FILTER (WHERE rule_code = 'R6') AS unidentified_deposits, max(pct) FILTER (WHERE rule_code = 'R7') AS concentration_pct, max(pct) FILTER (WHERE rule_code = 'R8') AS receivables_aged_pct, count(*) FILTER (WHERE status = 'open') AS open_risks,
  count(*) FILTER (WHERE status = 'open' AND severity = 'high') AS high_risks, count(*) FILTER (WHERE status = 'open' AND severity = 'medium') AS medium_risks, count(*) FILTER (WHERE status = 'open' AND severity = 'low') AS low_risks FROM fs GROUP BY 1, 2),
cards AS (SELECT *, {PCT.format(p="gst_matched", w="gst_total", n=1)} AS gst_coverage_pct, {PCT.format(p="bank_matched", w="bank_total", n=1)} AS bank_coverage_pct FROM (
  SELECT company_id, period, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gst_matched", "gst_total", "bank_matched", "bank_total", *reports.MONEY, "open_risks", "high_risks", "medium_risks", "low_risks"))}, concentration_pct, receivables_aged_pct
  FROM cg FULL JOIN cb USING (company_id, period) FULL JOIN cf USING (company_id, period)))"""
SUMMED = ("gst_matched", "gst_total", "bank_matched", "bank_total", *reports.MONEY, "open_risks", "high_risks", "medium_risks", "low_risks")


def cards(v) -> tuple[DataFrame, DataFrame]:
    """The cards and the findings that they show; matches are made once for both."""
    gst, paid = gst_matches(v), bank_states(v)
    found = findings(v, gst, paid)
    return matching.stored(reports.readiness(gst, of_lines(v, paid), found)), found


@register("SELECT * FROM cards", CARDS)
def readiness(v):
    return cards(v)[0]


@register(f""", mo AS (SELECT c.company_id, strftime(m, '%Y-%m') AS period FROM (SELECT DISTINCT company_id FROM periods) c, (SELECT unnest(generate_series(DATE '{START}-01', DATE '{END}-01', INTERVAL 1 MONTH)) AS m)),
mr AS (SELECT mo.company_id, mo.period, {", ".join(f"coalesce({c}, 0) AS {c}" for c in SUMMED)}, CAST(p.period IS NOT NULL AS BIGINT) AS present, CAST(coalesce(generated, false) AS BIGINT) AS generated, CAST(coalesce(filed, false) AS BIGINT) AS filed, CAST(1 AS BIGINT) AS months
  FROM mo LEFT JOIN cards c USING (company_id, period) LEFT JOIN periods p ON p.company_id = mo.company_id AND p.period = mo.period),
mt2 AS (SELECT * FROM mr UNION ALL SELECT company_id, 'total', {", ".join(f"CAST(sum({c}) AS BIGINT)" for c in (*SUMMED, "present", "generated", "filed", "months"))} FROM mr GROUP BY 1)
SELECT *, {PCT.format(p="gst_matched", w="gst_total", n=1)} AS gst_coverage_pct, {PCT.format(p="bank_matched", w="bank_total", n=1)} AS bank_coverage_pct FROM mt2""", CARDS)  # fmt: skip
def month_report(v):
    """Two years of every company with money, filing state and totals."""
    return reports.month_report(cards(v)[0], v["periods"], START, END)


DEADLINE = "CAST(make_date(CASE WHEN month(b.invoice_date) >= 4 THEN year(b.invoice_date) ELSE year(b.invoice_date) - 1 END + 1, 11, 30) AS VARCHAR)"
FIRM = CARDS + f""", lt AS (SELECT company_id, coalesce(max(period) FILTER (WHERE generated), max(period)) AS period FROM periods GROUP BY 1),
fd AS (SELECT fs.*, CASE WHEN rule_code = 'R1' THEN {DEADLINE} END AS deadline FROM fs LEFT JOIN books b ON fs.rule_code = 'R1' AND b.id = fs.record_id WHERE status = 'open'),
bo AS (SELECT company_id, count(*) AS all_open, count(*) FILTER (WHERE severity = 'high') AS all_high, CAST(coalesce(sum(headline) FILTER (WHERE rule_code = 'R1'), 0) AS BIGINT) AS exposure, min(deadline) AS next_deadline FROM fd GROUP BY 1),
be AS (SELECT bo.company_id, CAST(sum(headline) AS BIGINT) AS before_deadline, count(*) AS findings_before FROM bo JOIN fd ON fd.company_id = bo.company_id AND fd.deadline = bo.next_deadline GROUP BY 1),
fc AS (SELECT lt.company_id, lt.period, coalesce(gst_coverage_pct, 0) AS gst_coverage_pct, coalesce(bank_coverage_pct, 0) AS bank_coverage_pct, next_deadline, coalesce(bank_variance, 0) AS bank_variance, coalesce(open_risks, 0) AS open_risks,
  coalesce(all_open, 0) AS all_open, coalesce(all_high, 0) AS all_high, coalesce(exposure, 0) AS exposure, coalesce(before_deadline, 0) AS before_deadline, coalesce(findings_before, 0) AS findings_before
  FROM lt LEFT JOIN cards USING (company_id, period) LEFT JOIN bo ON bo.company_id = lt.company_id LEFT JOIN be ON be.company_id = lt.company_id)"""


def firm(v) -> DataFrame:
    made, found = cards(v)
    return reports.firm_cards(made, found, v["periods"])


@register("SELECT * FROM fc", FIRM)
def firm_cards(v):
    return firm(v)


@register("SELECT CAST(sum(exposure) AS BIGINT) AS exposure, min(next_deadline) AS soonest, CAST(sum(before_deadline) FILTER (WHERE next_deadline = (SELECT min(next_deadline) FROM fc)) AS BIGINT) AS due FROM fc", FIRM)
def firm_totals(v):
    return reports.firm_totals(matching.stored(firm(v)))


@register("SELECT company_id, coalesce(max(period) FILTER (WHERE generated), max(period)) AS latest FROM periods GROUP BY 1")
def latest_periods(v):
    return reports.latest_periods(v["periods"])


@register("SELECT p.company_id, p.period, status, generated, filed, coalesce(n, 0) AS open_risks, CAST(row_number() OVER (PARTITION BY p.company_id ORDER BY p.period DESC) AS INT) AS rank FROM periods p LEFT JOIN (SELECT company_id, period, count(*) AS n FROM fs WHERE status = 'open' GROUP BY 1, 2) r ON r.company_id = p.company_id AND r.period = p.period", FS)
def period_list(v):
    return reports.period_list(v["periods"], findings(v)).select("company_id", "period", "status", "generated", "filed", "open_risks", "rank")


TITLES = ", ru AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{d}', '{t}')" for c, d, t, *_ in rules.REGISTRY) + ") t(code, domain, title))"


@register(TITLES + f""" SELECT fs.company_id, fs.period, fs.rule_code, fs.risk_key, severity, headline, title, domain, CAST(coalesce(n, 0) AS INT) AS n_evidence,
CAST(row_number() OVER (PARTITION BY fs.company_id ORDER BY fs.period DESC, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, headline DESC NULLS LAST, fs.rule_code, fs.risk_key) AS INT) AS place
FROM fs JOIN ru ON code = rule_code LEFT JOIN (SELECT company_id, period, risk_key, count(DISTINCT nth) AS n FROM ev GROUP BY 1, 2, 3) e ON e.company_id = fs.company_id AND e.period = fs.period AND e.risk_key = fs.risk_key WHERE fs.period BETWEEN '{START}' AND '{END}'""", FS)  # fmt: skip
def findings_in_range(v):
    found = with_status(drafts(v))
    return reports.findings_in_range(found, runner.registry(v.spark), START, END).select(*BASE, "title", "domain", "n_evidence", "place")


@register(TITLES + ", " + FIRMS + """ SELECT f.company_id, f.period, f.risk_key, f.rule_code, title, domain, c.name AS company_name, f.record_id AS purchase, st.status AS match_status, CASE st.status WHEN 'matched' THEN category WHEN 'duplicate' THEN 'none' ELSE 'orphan_pr' END AS match_method, st.amount_delta, s.document, s.source_row
FROM fa f JOIN ru ON code = f.rule_code JOIN companies c ON c.company_id = f.company_id JOIN st ON st.id = f.record_id LEFT JOIN sources s ON s.record_type = 'purchase_invoice' AND s.record_id = f.record_id WHERE f.rule_code IN ('R1', 'R2', 'R3')""", DRAFTS)  # fmt: skip
def finding_detail(v):
    """Findings on purchases with their rule, company, first record and its match."""
    table = runner.registry(v.spark).where("code in ('R1', 'R2', 'R3')")
    gst = gst_matches(v)
    found = runner.run_rules(v, runner.enabled(table), AS_OF, gst=gst)
    out = reports.finding_detail(found, table, runner.evidence_rows(found, v["sources"]), gst, companies(v))
    first = F.element_at("records", 1)
    return out.select("company_id", "period", "risk_key", "rule_code", "title", "domain", "company_name", "purchase", "match_status", "match_method", "amount_delta", first["document"].alias("document"), first["source_row"].alias("source_row"))


@register(TITLES + " SELECT company_id, domain, count(*) AS findings FROM fa JOIN ru ON code = rule_code GROUP BY 1, 2", DRAFTS)
def domain_counts(v):
    return reports.domain_counts(drafts(v, evidence=False, everything=True), runner.registry(v.spark))


@register("WITH " + FIRMS + " SELECT c.company_id, c.name, c.firm_id, f.name AS firm_name FROM companies c JOIN firms f USING (firm_id)")
def company_header(v):
    return reports.company_header(companies(v), v["region"].select(F.col("r_regionkey").alias("firm_id"), F.col("r_name").alias("name"))).select("company_id", "name", "firm_id", "firm_name")


@register("SELECT 'books' AS \"table\", count(*) AS rows FROM books UNION ALL SELECT 'portal', count(*) FROM portal UNION ALL SELECT 'bank', count(*) FROM bank UNION ALL SELECT 'ledger', count(*) FROM ledger UNION ALL SELECT 'inbox', count(*) FROM inbox")
def row_counts(v):
    return reports.row_counts({n: v[n] for n in ("books", "portal", "bank", "ledger", "inbox")})


@register("""SELECT company_id, period, section, note_type, count(*) AS documents, CASE WHEN note_type = 'C' THEN 'Credit notes' WHEN note_type = 'D' THEN 'Debit notes' WHEN section = 'ISD' THEN 'Input service distributor' WHEN section = 'IMPG' THEN 'Imports of goods' ELSE section END AS label FROM portal GROUP BY 1, 2, 3, 4""")
def section_counts(v):
    return reports.section_counts(v["portal"])


@register("""WITH e AS (SELECT company_id, id, period, CASE WHEN lag(period) OVER w IS NULL OR lag(period) OVER w <> period THEN 1 ELSE 0 END AS first FROM books WINDOW w AS (PARTITION BY company_id ORDER BY id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY company_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT company_id, CAST(run AS BIGINT) AS run, period, min(id) AS starts_at, count(*) AS rows FROM s GROUP BY 1, 2, 3""")  # fmt: skip
def period_runs(v):
    return reports.period_runs(v["books"], "id")


@register("SELECT company_id, period, rule_code, risk_key, CAST(sum(headline) OVER (PARTITION BY company_id ORDER BY period, headline NULLS FIRST, rule_code, risk_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM fo", DRAFTS)
def running_headlines(v):
    return reports.running_headlines(drafts(v, evidence=False)).select("company_id", "period", "rule_code", "risk_key", "so_far")


@register("SELECT fa.company_id, CAST(deadline AS VARCHAR) AS deadline, count(*) AS findings, CAST(sum(fa.headline) AS BIGINT) AS headline FROM fa JOIN r1 ON fa.rule_code = 'R1' AND r1.id = fa.record_id GROUP BY 1, 2", DRAFTS)
def headlines_by_deadline(v):
    return reports.by_deadline(drafts(v, evidence=False))


@register("""WITH f AS (SELECT company_id, id, sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY company_id ORDER BY txn_date, id ROWS UNBOUNDED PRECEDING) AS flow FROM bank)
SELECT company_id, id, CAST(100000 - least(min(flow) OVER (PARTITION BY company_id), 0) + flow AS BIGINT) AS balance FROM f""")  # fmt: skip
def running_balance(v):
    return reports.running_balance(v["bank"], 100_000).select("company_id", "id", "balance")


@register("SELECT company_id, period, risk_key, CASE WHEN rule_code = 'R4' THEN 'resolved' ELSE 'open' END AS status FROM fo WHERE rule_code IN ('R4', 'R6')", DRAFTS)
def findings_marked(v):
    """Findings after a reviewer has marked some, of which the last mark counts, and after the rules have run again."""
    found = runner.run_rules(v, {c: rules.THRESHOLDS[c] for c in ("R4", "R6")}, AS_OF).withColumn("status", F.lit("open")).withColumn("explanation", F.lit(None).cast("string"))
    marks = found.where("rule_code = 'R4'").select("company_id", "period", "risk_key", F.explode(F.array(F.struct(F.lit("ignored").alias("status"), F.lit(1).alias("at")), F.struct(F.lit("resolved").alias("status"), F.lit(2).alias("at")))).alias("m")).select("company_id", "period", "risk_key", "m.*")
    marked = matching.stored(runner.set_status(found, marks))
    again = rules.upsert(marked, found.drop("status", "explanation"), ["R4", "R6"])
    return again.select("company_id", "period", "risk_key", "status")


@register("SELECT company_id, period, rule_code, risk_key, severity, headline, CASE WHEN rule_code = 'R4' THEN 'claim' ELSE 'open' END AS status FROM fo", DRAFTS)
def nightly_recompute(v):
    """All rules again, over findings of which some are decided and some belong to a rule that is off by now."""
    old = runner.run_rules(v, {c: {} for c in ("R4", "R13")}, AS_OF).withColumn("status", F.lit("claim")).withColumn("explanation", F.lit("said"))
    return runner.recompute(v, runner.registry(v.spark), old, AS_OF).select(*BASE, "status")


# The answer key: what the adapter views disturb on purpose, and one finding that nothing plants.
PLANTED = """planted AS (SELECT row_number() OVER (ORDER BY rule_code, id) AS defect, * FROM (
  SELECT company_id, 'reversal' AS defect_type, 'R4' AS rule_code, period, CAST(NULL AS VARCHAR) AS landing_period, 'R4:' || supplier_gstin || ':' || norm_invoice_no AS risk_key, id, false AS extended FROM portal WHERE reversal > 0 AND supplier_gstin IS NOT NULL AND id % 3 = 0
  UNION ALL SELECT company_id, 'unknown deposit', 'R6', period, NULL, 'R6:' || CAST(id AS VARCHAR), id, false FROM bank WHERE id >= 5000000000000
  UNION ALL SELECT company_id, 'moved', 'R4', '1990-01', period, 'R4:' || supplier_gstin || ':' || norm_invoice_no, id + 9000000000000, false FROM portal WHERE reversal > 0 AND supplier_gstin IS NOT NULL AND id % 3 = 1
  UNION ALL SELECT company_id, 'blocked', 'R13', period, NULL, 'R13:' || supplier_gstin || ':' || norm_invoice_no, id, true FROM portal WHERE NOT itc_available AND supplier_gstin IS NOT NULL))"""
EVAL = DRAFTS + ", " + PLANTED + """, ff AS (SELECT * FROM fa WHERE rule_code IN ('R4', 'R6', 'R13')),
fp AS (SELECT defect, company_id, period AS at, risk_key FROM planted UNION SELECT defect, company_id, landing_period, risk_key FROM planted WHERE landing_period IS NOT NULL),
oc AS (SELECT p.*, EXISTS (SELECT 1 FROM fp JOIN ff ON ff.company_id = fp.company_id AND ff.period = fp.at AND ff.risk_key = fp.risk_key WHERE fp.defect = p.defect) AS detected FROM planted p)"""


def planted(v) -> DataFrame:
    number = "concat('{0}:', supplier_gstin, ':', norm_invoice_no) as risk_key"
    key = lambda df, kind, rule, risk, period="period", landing="cast(null as string)", ext="false": df.selectExpr("company_id", f"'{kind}' as defect_type", f"'{rule}' as rule_code", f"{period} as period", f"{landing} as landing_period", risk, "id", f"{ext} as extended")
    back = v["portal"].where("reversal > 0 and supplier_gstin is not null")
    rows = key(back.where("id % 3 = 0"), "reversal", "R4", number.format("R4"))
    rows = rows.union(key(v["bank"].where("id >= 5000000000000"), "unknown deposit", "R6", "concat('R6:', cast(id as string)) as risk_key"))
    rows = rows.union(key(back.where("id % 3 = 1"), "moved", "R4", number.format("R4"), "'1990-01'", "period"))
    rows = rows.union(key(v["portal"].where("not itc_available and supplier_gstin is not null"), "blocked", "R13", number.format("R13"), ext="true"))
    return matching.stored(rows.withColumn("defect", F.monotonically_increasing_id()))


def scored_findings(v) -> DataFrame:
    return runner.run_rules(v, {c: rules.THRESHOLDS[c] for c in ("R4", "R6", "R13")}, AS_OF)


@register("""SELECT o.*, coalesce(f.row_findings, 0) AS row_findings, coalesce(f.period_findings, 0) AS period_findings, coalesce(f.unscored, 0) AS unscored, planted - detected AS missed,
  CASE WHEN planted > 0 THEN round_even(CAST(detected AS DOUBLE) / planted, 3) ELSE 0 END AS recall, CASE WHEN row_findings > 0 THEN round_even(CAST(row_detected AS DOUBLE) / row_findings, 3) ELSE 0 END AS precision
FROM (SELECT company_id, count(*) AS planted, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE rule_code IN ('R4', 'R6')) AS row_planted, count(*) FILTER (WHERE detected AND rule_code IN ('R4', 'R6')) AS row_detected, CAST(0 AS BIGINT) AS period_planted, CAST(0 AS BIGINT) AS period_detected FROM oc WHERE NOT extended GROUP BY 1) o
LEFT JOIN (SELECT company_id, count(*) FILTER (WHERE rule_code IN ('R4', 'R6')) AS row_findings, CAST(0 AS BIGINT) AS period_findings, CAST(0 AS BIGINT) AS unscored FROM ff GROUP BY 1) f USING (company_id)""", EVAL)  # fmt: skip
def evaluation_summary(v):
    return evaluation.summary(planted(v), scored_findings(v))


@register("SELECT company_id, extended, defect_type, rule_code, count(*) AS planted, count(*) FILTER (WHERE detected) AS detected FROM oc GROUP BY 1, 2, 3, 4", EVAL)
def evaluation_by_defect(v):
    return evaluation.by_defect(planted(v), scored_findings(v))


@register("SELECT company_id, period, rule_code, risk_key, headline FROM ff WHERE rule_code IN ('R4', 'R6') AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.company_id = ff.company_id AND fp.at = ff.period AND fp.risk_key = ff.risk_key)", EVAL)
def evaluation_false_positives(v):
    return evaluation.false_positives(planted(v), scored_findings(v)).select("company_id", "period", "rule_code", "risk_key", "headline")


@register("""SELECT o.*, coalesce(row_findings, 0) AS row_findings, CASE WHEN scored_planted > 0 THEN round_even(CAST(detected AS DOUBLE) / scored_planted, 3) END AS recall, CASE WHEN row_findings > 0 THEN round_even(CAST(row_detected AS DOUBLE) / row_findings, 3) END AS precision
FROM (SELECT company_id, count(*) AS planted, count(*) AS scored_planted, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE detected) AS row_detected FROM oc WHERE extended GROUP BY 1) o LEFT JOIN (SELECT company_id, count(*) AS row_findings FROM ff WHERE rule_code = 'R13' GROUP BY 1) f USING (company_id)""", EVAL)  # fmt: skip
def evaluation_extended(v):
    return evaluation.extended(planted(v), scored_findings(v), ["R13"])


@register("SELECT id, CAST(make_date(fy + 1, 11, 30) AS VARCHAR) AS deadline, CAST(fy AS VARCHAR) || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS financial_year, CAST(date_diff('day', DATE '1999-06-01', make_date(fy + 1, 11, 30)) AS INT) AS days_left, make_date(fy + 1, 11, 30) < DATE '1999-06-01' AS passed FROM (SELECT id, CASE WHEN month(invoice_date) >= 4 THEN year(invoice_date) ELSE year(invoice_date) - 1 END AS fy FROM invoices)")
def credit_clock(v):
    told = dates.days_left(F.col("invoice_date"), F.lit("1999-06-01").cast("date"))
    return v["invoices"].select("id", told.alias("t")).select("id", F.col("t.deadline").cast("string").alias("deadline"), "t.financial_year", "t.days_left", "t.passed")


@register("""WITH x AS (SELECT company_id, min(period) AS a, max(period) AS z FROM books GROUP BY 1), y AS (SELECT *, CAST(z || '-01' AS DATE) AS d, CASE WHEN substring(z, 6, 2) >= '04' THEN substring(z, 1, 4) ELSE CAST(CAST(substring(z, 1, 4) AS INT) - 1 AS VARCHAR) END || '-04' AS fy FROM x)
SELECT company_id, 'latest' AS name, z AS start, z AS "end" FROM y UNION ALL SELECT company_id, 'last_3', greatest(a, strftime(d - INTERVAL 2 MONTH, '%Y-%m')), z FROM y UNION ALL SELECT company_id, 'last_6', greatest(a, strftime(d - INTERVAL 5 MONTH, '%Y-%m')), z FROM y
UNION ALL SELECT company_id, 'financial_year', greatest(a, fy), z FROM y UNION ALL SELECT company_id, 'all', a, z FROM y""")  # fmt: skip
def range_presets(v):
    ends = v["books"].groupBy("company_id").agg(F.min("period").alias("a"), F.max("period").alias("z"))
    return ends.select("company_id", F.explode(dates.range_presets(F.col("a"), F.col("z"))).alias("name", "r")).select("company_id", "name", "r.start", F.col("r.end").alias("end"))


@register("SELECT company_id, period, (date_diff('month', CAST(period || '-01' AS DATE), DATE '2001-12-01') BETWEEN 0 AND 59) AS ok FROM periods")
def valid_ranges(v):
    return v["periods"].select("company_id", "period", dates.valid_range(F.col("period"), F.lit("2001-12")).alias("ok"))


@register("SELECT l_orderkey, l_linenumber, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', CAST(('0x' || h[17:17])::INT % 4 AS INT) + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM (SELECT l_orderkey, l_linenumber, sha1(unhex('6f9b2b1e7c2a5d3f8a4b1c2d3e4f5a6b') || encode('line:' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR))) AS h FROM lineitem)")
def stable_ids(v):
    return v["lineitem"].select("l_orderkey", "l_linenumber", text.stable_id("line", F.col("l_orderkey"), F.col("l_linenumber")).alias("id"))


def hundredths(n: str) -> str:
    """A whole number of hundredths with two decimals, in SQL."""
    return f"CAST({n} // 100 AS VARCHAR) || '.' || lpad(CAST({n} % 100 AS VARCHAR), 2, '0')"


@register(f"SELECT id, CASE WHEN t >= 1000000000 THEN '₹' || {hundredths('(t + 5000000) // 10000000')} || ' Cr' WHEN t >= 10000000 THEN '₹' || {hundredths('(t + 50000) // 100000')} || ' L' ELSE '₹' || {inr_sql('t')} END AS short, CASE WHEN t >= 10000000 THEN '₹' || {inr_sql('t')} END AS exact FROM (SELECT id, taxable * 7 AS t FROM invoices)")
def short_amounts(v):
    t = F.col("taxable") * 7
    return v["invoices"].select("id", text.short_inr(t).alias("short"), text.exact_inr(t).alias("exact"))


# An answer key as its files have it: what is planted is told by natural keys, not by findings' keys.
KEYED = """, dk AS (
  SELECT company_id, 'reversal' AS defect_type, 'R4' AS rule_code, CASE WHEN id % 3 = 0 THEN period ELSE '1990-01' END AS period, CASE WHEN id % 3 = 1 THEN period END AS landing_period, 'R4:' || supplier_gstin || ':' || norm_invoice_no AS risk_key, id, false AS extended FROM portal WHERE reversal > 0 AND supplier_gstin IS NOT NULL AND id % 3 <> 2
  UNION ALL SELECT company_id, 'unknown deposit', 'R6', period, NULL, 'R6:' || CAST(id AS VARCHAR), id, false FROM bank WHERE id >= 5000000000000
  UNION ALL SELECT company_id, 'variance', 'R5', period, NULL, 'R5:bank_books_variance', 0, false FROM periods WHERE period LIKE '1998%'
  UNION ALL SELECT company_id, 'concentration', 'R7', period, NULL, 'R7:customer_concentration', 0, false FROM periods WHERE period LIKE '1999%'
  UNION ALL SELECT company_id, 'blocked', 'R13', period, NULL, 'R13:' || supplier_gstin || ':' || norm_invoice_no, id, true FROM portal WHERE NOT itc_available AND supplier_gstin IS NOT NULL
  UNION ALL SELECT company_id, 'ageing', 'R8', period, NULL, 'R8:receivables_ageing', 0, true FROM periods WHERE period LIKE '2000%'),
dn AS (SELECT row_number() OVER (ORDER BY rule_code, company_id, period, id) AS n, * FROM dk),
dh AS (SELECT dn.*, EXISTS (SELECT 1 FROM fa WHERE fa.company_id = dn.company_id AND fa.risk_key = dn.risk_key AND fa.period IN (dn.period, dn.landing_period)) AS detected FROM dn)"""


#: The same with the numbers of blocked documents by their key, as `expected` makes it of what the key's file spells.
SPELT = KEYED.replace("'R13:' || supplier_gstin || ':' || norm_invoice_no", "'R13:' || supplier_gstin || ':' || " + number_sql("norm_invoice_no"))


def answer_key(v) -> DataFrame:
    """The defects of the adapter views, with numbers as feeds spell them."""
    text_ = lambda x: F.lit(x)
    kind = lambda df, name, rule, target, key, period=F.col("period"), extended=False: df.select("company_id", text_(name).alias("defect_type"), text_(rule).alias("expected_rule"), period.alias("period"), text_(target).alias("target_kind"), F.create_map(*(x for k, c in key.items() for x in (F.lit(k), c))).cast("map<string,string>").alias("natural_key"), F.lit(0).cast("bigint").alias("amount"), F.lit("").alias("note"), F.lit(extended).alias("extended"))
    doc = {"supplier_gstin": F.col("supplier_gstin"), "number": F.col("norm_invoice_no")}
    back = v["portal"].where("reversal > 0 and supplier_gstin is not null and id % 3 <> 2")
    moved = doc | {"landing_period": F.when(F.col("id") % 3 == 1, F.col("period"))}
    rows = kind(back, "reversal", "R4", "gstr2b_line", moved, F.when(F.col("id") % 3 == 0, F.col("period")).otherwise("1990-01"))
    rows = rows.union(kind(v["bank"].where("id >= 5000000000000"), "unknown deposit", "R6", "bank_txn", {"ref_no": F.col("id").cast("string")}))
    for year, name, rule, extended in (("1998", "variance", "R5", False), ("1999", "concentration", "R7", False), ("2000", "ageing", "R8", True)):
        rows = rows.union(kind(v["periods"].where(F.col("period").startswith(year)), name, rule, "company", {"none": F.lit("")}, extended=extended))
    blocked = v["portal"].where("not itc_available and supplier_gstin is not null")
    return rows.union(kind(blocked, "blocked", "R13", "gstr2b_line", doc | {"number": F.concat(F.lit("Invoice No. "), "norm_invoice_no")}, extended=True))


@register(DRAFTS + KEYED + """ SELECT o.*, coalesce(row_findings, 0) AS row_findings, coalesce(period_findings, 0) AS period_findings, coalesce(unscored, 0) AS unscored, planted - detected AS missed,
  CASE WHEN planted > 0 THEN round_even(CAST(detected AS DOUBLE) / planted, 3) ELSE 0 END AS recall, CASE WHEN row_findings > 0 THEN round_even(CAST(row_detected AS DOUBLE) / row_findings, 3) ELSE 0 END AS precision
FROM (SELECT company_id, count(*) AS planted, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE rule_code IN ('R4', 'R6')) AS row_planted, count(*) FILTER (WHERE detected AND rule_code IN ('R4', 'R6')) AS row_detected,
  count(*) FILTER (WHERE rule_code IN ('R5', 'R7')) AS period_planted, count(*) FILTER (WHERE detected AND rule_code IN ('R5', 'R7')) AS period_detected FROM dh WHERE NOT extended GROUP BY 1) o
LEFT JOIN (SELECT company_id, count(*) FILTER (WHERE rule_code IN ('R1', 'R2', 'R3', 'R4', 'R6')) AS row_findings, count(*) FILTER (WHERE rule_code IN ('R5', 'R7')) AS period_findings, count(*) FILTER (WHERE rule_code = 'R4b') AS unscored FROM fa GROUP BY 1) f USING (company_id)""")  # fmt: skip
def evaluation_of_key(v):
    """An answer key of natural keys, period rules among it, against all rules: one of them (R4b) is in no key."""
    return evaluation.summary(evaluation.expected(answer_key(v)), drafts(v, evidence=False, everything=True))


@register(DRAFTS + SPELT + " SELECT company_id, extended, defect_type, rule_code, count(*) AS planted, count(*) FILTER (WHERE detected) AS detected FROM dh GROUP BY 1, 2, 3, 4")
def evaluation_of_key_by_defect(v):
    return evaluation.by_defect(evaluation.expected(answer_key(v)), drafts(v, evidence=False, everything=True))


@register("SELECT company_id, period, rule_code, risk_key, severity, headline FROM fo WHERE rule_code IN ('R1', 'R2', 'R3', 'R4')", DRAFTS)
def nightly_resumed(v):
    """Two nights: on the second two companies have more rows, the run dies between its stages and is started again. Only these two
    are done anew, and all is as if done at once."""
    at = nightly.Nightly(v.spark, matching.scratch_path(v.spark, "nightly"))
    on = {c: rules.THRESHOLDS[c] for c in ("R1", "R2", "R3", "R4")}
    more = F.col("company_id").isin(1, 3)

    def stages(rows: dict[str, DataFrame], dies: bool = False):
        of = lambda n, todo: rows[n].join(todo, "company_id", "left_semi")

        def match(todo: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
            return matching.reconcile(of("books", todo), of("portal", todo))

        def find(todo: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
            if dies:
                raise InterruptedError("the night is over")
            return runner.run_rules({n: of(n, todo) for n in rows}, on, AS_OF, gst=made["matches"]).select(*BASE)

        return [("matches", match), ("findings", find)]

    every = {n: v[n] for n in ("books", "portal", "periods")}
    first = {n: df.where(~more | (F.col("period") < "1999-01")) for n, df in every.items()}
    version = lambda t: t["books"].groupBy("company_id").agg(F.count("*").alias("version"))
    at.run(version(first), stages(first))
    with contextlib.suppress(InterruptedError):
        at.run(version(every), stages(every, dies=True))
    at.run(version(every), stages(every))
    return at.read("findings")


@register("""WITH l AS (SELECT document, source_row, 'line ' || CAST(record_id AS VARCHAR) AS line FROM sources WHERE record_type = 'purchase_invoice'), w AS (SELECT document, source_row AS "at" FROM sources WHERE record_type = 'purchase_invoice' AND record_id % 97 = 0)
SELECT w.document, w."at", l.source_row, line, l.source_row = w."at" AS is_target, 'header of ' || w.document AS header FROM w JOIN (SELECT * FROM l UNION ALL SELECT DISTINCT document, 1, 'header of ' || document FROM l) l ON l.document = w.document AND l.source_row BETWEEN w."at" - 2 AND w."at" + 2""")  # fmt: skip
def evidence_source(v):
    """Wanted lines of stored documents with their neighbours and header, out of the store of lines."""
    store = lines.LineStore(v.spark, matching.scratch_path(v.spark, "lines"), 8)
    own = v["sources"].where("record_type = 'purchase_invoice'")
    body = own.select("document", "source_row", F.concat(F.lit("line "), F.col("record_id").cast("string")).alias("line"))
    store.add(body.union(own.select("document", F.lit(1), F.concat(F.lit("header of "), "document")).distinct()))
    return store.around(own.where("record_id % 97 = 0").select("document", "source_row"))


def fact(name: str) -> F.Column:
    return F.try_element_at("metrics", F.lit(name))


DAYS = f"date_diff('day', DATE '{AS_OF}', deadline)"


@register(f""" SELECT company_id, period, risk_key, age AS age_periods, CAST(days AS INT) AS days_to_deadline, CAST(deadline AS VARCHAR) AS deadline, reason,
'CGST ' || {inr_sql('cgst')} || ', SGST ' || {inr_sql('sgst')} || ', IGST ' || {inr_sql('igst')} || ', CESS ' || {inr_sql('cess')} || ', in all ' || {inr_sql('headline')} || ' in no statement; ' || reason AS calculation,
'A booked purchase that no statement shows, so its credit can''t be claimed yet. The limit of Sec 16(4) is ' || CAST(deadline AS VARCHAR) || ': ' || reason || '.' AS rule_text
FROM (SELECT *, CASE WHEN days < 0 THEN 'lost ' || CAST(-days AS VARCHAR) || ' days ago' WHEN days <= 60 THEN 'at risk in ' || CAST(days AS VARCHAR) || ' days' WHEN age >= 3 THEN 'at risk after ' || CAST(age AS VARCHAR) || ' periods'
  WHEN age >= 2 THEN 'to chase after ' || CAST(age AS VARCHAR) || ' periods' ELSE 'to watch' END AS reason
  FROM (SELECT r1.*, b.cgst, b.sgst, b.igst, b.cess, {DAYS} AS days, CAST((CAST(substring(latest, 1, 4) AS INT) * 12 + CAST(substring(latest, 6, 2) AS INT)) - (CAST(substring(r1.period, 1, 4) AS INT) * 12 + CAST(substring(r1.period, 6, 2) AS INT)) AS INT) AS age
    FROM r1 JOIN lp USING (company_id) JOIN books b ON b.id = r1.id))""", WHOLE)  # fmt: skip
def unmatched_reasons(v):
    """Why and how urgently each unmatched credit counts, with its arithmetic and rule."""
    found = rules.r1_unmatched_credit(v["books"], gst_matches(v), AS_OF, v["periods"])
    return found.select("company_id", "period", "risk_key", fact("age_periods").cast("int").alias("age_periods"), fact("days_to_deadline").cast("int").alias("days_to_deadline"), fact("sec_16_4_deadline").alias("deadline"), fact("reason").alias("reason"), "calculation", "rule_text")


@register(f""" SELECT r3.company_id, r3.period, r3.risk_key, CAST(n AS INT) AS occurrences, CAST(n AS VARCHAR) || ' rows of one document; ' || {inr_sql('headline')} || ' too much' AS calculation FROM r3 JOIN books b ON b.id = r3.id
JOIN (SELECT company_id, supplier_gstin, norm_invoice_no, count(*) AS n FROM books GROUP BY 1, 2, 3) c ON c.company_id = b.company_id AND c.supplier_gstin = b.supplier_gstin AND c.norm_invoice_no = b.norm_invoice_no""", WHOLE)  # fmt: skip
def duplicate_occurrences(v):
    found = rules.r3_duplicate(v["books"], v["portal"], gst_matches(v))
    return found.select("company_id", "period", "risk_key", fact("occurrences").cast("int").alias("occurrences"), "calculation")


SAYS = f""",
cl AS (SELECT r2.company_id, r2.period, r2.risk_key, r2.id AS record_id, 'booked ' || {inr_sql("b.taxable")} || ' less stated ' || {inr_sql("p.taxable")} || ' is ' || {inr_sql("(b.taxable - p.taxable)")} AS calculation FROM r2 JOIN books b ON b.id = r2.id JOIN portal p ON p.id = p_id
UNION ALL SELECT company_id, period, 'R4:' || {NUMBERED}, id, 'the statement reverses ' || {inr_sql("reversal")} FROM portal WHERE reversal > 0
UNION ALL SELECT g.company_id, g.period, 'R4b:' || {NUMBERED}, id, {inr_sql("reversal")} || ' was reversed; the supplier has filed since, last in ' || later FROM portal g
  JOIN (SELECT company_id, supplier_gstin AS s, max(period) AS later FROM portal WHERE reversal = 0 GROUP BY 1, 2) f ON f.company_id = g.company_id AND s = supplier_gstin WHERE reversal > 0
UNION ALL SELECT company_id, period, 'R5:bank_books_variance', NULL, 'books ' || {inr_sql("books_net")} || ' less bank ' || {inr_sql("bank_net")} || ' is ' || {inr_sql("variance")} || ', of which unexplained ' || {inr_sql("residual")} FROM r5p
UNION ALL SELECT company_id, period, 'R6:' || CAST(id AS VARCHAR), id, {inr_sql("credit")} || ' came in on ' || CAST(CAST(txn_date AS DATE) AS VARCHAR) || ' from nobody known and for no voucher' FROM bank WHERE credit > 0
UNION ALL SELECT company_id, period, 'R7:customer_concentration', NULL, {inr_sql("CAST(t AS BIGINT)")} || ' of ' || {inr_sql("CAST(w AS BIGINT)")} || ' is ' || printf('%.2f', CAST(pct AS DOUBLE)) || '%' FROM r7s
UNION ALL SELECT company_id, period, 'R8:receivables_ageing', NULL, {inr_sql("CAST(aged AS BIGINT)")} || ' older than 90 days of ' || {inr_sql("CAST(total AS BIGINT)")} || ' is ' || printf('%.2f', CAST(pct AS DOUBLE)) || '%' FROM r8s
UNION ALL SELECT company_id, period, 'R9:deemed_accepted', NULL, CAST(n AS VARCHAR) || ' records worth ' || {inr_sql("t")} || ' await an answer' FROM (SELECT company_id, period, count(*) AS n, CAST(sum(total) AS BIGINT) AS t FROM rec WHERE portal_status = 'no_action' GROUP BY 1, 2)
UNION ALL SELECT company_id, period, 'R10:' || {NUMBERED}, id, {inr_sql("total")} || ' in the inbox: ' || coalesce(action, 'decide') FROM rec
UNION ALL SELECT company_id, period, 'R11:recompute_required', NULL, CAST(count(*) AS VARCHAR) || ' actions after day 14, the last on ' || CAST(max(actioned_at) AS VARCHAR) FROM inbox WHERE day(actioned_at) > 14 GROUP BY 1, 2
UNION ALL SELECT company_id, strftime(CAST(period || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m'), 'R12:filing_chain', NULL, 'the return of ' || period || ' is not filed' FROM filings WHERE NOT filed
UNION ALL SELECT company_id, period, 'R13:' || {NUMBERED}, id, {inr_sql("(cgst + sgst + igst + cess)")} || ' is stated as not available' FROM portal WHERE NOT itc_available)
SELECT fa.company_id, fa.period, rule_code, fa.risk_key, calculation FROM fa LEFT JOIN cl ON cl.company_id = fa.company_id AND cl.period = fa.period AND cl.risk_key = fa.risk_key AND cl.record_id IS NOT DISTINCT FROM fa.record_id WHERE rule_code NOT IN ('R1', 'R3')
"""


@register(SAYS, DRAFTS)
def rule_calculations(v):
    """The arithmetic behind each finding; that of R1 and R3 stands in unmatched_reasons and duplicate_occurrences."""
    table = runner.registry(v.spark).where("code not in ('R1', 'R3')").withColumn("enabled", F.lit(True))
    return runner.run_rules(v, runner.enabled(table), AS_OF, False).select("company_id", "period", "rule_code", "risk_key", "calculation")


@register("SELECT company_id, period, CAST(max(actioned_at) AS VARCHAR) AS latest_action, CAST(count(*) AS VARCHAR) || ' actions after day 14, the last on ' || CAST(max(actioned_at) AS VARCHAR) AS calculation FROM inbox WHERE day(actioned_at) > 14 GROUP BY 1, 2")
def late_actions(v):
    return rules.r11_stale_statement(v["inbox"]).select("company_id", "period", fact("latest_action").alias("latest_action"), "calculation")


@register(f" SELECT s.company_id, s.period, CAST(n - 1 AS INT) AS nth, p.party_id, coalesce(name || ': ', '') || {inr_sql('CAST(amount AS BIGINT)')} || ' in the period' AS note FROM r7s s JOIN r7p p ON p.company_id = s.company_id AND p.period = s.period AND n <= 3 LEFT JOIN parties q ON q.company_id = p.company_id AND q.party_id = p.party_id WHERE pct > 50", DRAFTS)
def concentration_customers(v):
    """The customers behind each concentration, by name."""
    found = rules.r7_concentration(v["ledger"], parties=v["parties"])
    return found.select("company_id", "period", F.posexplode("evidence").alias("nth", "e")).select("company_id", "period", "nth", F.col("e.record_id").alias("party_id"), "e.note")


@register("""SELECT rec.company_id, rec.period, rec.id, coalesce(p.name, rec.supplier_gstin) AS supplier_name, CASE WHEN action IS NULL THEN 'decide' WHEN doc_type = 'credit_note' OR (is_amendment AND coalesce(direction, '') = 'downward') THEN 'ask first' ELSE 'reject' END AS advice
FROM rec LEFT JOIN parties p ON p.company_id = rec.company_id AND p.gstin = rec.supplier_gstin WHERE action = 'reject' OR (doc_type = 'credit_note' AND action IS NULL AND supplier_filed)""", REC)  # fmt: skip
def reject_suppliers(v):
    """Who stands behind the records to reject, by tax id, and what the rule says of them."""
    found = rules.r10_recommend_reject(inbox_ops.recommend(v["inbox"], v["books"]), v["parties"])
    text_ = F.col("rule_text")
    advice = F.when(text_.startswith("A credit note"), "decide").when(F.contains(text_, F.lit("ask them first")), "ask first").otherwise("reject")
    return found.select("company_id", "period", F.element_at("evidence", 1)["record_id"].alias("id"), fact("supplier_name").alias("supplier_name"), advice.alias("advice"))


@register("SELECT company_id, l_id AS left_id, r_id AS right_id, CAST(k0 + k1 + k2 + k3 + k4 + 2 AS INT) AS parameters_matched, CAST(1 AS DOUBLE) AS gstin, CAST(q AS DOUBLE) / 10000 AS invno, round_even(CAST(greatest(0, s - abs(amount_delta)) AS DOUBLE) / s, 4) AS amount, round_even(CAST(greatest(0, 30 - abs(date_delta_days)) AS DOUBLE) / 30, 4) AS day FROM mt", WHOLE)
def match_breakdown(v):
    """What each part of a match's score gave, and how many of seven things agree."""
    hit = gst_matches(v).where("status = 'matched'")
    return hit.select("company_id", "left_id", "right_id", "parameters_matched", *(F.col(f"breakdown.{n}").alias(a) for n, a in (("gstin", "gstin"), ("invno", "invno"), ("amount", "amount"), ("date", "day"))))


@register(DRAFTS + SPELT + """ SELECT company_id, planted, detected, defect_type, rule_code, kind_planted, kind_detected FROM (SELECT company_id, count(*) AS planted, count(*) FILTER (WHERE detected) AS detected FROM dh WHERE NOT extended GROUP BY 1)
JOIN (SELECT company_id, defect_type, rule_code, count(*) AS kind_planted, count(*) FILTER (WHERE detected) AS kind_detected FROM dh GROUP BY 1, 2, 3) USING (company_id)""")  # fmt: skip
def evaluation_report(v):
    """The report of the evaluation as it is written, read back: each company's outcomes and those of its kinds of defects."""
    at = matching.scratch_path(v.spark, "report")
    evaluation.write_report(evaluation.expected(answer_key(v)), drafts(v, evidence=False, everything=True), at)
    kinds = "by_defect_type array<struct<defect_type:string,rule_code:string,planted:bigint,detected:bigint>>"
    told = v.spark.read.schema(f"company_id int, planted bigint, detected bigint, {kinds}").json(at)
    return told.select("company_id", "planted", "detected", F.explode("by_defect_type").alias("k")).select("company_id", "planted", "detected", "k.defect_type", "k.rule_code", F.col("k.planted").alias("kind_planted"), F.col("k.detected").alias("kind_detected"))
