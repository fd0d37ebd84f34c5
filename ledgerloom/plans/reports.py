"""Reports over matches, drafts and views: sums first, ratios of sums after, months without rows filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import months_between
from ..functions.money import percent
from ..functions.text import section_label
from ..operators import scan
from ..operators.matching import stored

SEVERITIES = ("high", "medium", "low", "info")


def severity_rank(column: str = "severity"):
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(column)).cast("int")


def coverage(matches: DataFrame, left_type: str = "purchase_invoice") -> DataFrame:
    """Matched of all rows for each company and period."""
    out = matches.where(F.col("left_type") == left_type).groupBy("company_id", "period").agg(F.count_if(F.col("status") == "matched").alias("matched"), F.count("*").alias("total"))
    return out.withColumn("pct", percent(F.col("matched"), F.col("total"), 1))


def spine(rows: DataFrame) -> DataFrame:
    """Every month from each company's first period to its last."""
    ends = rows.groupBy("company_id").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    return ends.select("company_id", F.explode(months_between(F.col("first"), F.col("last"))).alias("period"))


def period_range(matches: DataFrame, drafts: DataFrame, months: DataFrame) -> DataFrame:
    """months: company_id, period. Coverage, findings by severity and money of a month; months without rows are zeros."""
    found = drafts.groupBy("company_id", "period").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES[:3]), F.sum("headline").alias("headline"))
    out = months.join(coverage(matches), ["company_id", "period"], "left").join(found, ["company_id", "period"], "left")
    return out.select("company_id", "period", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("matched", "total", "n_high", "n_medium", "n_low", "headline")))


def totals(months: DataFrame) -> DataFrame:
    """One row a company over its months; the ratio is that of the sums."""
    names = ("matched", "total", "n_high", "n_medium", "n_low", "headline")
    out = months.groupBy("company_id").agg(*(F.sum(n).alias(n) for n in names), F.count("*").alias("months"))
    return out.withColumn("pct", percent(F.col("matched"), F.col("total"), 1))


def dashboard(drafts: DataFrame, deadlines: DataFrame) -> DataFrame:
    """A row a company: open findings, exposure of R1, the nearest deadline and what falls due by it.

    deadlines: company_id, deadline, amount - a row for each R1 finding."""
    open_ = drafts.groupBy("company_id").agg(F.count("*").alias("n_open"), F.count_if(F.col("severity") == "high").alias("n_high"), F.coalesce(F.sum(F.when(F.col("rule_code") == "R1", F.col("headline"))), F.lit(0)).alias("exposure"))
    due = deadlines.groupBy("company_id", "deadline").agg(F.sum("amount").alias("due"), F.count("*").alias("n_due"))
    first = due.groupBy("company_id").agg(F.min_by(F.struct("deadline", "due", "n_due"), "deadline").alias("d"))
    return open_.join(first, "company_id", "left").select("company_id", "n_open", "n_high", "exposure", F.col("d.deadline").alias("deadline"), F.col("d.due").alias("due"), F.col("d.n_due").alias("n_due"))


def other_credit(portal: DataFrame) -> DataFrame:
    """Sections beside the supplies: documents and tax, with what they do to the claim (credit notes take from it)."""
    tax = F.col("cgst") + F.col("sgst") + F.col("igst") + F.col("cess")
    groups = portal.where("section not in ('B2B', 'B2BA')").groupBy("company_id", "period", "section", "note_type").agg(F.count("*").alias("documents"), F.sum("taxable").alias("taxable"), F.sum(tax).alias("tax"))
    return groups.withColumn("claimable", F.when(F.col("note_type") == "C", -F.col("tax")).otherwise(F.col("tax"))).withColumn("net_notes", F.when(F.col("note_type") == "C", -F.col("tax")).when(F.col("note_type") == "D", F.col("tax")).otherwise(0))


def inbox_summary(inbox: DataFrame) -> DataFrame:
    is_ = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v}")
    deemed = F.col("portal_status") == "no_action"
    return inbox.groupBy("company_id", "period").agg(F.count("*").alias("records"), F.sum("total").alias("value"), *(is_("action", v) for v in ("accept", "pending", "reject")), F.count_if(deemed).alias("n_deemed"), F.coalesce(F.sum(F.when(deemed, F.col("total"))), F.lit(0)).alias("deemed_value"))


def top_findings(drafts: DataFrame, n: int) -> DataFrame:
    """A company's n weightiest findings: by severity, then amount, then key."""
    order = Window.partitionBy("company_id").orderBy(severity_rank(), F.col("headline").desc_nulls_last(), "rule_code", "risk_key", "period")
    return drafts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def context_lines(lines: DataFrame, wanted: DataFrame, around: int = 2) -> DataFrame:
    """lines (document_id, source_row, line) within `around` of wanted rows; an equi-join on spread row numbers."""
    spread = wanted.select("document_id", F.col("source_row").alias("at"), F.explode(F.sequence(F.col("source_row") - around, F.col("source_row") + around)).alias("source_row"))
    return lines.join(spread, ["document_id", "source_row"])


#: The rules whose headlines are money that adds up, by the name of their sum.
MONEY = {"itc_at_risk": "R1", "itc_mismatch": "R2", "itc_reversal_37a": "R4", "bank_variance": "R5", "unidentified_deposits": "R6"}


def latest_periods(periods: DataFrame) -> DataFrame:
    """Each company's latest period with a statement, else its latest: company_id, latest."""
    return periods.groupBy("company_id").agg(F.coalesce(F.max(F.when(F.col("generated"), F.col("period"))), F.max("period")).alias("latest"))


def readiness(gst: DataFrame, bank: DataFrame, findings: DataFrame) -> DataFrame:
    """A card for each company and period: coverage of books and bank, money of all findings whatever their status,
    shares of R7 and R8, open findings by severity. gst, bank: matches; findings: with status."""
    key = ["company_id", "period"]
    covered = coverage(gst).select(*key, F.col("matched").alias("gst_matched"), F.col("total").alias("gst_total"))
    banked = coverage(bank, "bank_txn").select(*key, F.col("matched").alias("bank_matched"), F.col("total").alias("bank_total"))
    rule, open_ = (lambda c: F.col("rule_code") == c), F.col("status") == "open"
    found = findings.groupBy(*key).agg(
        *(F.sum(F.when(rule(c), F.col("headline"))).alias(n) for n, c in MONEY.items()),
        F.max(F.when(rule("R7"), F.col("pct"))).cast("double").alias("concentration_pct"), F.max(F.when(rule("R8"), F.col("pct"))).cast("double").alias("receivables_aged_pct"),
        F.count_if(open_).alias("open_risks"), *(F.count_if(open_ & (F.col("severity") == s)).alias(f"{s}_risks") for s in SEVERITIES[:3]),
    )
    counts = ("gst_matched", "gst_total", "bank_matched", "bank_total", *MONEY, "open_risks", "high_risks", "medium_risks", "low_risks")
    out = covered.join(banked, key, "full").join(found, key, "full")
    out = out.select(*key, *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in counts), "concentration_pct", "receivables_aged_pct")
    return out.withColumns({f"{d}_coverage_pct": percent(F.col(f"{d}_matched"), F.col(f"{d}_total"), 1).cast("double") for d in ("gst", "bank")})


def month_report(cards: DataFrame, periods: DataFrame, start: str, end: str) -> DataFrame:
    """readiness of every month from start to end for each company, months without rows as zeros: with what their filing
    says, and a total of the span under period 'total', whose ratios are those of the sums."""
    months = cards.select("company_id").union(periods.select("company_id")).distinct().select("company_id", F.explode(months_between(F.lit(start), F.lit(end))).alias("period"))
    counts = ("gst_matched", "gst_total", "bank_matched", "bank_total", *MONEY, "open_risks", "high_risks", "medium_risks", "low_risks")
    state = periods.select("company_id", "period", F.lit(True).alias("present"), "generated", "filed")
    out = months.join(cards.select("company_id", "period", *counts), ["company_id", "period"], "left").join(state, ["company_id", "period"], "left")
    flags = {n: F.coalesce(n, F.lit(False)).cast("int").cast("bigint") for n in ("present", "generated", "filed")}
    out = out.select("company_id", "period", *(F.coalesce(n, F.lit(0)).alias(n) for n in counts), *(c.alias(n) for n, c in flags.items()), F.lit(1).cast("bigint").alias("months"))
    names = [*counts, *flags, "months"]
    both = out.union(out.groupBy("company_id").agg(F.lit("total"), *(F.sum(n) for n in names)))
    return both.withColumns({f"{d}_coverage_pct": percent(F.col(f"{d}_matched"), F.col(f"{d}_total"), 1).cast("double") for d in ("gst", "bank")})


def firm_cards(cards: DataFrame, findings: DataFrame, periods: DataFrame) -> DataFrame:
    """A row a company: the card of its latest reconcilable period, and over all periods its open findings, the open
    credit at risk, the nearest limit among it, and how much and how many that limit governs."""
    open_, r1 = findings.where("status = 'open'"), F.col("rule_code") == "R1"
    limit = F.when(r1, F.try_element_at("metrics", F.lit("sec_16_4_deadline")))
    book = open_.groupBy("company_id").agg(F.count("*").alias("all_open"), F.count_if(F.col("severity") == "high").alias("all_high"), F.coalesce(F.sum(F.when(r1, F.col("headline"))), F.lit(0)).alias("exposure"), F.min(limit).alias("next_deadline"))
    due = open_.where(r1).groupBy("company_id", limit.alias("next_deadline")).agg(F.sum("headline").alias("before_deadline"), F.count("*").alias("findings_before"))
    now = latest_periods(periods).withColumnRenamed("latest", "period").join(cards, ["company_id", "period"], "left").select("company_id", "period", "gst_coverage_pct", "bank_coverage_pct", "bank_variance", "open_risks")
    met = now.join(book, "company_id", "left").join(due, ["company_id", "next_deadline"], "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("bank_variance", "open_risks", "all_open", "all_high", "exposure", "before_deadline", "findings_before")]
    return met.select("company_id", "period", *(F.coalesce(f"{d}_coverage_pct", F.lit(0.0)).alias(f"{d}_coverage_pct") for d in ("gst", "bank")), "next_deadline", *zero)


def firm_totals(cards: DataFrame) -> DataFrame:
    """One row over a firm's cards: exposure, the soonest limit and what falls due by it."""
    soonest = cards.agg(F.min("next_deadline").alias("soonest"))
    due = F.sum(F.when(F.col("next_deadline") == F.col("soonest"), F.col("before_deadline")))
    return cards.crossJoin(F.broadcast(soonest)).agg(F.sum("exposure").alias("exposure"), F.max("soonest").alias("soonest"), due.alias("due"))  # one row on the right


def period_list(periods: DataFrame, findings: DataFrame) -> DataFrame:
    """Each period with its state and open findings; rank 1 is a company's newest."""
    open_ = findings.where("status = 'open'").groupBy("company_id", "period").agg(F.count("*").alias("open_risks"))
    out = periods.join(open_, ["company_id", "period"], "left").withColumn("open_risks", F.coalesce("open_risks", F.lit(0)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("period"))))  # a company's months are few


def findings_in_range(findings: DataFrame, registry: DataFrame, start: str, end: str, rule: str | None = None) -> DataFrame:
    """Findings from start to end with their rule's title and domain and the number of records behind them; place is
    their order in a company: newest month first, then severity, then amount."""
    found = findings.where(F.col("period").between(start, end))
    found = found.where(F.col("rule_code") == rule) if rule else found
    order = [F.desc("period"), severity_rank(), F.col("headline").desc_nulls_last(), F.col("rule_code"), F.col("risk_key")]
    named = found.join(F.broadcast(registry.select(F.col("code").alias("rule_code"), "title", "domain")), "rule_code")  # a row a rule
    return scan.ranked(named.withColumn("n_evidence", F.size("evidence")), ["company_id"], order, "place")


def finding_detail(findings: DataFrame, registry: DataFrame, evidence: DataFrame, matches: DataFrame, companies: DataFrame) -> DataFrame:
    """Each finding with its rule, company name, records (a finding has two or a handful) and the match of its first
    purchase record. evidence: rows with document and source_row."""
    key = ["company_id", "period", "risk_key"]
    rows = evidence.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nth", "record_type", "record_id", "document", "source_row", "note"))).alias("records"))
    first = F.try_element_at(F.filter("records", lambda r: r["record_type"] == "purchase_invoice"), F.lit(1))
    made = findings.drop("evidence").join(rows, key, "left").withColumn("purchase", first["record_id"])
    match = matches.where("left_type = 'purchase_invoice'").select(F.col("left_id").alias("purchase"), F.col("status").alias("match_status"), F.col("method").alias("match_method"), F.col("score").alias("match_score"), "amount_delta", "date_delta_days")
    named = made.join(F.broadcast(registry.select(F.col("code").alias("rule_code"), "title", "domain", "thresholds")), "rule_code").join(companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left")
    return named.join(match, "purchase", "left")


def domain_counts(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings of each company by their rule's domain."""
    return findings.join(F.broadcast(registry.select(F.col("code").alias("rule_code"), "domain")), "rule_code").groupBy("company_id", "domain").agg(F.count("*").alias("findings"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows."""
    each = [df.agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n, df in tables.items()]
    out = each[0]
    for one in each[1:]:
        out = out.union(one)
    return out


def section_counts(portal: DataFrame) -> DataFrame:
    """Documents of each section of each statement, with the section's name."""
    named = portal.groupBy("company_id", "period", "section", "note_type").agg(F.count("*").alias("documents"))
    return named.withColumn("label", section_label(F.col("section"), F.col("note_type")))


def period_runs(rows: DataFrame, order: str = "source_row") -> DataFrame:
    """Where each run of one period starts and how long it is, down a company's rows (company_id, period, `order`)."""
    own = [F.col(order)]
    at = scan.placed(rows.select("company_id", "period", order), ["company_id"], own)
    starts = scan.before(at, ["company_id"], own, "period", "last").withColumn("first", F.coalesce((F.col("last") != F.col("period")).cast("int"), F.lit(1)))
    numbered = scan.running(starts, ["company_id"], own, {"run": F.col("first")})
    return numbered.groupBy("company_id", "run", "period").agg(F.min(order).alias("starts_at"), F.count("*").alias("rows"))


def running_headlines(findings: DataFrame) -> DataFrame:
    """Each finding with the company's sum of headlines so far, by period, then amount."""
    order = [F.col("period"), F.col("headline").asc_nulls_first(), F.col("rule_code"), F.col("risk_key")]
    return scan.running(scan.placed(findings, ["company_id"], order), ["company_id"], order, {"so_far": F.col("headline")}).drop(scan.RANGE)


def by_deadline(findings: DataFrame) -> DataFrame:
    """R1 findings of each company by the statutory limit that governs them."""
    limit = F.try_element_at("metrics", F.lit("sec_16_4_deadline")).alias("deadline")
    return findings.where("rule_code = 'R1'").groupBy("company_id", limit).agg(F.count("*").alias("findings"), F.sum("headline").alias("headline"))


def running_balance(bank: DataFrame, floor: int) -> DataFrame:
    """Statement lines with a balance that never dips under floor: the opening balance is floor less the deepest dip."""
    move = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    order = [F.col("txn_date"), F.col("id")]
    lines = stored(scan.running(scan.placed(bank, ["company_id"], order), ["company_id"], order, {"flow": move}).drop(scan.RANGE))
    dip = lines.groupBy("company_id").agg(F.least(F.min("flow"), F.lit(0)).alias("dip"))
    return lines.join(dip, "company_id").withColumn("balance", F.lit(floor) - F.col("dip") + F.col("flow")).drop("flow", "dip")


def company_header(companies: DataFrame, firms: DataFrame) -> DataFrame:
    return companies.join(firms.select("firm_id", F.col("name").alias("firm_name")), "firm_id")
