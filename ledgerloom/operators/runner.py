"""The rules that a registry turns on, over all companies and periods at once, and what becomes of their findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import inbox, matching, rules

# What a finding may be marked.
STATUSES = ("open", "acknowledged", "resolved", "ignored", "claim", "reversed", "ineligible", "pending", "reset")


def registry(spark: SparkSession) -> DataFrame:
    """The default registry: code, domain, title, enabled, thresholds."""
    return spark.createDataFrame(list(rules.REGISTRY), "code string, domain string, title string, enabled boolean, thresholds map<string,double>")


def enabled(table: DataFrame) -> dict[str, dict[str, float]]:
    """code -> thresholds of the rules of this build that the registry turns on; a missing threshold has its default."""
    known = [code for code, *_ in rules.REGISTRY]
    return {r.code: rules.THRESHOLDS[r.code] | (r.thresholds or {}) for r in table.where(F.col("enabled") & F.col("code").isin(known)).collect()}


def skipped(table: DataFrame) -> DataFrame:
    """Rules that don't run: turned off, or unknown to this build."""
    return table.where(~F.coalesce("enabled", F.lit(False)) | ~F.col("code").isin([code for code, *_ in rules.REGISTRY])).select("code", "title")


def one_each(drafts: DataFrame) -> DataFrame:
    """One finding for each company, period and key: of several drafts the last, in the order of their first records."""
    own = Window.partitionBy("company_id", "period", "risk_key").orderBy(F.try_element_at("evidence", F.lit(1))["record_id"].desc_nulls_last())
    return drafts.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth")


def drafts(t: dict[str, DataFrame], on: dict[str, dict[str, float]], as_of: str, evidence: bool = True, gst: DataFrame | None = None, paid: DataFrame | None = None) -> DataFrame:
    """What the rules that are on draft. t: books, portal, bank, ledger, inbox, filings, periods, and
    parties if findings shall name them.

    gst, paid: matches of books and bank that are there already; else they are made here, once, as the registry's
    tolerance says, and shared by the rules that read them.
    """
    out: list[DataFrame] = []
    if on.keys() & {"R1", "R2", "R3"}:
        if gst is None:
            gst = matching.stored(matching.reconcile(t["books"], t["portal"], tolerance=rules.paise((on.get("R2") or rules.THRESHOLDS["R2"])["tolerance_inr"])))
        m = gst
        out += [rules.r1_unmatched_credit(t["books"], m, as_of, t["periods"], on["R1"])] if "R1" in on else []
        out += [rules.r2_amount_mismatch(t["books"], t["portal"], m, on["R2"])] if "R2" in on else []
        out += [rules.r3_duplicate(t["books"], t["portal"], m)] if "R3" in on else []
    if on.keys() & {"R5", "R6"}:
        paid = matching.stored(matching.reconcile_bank(t["bank"], t["ledger"])) if paid is None else paid
        out += [rules.r5_variance(rules.variance_parts(t["bank"], t["ledger"], paid), on["R5"])] if "R5" in on else []
        out += [rules.r6_unidentified_deposit(t["bank"], paid, on["R6"])] if "R6" in on else []
    if on.keys() & {"R9", "R10"}:
        advised = inbox.recommend(t["inbox"], t["books"], rules.paise((on.get("R10") or rules.THRESHOLDS["R10"])["tolerance_inr"]))
        out += [f(advised) for code, f in (("R9", rules.r9_action_required), ("R10", lambda rows: rules.r10_recommend_reject(rows, t.get("parties")))) if code in on]
    if "R7" in on:
        out.append(rules.r7_concentration(t["ledger"], on["R7"], t.get("parties")))
    if "R8" in on:
        out.append(rules.r8_ageing(t["ledger"], t["ledger"].select("company_id", "period").distinct(), on["R8"], evidence))
    if "R11" in on:
        out.append(rules.r11_stale_statement(t["inbox"], on["R11"]))
    if "R12" in on:
        out.append(rules.r12_filing_blocked(t["filings"]))
    for code, made in (("R4", lambda: rules.r4_reversal(t["portal"], as_of)), ("R4b", lambda: rules.r4b_reclaimable(t["portal"])), ("R13", lambda: rules.r13_blocked_credit(t["portal"]))):
        out += [made()] if code in on else []
    return reduce(DataFrame.union, out)


def run_rules(t: dict[str, DataFrame], on: dict[str, dict[str, float]], as_of: str, evidence: bool = True, gst: DataFrame | None = None, paid: DataFrame | None = None) -> DataFrame:
    """The findings of the rules that are on, written."""
    return matching.stored(one_each(drafts(t, on, as_of, evidence, gst, paid)))


def recompute(t: dict[str, DataFrame], table: DataFrame, old: DataFrame, as_of: str) -> DataFrame:
    """The nightly run: findings after every enabled rule has run again over full history. Those found again keep status
    and explanation; those of any rule of this build that weren't, also of rules now off, go."""
    return rules.upsert(old, run_rules(t, enabled(table), as_of), [code for code, *_ in rules.REGISTRY])


def tallies(drafts: DataFrame) -> DataFrame:
    """Findings of each rule and severity."""
    return drafts.groupBy("rule_code", "severity").agg(F.count("*").alias("findings"), F.sum("headline").alias("headline"))


def finding_id(prefix: str = "") -> F.Column:
    from ..functions.text import stable_id

    return stable_id("risk", F.col(prefix + "company_id"), F.col(prefix + "period"), F.col(prefix + "risk_key"))


def evidence_rows(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each record behind a finding, with the document and the row there. Parties have no document."""
    each = drafts.select("company_id", "period", "rule_code", "risk_key", F.posexplode("evidence").alias("nth", "e")).select("company_id", "period", "rule_code", "risk_key", "nth", "e.*")
    return each.join(sources.select("record_type", "record_id", "document", "source_row"), ["record_type", "record_id"], "left")


def set_status(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """findings with the statuses of changes (company_id, period, risk_key, status); the last `at` of a finding counts.
    A status that isn't one of STATUSES is an error."""
    last = changes.groupBy("company_id", "period", "risk_key").agg(F.max_by("status", "at").alias("new"))
    sure = F.when(F.col("new").isin(*STATUSES), F.col("new")).otherwise(F.raise_error(F.concat(F.lit("no such status: "), F.coalesce("new", F.lit("null")))))
    met = findings.join(last.select("company_id", "period", "risk_key", sure.alias("new")), ["company_id", "period", "risk_key"], "left")
    return met.withColumn("status", F.coalesce("new", "status")).select(findings.columns)
