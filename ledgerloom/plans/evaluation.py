"""How well findings meet an answer key: recall for every rule, precision where the key is complete.

planted: company_id, defect_type, rule_code, period, landing_period (or null), risk_key, amount, note, extended (whether
it belongs to the second key), as `expected` makes them of an answer key's defects. findings: company_id, period, rule_code, risk_key, headline. A defect's footprint is its
key in its own period and in the one that it lands in; every finding of a footprint is credited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_invoice_no
from ..operators.matching import stored

# Rules whose findings belong to one record, and to a period; the same of the extended key.
ROW_RULES, PERIOD_RULES = ("R1", "R2", "R3", "R4", "R6"), ("R5", "R7")
EXTENDED_ROW_RULES, EXTENDED_PERIOD_RULES = ("R10", "R13"), ("R8", "R9", "R11", "R12")
KEY = ["company_id", "period", "risk_key"]


#: An answer key's defect; `extended` says which of its two sections it stands in.
DEFECT = "company_id int, defect_type string, expected_rule string, period string, target_kind string, natural_key map<string,string>, amount bigint, note string, extended boolean"
# The keys of findings that belong to a period.
PERIOD_KEYS = {"R5": "bank_books_variance", "R7": "customer_concentration", "R8": "receivables_ageing", "R9": "deemed_accepted", "R11": "recompute_required", "R12": "filing_chain"}


def expected(defects: DataFrame) -> DataFrame:
    """planted rows of an answer key's defects (DEFECT): the finding that each must lead to and the period that it may land in.

    Rules on documents are keyed by supplier and number (of the extended section, as the feed spells it, so without its document
    words and zeros), deposits by their reference, rules on periods by their name. A rule that no key is known of is an error.
    """
    rule, of = F.col("expected_rule"), lambda k: F.try_element_at("natural_key", F.lit(k))
    named = lambda *parts: F.concat_ws(":", rule, *(F.coalesce(p, F.lit("")) for p in parts))
    periods = F.create_map(*(F.lit(x) for kv in PERIOD_KEYS.items() for x in kv))
    key = (
        F.when(rule.isin("R1", "R2", "R3", "R4"), named(of("supplier_gstin"), of("number"))).when(rule == "R6", named(of("ref_no")))
        .when(rule.isin(*EXTENDED_ROW_RULES), named(of("supplier_gstin"), norm_invoice_no(of("number")))).when(rule.isin(*PERIOD_KEYS), named(F.try_element_at(periods, rule)))
        .otherwise(F.raise_error(F.concat(F.lit("no key is known for rule "), F.coalesce(rule, F.lit("null")))).cast("string"))
    )
    landing = F.nullif(of("landing_period"), F.col("period"))
    return stored(defects.select(F.monotonically_increasing_id().alias("defect"), "*", rule.alias("rule_code"), key.alias("risk_key"), landing.alias("landing_period")))


def targets(planted: DataFrame, books: DataFrame, bank: DataFrame) -> DataFrame:
    """defect and record_id: the row that each defect was planted in, the first of several; null if there is none. books: id,
    company_id, period, supplier_gstin, norm_invoice_no; bank: id, company_id, ref_no."""
    of = lambda k: F.try_element_at("natural_key", F.lit(k))
    bought = planted.where("target_kind = 'purchase_invoice'").select("defect", "company_id", "period", of("supplier_gstin").alias("supplier_gstin"), of("number").alias("norm_invoice_no"))
    paid = planted.where("target_kind = 'bank_txn'").select("defect", "company_id", of("ref_no").alias("ref_no"))
    rows = bought.join(books.select("id", "company_id", "period", "supplier_gstin", "norm_invoice_no"), ["company_id", "period", "supplier_gstin", "norm_invoice_no"])
    lines = paid.join(bank.select("id", "company_id", "ref_no"), ["company_id", "ref_no"])
    first = rows.select("defect", "id").union(lines.select("defect", "id")).groupBy("defect").agg(F.min("id").alias("record_id"))
    return planted.select("defect").join(first, "defect", "left")


def footprints(planted: DataFrame) -> DataFrame:
    """planted, a row for each period of a defect's footprint; defect numbers the planted rows."""
    periods = F.array_distinct(F.array_compact(F.array("period", "landing_period")))
    return planted.withColumn("at", F.explode(periods))


def outcomes(planted: DataFrame, findings: DataFrame) -> DataFrame:
    """planted (with its number, defect) and whether a finding meets it; the defect's own period comes first."""
    found = findings.select("company_id", F.col("period").alias("at"), "risk_key").distinct().withColumn("hit", F.lit(True))
    met = footprints(planted).join(found, ["company_id", "at", "risk_key"], "left")
    best = met.groupBy("defect").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("detected"), F.min(F.when(F.col("hit"), F.struct((F.col("at") != F.col("period")).alias("late"), "at")))["at"].alias("found_in"))
    return planted.join(best, "defect")


def credited(planted: DataFrame, findings: DataFrame) -> DataFrame:
    """findings with `planted`: whether they belong to a defect's footprint."""
    foot = footprints(planted).select("company_id", F.col("at").alias("period"), "risk_key").distinct().withColumn("planted", F.lit(True))
    return findings.join(foot, KEY, "left").withColumn("planted", F.coalesce("planted", F.lit(False)))


def false_positives(planted: DataFrame, findings: DataFrame, rules: tuple[str, ...] = ROW_RULES) -> DataFrame:
    return credited(planted, findings.where(F.col("rule_code").isin(*rules))).where(~F.col("planted")).drop("planted")


def summary(planted: DataFrame, findings: DataFrame) -> DataFrame:
    """A row a company for the first key: planted, detected, missed, recall; row rules' planted, detected, findings and
    precision; period rules' planted and detected and their findings, which the key doesn't score."""
    own = outcomes(planted.where("not extended"), findings)
    row, period = F.col("rule_code").isin(*ROW_RULES), F.col("rule_code").isin(*PERIOD_RULES)
    told = own.groupBy("company_id").agg(
        F.count("*").alias("planted"), F.count_if("detected").alias("detected"), F.count_if(row).alias("row_planted"), F.count_if(row & F.col("detected")).alias("row_detected"),
        F.count_if(period).alias("period_planted"), F.count_if(period & F.col("detected")).alias("period_detected"),
    )
    seen = findings.groupBy("company_id").agg(F.count_if(row).alias("row_findings"), F.count_if(period).alias("period_findings"), F.count_if(~row & ~period & ~F.col("rule_code").isin(*EXTENDED_ROW_RULES, *EXTENDED_PERIOD_RULES)).alias("unscored"))
    out = told.join(seen, "company_id", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.bround(F.col(a) / F.col(b), 3)).otherwise(0.0)
    return out.withColumns({"missed": F.col("planted") - F.col("detected"), "recall": ratio("detected", "planted"), "precision": ratio("row_detected", "row_findings")})


def by_defect(planted: DataFrame, findings: DataFrame) -> DataFrame:
    return outcomes(planted, findings).groupBy("company_id", "extended", "defect_type", "rule_code").agg(F.count("*").alias("planted"), F.count_if("detected").alias("detected"))


def extended(planted: DataFrame, findings: DataFrame, on: list[str]) -> DataFrame:
    """The second key, scored only for rules that are on: planted, scored, detected, recall, row precision."""
    own = outcomes(planted.where("extended"), findings.where(F.col("rule_code").isin(*on))).withColumn("scored", F.col("rule_code").isin(*on))
    hit, row = F.col("scored") & F.col("detected"), F.col("rule_code").isin(*EXTENDED_ROW_RULES)
    told = own.groupBy("company_id").agg(F.count("*").alias("planted"), F.count_if("scored").alias("scored_planted"), F.count_if(hit).alias("detected"), F.count_if(hit & row).alias("row_detected"))
    rows = findings.where(row & F.col("rule_code").isin(*on)).groupBy("company_id").agg(F.count("*").alias("row_findings"))
    out = told.join(rows, "company_id", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.bround(F.col(a) / F.col(b), 3))
    return out.withColumns({"recall": ratio("detected", "scored_planted"), "precision": ratio("row_detected", "row_findings")})


def write_report(planted: DataFrame, findings: DataFrame, path: str) -> None:
    """The summary as JSON lines, a line a company with its outcomes by kind of defect."""
    kinds = by_defect(planted, findings).groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("defect_type", "rule_code", "planted", "detected"))).alias("by_defect_type"))  # a few dozen kinds
    summary(planted, findings).join(kinds, "company_id", "left").write.mode("overwrite").json(path)
