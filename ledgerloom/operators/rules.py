"""The anomaly rules: each computes all companies and periods at once and returns drafts of one schema.

A draft: company_id, period, rule_code, risk_key, severity, headline (paise), pct (decimal(9,2), null if none), metrics
(what the calculation used, as text), calculation (the arithmetic to read), evidence (record_type, record_id, note of
each record behind it), rule_text (what the rule asks for and why). Dates of reckoning are inputs (as_of), never the clock; thresholds come from the registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import credit_deadline, first_day, periods_between, shift_period
from ..functions.money import format_inr, percent
from ..functions.text import document_key
from .matching import AMOUNTS, HEADS

# The registry - code, domain, title, enabled, thresholds (amounts in rupees).
REGISTRY = (
    ("R1", "gst", "ITC_UNMATCHED", True, {"chase_periods": 2.0, "at_risk_periods": 3.0}), ("R2", "gst", "ITC_AMOUNT_MISMATCH", True, {"tolerance_inr": 1.0}), ("R3", "gst", "DUPLICATE_PURCHASE", True, {}),
    ("R4", "gst", "ITC_REVERSAL_37A", True, {}), ("R4b", "gst", "REVERSAL_RECLAIMABLE", False, {}), ("R5", "bank", "BANK_BOOKS_VARIANCE", True, {"turnover_pct": 1.0, "residual_inr": 50000.0}),
    ("R6", "bank", "UNIDENTIFIED_DEPOSIT", True, {"min_credit_inr": 50000.0}), ("R7", "commercial", "CUSTOMER_CONCENTRATION", True, {"top_n": 3.0, "medium_pct": 50.0, "high_pct": 65.0}),
    ("R8", "commercial", "RECEIVABLES_AGEING", True, {"bucket_days": 90.0, "pct_of_total": 20.0}), ("R9", "ims", "IMS_ACTION_REQUIRED", False, {}), ("R10", "ims", "IMS_RECOMMEND_REJECT", False, {"tolerance_inr": 1.0}),
    ("R11", "ims", "GSTR2B_STALE", False, {"trigger_day_of_month": 14.0}), ("R12", "ims", "FILING_CHAIN_BLOCKED", False, {}), ("R13", "gst", "BLOCKED_CREDIT_17_5", False, {}),
)
THRESHOLDS = {code: thresholds for code, _, _, _, thresholds in REGISTRY}
#: Days before the statutory limit from which credit is at risk, and parties that an ageing finding names.
DEADLINE_DAYS, WORST = 60, 5
EVIDENCE = "array<struct<record_type:string,record_id:bigint,note:string>>"


def paise(rupees: float) -> int:
    return round(rupees * 100)


def inr(rupees: float) -> str:
    """A threshold in rupees, as a reader sees it."""
    return f"INR {rupees:,.2f}"


def record(kind: str, record_id: Column, note: Column) -> Column:
    return F.struct(F.lit(kind).alias("record_type"), record_id.cast("bigint").alias("record_id"), note.alias("note"))


def draft(df: DataFrame, code: str, key: Column, severity: Column, headline: Column, pct: Column | None = None, facts: dict[str, Column] | None = None, says: Column | None = None, evidence: list[Column] | Column | None = None, why: str | Column = "") -> DataFrame:
    metrics = F.create_map(*(x for k, v in (facts or {}).items() for x in (F.lit(k), v.cast("string")))) if facts else F.create_map().cast("map<string,string>")
    rows = F.array(*evidence) if isinstance(evidence, list) else F.array() if evidence is None else evidence
    return df.select(
        "company_id", "period", F.lit(code).alias("rule_code"), key.alias("risk_key"), severity.alias("severity"), headline.cast("bigint").alias("headline"), (F.lit(None) if pct is None else pct).cast("decimal(9,2)").alias("pct"),
        metrics.alias("metrics"), (F.lit(None) if says is None else says).cast("string").alias("calculation"), rows.cast(EVIDENCE).alias("evidence"), (F.lit(why) if isinstance(why, str) else why).alias("rule_text"),
    )


def told(*parts) -> Column:
    """Words and amounts (columns of paise) in a row."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def tax(prefix: str = "") -> Column:
    return sum((F.col(prefix + h) for h in HEADS[1:]), F.col(prefix + HEADS[0]))


def doc_key(code: str) -> Column:
    return document_key(code, F.col("supplier_gstin"), F.col("norm_invoice_no"), F.col("id"))


def of_document(**more: Column) -> dict[str, Column]:
    return {"supplier_gstin": F.col("supplier_gstin"), "invoice_no": F.col("norm_invoice_no"), "invoice_date": F.col("invoice_date")} | more


def of_status(books: DataFrame, matches: DataFrame, status: str) -> DataFrame:
    return books.join(matches.where(f"left_type = 'purchase_invoice' and status = '{status}'").select(F.col("left_id").alias("id")), "id", "left_semi")


def r1_unmatched_credit(books: DataFrame, matches: DataFrame, as_of: str, periods: DataFrame, lim: dict = THRESHOLDS["R1"]) -> DataFrame:
    """A document's age is counted from its company's last period; periods: company_id, period."""
    deadline = credit_deadline(F.col("invoice_date"))
    age, days = periods_between(F.col("period"), F.col("latest")), F.datediff(deadline, F.lit(as_of).cast("date"))
    severity = F.when((days <= DEADLINE_DAYS) | (age >= lim["at_risk_periods"]), "high").when(age >= lim["chase_periods"], "medium").otherwise("low")
    reason = (
        F.when(days < 0, told("lost ", F.abs(days).cast("string"), " days ago")).when(days <= DEADLINE_DAYS, told("at risk in ", days.cast("string"), " days"))
        .when(age >= lim["at_risk_periods"], told("at risk after ", age.cast("string"), " periods")).when(age >= lim["chase_periods"], told("to chase after ", age.cast("string"), " periods")).otherwise("to watch")
    )
    facts = of_document(itc_at_stake=tax(), age_periods=age, sec_16_4_deadline=deadline, days_to_deadline=days, reason=reason)
    says = told(*(p for h in HEADS for p in (h.upper() + " ", format_inr(F.col(h)), ", ")), "in all ", format_inr(tax()), " in no statement; ", reason)
    last = periods.groupBy("company_id").agg(F.max("period").alias("latest"))
    return draft(of_status(books, matches, "unmatched").join(last, "company_id"), "R1", doc_key("R1"), severity, tax(), facts=facts, says=says, evidence=[record("purchase_invoice", F.col("id"), F.lit("booked"))],
                 why=told("A booked purchase that no statement shows, so its credit can't be claimed yet. The limit of Sec 16(4) is ", deadline.cast("string"), ": ", reason, "."))


def r2_amount_mismatch(books: DataFrame, portal: DataFrame, matches: DataFrame, lim: dict = THRESHOLDS["R2"]) -> DataFrame:
    pairs = matches.where("status = 'matched'").select(F.col("left_id").alias("id"), F.col("right_id").alias("rid"))
    right = portal.select(F.col("id").alias("rid"), *(F.col(a).alias("p_" + a) for a in AMOUNTS))
    apart = {a: F.col(a) - F.col("p_" + a) for a in AMOUNTS}
    off = F.lit(False)
    for a in AMOUNTS:
        off |= F.abs(apart[a]) > paise(lim["tolerance_inr"])
    heads = F.array_join(F.array_compact(F.array(*(F.when(F.abs(apart[h]) > paise(lim["tolerance_inr"]), h) for h in HEADS))), ",")
    facts = of_document(taxable_delta=apart["taxable"], heads_out_of_tolerance=heads)
    says = told("booked ", format_inr(F.col("taxable")), " less stated ", format_inr(F.col("p_taxable")), " is ", format_inr(apart["taxable"]))
    both = [record("purchase_invoice", F.col("id"), F.lit("booked")), record("gstr2b_line", F.col("rid"), F.lit("stated"))]
    return draft(books.join(pairs, "id").join(right, "rid").where(off), "R2", doc_key("R2"), F.lit("medium"), F.abs(apart["taxable"]), facts=facts, says=says, evidence=both,
                 why=f"A matched document that differs by more than {inr(lim['tolerance_inr'])}; every tax head is held against it by itself, not their sum.")


def r3_duplicate(books: DataFrame, portal: DataFrame, matches: DataFrame) -> DataFrame:
    """A document booked again. occurrences counts its rows; they are reduced before the join."""
    keys = ["company_id", "supplier_gstin", "norm_invoice_no"]
    amended = portal.where("section in ('B2BA', 'CDNRA') and supplier_gstin is not null").select(*keys)
    rows = books.where("supplier_gstin is not null").groupBy(*keys).agg(F.count("*").alias("occurrences"))
    twice = of_status(books, matches, "duplicate").join(amended, keys, "left_anti").join(rows, keys, "left")
    total = F.col("taxable") + tax()
    says = told(F.col("occurrences").cast("string"), " rows of one document; ", format_inr(total), " too much")
    return draft(twice, "R3", doc_key("R3"), F.lit("high"), total, facts=of_document(occurrences=F.coalesce("occurrences", F.lit(0)), duplicated_value=total), says=says, evidence=[record("purchase_invoice", F.col("id"), F.lit("booked again"))],
                 why="One supplier's document stands in the register more than once and in the statement once. Amended documents don't count.")


def r4_reversal(portal: DataFrame, as_of: str) -> DataFrame:
    deadline = credit_deadline(F.col("invoice_date"))
    days = F.datediff(deadline, F.lit(as_of).cast("date"))
    return draft(
        portal.where("reversal > 0"), "R4", doc_key("R4"), F.when(days <= DEADLINE_DAYS, "high").otherwise("medium"), F.col("reversal"),
        facts=of_document(reversal_amount=F.col("reversal"), reverse_by=deadline, days_to_reversal_deadline=days), says=told("the statement reverses ", format_inr(F.col("reversal"))), evidence=[record("gstr2b_line", F.col("id"), F.lit("reversal"))],
        why=told("The supplier has stated the invoice but not filed the return (Rule 37A), so the credit goes back by ", deadline.cast("string"), "; after that interest under Sec 50 runs. The amount is the portal's own."),
    )


def r4b_reclaimable(portal: DataFrame) -> DataFrame:
    """A reversal of a supplier who has a later row without one: that supplier's last such period decides."""
    last = portal.where("reversal = 0 and supplier_gstin is not null").groupBy("company_id", "supplier_gstin").agg(F.max("period").alias("later"))
    found = portal.where("reversal > 0").join(last, ["company_id", "supplier_gstin"]).where("later > period")
    says = told(format_inr(F.col("reversal")), " was reversed; the supplier has filed since, last in ", F.col("later"))
    return draft(found, "R4b", doc_key("R4b"), F.lit("info"), F.col("reversal"), facts=of_document(reversed_amount=F.col("reversal")), says=says, evidence=[record("gstr2b_line", F.col("id"), F.lit("reversal"))],
                 why="Credit that was reversed under Rule 37A may be taken again once the supplier has filed, in any later period and without the limit of Sec 16(4).")


def variance_parts(bank: DataFrame, ledger: DataFrame, matches: DataFrame) -> DataFrame:
    """A row for each company and period with everything that the cash variance is made of."""
    state = matches.select(F.col("left_type").alias("kind"), F.col("left_id").alias("id"), F.col("right_id").alias("rid"), "status")
    signed = F.when(F.col("voucher_type") == "Receipt", F.coalesce("credit", F.lit(0))).when(F.col("voucher_type") == "Payment", -F.coalesce("debit", F.lit(0))).otherwise(0)
    zero = F.lit(0).cast("bigint")
    lone = state.where("kind = 'ledger_entry' and status = 'unmatched'").select("id", F.lit(True).alias("lone"))
    cleared = state.where("kind = 'bank_txn' and status = 'matched'").join(bank.select("id", F.col("period").alias("bank_period")), "id").select(F.col("rid").alias("id"), "bank_period")
    book = ledger.join(lone, "id", "left").join(cleared, "id", "left").select(
        "company_id", "period", signed.alias("books_net"), F.when(F.col("bank_period") != F.col("period"), signed).otherwise(0).alias("timing"), F.when(F.col("lone"), signed).otherwise(0).alias("books_only"),
        zero.alias("bank_net"), zero.alias("bank_in_only"), zero.alias("bank_out_only"), F.when(F.col("voucher_type") == "Sales", F.coalesce("debit", F.lit(0))).otherwise(0).alias("turnover"))
    odd = state.where("kind = 'bank_txn' and status = 'unmatched'").select("id", F.lit(True).alias("odd"))
    line = bank.join(odd, "id", "left").select(
        "company_id", "period", zero, zero, zero, F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0)), F.when(F.col("odd"), F.coalesce("credit", F.lit(0))).otherwise(0), F.when(F.col("odd"), F.coalesce("debit", F.lit(0))).otherwise(0), zero)
    names = ("books_net", "timing", "books_only", "bank_net", "bank_in_only", "bank_out_only", "turnover")
    out = book.union(line).groupBy("company_id", "period").agg(*(F.sum(n).alias(n) for n in names))
    variance = F.col("books_net") - F.col("bank_net")
    explained = F.col("timing") + F.col("bank_out_only") - F.col("bank_in_only") + F.col("books_only")
    return out.withColumn("variance", variance).withColumn("residual", variance - explained)


def r5_variance(parts: DataFrame, lim: dict = THRESHOLDS["R5"]) -> DataFrame:
    pct = percent(F.abs("variance"), F.col("turnover"), 2)
    over, left = pct > lim["turnover_pct"], F.abs("residual") > paise(lim["residual_inr"])
    names = ("books_net", "bank_net", "variance", "timing", "bank_in_only", "bank_out_only", "books_only", "residual", "turnover")
    says = told("books ", format_inr(F.col("books_net")), " less bank ", format_inr(F.col("bank_net")), " is ", format_inr(F.col("variance")), ", of which unexplained ", format_inr(F.col("residual")))
    return draft(parts.where(over | left), "R5", F.lit("R5:bank_books_variance"), F.when(over & left, "high").otherwise("medium"), F.abs("variance"), pct, {n: F.col(n) for n in names}, says,
                 why=f"Books and bank differ by more than {lim['turnover_pct']:g}% of turnover, or over {inr(lim['residual_inr'])} of it has no cause that the engine finds; such a rest is shown as one.")


def r6_unidentified_deposit(bank: DataFrame, matches: DataFrame, lim: dict = THRESHOLDS["R6"]) -> DataFrame:
    """Keyed by the bank's reference if the lines have one (ref_no), else by the row."""
    lone = matches.where("left_type = 'bank_txn' and status = 'unmatched'").select(F.col("left_id").alias("id"))
    found = bank.where((F.col("credit") >= paise(lim["min_credit_inr"])) & F.col("party_id").isNull()).join(lone, "id", "left_semi")
    ref = F.nullif("ref_no", F.lit("")) if "ref_no" in bank.columns else F.lit(None).cast("string")
    key = F.concat(F.lit("R6:"), F.coalesce(ref, F.col("id").cast("string")))
    says = told(format_inr(F.col("credit")), " came in on ", F.col("txn_date").cast("string"), " from nobody known and for no voucher")
    return draft(found, "R6", key, F.lit("medium"), F.col("credit"), facts={"txn_date": F.col("txn_date"), "ref_no": ref, "amount": F.col("credit")}, says=says, evidence=[record("bank_txn", F.col("id"), F.lit("deposit"))],
                 why=f"A credit of {inr(lim['min_credit_inr'])} or more whose payer no narration names and which meets no voucher.")


def r7_concentration(ledger: DataFrame, lim: dict = THRESHOLDS["R7"], parties: DataFrame | None = None) -> DataFrame:
    """parties (company_id, party_id, name), if given, name the customers in the evidence."""
    top_n = int(lim["top_n"])
    per = ledger.where("voucher_type = 'Sales'").groupBy("company_id", "period", "party_id").agg(F.sum("debit").alias("amount"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("company_id", "period").orderBy(F.desc("amount"), "party_id")))
    head = F.col("rank") <= top_n
    if parties is None:
        ranked = ranked.withColumn("name", F.lit(None).cast("string"))
    else:
        first = ranked.where(head).join(parties.groupBy("company_id", "party_id").agg(F.min("name").alias("name")), ["company_id", "party_id"], "left")
        ranked = first.unionByName(ranked.where(~head).withColumn("name", F.lit(None).cast("string")))
    customers = F.collect_list(F.when(head & F.col("party_id").isNotNull(), F.struct("rank", "party_id", "amount", "name")))  # top_n at most
    share = ranked.groupBy("company_id", "period").agg(F.sum("amount").alias("total"), F.sum(F.when(head, F.col("amount"))).alias("top"), F.count("*").alias("customers"), customers.alias("parties"))
    pct = percent(F.col("top"), F.col("total"), 2)
    named = F.transform(F.sort_array("parties"), lambda p: record("party", p["party_id"], told(F.coalesce(F.concat(p["name"], F.lit(": ")), F.lit("")), format_inr(p["amount"]), " in the period")))
    return draft(
        share.where((F.col("total") > 0) & (pct > lim["medium_pct"])), "R7", F.lit("R7:customer_concentration"), F.when(pct > lim["high_pct"], "high").otherwise("medium"), F.col("top"), pct,
        {"top_n": F.lit(top_n), "top_revenue": F.col("top"), "total_revenue": F.col("total"), "share_pct": pct, "customer_count": F.col("customers")}, told(format_inr(F.col("top")), " of ", format_inr(F.col("total")), " is ", pct.cast("string"), "%"), named,
        why=f"The {top_n} largest customers bring over {lim['medium_pct']:g}% of a period's sales; over {lim['high_pct']:g}% is high.",
    )


def _trade(ledger: DataFrame) -> DataFrame:
    """day, sale and paid of the entries that ageing sees: sales and receipts above nought with a party."""
    sale = F.when(F.col("voucher_type") == "Sales", F.col("debit"))
    paid = F.when(F.col("voucher_type") == "Receipt", F.col("credit"))
    rows = ledger.where("party_id is not null").select("company_id", "party_id", "id", "entry_date", F.coalesce(sale, F.lit(0)).alias("sale"), F.coalesce(paid, F.lit(0)).alias("paid"))
    return rows.where("sale > 0 or paid > 0")


def open_items(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    """What is open of each sale at the ends of the periods wanted: receipts pay a party's sales oldest first.

    A sale is open by what the party's receipts up to then leave of the running total. Each sale and period is a row,
    so ask for few periods; ageing sums all of them without these rows.
    """
    ends = periods.select("company_id", F.col("period").alias("at"), F.last_day(first_day(F.col("period"))).alias("as_of"))
    own = Window.partitionBy("company_id", "party_id").orderBy("entry_date", "id")
    rows = _trade(ledger).withColumn("before", F.coalesce(F.sum("sale").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    paid = rows.where("paid > 0").join(ends, "company_id").where("entry_date <= as_of").groupBy("company_id", "at", "party_id").agg(F.sum("paid").alias("got"))
    sales = rows.where("sale > 0").drop("paid").join(ends, "company_id").where("entry_date <= as_of").join(paid, ["company_id", "at", "party_id"], "left")
    left = F.col("sale") - F.greatest(F.lit(0), F.least(F.col("sale"), F.coalesce("got", F.lit(0)) - F.col("before")))
    return sales.select("company_id", F.col("at").alias("period"), "party_id", "id", "entry_date", left.alias("open"), F.datediff("as_of", "entry_date").alias("age"))


def _changes(ledger: DataFrame, shift: int) -> DataFrame:
    """How a party's open sum of sales `shift` days old and more changes by the month: company_id, party_id, month, open
    (the sum at the month's end). It is what the sales so old exceed all receipts by, as the oldest are paid first."""
    day = F.when(F.col("sale") > 0, F.date_add("entry_date", shift)).otherwise(F.col("entry_date"))
    months = _trade(ledger).groupBy("company_id", "party_id", F.date_format(day, "yyyy-MM").alias("month")).agg((F.sum("sale") - F.sum("paid")).alias("more"))
    upto = F.sum("more").over(Window.partitionBy("company_id", "party_id").orderBy("month"))
    return months.select("company_id", "party_id", "month", F.greatest(upto, F.lit(0)).alias("open"))


def ageing(ledger: DataFrame, periods: DataFrame, bucket_days: int) -> DataFrame:
    """total and aged (over bucket_days) open at the end of each period wanted: company_id, period, total, aged.

    Linear in the ledger: a party's open sum changes only in the months of its own entries, and the changes of all
    parties are summed by month and then run up over a company's months. Companies have a row from their first sale on.
    """
    whole, old = _changes(ledger, 0), _changes(ledger, bucket_days + 1)

    def steps(df: DataFrame, name: str) -> DataFrame:
        own = Window.partitionBy("company_id", "party_id").orderBy("month")
        change = F.col("open") - F.coalesce(F.lag("open").over(own), F.lit(0))
        zero = F.lit(0).cast("bigint")
        return df.select("company_id", "month", *((change if n == name else zero).alias(n) for n in ("total", "aged")))

    asked = periods.select("company_id", F.col("period").alias("month")).distinct()
    first = _trade(ledger).where("sale > 0").groupBy("company_id").agg(F.date_format(F.min("entry_date"), "yyyy-MM").alias("first"))
    moved = steps(whole, "total").union(steps(old, "aged")).groupBy("company_id", "month").agg(F.sum("total").alias("total"), F.sum("aged").alias("aged"))
    every = moved.withColumn("wanted", F.lit(0)).union(asked.select("company_id", "month", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(1)))
    monthly = every.groupBy("company_id", "month").agg(F.sum("total").alias("total"), F.sum("aged").alias("aged"), F.max("wanted").alias("wanted"))
    upto = Window.partitionBy("company_id").orderBy("month")
    run = monthly.select("company_id", F.col("month").alias("period"), F.sum("total").over(upto).alias("total"), F.sum("aged").over(upto).alias("aged"), "wanted")
    return run.where("wanted = 1").join(first, "company_id").where("period >= first").select("company_id", "period", "total", "aged")


def worst_parties(ledger: DataFrame, fired: DataFrame, bucket_days: int, n: int = WORST) -> DataFrame:
    """The parties with most aged at each (company_id, period) of fired, as evidence.

    A party's open sum is laid out over the months for which it stands, so it meets fired by company and period, and each
    task keeps its own first n before ranks are shuffled.
    """
    spans = _changes(ledger, bucket_days + 1).withColumn("until", F.lead("month").over(Window.partitionBy("company_id", "party_id").orderBy("month"))).where("open > 0")
    asked = fired.groupBy("company_id").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    start, end = F.greatest("month", "first"), F.least(F.coalesce(shift_period(F.col("until"), -1), "last"), "last")
    spans = spans.join(asked, "company_id").select("company_id", "party_id", "open", start.alias("start"), end.alias("end")).where("start <= end")
    months = F.explode(F.sequence(first_day(F.col("start")), first_day(F.col("end")), F.expr("interval 1 month")))
    months = spans.select("company_id", "party_id", "open", months.alias("day")).select("company_id", "party_id", "open", F.date_format("day", "yyyy-MM").alias("period"))
    met = months.join(fired.select("company_id", "period"), ["company_id", "period"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("company_id", "period").orderBy(F.desc("open"), "party_id"))
    top = met.withColumn("rank", rank).where(F.col("rank") <= n)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", "party_id", "open"))), lambda p: record("party", p["party_id"], told(format_inr(p["open"]), " aged")))
    return top.groupBy("company_id", "period").agg(rows.alias("worst"))


def r8_ageing(ledger: DataFrame, periods: DataFrame, lim: dict = THRESHOLDS["R8"], evidence: bool = False) -> DataFrame:
    sums = ageing(ledger, periods, int(lim["bucket_days"]))
    pct = percent(F.col("aged"), F.col("total"), 2)
    found = sums.where(F.col("total") > 0).where(pct > lim["pct_of_total"])
    if evidence:
        found = found.join(worst_parties(ledger, found, int(lim["bucket_days"])), ["company_id", "period"], "left")
    says = told(format_inr(F.col("aged")), f" older than {int(lim['bucket_days'])} days of ", format_inr(F.col("total")), " is ", pct.cast("string"), "%")
    return draft(found, "R8", F.lit("R8:receivables_ageing"), F.when(pct > 2 * lim["pct_of_total"], "high").otherwise("medium"), F.col("aged"), pct,
                 {"total_receivables": F.col("total"), "aged_receivables": F.col("aged"), "aged_share_pct": pct}, says, F.col("worst") if evidence else None,
                 why=f"Over {lim['pct_of_total']:g}% of what customers owe at the period's end is older than {int(lim['bucket_days'])} days; receipts pay the oldest sales first.")


def r9_action_required(inbox: DataFrame) -> DataFrame:
    """inbox: with recommendations."""
    sums = inbox.where("portal_status = 'no_action'").groupBy("company_id", "period").agg(
        F.sum("total").alias("value"), F.count("*").alias("records"), *(F.count_if(F.col("action") == a).alias(a) for a in ("accept", "reject", "pending")))
    severity = F.when(F.col("reject") > 0, "high").when(F.col("pending") > 0, "medium").otherwise("low")
    facts = {"records_awaiting_action": F.col("records"), "value": F.col("value")} | {f"recommended_{a}": F.col(a) for a in ("accept", "reject", "pending")}
    return draft(sums, "R9", F.lit("R9:deemed_accepted"), severity, F.col("value"), facts=facts, says=told(F.col("records").cast("string"), " records worth ", format_inr(F.col("value")), " await an answer"),
                 why="Records of the inbox that nobody has answered count as accepted once the return is filed, and can't be answered after that.")


def r10_recommend_reject(inbox: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """parties (company_id, party_id, gstin, name), if given, name the suppliers by their tax ids."""
    bad = (F.col("action") == "reject") | ((F.col("doc_type") == "credit_note") & F.col("action").isNull() & F.col("supplier_filed"))
    says = told(format_inr(F.col("total")), " in the inbox: ", F.coalesce("action", F.lit("decide")))
    facts = of_document(doc_type=F.col("doc_type"), corrects_document=F.col("orig_norm_invoice_no"), recommended_action=F.coalesce("action", F.lit("decide")))
    facts.pop("invoice_date")
    found = inbox.where(bad)
    if parties is not None:
        own = parties.where("gstin is not null").groupBy("company_id", F.col("gstin").alias("supplier_gstin")).agg(F.min_by("name", "party_id").alias("supplier_name"))
        found = found.join(own, ["company_id", "supplier_gstin"], "left")
        facts["supplier_name"] = F.coalesce("supplier_name", "supplier_gstin")
    blames = (F.col("doc_type") == "credit_note") | (F.col("is_amendment") & (F.coalesce("direction", F.lit("")) == "downward"))
    why = (
        F.when(F.col("action").isNull(), "A credit note for a document that isn't booked: it can't wait, and to reject it adds to what the supplier owes in a return where they see it. Decide before filing.")
        .when(blames, "To be rejected; that adds to what the supplier owes in the next return, where they see it, so ask them first.").otherwise("To be rejected; without an answer it counts as accepted.")
    )
    return draft(found, "R10", doc_key("R10"), F.lit("high"), F.col("total"), facts=facts, says=says, evidence=[record("ims_record", F.col("id"), F.lit("in the inbox"))], why=why)


def r11_stale_statement(inbox: DataFrame, lim: dict = THRESHOLDS["R11"]) -> DataFrame:
    """The headline counts the late actions; the last of them is among the metrics."""
    day = int(lim["trigger_day_of_month"])
    late = inbox.where(F.dayofmonth("actioned_at") > day).groupBy("company_id", "period").agg(F.count("*").alias("n"), F.max("actioned_at").alias("last"))
    says = told(F.col("n").cast("string"), f" actions after day {day}, the last on ", F.col("last").cast("string"))
    return draft(late, "R11", F.lit("R11:recompute_required"), F.lit("high"), F.col("n"), facts={"actions_after_cutoff": F.col("n"), "latest_action": F.col("last"), "cutoff_day": F.lit(day)}, says=says,
                 why="The inbox was answered after the statement had been drawn up, so it must be computed anew; until then the period's figures are those of an old one.")


def r12_filing_blocked(filings: DataFrame) -> DataFrame:
    """filings: company_id, period, filed. The period before must stand there as unfiled; a missing one says nothing."""
    before = filings.where("not filed").select("company_id", shift_period(F.col("period"), 1).alias("period"))
    prior = shift_period(F.col("period"), -1)
    return draft(filings.join(before, ["company_id", "period"], "left_semi"), "R12", F.lit("R12:filing_chain"), F.lit("high"), F.lit(0), facts={"blocked_by_period": prior}, says=told("the return of ", prior, " is not filed"),
                 why="Statements come in order: while the return of the period before isn't filed, this period's can't be drawn up and its figures are old.")


def r13_blocked_credit(portal: DataFrame) -> DataFrame:
    says = told(format_inr(tax()), " is stated as not available")
    return draft(portal.where("not itc_available"), "R13", doc_key("R13"), F.lit("medium"), tax(), facts=of_document(blocked_tax=tax()), says=says, evidence=[record("gstr2b_line", F.col("id"), F.lit("not available"))],
                 why="The statement says that this credit isn't available (Sec 17(5)). It may be overruled, as it depends on the company's trade.")


def upsert(old: DataFrame, new: DataFrame, codes: list[str]) -> DataFrame:
    """Findings after a run: those found again keep their status and explanation, the others of these rules go."""
    key = ["company_id", "period", "risk_key"]
    kept = new.join(old.select(*key, "status", "explanation"), key, "left").withColumn("status", F.coalesce("status", F.lit("open")))
    return kept.unionByName(old.where(~F.col("rule_code").isin(codes)).select(kept.columns))
