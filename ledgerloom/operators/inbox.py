"""What to answer to each record of the invoice inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import THRESHOLDS, paise


def pending_allowed(doc_type: Column, is_amendment: Column, direction: Column) -> Column:
    return (doc_type != "credit_note") & ~(is_amendment & (F.coalesce(direction, F.lit("")) == "downward"))


def recommend(inbox: DataFrame, books: DataFrame, tolerance: int = paise(THRESHOLDS["R10"]["tolerance_inr"])) -> DataFrame:
    """inbox with action (accept, pending, reject or null) and booked (paise, null if not booked).

    Of several register rows under a number the one with the least id counts; they are reduced before the join.
    """
    value = F.col("taxable") + F.col("cgst") + F.col("sgst") + F.col("igst") + F.col("cess")
    known = books.where("supplier_gstin <> ''").groupBy("company_id", "supplier_gstin", "norm_invoice_no").agg(F.min_by(value, "id").alias("booked"))
    orig = known.select("company_id", "supplier_gstin", F.col("norm_invoice_no").alias("orig_norm_invoice_no"), F.lit(True).alias("orig_booked"))
    met = inbox.join(known, ["company_id", "supplier_gstin", "norm_invoice_no"], "left").join(orig, ["company_id", "supplier_gstin", "orig_norm_invoice_no"], "left")
    action = (
        F.when(~F.col("supplier_filed"), F.lit(None)).when(F.col("doc_type") == "credit_note", F.when(F.col("orig_booked"), "accept"))
        .when(F.col("booked").isNull(), "reject")
        .when(F.abs(F.col("total") - F.col("booked")) > tolerance, F.when(pending_allowed(F.col("doc_type"), F.col("is_amendment"), F.col("direction")), "pending").otherwise("reject"))
        .otherwise("accept")
    )
    return met.withColumn("action", action).select(*inbox.columns, "booked", "action")
