"""Business records as views over the driver's tables, in SQL that Spark and DuckDB both run.

Money is in whole paise (bigint), so sums and comparisons are exact. Each order is an invoice of the books; the
portal is the books with known disturbances by the invoice's number, so that every rule has something to find. Company 3's
books end three months before the others', but not in ALL_INVOICES; some books name no supplier, some vouchers no party; of
what is booked twice the statement amends some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.matching import scratch_path
from ..sources import manifests

#: Every order that has lines.
INVOICES = """
SELECT id, CAST(party_id % 5 AS int) AS company_id, substring(CAST(day AS string), 1, 7) AS period, party_id, concat('G', CAST(party_id AS string)) AS supplier_gstin,
  concat('A', CAST(1000000 + id AS string)) AS norm_invoice_no, day AS invoice_date, CAST(taxable AS bigint) AS taxable,
  CAST(CASE WHEN party_id % 3 = 0 THEN 0 ELSE (tax - tax % 2) / 2 END AS bigint) AS cgst, CAST(CASE WHEN party_id % 3 = 0 THEN 0 ELSE (tax - tax % 2) / 2 END AS bigint) AS sgst,
  CAST(CASE WHEN party_id % 3 = 0 THEN tax ELSE 0 END AS bigint) AS igst, CAST(0 AS bigint) AS cess
FROM {amounts}"""

VIEWS = {
    "amounts": """
SELECT o_orderkey AS id, o_custkey AS party_id, CAST(o_orderdate AS date) AS day, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS bigint)) AS taxable,
  sum(CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS bigint)) AS tax
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, CAST(o_orderdate AS date)""",
    "invoices": INVOICES + " WHERE NOT (party_id % 5 = 3 AND day >= DATE '2001-05-01')",
    "books": """
SELECT id, company_id, period, party_id, CASE WHEN id % 101 = 0 THEN NULL ELSE supplier_gstin END AS supplier_gstin, norm_invoice_no, invoice_date, taxable, cgst, sgst, igst, cess FROM {invoices} UNION ALL
SELECT id + 1000000000000, company_id, period, party_id, supplier_gstin, norm_invoice_no, invoice_date, taxable, cgst, sgst, igst, cess FROM {invoices} WHERE id % 83 = 0 OR id % 159 = 0""",
    "portal_all": """
SELECT id, company_id, CASE WHEN id % 79 = 0 THEN substring(CAST(CAST(invoice_date + INTERVAL 1 MONTH AS date) AS string), 1, 7) ELSE period END AS period,
  CASE WHEN id % 41 = 0 THEN 'CDNR' WHEN id % 43 = 0 THEN 'ISD' WHEN id % 47 = 0 THEN 'IMPG' ELSE 'B2B' END AS section,
  CASE WHEN id % 41 = 0 AND id % 2 = 0 THEN 'C' WHEN id % 41 = 0 THEN 'D' END AS note_type,
  CASE WHEN id % 41 <> 0 AND id % 43 <> 0 AND id % 47 = 0 THEN NULL ELSE supplier_gstin END AS supplier_gstin,
  CASE WHEN id % 73 = 0 THEN concat(norm_invoice_no, 'X') ELSE norm_invoice_no END AS norm_invoice_no, CAST(NULL AS string) AS amends_invoice_no, invoice_date,
  CASE WHEN id % 89 = 0 THEN taxable + 50000 ELSE taxable END AS taxable, CASE WHEN id % 71 = 0 THEN cgst + 250 ELSE cgst END AS cgst, sgst, igst, cess,
  id % 61 <> 0 AS itc_available, CASE WHEN id % 67 = 0 THEN CAST(1000 + id AS bigint) ELSE CAST(0 AS bigint) END AS reversal
FROM {invoices} WHERE id % 97 <> 0""",
    "portal": """
SELECT * FROM {portal_all} UNION ALL
SELECT id + 2000000000000, company_id, period, 'B2BA', note_type, supplier_gstin, norm_invoice_no, norm_invoice_no, invoice_date, taxable + 300, cgst, sgst, igst, cess, itc_available, reversal
FROM {portal_all} WHERE section = 'B2B' AND id % 53 = 0""",
    "inbox": """
SELECT id, company_id, period, supplier_gstin, CASE WHEN note_type = 'C' THEN 'credit_note' WHEN note_type = 'D' THEN 'debit_note' ELSE 'invoice' END AS doc_type,
  CASE WHEN id % 29 = 0 THEN concat('Z', norm_invoice_no) ELSE norm_invoice_no END AS norm_invoice_no, CASE WHEN note_type = 'C' AND id % 4 = 0 THEN norm_invoice_no END AS orig_norm_invoice_no,
  taxable + cgst + sgst + igst + cess AS total, id % 31 <> 0 AS supplier_filed, id % 37 = 0 AS is_amendment, CASE WHEN id % 37 = 0 AND id % 2 = 0 THEN 'downward' WHEN id % 37 = 0 THEN 'upward' END AS direction,
  CASE WHEN id % 7 = 0 THEN 'accepted' WHEN id % 11 = 0 THEN 'rejected' ELSE 'no_action' END AS portal_status,
  CASE WHEN id % 7 = 0 THEN CAST(invoice_date + INTERVAL 40 DAY AS date) END AS actioned_at
FROM {portal_all} WHERE supplier_gstin IS NOT NULL""",
    "ledger": """
SELECT id, company_id, period, 'Sales' AS voucher_type, invoice_date AS entry_date, party_id, taxable + cgst + sgst + igst AS debit, CAST(NULL AS bigint) AS credit FROM {invoices} UNION ALL
SELECT id + 1000000000000, company_id, substring(CAST(CAST(invoice_date + INTERVAL 30 DAY AS date) AS string), 1, 7), 'Receipt', CAST(invoice_date + INTERVAL 30 DAY AS date),
  CASE WHEN id % 23 = 0 THEN NULL ELSE party_id END, CAST(NULL AS bigint), taxable + cgst + sgst + igst FROM {invoices} WHERE id % 5 <> 0 UNION ALL
SELECT id + 2000000000000, company_id, period, 'Payment', invoice_date, party_id, taxable, CAST(NULL AS bigint) FROM {invoices} WHERE id % 6 = 0""",
    "bank": """
SELECT id, company_id, substring(CAST(CAST(entry_date + INTERVAL 2 DAY AS date) AS string), 1, 7) AS period, CAST(entry_date + INTERVAL 2 DAY AS date) AS txn_date,
  CASE WHEN voucher_type = 'Payment' THEN debit - id % 3 * 40 END AS debit, CASE WHEN voucher_type = 'Receipt' THEN credit + id % 4 * 30 END AS credit,
  CASE WHEN id % 17 = 0 THEN NULL ELSE party_id END AS party_id
FROM {ledger} WHERE voucher_type <> 'Sales' AND id % 13 <> 0 UNION ALL
SELECT id + 5000000000000, company_id, period, entry_date, CAST(NULL AS bigint), debit + 7, CAST(NULL AS bigint) FROM {ledger} WHERE voucher_type = 'Sales' AND id % 19 = 0""",
    "filings": "SELECT DISTINCT company_id, period, (company_id + CAST(substring(period, 6, 2) AS int)) % 4 <> 0 AS filed FROM {ledger}",
    "parties": """
SELECT CAST(c_custkey % 5 AS int) AS company_id, c_custkey AS party_id, CASE WHEN c_custkey % 7 <> 0 THEN concat('G', CAST(c_custkey AS string)) END AS gstin, concat('Party ', CAST(c_custkey AS string), ' Ltd') AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'vendor' ELSE 'customer' END AS kind FROM {customer}""",
    "sources": """
SELECT 'purchase_invoice' AS record_type, id AS record_id, company_id, period, concat('purchases_', CAST(company_id AS string), '_', period, '.csv') AS document, CAST(row_number() OVER (PARTITION BY company_id, period ORDER BY id) + 1 AS int) AS source_row FROM {books} UNION ALL
SELECT 'gstr2b_line', id, company_id, period, concat('gstr2b_', CAST(company_id AS string), '_', period, '.json'), CAST(row_number() OVER (PARTITION BY company_id, period ORDER BY id) AS int) FROM {portal} UNION ALL
SELECT 'ims_record', id, company_id, period, concat('ims_', CAST(company_id AS string), '_', period, '.json'), CAST(row_number() OVER (PARTITION BY company_id, period ORDER BY id) AS int) FROM {inbox} UNION ALL
SELECT 'bank_txn', id, company_id, period, concat('bank_', CAST(company_id AS string), '_', period, '.csv'), CAST(row_number() OVER (PARTITION BY company_id, period ORDER BY id) + 1 AS int) FROM {bank}""",
    "periods": """
SELECT f.company_id, f.period, f.filed, g.period IS NOT NULL AS generated, CASE WHEN f.filed THEN 'filed' ELSE 'open' END AS status
FROM {filings} f LEFT JOIN (SELECT DISTINCT company_id, period FROM {portal} WHERE period < '2001-08') g ON g.company_id = f.company_id AND g.period = f.period""",
}
#: The same views on every invoice, company 3's last months among them.
ALL_INVOICES = VIEWS | {"invoices": INVOICES}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


#: Where `amounts` of a session's inputs lies: by application, folder and the inputs' state.
_WRITTEN: dict[tuple, str] = {}


class Views(dict):
    """name -> lazy DataFrame, made when it is asked for. `amounts`, which most views start from, is written once a session for
    the files as they are; if they change, or what was written is gone, it is written anew."""

    def __init__(self, spark: SparkSession, sf_dir: str, texts: dict[str, str] = VIEWS):
        super().__init__()
        self.spark, self.sf_dir, self.texts = spark, sf_dir, texts

    def __missing__(self, name: str) -> DataFrame:
        if name in TABLES:
            made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            text = self.texts[name]
            made = self.spark.sql(text, **{t: self[t] for t in (*TABLES, *self.texts) if "{" + t + "}" in text})
        self[name] = self._once(made) if name == "amounts" else made
        return self[name]

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        return self[name] if name in self.texts or name in TABLES else default

    def _once(self, made: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, *(manifests.changed(self.spark, f"{self.sf_dir}/{t}.parquet") for t in ("orders", "lineitem")))
        at = _WRITTEN.get(key)
        if at is None or "_SUCCESS" not in manifests.names(self.spark, at):
            at = _WRITTEN[key] = scratch_path(self.spark, "amounts")
            made.write.parquet(at)
        return self.spark.read.schema(made.schema).parquet(at)


def views(spark: SparkSession, sf_dir: str, texts: dict[str, str] = VIEWS) -> Views:
    return Views(spark, sf_dir, texts)


def oracle(text: str, texts: dict[str, str] = VIEWS) -> str:
    """The text with the views before it as common table expressions, for DuckDB."""
    named = {t: t for t in (*TABLES, *texts)}
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body.format(**named)})" for name, body in texts.items()) + ",\n" + text.strip().removeprefix("WITH ") if text.strip().startswith("WITH ") else "WITH " + ",\n".join(f"{name} AS ({body.format(**named)})" for name, body in texts.items()) + "\n" + text.strip()
