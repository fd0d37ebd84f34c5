"""Matches that follow late rows: a stream of arrivals rewrites the blocks that they fall into, each batch once.

A folder holds the rows that came, by batch and bucket of their block (company and supplier), the decisions by batch and
bucket, and a commit a batch that says which batches and which version of each bucket count. A batch whose commit is there
changes nothing; one that died before its commit is written anew over its own folders. Rows known by id are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import reconcile
from ..sources import manifests
from .arrivals import touched

#: Columns of a row; the portal alone has the last two.
ROW = "side string, id bigint, company_id int, period string, supplier_gstin string, norm_invoice_no string, invoice_date date, taxable bigint, cgst bigint, sgst bigint, igst bigint, cess bigint, section string, amends_invoice_no string"
NAMES = [f.split()[0] for f in ROW.split(", ")]
MATCH = "company_id int, period string, left_type string, left_id bigint, right_id bigint, status string, method string, score double, amount_delta bigint, date_delta_days int, period_gap int, parameters_matched int, breakdown struct<gstin:double,invno:double,amount:double,date:double>"
BOOKS, PORTAL = "books", "portal"


def arrival_rows(books: DataFrame, portal: DataFrame) -> DataFrame:
    """Rows of both sides in one shape, `side` saying which."""
    absent = lambda df: [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in NAMES[1:]]
    one = lambda df, side: df.select(F.lit(side).alias("side"), *absent(df))
    return one(books, BOOKS).union(one(portal, PORTAL))


class LateMatches:
    """The store below `path`; at most `buckets` folders a batch, and only those that a batch touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def state(self) -> dict:
        """The newest commit: its batch, the batches that have rows, and the batch that wrote each bucket last."""
        made = manifests.names(self.spark, f"{self.path}/commits")
        made = [n for n in made if n.endswith(".json")]
        return manifests.read_json(self.spark, f"{self.path}/commits/{made[-1]}") if made else {"batch": -1, "rows": [], "matches": {}}

    def _rows(self, batches: list[int]) -> DataFrame:
        at = [f"{self.path}/rows/batch={n}" for n in batches]
        read = self.spark.read.schema(ROW + ", batch int, bucket int").option("basePath", f"{self.path}/rows")
        return read.parquet(*at) if at else self.spark.createDataFrame([], ROW + ", batch int, bucket int")

    def _matches(self, versions: dict[str, int]) -> DataFrame:
        at = [f"{self.path}/matches/batch={n}/bucket={b}" for b, n in versions.items()]
        read = self.spark.read.schema(MATCH + ", batch int, bucket int").option("basePath", f"{self.path}/matches")
        return read.parquet(*at) if at else self.spark.createDataFrame([], MATCH + ", batch int, bucket int")

    def current(self) -> DataFrame:
        """The decisions on all rows that came, as one reconciliation of all of them gives."""
        return self._matches(self.state()["matches"]).drop("batch", "bucket")

    def apply(self, arrived: DataFrame, batch: int) -> None:
        """Takes a batch of arrivals (ROW) in; for foreachBatch."""
        state = self.state()
        if batch <= state["batch"]:
            return
        own = F.pmod(F.xxhash64("company_id", F.coalesce("supplier_gstin", F.lit(""))), F.lit(self.buckets)).cast("int")
        placed = arrived.select(*NAMES).dropDuplicates(["side", "id"]).withColumn("bucket", own)
        known = self._rows(state["rows"]).select("side", "id", "bucket")
        fresh = placed.join(known, ["side", "id", "bucket"], "left_anti").select(*NAMES, "bucket")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={batch}")
        new = self._rows([batch])
        hit = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` numbers at most
        if hit:
            rows = touched(self._rows([*state["rows"], batch]).where(F.col("bucket").isin(hit)), new)
            kind = F.when(F.col("side") == BOOKS, "purchase_invoice").otherwise("gstr2b_line").alias("left_type")
            mine = rows.select(kind, F.col("id").alias("left_id"), "bucket")
            anew = reconcile(rows.where(F.col("side") == BOOKS), rows.where(F.col("side") == PORTAL)).join(mine, ["left_type", "left_id"])
            old = self._matches({b: n for b, n in state["matches"].items() if int(b) in hit}).join(mine, ["left_type", "left_id"], "left_anti")
            names = self.spark.createDataFrame([], MATCH).columns
            out = f"{self.path}/matches/batch={batch}"
            old.select(*names, "bucket").union(anew.select(*names, "bucket")).write.mode("overwrite").partitionBy("bucket").parquet(out)
            written = {n.removeprefix("bucket=") for n in manifests.names(self.spark, out)}
            versions = {b: n for b, n in state["matches"].items() if int(b) not in hit} | {str(b): batch for b in hit if str(b) in written}
            state = {"batch": batch, "rows": [*state["rows"], batch], "matches": versions}
        manifests.write_json(self.spark, f"{self.path}/commits/{batch:012d}.json", state | {"batch": batch})
