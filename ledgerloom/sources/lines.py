"""The lines of stored documents, laid out so that a few of them are read without the rest.

Lines are Parquet rows sorted by document and place, in folders by a hash of the document and in small pages; a reader that asks
for places of named documents reads the footers of their folders and the pages that hold those places, however large the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "document string, source_row int, line string"
#: Bytes of a row group and rows of a page.
GROUP_BYTES, PAGE_ROWS = 1 << 20, 500
#: Places that are asked for by filters that reach the pages; more are joined.
FEW = 200


class LineStore:
    """The store below `path`, with so many folders."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, document: Column) -> Column:
        return F.pmod(F.xxhash64(document), F.lit(self.buckets)).cast("int")

    def add(self, lines: DataFrame) -> None:
        """Appends the lines (document, source_row, line) of new documents. A document is sorted over several tasks if it is large."""
        placed = lines.select("document", "source_row", "line").withColumn("bucket", self._bucket(F.col("document")))
        ordered = placed.repartitionByRange("bucket", "document", "source_row").sortWithinPartitions("bucket", "document", "source_row")
        ordered.write.mode("append").partitionBy("bucket").option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(self.path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(LINE + ", bucket int").parquet(self.path)

    def around(self, wanted: list[tuple[str, int]] | DataFrame, context: int = 2) -> DataFrame:
        """document, at (the place asked for), source_row, line, is_target and the document's header (its first line): the lines
        up to `context` before and after each place; none for a place that isn't there. wanted: (document, place) pairs, or
        a frame of document and source_row for many."""
        if isinstance(wanted, DataFrame):
            return self._joined(wanted, context)
        frame = self.spark.createDataFrame(list(wanted), "document string, source_row int")
        if not wanted or len(set(wanted)) > FEW:
            return self._joined(frame, context)
        near = lambda d, r: (F.col("document") == d) & (F.col("source_row").between(r - context, r + context) | (F.col("source_row") == 1))
        homes = [r.b for r in frame.select(self._bucket(F.col("document")).alias("b")).distinct().collect()]  # FEW at most
        found = self._all().where(F.col("bucket").isin(homes)).where(reduce(lambda a, b: a | b, (near(d, r) for d, r in sorted(set(wanted)))))
        return self._told(found, frame, context)

    def _joined(self, wanted: DataFrame, context: int) -> DataFrame:
        return self._told(self._all(), wanted, context)

    def _told(self, lines: DataFrame, wanted: DataFrame, context: int) -> DataFrame:
        asked = wanted.select("document", F.col("source_row").alias("at")).distinct()
        rows = F.array_union(F.sequence(F.col("at") - context, F.col("at") + context), F.array(F.lit(1)))
        spread = asked.withColumn("bucket", self._bucket(F.col("document"))).withColumn("source_row", F.explode(rows))
        met = lines.join(spread, ["bucket", "document", "source_row"])
        heads = met.where("source_row = 1").select("document", "at", F.col("line").alias("header"))
        there = met.where(F.col("source_row") == F.col("at")).select("document", "at")
        shown = met.where(F.abs(F.col("source_row") - F.col("at")) <= context).join(there, ["document", "at"], "left_semi")
        return shown.join(heads, ["document", "at"], "left").select("document", "at", "source_row", "line", (F.col("source_row") == F.col("at")).alias("is_target"), "header")
