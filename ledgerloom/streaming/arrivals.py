"""Feeds that keep arriving: files picked up once by path, taken once by content (unseen), and what a batch touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import reconcile


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """company_id (of a folder company_id=N on the path, else null), path, content and sha256 of each new file below the folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    company = F.nullif(F.regexp_extract("path", "/company_id=([0-9]+)/", 1), F.lit("")).cast("int").alias("company_id")
    return files.select(company, "path", "content", F.sha2("content", 256).alias("sha256"))


def unseen(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Arrived files (company_id, path, content, sha256) whose content no registered document (company_id, sha256) has. The same
    content under several paths of one company counts once; two companies may have the same file."""
    key = ["company_id", "sha256"]
    return files.dropDuplicates(key).join(manifest.select(*key).distinct(), key, "left_anti")


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], stores: int | None = None) -> StreamingQuery:
    """Runs `handle` on what has arrived and stops; the next call goes on from there. stores: into how many partitions the state goes,
    which stays so for the checkpoint's life; else as many as the session's shuffles have."""
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    usual = conf.get(name)
    try:
        conf.set(name, str(stores or usual))
        return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, usual)


def touched(books: DataFrame, arrived: DataFrame) -> DataFrame:
    """All rows of the supplier blocks that new rows fall into: a late document can match any earlier period. Rows
    without a supplier are a block of their company's."""
    blocks = arrived.select(F.col("company_id").alias("c"), F.col("supplier_gstin").alias("g")).distinct()
    return books.join(blocks, F.col("company_id").eqNullSafe(F.col("c")) & F.col("supplier_gstin").eqNullSafe(F.col("g")), "left_semi")


def rematched(matches: DataFrame, books: DataFrame, portal: DataFrame, arrived: DataFrame) -> DataFrame:
    """The matches of all rows after some have arrived (company_id, supplier_gstin), where only their blocks are matched
    anew: decisions of other blocks stay. books and portal hold the new rows."""
    mine, theirs = touched(books, arrived), touched(portal, arrived)
    anew = mine.select(F.lit("purchase_invoice").alias("left_type"), F.col("id").alias("left_id")).union(theirs.select(F.lit("gstr2b_line"), "id"))
    return matches.join(anew, ["left_type", "left_id"], "left_anti").select(matches.columns).union(reconcile(mine, theirs).select(matches.columns))
