"""Folders of feeds, of one company or of all, or one uploaded file, as typed tables with parties resolved.

Feeds are read in a fixed order, which is also the order in which they name parties: statement, inbox, purchases, sales,
vouchers, bank. Names that no party of the statement, an earlier feed or an earlier row is like become parties of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import dates, text
from ..operators import parties
from ..operators.matching import stored
from . import feeds
from .columns import BANK, LEDGER, PURCHASES, SALES, Layout

# The files of a folder, in the order in which they are read.
FILES = {
    "gstr2b": "gstr2b_*.json", "ims": "ims_*.json", "purchase_register": "tally_purchase_register*.csv", "sales_ledger": "tally_sales_register*.csv", "ledger": "tally_ledger_entries*.csv", "bank_stmt": "bank_statement*.csv",
}
CSV: dict[str, Callable[[DataFrame], DataFrame]] = {"purchase_register": feeds.purchases, "sales_ledger": feeds.sales, "ledger": feeds.ledger, "bank_stmt": feeds.bank}
LAYOUTS: dict[str, Layout] = {"purchase_register": PURCHASES, "sales_ledger": SALES, "ledger": LEDGER, "bank_stmt": BANK}
JSON: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {"gstr2b": feeds.statement, "ims": feeds.inbox}


def read_kind(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """The rows of a kind's files below the paths, whatever spellings their headers have; a header that lacks a field is an error."""
    if kind in JSON:
        return JSON[kind](spark, paths)
    frames, wrong = feeds.by_layout(stored(feeds.scan_csv(spark, paths, F.lit(kind))), LAYOUTS[kind])
    if bad := wrong.first():
        raise ValueError(f"{bad.document}: {bad.error}")
    blank = StructType([StructField(names[0], StringType()) for _, names in LAYOUTS[kind].values()]).add("document", "string").add("source_row", "integer")
    return reduce(DataFrame.unionByName, map(CSV[kind], frames or [spark.createDataFrame([], blank)]))


def periods_in(rows: DataFrame) -> DataFrame:
    """The periods that rows touch; unreadable dates touch none."""
    return rows.where("period is not null").select("period").distinct()


def seen(feed: int) -> F.Column:
    return F.struct(F.lit(feed).alias("feed"), F.col("document"), F.col("source_row"))


def name_parties(spark: SparkSession, statement: DataFrame | None, named: list[tuple[int, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """The companies' parties and the party of each name (company_id, name, party_id, method), as if the feeds were read row by
    row. statement: rows with company_id, supplier_gstin, supplier_name; named: (feed number, rows with company_id, party and
    perhaps supplier_gstin, kind) in feed order. A name that no party before it is like makes one (parties.elect)."""
    rows = spark.createDataFrame([], "company_id int, gstin string, name string, kind string, seen struct<feed:int,document:string,source_row:int>, said string")
    if statement is not None:
        rows = rows.union(statement.where("supplier_gstin is not null").select("company_id", "supplier_gstin", "supplier_name", F.lit("vendor"), seen(0), text.norm_party(F.col("supplier_name"))))
    for feed, df, kind in named:
        gstin = F.col("supplier_gstin") if "supplier_gstin" in df.columns else F.lit(None).cast("string")
        said = df.where("party <> ''").select("company_id", gstin.alias("gstin"), F.col("party").alias("name"), F.lit(kind).alias("kind"), seen(feed).alias("seen"), text.norm_party(F.col("party")).alias("said"))
        known = parties.observed(rows).where("key <> ''").groupBy("company_id", "key").agg(F.min_by("name", "seen").alias("known_as"))
        asked = said.where("said <> ''").groupBy("company_id", F.col("said").alias("key")).agg(F.min("seen").alias("seen"), F.min(F.when(F.col("gstin").isNotNull(), F.col("seen"))).alias("stated"), F.min_by("name", "seen").alias("first_as"))
        asked = stored(asked.join(known.select("company_id", "key"), ["company_id", "key"], "left_anti"))
        called = known.select("company_id", F.col("key").alias("meant"), F.col("known_as").alias("as")).union(asked.select("company_id", "key", "first_as"))
        meant = parties.elect(asked, known).join(called, ["company_id", "meant"]).select("company_id", F.col("key").alias("said"), "as")
        rows = stored(rows.union(said.join(meant, ["company_id", "said"], "left").select("company_id", "gstin", F.when(F.col("gstin").isNull(), F.coalesce("as", "name")).otherwise(F.col("name")), "kind", "seen", "said")))
    every = stored(parties.register(rows.drop("said")))
    alias = parties.observed(rows).where("said <> ''").groupBy("company_id", F.col("said").alias("key")).agg(F.min_by("party_id", "seen").alias("party_id"))
    return every, stored(alias)


def with_parties(raw: dict[str, DataFrame], every: DataFrame, alias: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """The feeds' rows of known periods (company_id, period) with their party; purchases without a stated tax id get their
    party's. raw: rows with company_id by kind."""
    out = {}
    for kind, df in raw.items():
        if kind in JSON:
            out[kind] = df
            continue
        rows = df.where("error is null").join(known, ["company_id", "period"], "left_semi")
        if kind == "bank_stmt":
            met = parties.resolve_narrations(df.select("company_id", "narration").distinct(), every.select("company_id", "key", "party_id"))
            out[kind] = rows.join(met, ["company_id", "narration"], "left")
            continue
        met = parties.resolve_names(df.select("company_id", F.col("party").alias("name")).distinct(), every.select("company_id", "party_id", "name"), alias)
        rows = rows.join(met.select("company_id", F.col("name").alias("party"), "party_id"), ["company_id", "party"], "left")
        if kind == "purchase_register":
            stamp = every.select("company_id", "party_id", F.col("gstin").alias("own_gstin"))
            rows = rows.join(stamp, ["company_id", "party_id"], "left").withColumn("supplier_gstin", F.coalesce("supplier_gstin", "own_gstin")).drop("own_gstin")
        out[kind] = rows
    return out


#: The feeds that make parties, after the statement, and what their parties are.
MAKERS = (("purchase_register", "vendor"), ("sales_ledger", "customer"))


def kind_of(document: F.Column, kinds: Iterable[str] = FILES) -> F.Column:
    """The kind of a file, by a folder kind=... on its way or by its name; null for others."""
    name = F.element_at(F.split(document, "/"), -1)
    out = F.lit(None).cast("string")
    for kind in kinds:
        out = F.when(F.contains(document, F.lit(f"/kind={kind}/")), kind).otherwise(out)
        out = F.when(name.rlike("^" + FILES[kind].replace(".", "\\.").replace("*", ".*") + "$"), kind).otherwise(out)
    return out


def company_of(document: F.Column) -> F.Column:
    """The company of a file: its folder is company_id=N."""
    return F.regexp_extract(document, "/company_id=([0-9]+)/", 1).cast("int")


def _ingest(spark: SparkSession, csv_at: list[str], json_at: dict[str, list[str]], company: F.Column) -> dict[str, DataFrame]:
    """The feeds of the CSV files below csv_at and of each kind's json_at; company tells a file's company from its `document`."""
    raw, bad = {}, []
    if csv_at:
        records = stored(feeds.scan_csv(spark, csv_at, kind_of(F.col("document"), CSV)))
        for kind, read in CSV.items():
            frames, wrong = feeds.by_layout(records.where(F.col("kind") == kind), LAYOUTS[kind])
            bad.append(wrong)
            if frames:
                raw[kind] = stored(reduce(DataFrame.unionByName, (read(f) for f in frames)).withColumn("company_id", company))
    named = spark.createDataFrame([], "company_id int, period string")
    for kind, at in json_at.items():
        raw[kind] = stored(JSON[kind](spark, at).withColumn("company_id", company))
        document = spark.read.format("binaryFile").load(at).select(F.col("path").alias("document"))  # names alone, files may hold no row
        named = named.union(document.select(company.alias("company_id"), dates.named_period(F.element_at(F.split("document", "/"), -1))))
    periods = reduce(DataFrame.union, (df.select("company_id", "period") for df in raw.values()), named)
    known = stored(periods.where("period is not null").distinct())
    every, alias = name_parties(spark, raw.get("gstr2b"), [(n, raw[k], kind) for n, (k, kind) in enumerate(MAKERS, 2) if k in raw])
    unreadable = reduce(DataFrame.union, bad, spark.createDataFrame([], "document string, error string")).withColumn("company_id", company)
    return {"periods": known, "parties": every, "unreadable": unreadable} | with_parties(raw, every, alias, known)


def _there(spark: SparkSession, *patterns: str) -> list[str]:
    return [p for p in patterns if feeds.any_file(spark, p)]


def ingest_folder(spark: SparkSession, folder: str, company_id: int) -> dict[str, DataFrame]:
    """periods (those that rows' dates or the names of statements and inboxes tell), parties, and the rows of each feed of one
    company's folder, those of known periods with their party. Besides `unreadable`: files whose headers lack a field, with
    the reason, which stop no other file. Files are those named as FILES says."""
    at = {kind: _there(spark, f"{folder.rstrip('/')}/{FILES[kind]}") for kind in FILES}
    return _ingest(spark, [p for kind in CSV for p in at[kind]], {kind: at[kind] for kind in JSON if at[kind]}, F.lit(company_id))


def ingest_companies(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What ingest_folder gives, for all companies' folders root/company_id=N at once, each row with its company_id; a file may also
    lie in a folder kind=K there, under any name.

    One scan reads all CSV files and one each all statements and inboxes; so the number of jobs depends on neither the
    companies nor the files.
    """
    base = root.rstrip("/")
    at = {kind: _there(spark, f"{base}/*/{FILES[kind]}", f"{base}/*/kind={kind}/*") for kind in JSON}
    return _ingest(spark, [base], {kind: found for kind, found in at.items() if found}, company_of(F.col("document")))


def ingest_upload(spark: SparkSession, path: str, kind: str, manifest: DataFrame, company_id: int) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """One uploaded file: its rows (None if its content is known), its periods, and the manifest with it.

    manifest: company_id, sha256, document. A kind nobody knows is an error, and so is a file without any period.
    """
    if kind not in FILES:
        raise ValueError(f"{kind!r} is none of {', '.join(FILES)}")
    files = spark.read.format("binaryFile").load(path).select(F.lit(company_id).alias("company_id"), "path", "content")
    rows = read_kind(spark, [path], kind)
    periods = periods_in(rows)
    if not periods.limit(1).count():
        raise ValueError(f"no readable date in {path}")
    new = feeds.new_documents(files, manifest).select("company_id", "sha256", F.col("path").alias("document"))
    return (rows if new.limit(1).count() else None), periods, manifest.select("company_id", "sha256", "document").union(new)
