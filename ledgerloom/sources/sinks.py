"""What is written: rows once by id, files once by content, merged dimensions, matches by domain, exports and templates."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from . import manifests
from .columns import BANK, LEDGER, PURCHASES, SALES, Layout


def new_rows(existing: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key isn't there yet, each once; append them and a second run changes nothing."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def storage_key(slug: Column, sha256: Column, name: Column) -> Column:
    return F.concat_ws("/", slug, F.substring(sha256, 1, 2), sha256, name)


def new_objects(files: DataFrame, store: DataFrame) -> DataFrame:
    """files (slug, name, content) under their content's key, without what the store (key) holds; equal ones once."""
    sha = F.sha2("content", 256)
    keyed = files.withColumn("sha256", sha).withColumn("key", storage_key(F.col("slug"), F.col("sha256"), F.col("name")))
    return keyed.dropDuplicates(["key"]).join(store.select("key"), "key", "left_anti")


def merge_rows(old: DataFrame, new: DataFrame, key: list[str], replace: list[str] | None = None) -> DataFrame:
    """old with new rows by key: columns named in `replace` take the new value where there is one, others keep theirs."""
    replace = [c for c in old.columns if c not in key] if replace is None else replace
    met = old.alias("a").join(new.alias("b"), key, "full")
    pick = lambda c: F.coalesce(f"b.{c}", f"a.{c}") if c in replace else F.coalesce(f"a.{c}", f"b.{c}")
    return met.select(*key, *(pick(c).alias(c) for c in old.columns if c not in key))


def merge_companies(firms: DataFrame, companies: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """firms (firm_id, name) and companies (company_id, firm_id, slug, name, gstin) after a run of named companies (firm, slug, name,
    gstin, seen): ids are those of the firm's name and the slug, a firm that is known stays, a company that is known takes the new
    name and tax id and stays with its firm. Of several rows of a slug the last seen counts."""
    last = named.groupBy("slug").agg(*(F.max_by(c, "seen").alias(c) for c in ("firm", "name", "gstin")))
    new_firms = named.select(stable_id("firm", F.col("firm")).alias("firm_id"), F.col("firm").alias("name")).distinct()
    new = last.select(stable_id("company", F.col("slug")).alias("company_id"), stable_id("firm", F.col("firm")).alias("firm_id"), "slug", "name", "gstin")
    return merge_rows(firms, new_firms, ["firm_id"], []), merge_rows(companies, new, ["company_id"], ["name", "gstin"])


def count_rows(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """documents (document, ...) with row_count: how many of rows (document) came of each; 0 if none did."""
    n = rows.groupBy("document").agg(F.count("*").alias("row_count"))
    return documents.join(n, "document", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def mark_generated(periods: DataFrame, statements: DataFrame) -> DataFrame:
    """periods with `generated` set where statements (company_id, period) have come."""
    came = statements.select("company_id", "period").distinct().withColumn("came", F.lit(True))
    return periods.join(came, ["company_id", "period"], "left").withColumn("generated", F.coalesce("generated", F.lit(False)) | F.coalesce("came", F.lit(False))).select(periods.columns)


def replace_matches(matches: DataFrame, domain: str, path: str, ran: DataFrame | None = None) -> None:
    """Writes the matches of a domain, a folder for each company and domain; only these folders are replaced.

    ran: company_id of the companies that were matched, if more than have matches now: what the others of them had goes. A
    run that dies between is run again: each folder is replaced or removed whatever it holds.
    """
    rows = matches.withColumn("domain", F.lit(domain))
    if ran is not None:
        files = manifests.file_system(matches.sparkSession, path)
        for r in ran.join(rows.select("company_id"), "company_id", "left_anti").distinct().toLocalIterator():  # a company each, as they are removed
            manifests.remove(files, f"{path.rstrip('/')}/company_id={r.company_id}/domain={domain}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company_id", "domain").parquet(path)


def export_register(rows: DataFrame, path: str) -> None:
    """A register (feeds.as_register) as CSV files with a header each."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


LAYOUTS: dict[str, Layout] = {"purchase_register": PURCHASES, "sales_ledger": SALES, "ledger": LEDGER, "bank_stmt": BANK}


def template(kind: str, rows: list[dict[str, str]] = ()) -> str:
    """An example file of a kind: the first spelling of each field, and rows by field."""
    layout, out = LAYOUTS[kind], io.StringIO()
    lines = csv.writer(out, lineterminator="\n")
    lines.writerow([names[0] for _, names in layout.values()])
    lines.writerows([row.get(field, "") for field in layout] for row in rows)
    return out.getvalue()


def write_layout(rows: DataFrame, kind: str, path: str) -> None:
    """rows (a text column for each field of a kind that they have) as CSV files in the template's layout."""
    shown = ((F.col(field) if field in rows.columns else F.lit("")).alias(names[0]) for field, (_, names) in LAYOUTS[kind].items())
    rows.select(*shown).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def required_headers(kind: str) -> tuple[str, ...]:
    return tuple(names[0] for must, names in LAYOUTS[kind].values() if must)
