"""Readers of the feeds. Each row carries its file and its place there; what can't be read says so in `error`."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..operators.inbox import pending_allowed
from ..operators.matching import stored
from .columns import BANK, LEDGER, PURCHASES, SALES, Layout, resolve, value

# The statement's sections - code, key, child list, number field, date field, amendment, has a supplier.
SECTIONS = (
    ("B2B", "b2b", "inv", "inum", "idt", False, True), ("B2BA", "b2ba", "inv", "inum", "idt", True, True), ("CDNR", "cdnr", "nt", "ntnum", "ntdt", False, True),
    ("CDNRA", "cdnra", "nt", "ntnum", "ntdt", True, True), ("ISD", "isd", "doclist", "docnum", "docdt", False, True), ("ISDA", "isda", "doclist", "docnum", "docdt", True, True),
    ("IMPG", "impg", "boe", "boenum", "boedt", False, False), ("IMPGSEZ", "impgsez", "boe", "boenum", "boedt", False, False),
    ("ECO", "eco", "doc", "docnum", "docdt", False, True), ("ECOA", "ecoa", "doc", "docnum", "docdt", True, True),
)
# An entry's further fields.
ENTRY = ("txval", "camt", "samt", "iamt", "csamt", "val", "rev", "itcavl", "rsn", "nttyp", "oinum", "oidt", "portcode")
AMOUNT_FIELDS = {"taxable": "txval", "cgst": "camt", "sgst": "samt", "igst": "iamt", "cess": "csamt", "total": "val"}


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, with document (file name) and source_row: the record's place, the header being 1.

    Files are read whole by record, quoted line breaks included, so a file is one task; a byte-order mark is dropped from
    the header. All files must have the header of the first, or reading fails; csv_groups takes them apart by header.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=False)
    raw = raw.toDF(*[(c or "").lstrip("\ufeff") for c in raw.columns])
    named = raw.withColumn("document", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    return named.withColumn("source_row", F.row_number().over(Window.partitionBy("document").orderBy("__at")) + 1).drop("__at")


def csv_groups(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """The records of the files below path as read_csv gives them, a frame for each different header; only headers come to the
    driver. A name that a header has before gets its place added."""
    records, out = stored(scan_csv(spark, path, F.lit("csv"))), []
    for header, fields in headers(records).items():
        names = [n or f"_c{i}" for i, n in enumerate(fields)]
        names = [n if n not in names[:i] else f"{n}{i}" for i, n in enumerate(names)]
        mine = with_cells(records.where(F.col("header") == header), len(names))
        out.append(mine.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)), "document", "source_row"))
    return out


#: A record of a CSV file, quoted breaks included.
RECORD = r'(?:[^"\n]++|"(?:[^"]++|"")*+(?:"|\z))++'


def scan_csv(spark: SparkSession, paths: str | list[str], kind: Column) -> DataFrame:
    """The records of all CSV files below the paths in one scan: document, kind, source_row (the header is 1), header, record.

    kind tells a file's kind from its `document`; files of no kind are left out. A file is one row of the scan, so a single one
    must fit a task; nothing is shuffled. Empty lines are no records. What comes of the files doesn't depend on how many there are.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(paths, wholetext=True)
    named = files.select(F.input_file_name().alias("document"), F.regexp_replace("value", "^\ufeff|\r(?=\n|$)", "").alias("text")).withColumn("kind", kind).where("kind is not null")
    records = F.filter(F.regexp_extract_all("text", F.lit(RECORD), F.lit(0)), lambda r: F.length(r) > 0)
    whole = named.select("document", "kind", records.alias("records"))
    each = whole.select("document", "kind", F.get("records", F.lit(0)).alias("header"), F.posexplode("records").alias("at", "record"))
    return each.where("at > 0").select("document", "kind", (F.col("at") + 1).alias("source_row"), "header", "record")


def headers(records: DataFrame) -> dict[str, list[str]]:
    """The different header lines of records with their fields, in order; one for each spelling comes to the driver."""
    lines = sorted(r.header for r in records.select("header").distinct().collect())
    return {line: next(csv.reader(io.StringIO(line, newline="")), []) for line in lines}


def with_cells(records: DataFrame, width: int) -> DataFrame:
    """records with their first `width` fields as `cells`; fields that a record hasn't are null."""
    fields = F.from_csv("record", ", ".join(f"c{i} string" for i in range(max(width, 1))), {"escape": '"'})
    return records.withColumn("__c", fields).withColumn("cells", F.array(*(F.col(f"__c.c{i}") for i in range(width)))).drop("__c", "record")


def by_layout(records: DataFrame, layout: Layout) -> tuple[list[DataFrame], DataFrame]:
    """Frames with a column for each field that the files have, by its first spelling, and the documents whose headers lack a
    field: document, error. Headers go to the driver, one for each spelling of a file's first line; files of all headers with the
    same fields share a frame."""
    shapes: dict[tuple[str, ...], list] = {}
    bad = []
    for header, names in headers(records).items():
        try:
            at = resolve([n for n in names if n], layout)
        except ValueError as e:
            bad.append((header, str(e)))
        else:
            shapes.setdefault(tuple(k for k in layout if k in at), []).append((header, {k: names.index(n) for k, n in at.items()}))
    spark, out = records.sparkSession, []
    for fields, files in shapes.items():
        where = F.broadcast(spark.createDataFrame(files, "header string, places map<string,int>"))  # as few as there are spellings of a header
        cell = lambda k: F.get("cells", F.col("places")[k]).alias(layout[k][1][0])
        width = 1 + max(n for _, places in files for n in places.values())
        out.append(with_cells(records.join(where, "header"), width).select("document", "source_row", *(cell(k) for k in fields)))
    wrong = F.broadcast(spark.createDataFrame(bad, "header string, error string"))
    return out, records.join(wrong, "header").select("document", "error").distinct()


def _rows(df: DataFrame, fields: Layout, out: dict[str, Column], at: dict[str, str]) -> DataFrame:
    day = dates.parse_date(value(df, at, "date"))
    bad = F.when(day.isNull(), F.concat(F.lit("unreadable date: "), value(df, at, "date")))
    for key in ("total", "taxable", "cgst", "sgst", "igst", "cess", "debit", "credit"):
        if key in at:
            bad = F.coalesce(bad, F.when(money.parse_amount(value(df, at, key)).isNull(), F.concat(F.lit(f"unreadable {key}: "), value(df, at, key))))
    return df.select("document", "source_row", day.alias("day"), dates.period_of(day).alias("period"), *(c.alias(n) for n, c in out.items()), bad.alias("error"))


def skipped(rows: DataFrame) -> DataFrame:
    """Rows of each document that can't be used, by the reason's kind."""
    return rows.where("error is not null").groupBy("document", F.regexp_extract("error", "^[^:]*", 0).alias("reason")).agg(F.count("*").alias("rows"))


def purchases(df: DataFrame) -> DataFrame:
    at = resolve([c for c in df.columns if c not in ("document", "source_row")], PURCHASES)
    v = lambda k: value(df, at, k)
    amounts = {k: money.parse_amount(v(k)) for k in ("total", "taxable", "cgst", "sgst", "igst", "cess")}
    return _rows(df, PURCHASES, {"party": text.display_party(v("party")), "norm_party": text.norm_party(v("party")), "supplier_gstin": text.norm_gstin(v("gstin")), "invoice_no": v("voucher_no"),
                                 "norm_invoice_no": text.norm_invoice_no(v("voucher_no")), **amounts}, at)


def sales(df: DataFrame) -> DataFrame:
    """Ledger rows of type Sales: the total is the debit."""
    at = resolve([c for c in df.columns if c not in ("document", "source_row")], SALES)
    v = lambda k: value(df, at, k)
    return _rows(df, SALES, {"voucher_type": F.lit("Sales"), "voucher_no": v("voucher_no"), "party": text.display_party(v("party")), "debit": money.parse_amount(v("total")), "credit": F.lit(None).cast(money.MONEY)}, at)


def ledger(df: DataFrame) -> DataFrame:
    at = resolve([c for c in df.columns if c not in ("document", "source_row")], LEDGER)
    v = lambda k: value(df, at, k)
    return _rows(df, LEDGER, {"voucher_type": v("voucher_type"), "voucher_no": v("voucher_no"), "party": text.display_party(v("party")), "debit": money.optional_amount(v("debit")), "credit": money.optional_amount(v("credit"))}, at)


def bank(df: DataFrame) -> DataFrame:
    """Zero amounts are none; rows with neither side are named in `error`. One signed column serves for both."""
    at = resolve([c for c in df.columns if c not in ("document", "source_row")], BANK)
    v = lambda k: value(df, at, k)
    debit, credit = money.optional_amount(v("debit")), money.optional_amount(v("credit"))
    if "amount" in at and not {"debit", "credit"} & at.keys():
        debit, credit = money.signed_amount(v("amount"))
    out = _rows(df, BANK, {"narration": v("narration"), "ref_no": F.nullif(v("ref_no"), F.lit("")), "balance": money.optional_amount(v("balance")), "debit": F.nullif(debit, F.lit(0)).cast(money.MONEY), "credit": F.nullif(credit, F.lit(0)).cast(money.MONEY)}, at)
    return out.withColumn("error", F.coalesce("error", F.when(F.col("debit").isNull() & F.col("credit").isNull(), F.lit("neither debit nor credit"))))


def any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a file fits the pattern."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def _fields_of(number: str, day: str) -> str:
    return ",".join(f"{n}:string" for n in dict.fromkeys((number, day, *ENTRY)))


def _block_type(child: str, number: str, day: str) -> str:
    return f"array<struct<ctin:string,trdnm:string,supprd:string,{child}:array<struct<{_fields_of(number, day)}>>>>"


STATEMENT = "rtnprd string, gstin string, gendt string, docdata struct<" + ",".join(f"{key}:{_block_type(child, number, day)}" for _, key, child, number, day, _, _ in SECTIONS) + ">, itcrev37a array<struct<ctin:string,inum:string,idt:string,rev_amt:string,rsn:string>>"
INBOX = "rtnprd string, gstin string, records array<struct<ctin:string,trdnm:string,doctype:string,inum:string,orig_inum:string,idt:string,val:string,supplier_filed:boolean,is_amendment:boolean,amend_direction:string,status:string,actioned_at:string>>"


def _documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """document and d, what a file holds, under `data` or at its top; each file is parsed once."""
    from pyspark.sql.types import StructType

    inner = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document"), F.from_json("value", f"data struct<{inner}>, {ddl}").alias("j"))
    return whole.select("document", F.coalesce("j.data", F.struct(*(F.col(f"j.{f.name}") for f in StructType.fromDDL(ddl).fields))).alias("d"))


def _entries() -> Column:
    """All entries of a statement in their canonical order: the sections' order, then blocks, then entries."""

    def of_section(code: str, key: str, child: str, number: str, day: str, amends: bool, supplied: bool) -> Column:
        def one(block: Column, x: Column) -> Column:
            named = F.when(F.lit(supplied), block["ctin"]), F.when(F.lit(supplied), block["trdnm"])
            return F.struct(
                F.lit(code).alias("section"), F.lit(amends).alias("is_amendment"), named[0].alias("ctin"), named[1].alias("trdnm"), x[number].alias("number"), x[day].alias("date"), *(x[f].alias(f) for f in ENTRY)
            )

        blocks = F.coalesce(F.col(f"d.docdata.{key}"), F.array().cast(_block_type(child, number, day)))
        return F.flatten(F.transform(blocks, lambda block: F.transform(F.coalesce(block[child], F.array().cast(f"array<struct<{_fields_of(number, day)}>>")), lambda x: one(block, x))))

    return F.concat(*(of_section(*s) for s in SECTIONS))


#: The types of an entry in its canonical form and of a reversal.
ENTRY_TYPE = "struct<section:string,is_amendment:boolean,ctin:string,trdnm:string,number:string,date:string," + ",".join(f"{f}:string" for f in ENTRY) + ">"
REVERSAL_TYPE = "struct<ctin:string,inum:string,idt:string,rev_amt:string,rsn:string>"


def _entries_and_reversals() -> Column:
    """All entries, then the reversals, each as a struct of which the other half is null; so a file is parsed once for both."""
    both = lambda entry, back: F.struct(entry.cast(ENTRY_TYPE).alias("entry"), back.cast(REVERSAL_TYPE).alias("back"))
    reversals = F.coalesce(F.col("d.itcrev37a"), F.array().cast(f"array<{REVERSAL_TYPE}>"))
    return F.concat(F.transform(_entries(), lambda e: both(e, F.lit(None))), F.transform(reversals, lambda r: both(F.lit(None), r)))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """document, period, source_row (from 1) and the entry as the file has it, with its section and supplier."""
    docs = _documents(spark, path, STATEMENT)
    return docs.select("document", _period(F.col("d.rtnprd"), F.col("document")).alias("period"), F.posexplode(_entries()).alias("at", "entry")).select("document", "period", (F.col("at") + 1).alias("source_row"), "entry")


def entry_at(rows: DataFrame, source_row: int) -> DataFrame:
    """The entry at a place of each document; none if there is no such place."""
    return rows.where(F.col("source_row") == source_row)


def described(rows: DataFrame) -> DataFrame:
    """document, source_row and the entry as JSON; what it hasn't is left out."""
    return rows.select("document", "source_row", F.to_json("entry").alias("line"))


def _period(rtnprd: Column, document: Column) -> Column:
    """The period that a file states, else that of its name; an error if neither does."""
    name = F.element_at(F.split(document, "/"), -1)
    return F.coalesce(dates.statement_period(rtnprd), dates.named_period(name), F.raise_error(F.concat(F.lit("no period in the file or the name of "), name)).cast("string"))


def statement(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a portal statement, the sections in their fixed order, null or missing ones empty;
    source_row counts through them. Reversals are summed by supplier and number and joined."""
    x = lambda f: F.col(f"entry.{f}")
    gstin, number = text.norm_gstin(F.coalesce(x("ctin"), F.col("back.ctin"))), text.norm_invoice_no(F.coalesce(x("number"), F.col("back.inum")))
    own = Window.partitionBy("document", "supplier_gstin", "norm_invoice_no")
    summed = F.when(F.col("supplier_gstin").isNotNull() & F.col("norm_invoice_no").isNotNull(), F.sum("back_amount").over(own))
    both = _documents(spark, path, STATEMENT).select("document", _period(F.col("d.rtnprd"), F.col("document")).alias("period"), F.posexplode(_entries_and_reversals()).alias("at", "row")).select("document", "period", (F.col("at") + 1).alias("source_row"), "row.*")
    keyed = both.withColumns({"supplier_gstin": gstin, "norm_invoice_no": number, "back_amount": F.when(F.col("back").isNotNull(), money.parse_amount(F.col("back.rev_amt")))})
    return keyed.withColumn("reversal", F.coalesce(summed, F.lit(0)).cast(money.MONEY)).where("entry is not null").select(
        "document", "period", "source_row", x("section").alias("section"), x("is_amendment").alias("is_amendment"), "supplier_gstin", x("trdnm").alias("supplier_name"),
        x("number").alias("invoice_no"), "norm_invoice_no", dates.parse_date(x("date")).alias("day"),
        *(money.parse_amount(x(f)).alias(n) for n, f in AMOUNT_FIELDS.items()), (F.coalesce(x("itcavl"), F.lit("Y")) != "N").alias("itc_available"),
        F.when(x("nttyp").isin("C", "D"), x("nttyp")).alias("note_type"), F.when(x("is_amendment"), text.norm_invoice_no(x("oinum"))).alias("amends_invoice_no"), "reversal",
    )


def inbox(spark: SparkSession, path: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for x in ("INV", "invoice", "DBN", "debit_note", "DN", "debit_note", "CRN", "credit_note", "CN", "credit_note")))
    rows = _documents(spark, path, INBOX).select("document", _period(F.col("d.rtnprd"), F.col("document")).alias("period"), F.posexplode("d.records").alias("at", "r"))
    return rows.select(
        "document", (F.col("at") + 1).alias("source_row"), "period", text.norm_gstin(F.col("r.ctin")).alias("supplier_gstin"), F.col("r.trdnm").alias("supplier_name"), F.coalesce(F.try_element_at(kind, F.upper("r.doctype")), F.lit("invoice")).alias("doc_type"),
        F.col("r.inum").alias("invoice_no"), text.norm_invoice_no(F.col("r.inum")).alias("norm_invoice_no"), text.norm_invoice_no(F.col("r.orig_inum")).alias("orig_norm_invoice_no"), dates.parse_date(F.col("r.idt")).alias("day"),
        money.parse_amount(F.col("r.val")).alias("total"), F.coalesce("r.supplier_filed", F.lit(False)).alias("supplier_filed"), F.coalesce("r.is_amendment", F.lit(False)).alias("is_amendment"), F.col("r.amend_direction").alias("direction"),
        F.coalesce("r.status", F.lit("no_action")).alias("portal_status"), dates.parse_date(F.substring("r.actioned_at", 1, 10)).alias("actioned_at"),
    ).withColumns({"pending_allowed": pending_allowed(F.col("doc_type"), F.col("is_amendment"), F.col("direction")), "reject_raises_supplier_liability": (F.col("doc_type") == "credit_note") | (F.col("is_amendment") & F.coalesce(F.col("direction") == "downward", F.lit(False)))})


#: An ampersand that starts no entity, and numbered entities of control characters, which XML doesn't allow.
LONE_AMPERSAND, CONTROL = "&(?![A-Za-z][A-Za-z0-9]*;|#[0-9]+;|#[xX][0-9A-Fa-f]+;)", "&#(?:0*(?:[0-8]|1[124-9]|2[0-9]|3[01])|[xX]0*(?:[0-8BbCcEeFf]|1[0-9A-Fa-f]));"


def vouchers(spark: SparkSession, path: str, kind: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Vouchers of a gateway's XML export, of one type and from start to end (dates as yyyy-MM-dd) if these are given;
    lone ampersands and control entities are mended first, vouchers without a date left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document"), F.regexp_replace(F.regexp_replace("value", CONTROL, ""), LONE_AMPERSAND, "&amp;").alias("xml"))
    each = raw.select("document", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<VOUCHER\b.*?</VOUCHER>"), F.lit(0))).alias("at", "v"))
    get = lambda n: F.trim(F.xpath_string("v", F.lit(f"VOUCHER/{n}")))
    day = F.try_to_timestamp(get("DATE"), F.lit("yyyyMMdd")).cast("date")
    out = each.select("document", (F.col("at") + 1).alias("source_row"), day.alias("day"), get("VOUCHERNUMBER").alias("voucher_no"), get("VOUCHERTYPENAME").alias("voucher_type"), get("PARTYLEDGERNAME").alias("party"), F.abs(money.parse_amount(get("AMOUNT"))).alias("total"), get("NARRATION").alias("narration"))
    wanted = F.col("day").isNotNull()
    for given, test in ((kind, F.col("voucher_type") == kind), (start, F.col("day") >= F.lit(start).cast("date")), (end, F.col("day") <= F.lit(end).cast("date"))):
        wanted = wanted & test if given else wanted
    return out.where(wanted)


def as_register(found: DataFrame) -> DataFrame:
    """Vouchers in the layout of a purchase register; what the gateway doesn't say stays empty."""
    blank = F.lit("")
    shown = {"Date": F.date_format("day", "dd-MMM-yyyy"), "Particulars": F.col("party"), "Voucher Type": F.col("voucher_type"), "Voucher No": F.col("voucher_no")}
    shown |= {n: blank for n in ("Taxable Value", "CGST", "SGST", "IGST", "Cess")} | {"Invoice Value": F.col("total").cast("string"), "Narration": F.col("narration")}
    return found.select(*(c.alias(n) for n, c in shown.items()))


def new_documents(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, content) whose content no registered document (company_id, sha256) has; equal ones count once."""
    known = files.withColumn("sha256", F.sha2("content", 256))
    first = known.withColumn("nth", F.row_number().over(Window.partitionBy("company_id", "sha256").orderBy("path"))).where("nth = 1").drop("nth")
    return first.join(manifest.select("company_id", "sha256"), ["company_id", "sha256"], "left_anti")


def resolve_parties(names: DataFrame, parties: DataFrame, cutoff: float = 92.0) -> DataFrame:
    """names (name) with party_id: by equal key, else the likest key of at least `cutoff`; blank names have none."""
    from ..operators.parties import resolve_names

    index = parties.select(F.lit(0).alias("company_id"), "party_id", "name")
    found = resolve_names(names.select(F.lit(0).alias("company_id"), "name").distinct(), index, None, cutoff)
    return names.join(found.select("name", "party_id"), "name", "left")
