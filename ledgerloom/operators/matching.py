"""Register rows against portal rows, bank lines against vouchers: blocked pairs, scores, one-to-one choice.

Left and right rows carry id, company_id, period, supplier_gstin, norm_invoice_no, invoice_date and paise amounts
taxable, cgst, sgst, igst, cess. A choice among pairs is greedy in one total order; it streams through sorted pairs
of a block, and blocks with very many pairs are first split into their connected parts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import half_even
from ..functions.text import doc_type, indel_ratio
from . import likest

HEADS = ("cgst", "sgst", "igst", "cess")
AMOUNTS = ("taxable", *HEADS)
# Weights of a pair's score in thousandths, days beyond which dates count as apart, least score, fuzzy ranks and floor.
W_GSTIN, W_NUMBER, W_AMOUNT, W_DATE = 450, 300, 150, 100
DATE_HORIZON, SCORE_FLOOR, FUZZY_RANKS, FUZZY_FLOOR = 30, 0.70, 3, 60
#: The greatest score, in thousandths, and the length up to which only pairs of equal numbers have it: a letter that differs costs 300
#: thousandths by the two numbers' length, over half a thousandth below 600 letters.
FULL_SCORE, LONGEST = W_GSTIN + W_NUMBER + W_AMOUNT + W_DATE, 200
#: What each part of a score gave, from 0 to 1.
BREAKDOWN = "struct<gstin:double,invno:double,amount:double,date:double>"
#: Equal up to one rupee, in paise.
TOLERANCE = 100
BANK_PAISE, BANK_DAYS = 100, 5
#: Pairs of a block from which it is split into connected parts, and pairs of numbers up to which a block is joined.
MOST_PAIRS, MOST_JOINED = 1_000_000, 100_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; only a local master gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written below spark.checkpoint.dir; results that aren't written elsewhere go too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again, so that iterations don't grow their plan."""
    path = scratch_path(df.sparkSession, "match")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side(df: DataFrame, prefix: str) -> DataFrame:
    names = ("id", "period", "supplier_gstin", "norm_invoice_no", "invoice_date", *AMOUNTS)
    return df.select("company_id", *(F.col(n).alias(f"{prefix}_{n}") for n in names))


def comparable(portal: DataFrame) -> DataFrame:
    """Portal rows that answer to the register: supplies, without those that an amendment has replaced."""
    b2b = portal.where("section in ('B2B', 'B2BA')")
    newer = portal.where("section = 'B2BA' and amends_invoice_no is not null").select(
        F.col("company_id").alias("c"), F.col("supplier_gstin").alias("g"), F.col("amends_invoice_no").alias("n"))
    return b2b.join(newer, (F.col("section") == "B2B") & (F.col("company_id") == F.col("c")) & (F.col("supplier_gstin") == F.col("g")) & (F.col("norm_invoice_no") == F.col("n")), "left_anti")


def scored(pairs: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Adds score (3 decimals, half to even, from whole numbers), category, amount_delta, date_delta_days,
    parameters_matched and the breakdown. number_ratio is 0..1, amounts go up to 6e13 paise."""
    col = F.col
    near = lambda n: F.abs(col(f"l_{n}") - col(f"r_{n}")) <= tolerance
    total = lambda p: sum((col(f"{p}_{h}") for h in HEADS[1:]), col(f"{p}_cgst"))
    both = (F.coalesce("l_norm_invoice_no", F.lit("")) != "") & (F.coalesce("r_norm_invoice_no", F.lit("")) != "")
    same_gstin = F.coalesce((col("l_supplier_gstin") != "") & (col("l_supplier_gstin") == col("r_supplier_gstin")), F.lit(False))
    same_type = doc_type(col("l_norm_invoice_no")) == doc_type(col("r_norm_invoice_no"))
    same_number = F.coalesce(both & (col("l_norm_invoice_no") == col("r_norm_invoice_no")), F.lit(False))
    likeness = F.when(same_number, 10_000).when(both, F.bround(col("number_ratio") * 10_000)).otherwise(0).cast("bigint")
    delta, days = col("l_taxable") - col("r_taxable"), F.datediff("l_invoice_date", "r_invoice_date")
    scale = F.greatest(F.abs(col("l_taxable")), F.lit(100)).cast("bigint")
    amount, day = F.greatest(F.lit(0), scale - F.abs(delta)), F.greatest(F.lit(0), DATE_HORIZON - F.abs(days))
    # thousandths times 300 scale: 1000 (0.45 gstin + 0.30 likeness / 10^4 + 0.15 amount / scale + 0.10 day / 30)
    parts = F.when(same_gstin, 300 * W_GSTIN * scale).otherwise(0) + 300 * W_NUMBER // 10_000 * likeness * scale + 300 * W_AMOUNT * amount + 300 * W_DATE // DATE_HORIZON * day * scale
    identity = same_gstin & same_type
    rest = [same_number, days == 0, near("taxable"), F.abs(total("l") - total("r")) <= tolerance, near("cgst") & near("sgst") & near("igst") & near("cess")]
    agree = sum((r.cast("int") for r in rest[1:]), rest[0].cast("int"))
    category = (
        F.when(identity & (agree == 5), "exact").when(identity & (agree == 4), "partial").when(~identity & (agree == 5), "probable")
        .when(identity & rest[0] & rest[1], "value_mismatch").otherwise("fuzzy")
    )
    told = F.struct(same_gstin.cast("double").alias("gstin"), (likeness / 10_000).alias("invno"), F.bround(amount / scale, 4).alias("amount"), F.bround(day / DATE_HORIZON, 4).alias("date"))
    return pairs.select(
        "*", half_even(parts, 300 * scale).alias("score_milli"), category.alias("category"), delta.alias("amount_delta"), days.alias("date_delta_days"),
        (agree + same_gstin.cast("int") + same_type.cast("int")).alias("parameters_matched"), told.alias("breakdown"),
    ).withColumn("score", F.col("score_milli") / 1000)


def number_pairs(books: DataFrame, portal: DataFrame) -> DataFrame:
    """Pairs of one supplier with equal numbers, scored. Rows without a supplier can't reach the floor."""
    left, right = side(books, "l").where("l_supplier_gstin <> ''"), side(portal, "r").where("r_supplier_gstin <> ''")
    right = right.withColumnRenamed("company_id", "c")
    same = (F.col("company_id") == F.col("c")) & (F.col("l_supplier_gstin") == F.col("r_supplier_gstin")) & (F.col("l_norm_invoice_no") == F.col("r_norm_invoice_no"))
    return scored(left.join(right, same).drop("c").withColumn("number_ratio", F.lit(1.0)))


def fuzzy_pairs(books: DataFrame, portal: DataFrame, most: int = MOST_JOINED, free: DataFrame | None = None) -> DataFrame:
    """Pairs of one supplier whose numbers resemble each other: for each left number the FUZZY_RANKS best
    distinct right numbers of its block (an equal one takes a rank), if they are over the floor and not equal.
    free: the portal rows that pairs are made with, if not all; the ranks go by all.

    Small blocks are joined; numbers of too different lengths can't reach the floor and aren't compared. Blocks of more than
    `most` pairs are searched (likest.py), which rates few pairs and finds the same.
    """
    keys = ["company_id", "supplier_gstin"]
    numbers = lambda df, name: df.where("supplier_gstin <> '' and norm_invoice_no <> ''").select(*keys, F.col("norm_invoice_no").alias(name)).distinct()
    left, right = numbers(books, "l_no"), numbers(portal, "r_no")
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    large = stored(count(left, "lefts").join(count(right, "rights"), keys).where(F.col("lefts") * F.col("rights") > most))
    room = 200.0 / FUZZY_FLOOR - 1  # the longer may be so many times the shorter
    n, m = F.length("l_no"), F.length("r_no")
    near = left.join(large, keys, "left_anti").join(right, keys).where(F.greatest(n, m) <= room * F.least(n, m))
    both = near.withColumn("ratio", F.when(F.col("l_no") == F.col("r_no"), 100.0).otherwise(indel_ratio("l_no", "r_no"))).where(F.col("ratio") >= FUZZY_FLOOR)
    if large.limit(1).count():
        both = both.select(*keys, "l_no", "r_no", "ratio").union(likest.searched(left, right, large, keys, FUZZY_RANKS, FUZZY_FLOOR))
    best = Window.partitionBy(*keys, "l_no").orderBy(F.desc("ratio"), "r_no")
    top = both.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= FUZZY_RANKS) & (F.col("ratio") < 100))
    top = top.select(F.col("company_id").alias("c"), F.col("supplier_gstin").alias("g"), "l_no", "r_no", (F.col("ratio") / 100).alias("number_ratio"))
    left = side(books, "l").join(top, (F.col("company_id") == F.col("c")) & (F.col("l_supplier_gstin") == F.col("g")) & (F.col("l_norm_invoice_no") == F.col("l_no")))
    right = side(portal if free is None else free, "r").withColumnRenamed("company_id", "rc")
    met = left.join(right, (F.col("c") == F.col("rc")) & (F.col("g") == F.col("r_supplier_gstin")) & (F.col("r_no") == F.col("r_norm_invoice_no")))
    return scored(met.drop("c", "g", "l_no", "r_no", "rc"))


def connected(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Each left row's part: the least left id that pairs connect it with. Rounds of least labels over both sides,
    each a written table; the number of rounds grows with the logarithm of the longest way, as labels jump."""
    edges = stored(pairs.select(F.col(left).alias("l"), F.col(right).alias("r")).distinct())
    labels = stored(edges.select("l", F.col("l").alias("part")).distinct())
    while True:
        of_right = edges.join(labels, "l").groupBy("r").agg(F.min("part").alias("part"))
        near = edges.join(of_right, "r").groupBy("l").agg(F.min("part").alias("to"))
        onward = labels.select(F.col("l").alias("to"), F.col("part").alias("jump"))
        new = labels.join(near, "l").join(onward, "to").select("l", F.least("to", "jump").alias("part"), (F.least("to", "jump") < F.col("part")).alias("moved"))
        new = stored(new)
        labels = new.select("l", "part")
        if not new.where("moved").limit(1).count():
            return labels.withColumnRenamed("l", left)


def one_to_one(pairs: DataFrame, left: str, right: str, order: list[Column], block: list[str] | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """The greedy one-to-one choice in the given order (made total by the two ids). Equal pairs count once.

    block: columns whose values no pair crosses. Pairs of a block are sorted by Spark and stream through a task that
    remembers the ids it has given away. A block with more than `most` pairs is split into connected parts first; if
    no block is named, everything is.
    """
    pairs = stored(pairs)
    if block:
        keys = {f"__k{i}": F.col(c) for i, c in enumerate(block)}
        keyed = pairs.withColumns(keys)
        large = keyed.groupBy(*keys).count().where(F.col("count") > most).drop("count")
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col("o" + k))
        others = stored(large.toDF(*("o" + k for k in keys)))
        whole = keyed.withColumn("__part", F.lit(None).cast("long"))
        if others.limit(1).count():
            rest = keyed.join(others, same, "left_semi")
            whole = keyed.join(others, same, "left_anti").withColumn("__part", F.lit(None).cast("long")).unionByName(rest.join(connected(rest, left, right).withColumnRenamed("part", "__part"), left).select(*keyed.columns, "__part"))
    else:
        keys = {}
        whole = pairs.join(connected(pairs, left, right).withColumnRenamed("part", "__part"), left).select(*pairs.columns, "__part")
    group = [*keys, "__part"]
    names, schema = pairs.columns, pairs.schema

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        lefts: set = set()
        rights: set = set()
        for batch in batches:
            keep = []
            for key, a, b in zip(zip(*(batch.column(g).to_pylist() for g in group), strict=True), batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True):
                if key != now:
                    now, lefts, rights = key, set(), set()
                free = a not in lefts and b not in rights
                keep.append(free)
                if free:
                    lefts.add(a)
                    rights.add(b)
            yield batch.select(names).filter(pa.array(keep, type=pa.bool_()))

    return whole.repartition(*group).sortWithinPartitions(*group, *order, left, right).mapInArrow(choose, schema)


def reconcile(books: DataFrame, portal: DataFrame, fuzzy: bool = True, tolerance: int = TOLERANCE) -> DataFrame:
    """A decision for every register row and every portal row: matched, duplicate, unmatched.

    Pairs of full score come first in the greedy order and can't be of numbers that differ (up to LONGEST characters), so they are
    chosen first; only rows that these leave are compared by their numbers' likeness. The choice is the same as among all pairs.
    """
    portal = comparable(portal)
    pairs = number_pairs(books, portal).where(F.col("score") >= SCORE_FLOOR)
    choice = lambda df: stored(one_to_one(df, "l_id", "r_id", [F.desc("score")], ["company_id", "l_supplier_gstin"]))
    if not fuzzy:
        return decisions(books, portal, choice(pairs))
    pairs = stored(pairs)
    full = (F.col("score_milli") == FULL_SCORE) & (F.length("l_norm_invoice_no") <= LONGEST)
    first = choice(pairs.where(full))
    taken = lambda p: first.select("company_id", F.col(f"{p}_id").alias("id"))
    left, right = (df.join(taken(p), ["company_id", "id"], "left_anti") for df, p in ((books, "l"), (portal, "r")))
    rest = pairs.where(~full)
    for p in "lr":
        rest = rest.join(first.select("company_id", f"{p}_id"), ["company_id", f"{p}_id"], "left_anti")
    rest = rest.unionByName(fuzzy_pairs(left, portal, free=right).where(F.col("score") >= SCORE_FLOOR))
    return decisions(books, portal, first.unionByName(choice(rest)))


def decisions(books: DataFrame, portal: DataFrame, matched: DataFrame) -> DataFrame:
    gap = lambda a, b: (F.substring(b, 1, 4).cast("int") - F.substring(a, 1, 4).cast("int")) * 12 + F.substring(b, 6, 2).cast("int") - F.substring(a, 6, 2).cast("int")
    unmet = F.lit(None).cast("int"), F.lit(None).cast(BREAKDOWN)
    hit = matched.select(
        "company_id", F.col("l_period").alias("period"), F.lit("purchase_invoice").alias("left_type"), F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"),
        F.lit("matched").alias("status"), F.col("category").alias("method"), "score", "amount_delta", "date_delta_days", gap("l_period", "r_period").alias("period_gap"), "parameters_matched", "breakdown",
    )
    claimed = matched.select("company_id", F.col("l_supplier_gstin").alias("supplier_gstin"), F.col("l_norm_invoice_no").alias("norm_invoice_no")).distinct().withColumn("claimed", F.lit(True))
    seen = portal.where("supplier_gstin <> ''").select("company_id", "supplier_gstin").distinct().withColumn("seen", F.lit(True))
    alone = books.join(matched.select(F.col("l_id").alias("id")), "id", "left_anti").join(claimed, ["company_id", "supplier_gstin", "norm_invoice_no"], "left").join(seen, ["company_id", "supplier_gstin"], "left")
    dup = F.coalesce("claimed", F.lit(False))
    miss = alone.select(
        "company_id", "period", F.lit("purchase_invoice"), "id", F.lit(None).cast("bigint"), F.when(dup, "duplicate").otherwise("unmatched"), F.when(dup, "none").otherwise("orphan_pr"),
        F.when(~dup, F.when(F.col("seen"), W_GSTIN / 1000).otherwise(0.0)), F.lit(None).cast("bigint"), F.lit(None).cast("int"), F.lit(0), *unmet,
    )
    extra = portal.join(matched.select(F.col("r_id").alias("id")), "id", "left_anti").select(
        "company_id", "period", F.lit("gstr2b_line"), "id", F.lit(None).cast("bigint"), F.lit("unmatched"), F.lit("orphan_2b"), F.lit(None).cast("double"), F.lit(None).cast("bigint"), F.lit(None).cast("int"), F.lit(0), *unmet
    )
    return hit.union(miss).union(extra)


def bank_sides(bank: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = bank.where("credit is not null or debit is not null").select(
        "company_id", F.col("id").alias("b_id"), F.col("txn_date").alias("b_day"), F.coalesce("credit", "debit").alias("b_paise"),
        F.when(F.col("credit").isNotNull(), "in").otherwise("out").alias("direction"), F.coalesce(F.col("party_id"), F.lit(-1)).alias("party"),
    )
    vouchers = ledger.where("(voucher_type = 'Receipt' and credit is not null) or (voucher_type = 'Payment' and debit is not null)").select(
        "company_id", F.col("id").alias("v_id"), F.col("entry_date").alias("v_day"), F.when(F.col("voucher_type") == "Receipt", F.col("credit")).otherwise(F.col("debit")).alias("v_paise"),
        F.when(F.col("voucher_type") == "Receipt", "in").otherwise("out").alias("direction"), F.coalesce(F.col("party_id"), F.lit(-1)).alias("party"),
    )
    return lines, vouchers


def bank_pairs(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Band join: same direction and party (or none on both sides), within BANK_PAISE and BANK_DAYS. Vouchers go to
    three buckets of BANK_PAISE each, so it stays a hash join on the bucket however many lines a party has."""
    lines, vouchers = bank_sides(bank, ledger)
    bucket = lambda x: F.floor(F.col(x) / BANK_PAISE)
    spread = vouchers.withColumn("bucket", F.explode(F.array(*(bucket("v_paise") + d for d in (-1, 0, 1)))))
    met = lines.withColumn("bucket", bucket("b_paise")).join(spread, ["company_id", "direction", "party", "bucket"])
    met = met.withColumn("gap", F.abs(F.datediff("b_day", "v_day"))).withColumn("offset", F.col("v_paise") - F.col("b_paise"))
    return met.where((F.col("gap") <= BANK_DAYS) & (F.abs("offset") <= BANK_PAISE)).drop("bucket")


def reconcile_bank(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Bank lines in statement order (day, id) each take the free voucher of least gap, then offset, then order."""
    pairs = bank_pairs(bank, ledger)
    order = [F.asc("b_day"), F.asc("b_id"), F.asc("gap"), F.asc("offset"), F.asc("v_day"), F.asc("v_id")]
    taken = stored(one_to_one(pairs, "b_id", "v_id", order, ["company_id", "direction", "party"]))
    strong = (F.col("gap") == 0) & (F.col("party") >= 0)
    hit = taken.select("company_id", F.lit("bank_txn").alias("left_type"), F.col("b_id").alias("left_id"), F.col("v_id").alias("right_id"), F.lit("matched").alias("status"),
                       F.when(strong, "strong").otherwise("amount_date").alias("method"), F.when(strong, 1.0).otherwise(0.85).alias("score"), "gap")
    lines, vouchers = bank_sides(bank, ledger)
    alone = lambda df, key, kind: df.join(taken.select(key), key, "left_anti").select("company_id", F.lit(kind), key, F.lit(None).cast("bigint"), F.lit("unmatched"), F.lit("none"), F.lit(None).cast("double"), F.lit(None).cast("int"))
    return hit.union(alone(lines, "b_id", "bank_txn")).union(alone(vouchers, "v_id", "ledger_entry"))
