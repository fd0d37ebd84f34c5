"""What each of several quality filters removes, alone and beside the others: Shapley values of the multilinear extension.

A document's failures are a mask, a bit a filter. The number of documents that a set of filters removes is a game;
its multilinear extension, the removal polynomial of a part, follows from the counts of masks alone. Its values at
corners are what is gone after any first filters of an order, the integral of a partial derivative along the
diagonal is a filter's Shapley value, and with exact rationals the sum over all orders is a whole number.

The filters of `failures`: A under 50 words, B less than 65 distinct of 100 words, C over 5 of 100 code points in A to Z,
D any of # $ % & * |, E the text of a smaller doc_id again. Words end at ASCII white space; case counts.

A null text is the empty one, a null part the empty string. A row without doc_id is no one's original and never a repeat (it
fails no E); it has no labels. Repeated rows count as often as they stand, and a repeated row isn't a repeat of itself. Of several
labels of one doc_id any 1 counts. An empty table gives no rows; other columns are ignored. A text is held whole with
its words, so a task's memory follows its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_columns, materialize

FILTERS = "ABCDE"
# Least words, least distinct words of 100, most capitals of 100 code points, marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
REPEATED = 1 << FILTERS.index("E")
COUNTS = ("n", "good", "toxic")


def own_failures(text: bytes, points: int) -> int:
    """The mask of the filters that look at one text only; points: its code points."""
    words = text.split()  # of bytes: at space and \x09 to \x0d
    n = len(words)
    fails = (
        n < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * n,
        100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points, len(text) != len(text.translate(None, MARKS)),
    )
    return sum(bad << k for k, bad in enumerate(fails))


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, the text's SHA-256 and mask, n: the rows that are alike in all these.

    Texts are read once; what goes on is a few bytes a row. The first of equal texts are found by a sum a text, and rows
    meet them by text and doc_id together, so copies of one text, however many, lie in many tasks.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("print", pa.binary()), ("mask", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = pc.utf8_length(batch.column("text")).to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            mask = [own_failures(t, n) for t, n in zip(texts, points, strict=True)]
            prints = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(prints, pa.binary()), pa.array(mask, pa.int32())], schema=schema)

    text, named = F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    each = materialize(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), named, text), run, "doc_id long, part string, print binary, mask int"), "audit-masks")
    alike = each.groupBy("doc_id", "part", "print", "mask").agg(F.count("*").alias("n"))
    known = alike.where("doc_id is not null")
    first = each.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = known.join(first, ["print", "doc_id"], "left").withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(REPEATED)))
    return met.select(alike.columns).unionByName(alike.where("doc_id is null"))


def tallies(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n and of these the good and the toxic ones, as labels (doc_id, quality, toxic) say."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(c)
    each = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    named = failed.where("doc_id is not null").select("doc_id", "part", "mask", "n").join(each, "doc_id", "left")
    bare = failed.where("doc_id is null").select("doc_id", "part", "mask", "n").withColumns({"quality": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    labelled = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return named.unionByName(bare).groupBy("part", "mask").agg(F.sum("n").alias("n"), labelled("quality").alias("good"), labelled("toxic").alias("toxic"))


def polynomial(counts: dict[int, int], filters: int) -> list[int]:
    """Coefficients of the removal polynomial: at [T] that of the product of x_i over the filters i in the mask T.

    A document of mask m is gone by 1 - prod(1 - x_i for i in m); expanded, T has (-1)^(|T|+1) for each document
    whose mask holds T.
    """
    return [0] + [(-1) ** (t.bit_count() + 1) * sum(c for m, c in counts.items() if m & t == t) for t in range(1, 1 << filters)]


def corner(poly: list[int], on: int) -> int:
    """The polynomial where the filters of the mask `on` are 1 and the others 0: documents that these remove."""
    return sum(a for t, a in enumerate(poly) if t & on == t)


def shapley(poly: list[int], i: int) -> Fraction:
    """The integral of the partial derivative by x_i along the diagonal: of a term t^(|T|-1), 1/|T|."""
    return sum((Fraction(a, t.bit_count()) for t, a in enumerate(poly) if t >> i & 1), Fraction(0))


def audited(masks: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of a part, for all orders."""
    k = len(filters)
    polys = [polynomial({m: c[j] for m, c in masks.items()}, k) for j in range(len(COUNTS))]
    gone, good, toxic = ([corner(p, s) for s in range(1 << k)] for p in polys)
    everything, full = sum(c[0] for c in masks.values()), (1 << k) - 1
    fair = [shapley(polys[0], i) * factorial(k) for i in range(k)]
    assert all(f.denominator == 1 for f in fair)
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = gone[after] - gone[before]
            yield (
                "".join(filters[j] for j in order), step, everything - gone[after], here, gone[1 << i] - here, gone[full] - gone[full ^ 1 << i],
                good[after] - good[before], toxic[after] - toxic[before], int(fair[i]),
            )
            before = after


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step. counts: part, mask, n, good, toxic; at most 2^filters rows a part."""
    each = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        names = [f.split()[0] for f in AUDIT.split(", ")]
        for batch in batches:
            for part, masks in zip(batch["part"], batch["masks"], strict=True):
                rows = audited({m["mask"]: tuple(m[c] for c in COUNTS) for m in masks}, filters)
                columns = list(zip(*rows, strict=True))
                yield dict(zip(names, ([part] * len(columns[0]), *map(list, columns)), strict=True))

    return map_columns(each, run, AUDIT)


def filter_interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    return audit(tallies(failures(docs, part), labels))
