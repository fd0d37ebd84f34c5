"""Running sums, places and runs over the ordered rows of groups of any size, in two levels.

Rows are sorted into ranges of the group and its order, so a large group lies in many ranges. Each range has its own running sums;
its totals, a row for each group and range, are run up the same way and added. No task has more than a range of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import stored

#: The number of a row's range.
RANGE = "__range"


def placed(rows: DataFrame, group: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """rows with their range, written: ranges ascend by the group and its order (which must be total)."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *group, *order).withColumn(RANGE, F.spark_partition_id()))


def _same(group: list[str], names: dict[str, str]) -> Column:
    out = F.col(RANGE) == F.col(names[RANGE])
    for g in group:
        out &= F.col(g).eqNullSafe(F.col(names[g]))
    return out


def running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """placed rows with each sum over the group's rows up to and including their own; nulls count as nothing."""
    own = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.groupBy(RANGE, *group).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # of a group, a row a range
    names = {c: f"__of_{c}" for c in (RANGE, *group)}
    offsets = total.select(*(F.col(c).alias(names[c]) for c in names), *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    local = rows.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    met = local.join(offsets, _same(group, names))
    return met.select(*rows.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def before(rows: DataFrame, group: list[str], order: list[Column], column: str, name: str) -> DataFrame:
    """placed rows with the column's value in the row before in their group, null for the first; the column must not be null."""
    own = Window.partitionBy(RANGE, *group).orderBy(*order)
    last = rows.withColumn("__at", F.row_number().over(own)).groupBy(RANGE, *group).agg(F.max_by(column, "__at").alias("__last"))
    names = {c: f"__of_{c}" for c in (RANGE, *group)}
    ends = last.withColumn("__before", F.lag("__last").over(Window.partitionBy(*group).orderBy(RANGE))).select(*(F.col(c).alias(names[c]) for c in names), "__before")
    local = rows.withColumn(name, F.lag(column).over(own))
    return local.join(ends, _same(group, names)).select(*rows.columns, F.coalesce(name, "__before").alias(name))


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their place in their group, from 1."""
    return running(placed(rows, group, order), group, order, {name: F.lit(1)}).drop(RANGE).withColumn(name, F.col(name).cast("int"))
