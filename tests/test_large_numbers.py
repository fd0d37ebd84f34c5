"""Queries against their SQL on tables whose numbers hold runs of years and whose amounts are ties, which small tables lack."""

import datetime
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.catalog import number_sql
from ledgerloom.functions import text

TABLES = ("region", "nation", "customer", "orders", "lineitem")
NAMES = [
    "companies_ingested",
    "short_amounts",
    "statement_feed",
    "register_feed",
    "norm_invoice",
    "templates_filled",
    "inbox_feed",
    "evaluation_of_key_by_defect",
    "evaluation_report",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders with a run of years (A1200012), with two of which nothing would stay (A20122034) and without any."""
    at, first = str(tmp_path_factory.mktemp("large")), datetime.datetime(2000, 1, 1)
    keys = [*range(199_900, 200_400), *range(19_121_900, 19_122_100)]
    frames = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(k, f"N{k}", 0) for k in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"C{k}") for k in range(10)], "c_custkey long, c_name string"),
        "orders": ([(k, k % 10, first + datetime.timedelta(days=k % 600)) for k in keys], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(k, 14_500.0 + 100 * (k % 5), 0.05) for k in keys], "l_orderkey long, l_extendedprice double, l_tax double"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, tables)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and Counter(map(tuple, got.collect())) == Counter(want)


def test_number_sql(spark):
    numbers = ["", "0", "000", "00200001", "200001", "2000012", "A1200012", "A20122034", "A201220345", "ZA3201199", "A1999999", "A12012013", "0020", "20202020202020"]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string")
    got = [r[0] for r in rows.select(text.norm_invoice_no(F.col("n"))).collect()]
    want = [duckdb.connect().execute(f"SELECT {number_sql('n')} FROM (SELECT ? AS n)", [n]).fetchall()[0][0] for n in numbers]
    assert got == want
