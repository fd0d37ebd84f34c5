"""Lines of documents read alone, a night in stages, an answer key's expected findings."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import evaluation, nightly
from ledgerloom.sources import lines


def rows_scanned(df):
    """Rows that the scan of lines gave to the plan, after the pages were chosen."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "Or(" in plan
    scans, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if "Scan parquet" in node.nodeName():
            scans.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().length())]
    return max(scans)


def test_lines_are_read_alone(spark, tmp_path):
    store = lines.LineStore(spark, str(tmp_path / "lines"), 4)
    body = spark.range(200_000).select(F.concat(F.lit("doc"), (F.col("id") % 4).cast("string")).alias("document"), (F.col("id") / 4).cast("int").alias("n"))
    store.add(body.select("document", (F.col("n") + 1).alias("source_row"), F.concat_ws("-", "document", F.col("n") + 1, F.lit("x" * 40)).alias("line")))
    store.add(spark.createDataFrame([("late", 1, "h"), ("late", 2, "a"), ("late", 3, "b")], lines.LINE))
    wanted = [("doc1", 30_000), ("doc2", 1), ("late", 3), ("late", 9), ("none", 1)]
    got = store.around(wanted)
    shown = {(r.document, r.at): [] for r in got.collect()}
    for r in got.orderBy("document", "at", "source_row").collect():
        shown[r.document, r.at].append((r.source_row, r.line.split("-x")[0], r.is_target, r.header.split("-x")[0]))
    assert shown["doc1", 30_000] == [(k, f"doc1-{k}", k == 30_000, "doc1-1") for k in range(29_998, 30_003)]
    assert [x[0] for x in shown["doc2", 1]] == [1, 2, 3] and shown["late", 3] == [(k, t, k == 3, "h") for k, t in ((1, "h"), (2, "a"), (3, "b"))]
    assert set(shown) == {("doc1", 30_000), ("doc2", 1), ("late", 3)}
    assert rows_scanned(got) < 30_000  # of 200,003
    many = spark.createDataFrame(wanted, "document string, source_row int")
    assert sorted(map(str, store.around(many).collect())) == sorted(map(str, got.collect()))
    assert store.around([]).count() == 0


def test_a_night_goes_on_where_it_died(spark, tmp_path):
    at, calls = nightly.Nightly(spark, str(tmp_path / "n")), []

    def stages(rows, dies=None):
        frame = spark.createDataFrame(rows, "company_id int, x int")

        def one(todo, made):
            calls.append(("one", sorted(r.company_id for r in todo.collect())))
            return frame.join(todo, "company_id", "left_semi")

        def two(todo, made):
            calls.append(("two", sorted(r.company_id for r in todo.collect())))
            if dies:
                raise OSError("killed")
            return made["one"].groupBy("company_id").agg(F.sum("x").alias("s"))

        return [("one", one), ("two", two)]

    version = lambda rows: spark.createDataFrame([(c, str(sorted(r for r in rows if r[0] == c))) for c in {c for c, _ in rows}], "company_id int, version string")
    sums = lambda: sorted(map(tuple, at.read("two").collect()))
    rows = [(1, 5), (1, 6), (2, 7), (3, 8)]
    assert at.run(version(rows), stages(rows)) == ["one", "two"] and sums() == [(1, 11), (2, 7), (3, 8)]
    assert at.run(version(rows), stages(rows)) == []  # nothing is new
    rows = [(1, 5), (1, 6), (2, 9), (4, 1)]
    calls.clear()
    with pytest.raises(OSError, match="killed"):
        at.run(version(rows), stages(rows, dies=True))
    assert sums() == [(1, 11), (2, 7), (3, 8)]  # readers see the last finished run
    assert at.run(version(rows), stages(rows)) == ["two"] and sums() == [(1, 11), (2, 9), (4, 1)]
    assert calls == [("one", [2, 4]), ("two", [2, 4]), ("two", [2, 4])]


def test_versions_follow_contents(spark):
    of = lambda rows: {r.company_id: r.version for r in nightly.versions_of(spark.createDataFrame(rows, "company_id int, sha256 string")).collect()}
    a, b, c = ("a" * 64, "b" * 64, "c" * 64)
    assert of([(1, a), (1, b), (2, a)]) == of([(2, a), (1, b), (1, a), (1, a)]) and of([(1, a), (1, c)])[1] != of([(1, a), (1, b)])[1]


def test_expected_keys(spark):
    defect = lambda rule, key, period="2026-01", kind="purchase_invoice": (1, "d", rule, period, kind, key, 5, "n", rule in ("R10", "R13"))
    doc = {"supplier_gstin": "G", "number": "INV-007"}
    rows = [defect("R1", doc), defect("R4", doc | {"landing_period": "2026-02"}), defect("R3", doc | {"landing_period": "2026-01"}), defect("R6", {"ref_no": "R99"}, kind="bank_txn"), defect("R13", doc), defect("R5", {}), defect("R12", {})]
    planted = evaluation.expected(spark.createDataFrame(rows, evaluation.DEFECT))
    got = {r.rule_code: (r.risk_key, r.landing_period) for r in planted.collect()}
    assert got == {"R1": ("R1:G:INV-007", None), "R4": ("R4:G:INV-007", "2026-02"), "R3": ("R3:G:INV-007", None), "R6": ("R6:R99", None), "R13": ("R13:G:7", None), "R5": ("R5:bank_books_variance", None), "R12": ("R12:filing_chain", None)}
    books = spark.createDataFrame([(8, 1, "2026-01", "G", "INV-007"), (4, 1, "2026-01", "G", "INV-007"), (3, 1, "2026-02", "G", "INV-007")], "id long, company_id int, period string, supplier_gstin string, norm_invoice_no string")
    bank = spark.createDataFrame([(77, 1, "R99")], "id long, company_id int, ref_no string")
    met = evaluation.targets(planted, books, bank).join(planted, "defect")
    assert {r.rule_code: r.record_id for r in met.collect()} == {"R1": 4, "R4": 4, "R3": 4, "R6": 77, "R13": 4, "R5": None, "R12": None}
    with pytest.raises(Exception, match="no key is known"):
        evaluation.expected(spark.createDataFrame([defect("R99", doc)], evaluation.DEFECT)).collect()
