"""Folders of many companies read at once, and names in the order of their rows, against loops."""

import json
import random

from pyspark.sql import functions as F

from ledgerloom.operators import parties
from ledgerloom.sources import feeds, ingest

from .test_parties_and_ingest import feed_folder


def ratio(a, b):
    """Likeness by insertions and deletions."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b))


def by_rows(known, rows):
    """key -> what it means, going row by row; rows: (key, stated)."""
    names, meant = list(known), {}
    for key, stated in rows:
        if key not in meant and key not in names:
            best = max(((ratio(key, n), -k) for k, n in enumerate(names)), default=(0, 0))
            meant[key] = names[-best[1]] if best[0] >= parties.CUTOFF else key
        if (stated or meant.get(key) == key) and key not in names:
            names.append(key)
    return meant


def test_names_equal_a_loop_over_rows(spark):
    rng = random.Random(4)
    chains = 0
    for turn in range(3):
        base = ["".join(rng.choices("ABCD", k=26)) for _ in range(12)]
        rows = []
        for _ in range(150):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                s[rng.randrange(len(s))] = rng.choice("ABCD")
            rows.append(("".join(s), rng.random() < 0.1))
        known = sorted({"".join(rng.choices("ABCD", k=26)) for _ in range(3)} | set(rng.sample(base, 3)))
        want = by_rows(known, rows)
        frame = spark.createDataFrame([(1, k, n, stated) for n, (k, stated) in enumerate(rows) if k not in known], "company_id int, key string, n int, st boolean")
        asked = frame.groupBy("company_id", "key").agg(F.min("n").alias("seen"), F.min(F.when(F.col("st"), F.col("n"))).alias("stated"))
        got = {r.key: r.meant for r in parties.elect(asked, spark.createDataFrame([(1, k) for k in known], "company_id int, key string")).collect()}
        assert got == want
        chains += sum(m != k and m not in known for k, m in want.items())
    assert chains > 20


def many(at, companies=3):
    """The folder of the other tests for each company, one with other headers, one file that can't be read."""
    for c in range(companies):
        (at / f"company_id={c}").mkdir(parents=True)
        feed_folder(at / f"company_id={c}")
    (at / "company_id=1" / "tally_purchase_register_2.csv").write_text('﻿Supplier,Bill Date,Bill No,Grand Total,Note\r\n"Beta\r\nMills",08-Oct-2026,A7,"1,250.50","say ""hi"", twice"\r\n\r\nM/s BETA MILLS Ltd,09-Oct-2026,A8,5,\r\n')
    (at / "company_id=2" / "tally_sales_register.csv").write_text("Date,Nobody\n01-01-2026,x\n")
    (at / "company_id=2" / "notes.csv").write_text("a,b\n1,2\n")


def test_all_companies_equal_one_by_one(spark, tmp_path):
    many(tmp_path)
    out = ingest.ingest_companies(spark, str(tmp_path))
    assert [(r.company_id, r.document.split("/")[-1], "party" in r.error) for r in out["unreadable"].collect()] == [(2, "tally_sales_register.csv", True)]
    (tmp_path / "company_id=2" / "tally_sales_register.csv").unlink()
    for c in range(3):
        one = ingest.ingest_folder(spark, str(tmp_path / f"company_id={c}"), c)
        assert {r.period for r in one["periods"].collect()} == {r.period for r in out["periods"].where(F.col("company_id") == c).collect()}
        for kind in ("parties", *ingest.FILES):
            if kind in one:
                names = sorted(set(one[kind].columns) - {"error"})
                shown = lambda df, names=names: sorted(map(str, df.select(*names).collect()))
                assert shown(one[kind]) == shown(out[kind].where(F.col("company_id") == c)), kind
    beta = [r for r in out["purchase_register"].where("company_id = 1").collect() if r.norm_party == "BETAMILLS"]
    assert len({r.party_id for r in beta}) == 1 and {str(r.total) for r in beta if r.norm_invoice_no == "A7"} == {"1250.50"}


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    jobs = []
    for n in (1, 6):
        many(tmp_path / str(n), max(n, 3))
        spark.sparkContext.setJobGroup(f"ingest-{n}", "")
        ingest.ingest_companies(spark, str(tmp_path / str(n)))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ingest-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 3, jobs


def test_records_of_odd_files(spark, tmp_path):
    texts = {"a": 'h1,h2\n1,"a\nb"\n\n2,""\n"x ""y"",z",3', "b": "h1,h2\r\n1,2\r\n", "c": 'h1\n"never closed\n1', "d": "", "e": "h1,h2\n,\n"}
    for k, t in texts.items():
        (tmp_path / f"{k}.csv").write_bytes(t.encode())
    got = {}
    for r in feeds.with_cells(feeds.scan_csv(spark, str(tmp_path), F.lit("k")), 2).orderBy("document", "source_row").collect():
        got.setdefault(r.document[-5], []).append((r.source_row, r.cells[0], r.cells[1]))
    assert got["a"] == [(2, "1", "a\nb"), (3, "2", got["a"][1][2]), (4, 'x "y",z', "3")] and not got["a"][1][2]
    assert got["b"] == [(2, "1", "2")] and len(got["c"]) == 1 and "d" not in got and got["e"][0][0] == 2


def test_periods_of_statements_without_rows_and_unreadable_files(spark, tmp_path):
    at = tmp_path / "company_id=4"
    at.mkdir()
    (at / "gstr2b_2025_03.json").write_text('{"data": {"docdata": {}}}')
    (at / "tally_sales_register.csv").write_text("Date,Nobody\n01-01-2026,x\n")
    (at / "bank_statement.csv").write_text("Txn Date,Narration,Amount,Amount\n08/09/2026,CASH,-5,9\n")
    for out in (ingest.ingest_folder(spark, str(at), 4), ingest.ingest_companies(spark, str(tmp_path))):
        assert {(r.company_id, r.period) for r in out["periods"].collect()} == {(4, "2025-03"), (4, "2026-09")}
        assert [(r.company_id, "party" in r.error) for r in out["unreadable"].collect()] == [(4, True)] and out["parties"].count() == 0
        assert [(r.narration, str(r.debit), r.party_id) for r in out["bank_stmt"].collect()] == [("CASH", "5.00", None)]
    (group,) = [g for g in feeds.csv_groups(spark, str(at)) if "Amount" in g.columns]
    assert group.columns == ["Txn Date", "Narration", "Amount", "Amount3", "document", "source_row"] and group.first().Amount3 == "9"


def test_no_file_at_all(spark, tmp_path):
    out = ingest.ingest_folder(spark, str(tmp_path), 1)
    assert {k: df.count() for k, df in out.items()} == {"periods": 0, "parties": 0, "unreadable": 0}
