"""Parties, a folder of feeds, uploads, writers, labels and late arrivals."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, text
from ledgerloom.operators import matching, parties
from ledgerloom.sources import columns, feeds, ingest, sinks
from ledgerloom.streaming import arrivals, events


def test_likest_names_equal_all_pairs(spark):
    """Names that meet by rare letter pairs, against every pair's ratio."""
    rng = random.Random(2)
    words = ["STEEL", "TRADE", "SHARMA", "GUPTA", "CHEM", "OLYMPUS", "AAAA", "B"]
    known = sorted({"".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(80)})
    asked = []
    for k in known:
        s = list(k)
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(s) + 1)
            s = s[:at] + [rng.choice("XYZ")] + s[at:] if rng.random() < 0.5 else s[:at] + s[at + 1 :]
        asked.append("".join(s))
    asked = sorted({a for a in asked if a})
    frame = lambda names: spark.createDataFrame([(1, n) for n in names], "company_id int, key string")
    got = {r.key: r.known for r in parties.like_keys(frame(asked), frame(known)).collect()}
    want = {}
    for a in asked:
        rated = [(-200.0 * text.lcs_length(a, k) / (len(a) + len(k)), k) for k in known]
        best = min(rated)
        if -best[0] >= parties.CUTOFF:
            want[a] = best[1]
    assert got == want and len(want) > 20


def test_parties_as_rows_come(spark):
    rows = [(1, "27AAPFU0939F1ZV", "Acme Pvt Ltd", "vendor", 0), (1, None, "ACME", "customer", 1), (1, None, "Beta", "vendor", 2), (1, "29BBBBB1111B1Z5", "Beta Ltd", "vendor", 3), (1, None, "beta", "vendor", 4), (2, None, "Acme", "vendor", 0), (1, None, "--", "vendor", 5)]
    frame = spark.createDataFrame(rows, "company_id int, gstin string, name string, kind string, seen int")
    seen = {(r.company_id, r.seen): r.party_id for r in parties.observed(frame).collect()}
    assert seen[1, 0] == seen[1, 1] and seen[1, 2] == seen[1, 4] != seen[1, 3] and seen[2, 0] != seen[1, 0]
    made = {(r.company_id, r.name): r for r in parties.register(frame).collect()}
    assert made[1, "Acme Pvt Ltd"].kind == "both" and made[1, "Acme Pvt Ltd"].pan == "AAPFU0939F" and made[1, "Beta"].gstin is None


def test_blank_names_and_narrations(spark):
    known = spark.createDataFrame([(1, 5, "Sharma"), (1, 6, "Sharma Steel"), (1, 9, "--"), (1, 7, "Abc")], "company_id int, party_id long, name string")
    names = spark.createDataFrame([(1, ""), (1, "--"), (1, "M/s SHARMA Ltd"), (1, "Nobody")], "company_id int, name string")
    assert {r.name: (r.party_id, r.method) for r in parties.resolve_names(names, known).collect()} == {"": (None, None), "--": (None, None), "M/s SHARMA Ltd": (5, "norm_name"), "Nobody": (None, None)}
    lines = spark.createDataFrame([(1, "NEFT N123456789 SHARMA STEEL MUMBAI"), (1, "UPI/SHARMA/1234567"), (1, "ABC"), (1, ""), (1, None)], "company_id int, narration string")
    index = known.withColumn("key", text.norm_party(F.col("name")))
    assert {r.narration: r.party_id for r in parties.resolve_narrations(lines, index).collect()} == {"NEFT N123456789 SHARMA STEEL MUMBAI": 6, "UPI/SHARMA/1234567": 5, "ABC": None, "": None, None: None}


def feed_folder(at):
    (at / "gstr2b_2026_08.json").write_text(json.dumps({"data": {"docdata": {"b2b": [{"ctin": "27AAPFU0939F1ZV", "trdnm": "Acme Components Pvt Ltd", "inv": [{"inum": "A1", "idt": "05-08-2026", "txval": "10"}]}]}}}))
    (at / "ims_2026_08.json").write_text(json.dumps({"records": [{"ctin": "g1", "doctype": "INV", "inum": "1", "val": "1"}]}))
    (at / "tally_purchase_register.csv").write_text("Date,Particulars,Voucher No,Invoice Value\n05-Aug-2026,ACME COMPONENTS,A1,10\n06-Sep-2026,Acme Componants,A2,20\nnever,Beta,A3,30\n07-Sep-2026,Beta Mills,A4,40\n", encoding="utf-8")
    (at / "tally_ledger_entries.csv").write_text("Date,Voucher Type,Particulars,Debit,Credit\n07-Sep-2026,Payment,Beta Mills,40,\n08-Sep-2026,Payment,Gamma,5,\n")
    (at / "bank_statement.csv").write_text("Txn Date,Narration,Withdrawal Amt,Deposit Amt\n08/09/2026,NEFT BETA MILLS 99887766,40,0\n09/10/2026,CASH,0,7\n")


def test_a_folder_of_feeds(spark, tmp_path):
    feed_folder(tmp_path)
    out = ingest.ingest_folder(spark, str(tmp_path), 1)
    assert sorted(r.period for r in out["periods"].collect()) == ["2026-08", "2026-09", "2026-10"]
    made = {r.name: r for r in out["parties"].collect()}
    assert set(made) == {"Acme Components Pvt Ltd", "Beta Mills", "Beta"}
    acme, beta = made["Acme Components Pvt Ltd"], made["Beta Mills"]
    bought = {r.norm_invoice_no: r for r in out["purchase_register"].collect()}
    assert set(bought) == {"A1", "A2", "A4"} and {bought[k].party_id for k in ("A1", "A2")} == {acme.party_id}
    assert bought["A1"].supplier_gstin == "27AAPFU0939F1ZV" and bought["A4"].supplier_gstin is None and bought["A4"].party_id == beta.party_id
    assert {r.party: r.party_id for r in out["ledger"].collect()} == {"Beta Mills": beta.party_id, "Gamma": None}
    assert {r.narration: r.party_id for r in out["bank_stmt"].collect()} == {"NEFT BETA MILLS 99887766": beta.party_id, "CASH": None}
    assert out["gstr2b"].first().period == "2026-08" and out["ims"].count() == 1


def test_uploads_once_and_errors(spark, tmp_path):
    feed_folder(tmp_path)
    manifest = spark.createDataFrame([], "company_id int, sha256 string, document string")
    path = str(tmp_path / "tally_purchase_register.csv")
    rows, periods, manifest = ingest.ingest_upload(spark, path, "purchase_register", manifest, 1)
    assert rows.count() == 4 and {r.period for r in periods.collect()} == {"2026-08", "2026-09"}
    again, _, more = ingest.ingest_upload(spark, path, "purchase_register", manifest, 1)
    assert again is None and more.count() == 1
    with pytest.raises(ValueError, match="none of"):
        ingest.ingest_upload(spark, path, "photos", manifest, 1)
    (tmp_path / "x.csv").write_text("Date,Party,Voucher No,Total\nx,y,1,1\n")
    with pytest.raises(ValueError, match="no readable date"):
        ingest.ingest_upload(spark, str(tmp_path / "x.csv"), "purchase_register", manifest, 1)
    (tmp_path / "some.json").write_text("{}")
    (tmp_path / "odd.json").write_text(json.dumps({"docdata": {"b2b": [{"inv": [{"inum": "1"}]}]}}))
    with pytest.raises(Exception, match="no period"):
        feeds.statement(spark, str(tmp_path / "odd.json")).collect()
    assert {(r.reason, r.rows) for r in feeds.skipped(ingest.read_kind(spark, [path], "purchase_register")).collect()} == {("unreadable date", 1)}


def test_files_with_other_headers_are_not_mixed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Party,Voucher No,Total\n05-08-2026,Acme,1,10\n")
    (tmp_path / "b.csv").write_text("Party,Date,Total,Voucher No\nBeta,06-08-2026,20,2\n")
    rows = [r for g in feeds.csv_groups(spark, str(tmp_path)) for r in feeds.purchases(g).collect()]
    assert sorted((r.party, str(r.day), str(r.total), r.error) for r in rows) == [("Acme", "2026-08-05", "10.00", None), ("Beta", "2026-08-06", "20.00", None)]
    with pytest.raises(Exception):
        feeds.read_csv(spark, str(tmp_path)).collect()


def test_templates_are_read_by_the_readers(spark, tmp_path):
    for kind, read in ingest.CSV.items():
        rows = [{"date": "02-Apr-2026", "party": "Acme", "voucher_no": "1", "total": "10", "voucher_type": "Receipt", "narration": "NEFT ACME", "credit": "10"}]
        (tmp_path / f"{kind}.csv").write_text(sinks.template(kind, rows))
        got = read(feeds.read_csv(spark, str(tmp_path / f"{kind}.csv"))).collect()
        assert len(got) == 1 and got[0].error is None and got[0].period == "2026-04"
    assert "Date" in sinks.required_headers("purchase_register") and columns.resolve(["DATE"], {"date": (True, ("Date",))}) == {"date": "DATE"}


def test_export_reads_back(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<E><VOUCHER><DATE>20260805</DATE><VOUCHERNUMBER>7</VOUCHERNUMBER><VOUCHERTYPENAME>Purchase</VOUCHERTYPENAME><PARTYLEDGERNAME>A &amp; B, \"C\"</PARTYLEDGERNAME><AMOUNT>-12.50</AMOUNT></VOUCHER><VOUCHER><DATE>20250101</DATE></VOUCHER></E>")
    sinks.export_register(feeds.as_register(feeds.vouchers(spark, str(tmp_path / "v.xml"), "Purchase", "2026-01-01")), str(tmp_path / "out"))
    row = feeds.purchases(feeds.csv_groups(spark, str(tmp_path / "out"))[0]).first()
    assert (row.party, str(row.day), str(row.total)) == ('A & B, "C"', "2026-08-05", "12.50")


def test_labels_and_clocks(spark):
    rows = spark.createDataFrame([("CDNRA", "C"), ("CDNR", "D"), ("ISD", None), ("XX", None), ("CDNR", "Z")], "s string, n string")
    assert [r[0] for r in rows.select(text.section_label(F.col("s"), F.col("n"))).collect()] == ["Credit notes, amended", "Debit notes", "Input service distributor", "XX", "Credit and debit notes"]
    one = spark.sql("select date'2026-03-31' as a, date'2026-04-01' as b").select(dates.financial_year(F.col("a")), dates.financial_year(F.col("b")), text.clean_narration(F.lit("NEFT-CR N12345678 ACME TRADERS 99887766")), text.state_of(F.lit("27AAPFU0939F1ZV"))).first()
    assert tuple(one) == ("2025-26", "2026-27", "ACME", "27")


def test_late_rows_and_repeated_content(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("company_id=1/a.csv", "company_id=1/b.csv", "company_id=2/a.csv", "company_id=3/a.csv"):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("the same")
    seen = []
    known = spark.createDataFrame([(3, hashlib.sha256(b"the same").hexdigest())], "company_id int, sha256 string")
    arrivals.each_batch(arrivals.arriving_files(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, n: seen.extend(arrivals.unseen(df, known).collect())).awaitTermination()
    assert sorted(r.company_id for r in seen) == [1, 2]  # once a company; the third knows it
    books = spark.createDataFrame([(1, "G", "2026-01"), (1, "G", "2026-08"), (1, "H", "2026-08"), (1, None, "2026-01"), (2, None, "2026-01")], "company_id int, supplier_gstin string, period string")
    assert arrivals.touched(books, books.where("supplier_gstin = 'H'")).count() == 1
    assert arrivals.touched(books, spark.createDataFrame([(1, None)], "company_id int, supplier_gstin string")).count() == 1


def test_late_rows_without_a_supplier(spark):
    """A late row without a supplier gets a decision, as if all had been matched at once."""
    row = "id long, company_id int, period string, supplier_gstin string, norm_invoice_no string, invoice_date date, taxable long, cgst long, sgst long, igst long, cess long, section string, amends_invoice_no string"
    day = datetime.date(2026, 1, 5)
    one = lambda i, g: (i, 1, "2026-01", g, f"A{i % 10}", day, 1000, 0, 0, 0, 0, "B2B", None)
    books, portal = spark.createDataFrame([one(1, "G1"), one(2, None)], row), spark.createDataFrame([one(11, "G1"), one(12, None)], row)
    before = matching.stored(matching.reconcile(books.where("id = 1"), portal.where("id = 11")))
    late = books.where("id = 2").union(portal.where("id = 12")).select("company_id", "supplier_gstin")
    got = arrivals.rematched(before, books, portal, late)
    assert sorted(map(str, got.collect())) == sorted(map(str, matching.reconcile(books, portal).collect())) and got.count() == 3


def test_a_company_without_matches_loses_its_old_ones(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (2, 2)], "id int, company_id int")
    sinks.replace_matches(rows, "gst", str(tmp_path / "m"))
    sinks.replace_matches(rows.where("id = 2"), "gst", str(tmp_path / "m"), rows.select("company_id"))
    assert [r.company_id for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [2]


def test_narrations_meet_only_names_that_they_may_hold(spark):
    """Names with one common beginning and end: candidates grow with the lines, not with lines times names."""
    n = 3000
    index = spark.range(n).selectExpr("0 as company_id", "concat('PARTYNO', lpad(id * 7 + 10000, 5, '0'), 'TRADING') as key", "id as party_id")
    lines = index.selectExpr("company_id", "concat('NEFT CR ', key, ' 99887766') as narration", "party_id as want")
    cleaned = lines.select("company_id", F.xxhash64("company_id", "narration").alias("line"), text.clean_narration(F.col("narration")).alias("clean"))
    assert parties.narration_candidates(cleaned, index).count() < 8 * n
    met = parties.resolve_narrations(lines.select("company_id", "narration"), index).join(lines, ["company_id", "narration"])
    assert met.where("party_id <=> want").count() == n


def test_narrations_equal_a_loop(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("ABC", k=rng.randint(2, 9)))
    names = sorted({word() for _ in range(60)})
    said = sorted({" ".join(word() for _ in range(3)) for _ in range(200)} | {"", "AB"})
    index = spark.createDataFrame([(0, k, i) for i, k in enumerate(names)], "company_id int, key string, party_id long")
    lines = spark.createDataFrame([(0, s) for s in said], "company_id int, narration string")
    got = {r.narration: r.party_id for r in parties.resolve_narrations(lines, index).collect()}
    clean = {r.narration: r.c for r in lines.select("narration", text.clean_narration(F.col("narration")).alias("c")).collect()}
    for s in said:
        fit = [k for k in names if len(k) >= 4 and k in clean[s]]
        assert got[s] == (names.index(min(fit, key=lambda k: (-len(k), k))) if fit else None), s


def test_hourly_stream_counts_like_the_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "e"))
    q = events.hourly_stream(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == table.count()
