import json

import pytest

from ledgerloom.sources import columns, feeds
from ledgerloom.streaming import arrivals


def test_headers():
    assert columns.resolve(["Bill Date", "VENDOR NAME", "bill-no", "Grand Total"], columns.PURCHASES) == {"date": "Bill Date", "party": "VENDOR NAME", "voucher_no": "bill-no", "total": "Grand Total"}
    with pytest.raises(ValueError, match="voucher_no"):
        columns.resolve(["Date", "Party", "Total"], columns.PURCHASES)


def test_register_with_provenance(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿Date,Particulars,Voucher No,Taxable Value,Invoice Value\n05-Aug-2026,"Acme\nPvt Ltd",INV/0042,"1,000.00","1,180.00"\nbad,Beta,7,1,2\n', encoding="utf-8")
    rows = feeds.purchases(feeds.read_csv(spark, str(tmp_path / "p.csv"))).orderBy("source_row").collect()
    assert [(r.source_row, r.period, r.norm_invoice_no, str(r.total)) for r in rows] == [(2, "2026-08", "42", "1180.00"), (3, None, "7", "2.00")]
    assert rows[0].norm_party == "ACME" and rows[0].error is None and "bad" in rows[1].error


def test_bank_with_one_signed_column(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Txn Date,Narration,Amount\n01/08/2026,NEFT ACME,500.00 Cr\n02/08/2026,X,70 Dr\n03/08/2026,Y,0\n")
    rows = feeds.bank(feeds.read_csv(spark, str(tmp_path / "b.csv"))).orderBy("source_row").collect()
    assert [(r.debit and int(r.debit), r.credit and int(r.credit), r.error) for r in rows] == [(None, 500, None), (70, None, None), (None, None, "neither debit nor credit")]


def test_statement_walk_and_reversals(spark, tmp_path):
    entry = lambda **k: {"txval": "100", "camt": "9", "samt": "9", **k}
    body = {"data": {"rtnprd": "082026", "docdata": {"b2b": [{"ctin": "g1", "trdnm": "A", "inv": [entry(inum="INV1", idt="01-08-2026"), entry(inum="2", idt="02-08-2026", itcavl="N")]}], "cdnr": None,
                     "impg": [{"ctin": "g9", "boe": [entry(boenum="77", boedt="03-08-2026")]}], "b2ba": [{"ctin": "g1", "inv": [entry(inum="3", idt="04-08-2026", oinum="INV/1")]}]},
                     "itcrev37a": [{"ctin": "G1", "inum": "1", "rev_amt": "5"}, {"ctin": "G1", "inum": "INV1", "rev_amt": "2.50"}]}}
    (tmp_path / "gstr2b_2026_08.json").write_text(json.dumps(body))
    rows = feeds.statement(spark, str(tmp_path / "gstr2b_2026_08.json")).orderBy("source_row").collect()
    assert [(r.section, r.norm_invoice_no, r.supplier_gstin, str(r.reversal), r.itc_available) for r in rows] == [("B2B", "1", "G1", "7.50", True), ("B2B", "2", "G1", "0.00", False), ("B2BA", "3", "G1", "0.00", True), ("IMPG", "77", None, "0.00", True)]
    assert rows[2].amends_invoice_no == "1" and rows[0].period == "2026-08"


def test_inbox_and_gateway(spark, tmp_path):
    (tmp_path / "ims.json").write_text(json.dumps({"rtnprd": "082026", "records": [{"ctin": "g1", "doctype": "CN", "inum": "9", "val": "10", "supplier_filed": True}]}))
    assert feeds.inbox(spark, str(tmp_path / "ims.json")).first().doc_type == "credit_note"
    (tmp_path / "v.xml").write_text("<ENVELOPE><VOUCHER><DATE>20260805</DATE><PARTYLEDGERNAME>A & B&#4;</PARTYLEDGERNAME><AMOUNT>-12.50</AMOUNT></VOUCHER><VOUCHER><AMOUNT>1</AMOUNT></VOUCHER></ENVELOPE>")
    rows = feeds.vouchers(spark, str(tmp_path / "v.xml")).collect()
    assert [(r.party, str(r.total)) for r in rows] == [("A & B", "12.50")]


def test_parties(spark):
    parties = spark.createDataFrame([(1, "Acme Components Pvt Ltd"), (2, "Beta Mills")], "party_id long, name string")
    names = spark.createDataFrame([("ACME COMPONENTS",), ("Acme Componants Ltd",), ("Gamma",), ("",)], "name string")
    assert {r.name: r.party_id for r in feeds.resolve_parties(names, parties).collect()} == {"ACME COMPONENTS": 1, "Acme Componants Ltd": 1, "Gamma": None, "": None}


def test_arrivals_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("x")
    seen = []
    for _ in range(2):
        arrivals.each_batch(arrivals.arriving_files(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, n: seen.extend(df.select("sha256").collect())).awaitTermination()
    assert len(seen) == 1
