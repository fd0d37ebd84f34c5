"""Running sums, places and runs in two levels against loops, with a group over many ranges, empty and null groups."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import scan
from ledgerloom.plans import reports


def test_running_before_and_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None, 3]), i, rng.choice(["a", "b"]), rng.choice([None, *range(-5, 6)])) for i in range(700)]
    frame = spark.createDataFrame(rows, "g int, id int, p string, x int")
    at = scan.placed(frame, ["g"], [F.col("id")], 13)
    assert at.where("g = 1").select(scan.RANGE).distinct().count() >= 5  # no task has the whole of it
    got = {r.id: r for r in scan.running(scan.before(at, ["g"], [F.col("id")], "p", "last"), ["g"], [F.col("id")], {"s": F.col("x"), "n": F.lit(1)}).collect()}
    place = {r.id: r.k for r in scan.ranked(frame, ["g"], [F.desc("x"), F.col("id")], "k").collect()}
    for g in {r[0] for r in rows}:
        s, last, own = 0, None, sorted(r for r in rows if r[0] == g) if g is not None else [r for r in rows if r[0] is None]
        for n, (_, i, p, x) in enumerate(own, 1):
            s += x or 0
            assert (got[i].s, got[i].n, got[i].last) == (s, n, last)
            last = p
        order = sorted(own, key=lambda r: (-99 if r[3] is None else r[3]), reverse=True)
        order.sort(key=lambda r: (-(-99 if r[3] is None else r[3]), r[1]))
        assert [place[r[1]] for r in order] == list(range(1, len(own) + 1))
    assert scan.ranked(frame.limit(0), ["g"], [F.col("id")], "k").count() == 0


def test_balance_and_runs(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2]), i, f"2026-{rng.choice('123')}", rng.choice([None, 10]), rng.choice([None, 25])) for i in range(200)]
    bank = spark.createDataFrame(rows, "company_id int, id int, period string, credit long, debit long").withColumn("txn_date", F.lit("2026-01-01").cast("date"))
    got = {r.id: r.balance for r in reports.running_balance(bank, 1000).collect()}
    runs = {(r.company_id, r.run): (r.period, r.starts_at, r.rows) for r in reports.period_runs(bank, "id").collect()}
    for c in (1, 2):
        flow, flows, want, last, n = 0, {}, {}, None, 0
        for _, i, p, credit, debit in (r for r in rows if r[0] == c):
            flow += (credit or 0) - (debit or 0)
            flows[i] = flow
            if p != last:
                n += 1
                want[c, n] = [p, i, 0]
            want[c, n][2] += 1
            last = p
        assert all(got[i] == 1000 - min(0, *flows.values()) + f for i, f in flows.items())
        assert {k: tuple(v) for k, v in want.items()} == {k: v for k, v in runs.items() if k[0] == c}
