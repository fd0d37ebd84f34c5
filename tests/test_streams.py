"""Late rows as a stream and answers by timers, against plain loops; batches that die or come again."""

import datetime
import os
import random
import subprocess
import sys

import pyspark
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom.operators import matching
from ledgerloom.sources import manifests
from ledgerloom.streaming import arrivals, inbox_clock, late

DAY = datetime.date(2026, 1, 5)


def row(side, i, supplier, number, taxable=1000, section="B2B"):
    return (side, i, 1 + i % 2, "2026-01", supplier, number, DAY, taxable, 90, 90, 0, 0, section if side == "portal" else None, None)


def some_rows(n=60):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        supplier = rng.choice(["G1", "G2", "G3", None, ""])
        number = f"INV{rng.randrange(12):03}"
        rows.append(row("books", i, supplier, number))
        if rng.random() < 0.7:
            rows.append(row("portal", 1000 + i, supplier, number + rng.choice(["", "", "X"]), section=rng.choice(["B2B", "B2B", "CDNR"])))
    rng.shuffle(rows)
    return rows


def shown(df):
    return sorted(map(str, df.select(*df.sparkSession.createDataFrame([], late.MATCH).columns).collect()))


def at_once(spark, rows):
    every = spark.createDataFrame(rows, late.ROW)
    return shown(matching.reconcile(every.where("side = 'books'"), every.where("side = 'portal'")))


def test_batches_equal_all_at_once(spark, tmp_path):
    """Three batches; the second dies before its commit, is run again and replayed after it, and the third repeats rows."""
    rows = some_rows()
    parts = [rows[:40], rows[40:70], rows[70:] + rows[30:50]]
    store = late.LateMatches(spark, str(tmp_path / "store"), 4)
    frame = lambda part: spark.createDataFrame(part, late.ROW)
    store.apply(frame(parts[0]), 0)
    assert shown(store.current()) == at_once(spark, parts[0])
    commit, manifests.write_json = manifests.write_json, lambda *a: (_ for _ in ()).throw(OSError("died"))
    try:
        with pytest.raises(OSError, match="died"):
            store.apply(frame(parts[1]), 1)
    finally:
        manifests.write_json = commit
    assert shown(store.current()) == at_once(spark, parts[0])
    store.apply(frame(parts[1]), 1)
    store.apply(frame(parts[2]), 1)  # a batch that is committed: nothing happens, whatever it brings
    assert shown(store.current()) == at_once(spark, rows[:70])
    store.apply(frame(parts[2]), 2)
    store.apply(frame([]), 3)
    assert shown(store.current()) == at_once(spark, rows)
    assert store.state()["batch"] == 3


def test_a_commit_is_written_once(spark, tmp_path):
    at = str(tmp_path / "m" / "1.json")
    assert manifests.read_json(spark, at) is None and manifests.names(spark, str(tmp_path / "m")) == []
    assert manifests.write_json(spark, at, {"a": [1, "é"]}) and not manifests.write_json(spark, at, {"a": 2})
    assert manifests.read_json(spark, at) == {"a": [1, "é"]} and manifests.names(spark, str(tmp_path / "m")) == ["1.json"]


def day(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)


def test_timers_and_answers(spark, tmp_path):
    """1 is never answered; 2 in time; 3 too late; 4 twice; 5's answer comes before the record; 6 waits still; 1 comes again."""
    record = lambda i, at, end: (1, i, day(at), "record", day(end), None)
    action = lambda i, at, what: (1, i, day(at), "action", None, what)
    tick = lambda at: (0, -1, day(at), "tick", None, None)
    batches = [
        [record(1, 1, 20), record(2, 1, 20), record(3, 1, 20), record(4, 1, 20), action(5, 2, "rejected"), tick(2)],
        [action(2, 10, "accepted"), action(4, 11, "pending"), action(4, 9, "rejected"), record(5, 10, 20), tick(11)],
        [action(3, 25, "accepted"), record(6, 22, 60), tick(30)],
        [record(1, 31, 20), (None, None, day(31), "tick", None, None), tick(31)],
        [tick(32)],
    ]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, inbox_clock.EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(inbox_clock.EVENT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        arrivals.each_batch(inbox_clock.answered(stream), str(tmp_path / "cp"), lambda df, n: got.extend(df.where(F.col("id") > 0).collect())).awaitTermination()
    assert sorted((r.id, r.outcome, r["at"]) for r in got) == [(1, "deemed_accepted", day(20)), (2, "accepted", day(10)), (3, "deemed_accepted", day(20)), (4, "rejected", day(9)), (5, "rejected", day(2))]


def test_processor_loads_without_the_package(tmp_path):
    """Spark starts it first in a Python that doesn't know this package."""
    (tmp_path / "processor").write_bytes(cloudpickle.dumps(inbox_clock.Answers()))
    load = "from pyspark import cloudpickle; print(type(cloudpickle.loads(open('processor', 'rb').read())).__name__)"
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(pyspark.__file__))}
    assert subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.strip() == "Answers"
