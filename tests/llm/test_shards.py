from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import shards as S

from .helpers import AWKWARD, docs


def texts(frame):
    return sorted((r.doc_id or 0, r.text or "") for r in frame.collect())


def test_appends_compaction_and_versions(spark, tmp_path):
    frame = docs(spark, AWKWARD)
    store = S.ShardStore(spark, str(tmp_path), target=64 << 20, unit=1 << 30, fan=3)
    assert store.versions() == [] and store.read(frame.schema).count() == 0
    for _ in range(5):
        store.append(frame)
    store.append(frame.where("false"))
    before = texts(store.read(frame.schema))
    assert len(store.runs()) == 6
    assert store.compact(frame.schema)
    assert len(store.runs()) == 1 and store.runs()[0].files == 1
    assert texts(store.read(frame.schema)) == before == sorted(texts(frame) * 5)
    assert texts(store.read(frame.schema, version=1)) == texts(frame)
    assert store.vacuum() == 6
    assert texts(store.read(frame.schema)) == before and len(store.versions()) == 1


def test_tiers_merge_runs_of_like_size_only(spark, tmp_path):
    unit = 1000
    run = lambda n: S.Run("r", n, 1)
    assert [run(n).tier(unit, 4) for n in (0, 1, 1000, 1001, 4000, 4001, 16000, 16001)] == [0, 0, 0, 1, 1, 2, 2, 3]
    big = spark.range(200_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = S.ShardStore(spark, str(tmp_path), target=4 << 20, unit=64 << 10, fan=2)
    store.append(big)
    for k in range(2):
        store.append(big.where(F.col("doc_id") == k))
    store.compact(big.schema)
    assert len(store.runs()) == 2
    assert store.read(big.schema).count() == 200_002


def test_one_write_of_many_arrivals(spark, tmp_path):
    frame = docs(spark, AWKWARD)
    store = S.ShardStore(spark, str(tmp_path), fan=4)
    versions = store.append_each(frame, S.arrivals(count=6))
    assert versions == list(range(1, len(versions) + 1))
    store.compact(frame.schema)
    assert len(store.runs()) < 4
    assert texts(store.read(frame.schema)) == texts(frame)
    assert store.read(frame.schema).columns == frame.columns
    empty = S.ShardStore(spark, str(tmp_path / "none"))
    empty.append_each(frame.where("false"), S.arrivals())
    assert empty.read(frame.schema).count() == 0


def test_a_version_is_committed_once(spark, tmp_path):
    store, other = (S.ShardStore(spark, str(tmp_path)) for _ in range(2))
    store.append(docs(spark, AWKWARD))
    other._commit(other.runs(), 1)
    with pytest.raises(S.CommitConflict):
        store._commit(store.runs(1), 1)


def test_writers_at_once_lose_no_version(spark, tmp_path):
    """Of many commits of one version at once exactly one succeeds; writers that try again get all theirs in."""
    rows = [S.Run(f"runs/{k}", k, 1) for k in range(24)]
    stores = [S.ShardStore(spark, str(tmp_path)) for _ in range(8)]

    def add(k):
        store, refused = stores[k % 8], 0
        while True:
            after = max(store.versions(), default=0)
            try:
                store._commit([*store.runs(after), rows[k]], after)
                return refused
            except S.CommitConflict:
                refused += 1

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(24)))
    assert stores[0].versions() == list(range(1, 25))
    assert {r.name for r in stores[0].runs()} == {r.name for r in rows}


def test_failed_writes_and_clashing_columns(spark, tmp_path):
    frame = docs(spark, AWKWARD).withColumn("__arrival", F.lit(3)).withColumn("arrival", F.lit("x"))
    store = S.ShardStore(spark, str(tmp_path))
    store.append_each(frame, S.arrivals(count=4))
    frame.write.parquet(f"{tmp_path}/runs/left-by-a-failed-write")
    assert texts(store.read(frame.schema)) == texts(frame) and store.read(frame.schema).columns == frame.columns
    store.vacuum()
    assert (tmp_path / "runs/left-by-a-failed-write").exists()
    store.vacuum(orphan_hours=0)
    assert not (tmp_path / "runs/left-by-a-failed-write").exists()
    assert texts(store.read(frame.schema)) == texts(frame)


def test_rename_refuses_a_taken_name(spark, tmp_path):
    store = S.ShardStore(spark, str(tmp_path))
    for name in "ab":
        (tmp_path / name).write_text(name)
    store._rename(store._path(f"{tmp_path}/a"), store._path(f"{tmp_path}/c"))
    with pytest.raises(Exception, match="exist"):
        store._rename(store._path(f"{tmp_path}/b"), store._path(f"{tmp_path}/c"))
    assert (tmp_path / "c").read_text() == "a"
