"""Sharding: an append-only store of immutable shards with size-tiered compaction and versioned manifests.

An arrival is written as a run: a folder of small shards that never change. A manifest version names the
runs that make up the table. Runs of similar size (the same power of `fan` above `target`/fan^k) are merged
into one run of target-sized files once there are `fan` of them. A version is committed by giving its file its
name, which fails if another writer has taken it; readers take the highest version, and files that no version
names don't exist for them. That is exclusive on HDFS (a rename without overwriting) and on a local disk (a hard
link). An object store whose rename copies can't promise it: there one writer at a time must commit.
A failed write leaves a folder that no manifest names; vacuum removes it once it is old enough.

Rows are kept as they are, nulls and repeats too, and columns of any name. An empty arrival is a run without rows.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Run:
    name: str
    bytes: int
    files: int

    def tier(self, unit: int, fan: int) -> int:
        """0 up to `unit` bytes, then one more for each power of fan."""
        return max(0, math.ceil(math.log(max(self.bytes, 1) / unit, fan)))


class ShardStore:
    """The manifest holds a few numbers a run, and compaction keeps the runs to about fan for each power of fan
    in the table's size; what files a run has, its folder says."""

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, unit: int = 16 << 20, fan: int = 4):
        self.spark, self.root, self.target, self.unit, self.fan = spark, root.rstrip("/"), target, unit, fan
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def runs(self, version: int | None = None) -> list[Run]:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return []
        text = self.spark.sparkContext.wholeTextFiles(f"{self.root}/manifest/{version:012d}.json", 1).first()[1]
        return [Run(**r) for r in json.loads(text)["runs"]]

    def _commit(self, runs: list[Run], after: int) -> int:
        """Creates version after + 1 as a whole: written aside, then renamed, which fails if the name is taken."""
        version = after + 1
        aside, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/{version:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        try:
            self._rename_if_free(aside, final)
        except Exception as e:
            raise CommitConflict(version) from e
        finally:
            self._fs.delete(aside, False)
        return version

    def _rename_if_free(self, aside, final) -> None:
        """Gives a file its name; an error if the name is taken."""
        if self._fs.getUri().getScheme() == "file":
            os.link(aside.toUri().getPath(), final.toUri().getPath())
            return
        self._rename(aside, final)

    def _rename(self, aside, final) -> None:
        """A rename that fails if the name is taken."""
        choice = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(choice, 1)
        options[0] = choice.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(aside, final, options)

    def _measured(self, name: str) -> Run:
        files = [s for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.getPath().getName().endswith(".parquet")]
        return Run(name, sum(s.getLen() for s in files), len(files))

    def append(self, df: DataFrame) -> int:
        """One arrival, as one run."""
        after = max(self.versions(), default=0)
        name = f"runs/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return self._commit([*self.runs(after), self._measured(name)], after)

    def append_each(self, df: DataFrame, arrival) -> list[int]:
        """Arrivals that lie in one table, split by the integer column `arrival`: one write, a version each."""
        batch, part = f"runs/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        df.withColumn(part, arrival).write.partitionBy(part).parquet(f"{self.root}/{batch}")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{batch}")) if s.isDirectory() and "=" in s.getPath().getName())
        out = []
        for name in names or [""]:
            after = max(self.versions(), default=0)
            out.append(self._commit([*self.runs(after), self._measured(f"{batch}/{name}".rstrip("/"))], after))
        return out

    def read(self, schema, version: int | None = None) -> DataFrame:
        return self._read(self.runs(version), schema)

    def _read(self, runs: list[Run], schema) -> DataFrame:
        paths = [f"{self.root}/{r.name}" for r in runs if r.files]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self, schema) -> list[int]:
        """Merges tiers that hold `fan` runs or more until none does. Rows stream from small shards to large files
        without a shuffle: tasks read neighbouring shards, and as many tasks run as target-sized files are due."""
        done = []
        while True:
            after = max(self.versions(), default=0)
            runs = self.runs(after)
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(r.tier(self.unit, self.fan), []).append(r)
            due = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
            if due is None:
                return done
            files = max(1, math.ceil(sum(r.bytes for r in due) / self.target))
            name = f"runs/{uuid.uuid4().hex}"
            self._read(due, schema).coalesce(files).write.parquet(f"{self.root}/{name}")
            merged = self._measured(name)
            at = min(runs.index(r) for r in due)
            done.append(self._commit([*(r for r in runs[:at] if r not in due), merged, *(r for r in runs[at:] if r not in due)], after))

    def vacuum(self, keep: int = 1, orphan_hours: float = 24.0) -> int:
        """Deletes run folders that none of the newest `keep` versions names, and older manifests.

        A folder that no version names may be a write under way, so it goes only once it is `orphan_hours` old.
        """
        versions = self.versions()
        live = {r.name for v in versions[-keep:] for r in self.runs(v)}
        old = {r.name for v in versions[:-keep] for r in self.runs(v)} - live
        for name in old:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/{v:012d}.json"), False)
        folder, before = self._path(f"{self.root}/runs"), (time.time() - 3600 * orphan_hours) * 1000
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
            name = f"runs/{s.getPath().getName()}"
            if s.getModificationTime() <= before and not any(n == name or n.startswith(name + "/") for n in live):
                self._fs.delete(s.getPath(), True)
        return len(old)


def arrivals(key: str = "doc_id", count: int = 16) -> F.Column:
    """Number of the arrival of a row: half of the rows come first, the rest in count - 1 equal parts."""
    h = F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(0)), F.lit("arrival")), F.lit(2 * (count - 1)))
    return F.when(h < count - 1, 0).otherwise(h - (count - 2)).cast("int")
