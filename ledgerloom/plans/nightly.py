"""The nightly run in stages that survive being killed: what is done stays, and companies whose inputs are as before aren't redone.

A run is named by its inputs' versions, a number or digest a company. Each stage writes a folder a company and then a commit; a run
that starts again goes on at the first stage without one. When all stages are done the run's own commit says which
run made each company's rows, and only that is what readers see.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import manifests

#: (companies to do, what the earlier stages of this run made for them) -> rows with company_id.
Stage = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]


class Nightly:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> dict:
        """The newest finished run: its number and name, versions by company, and for each stage the run that made a company's rows."""
        runs = [n for n in manifests.names(self.spark, f"{self.path}/runs") if n.endswith(".json")]
        return manifests.read_json(self.spark, f"{self.path}/runs/{runs[-1]}") if runs else {"number": 0, "name": "", "versions": {}, "made": {}, "schemas": {}}

    def _folder(self, stage: str, run: str) -> str:
        return f"{self.path}/stages/{stage}/run={run}"

    def _rows(self, stage: str, schema: str, made: dict[str, str]) -> DataFrame:
        at = [f"{self._folder(stage, run)}/company_id={c}" for c, run in made.items()]
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/stages/{stage}")
        names = self.spark.createDataFrame([], schema).columns
        return (read.parquet(*at) if at else self.spark.createDataFrame([], schema)).select(names)

    def read(self, stage: str) -> DataFrame:
        """What a stage made, for all companies, by the last finished run."""
        last = self.last()
        return self._rows(stage, last["schemas"][stage], last["made"][stage])

    def run(self, versions: DataFrame, stages: list[tuple[str, Stage]]) -> list[str]:
        """Brings all stages up to the versions (company_id, version; a row a company, which the driver holds); gives the names of the
        stages that it ran. Companies that have gone lose their rows."""
        now = {str(r.company_id): str(r.version) for r in versions.select("company_id", "version").collect()}
        name = hashlib.sha256(json.dumps([sorted(now.items()), [s for s, _ in stages]]).encode()).hexdigest()[:16]
        last = self.last()
        if last["name"] == name:
            return []
        run = f"{last['number'] + 1:06d}-{name}"
        same = last["versions"] if set(last["made"]) == {s for s, _ in stages} else {}
        todo = sorted(c for c, v in now.items() if same.get(c) != v)
        touched = self.spark.createDataFrame([(int(c),) for c in todo], "company_id int")
        ran, made, schemas, earlier = [], {}, {}, {}
        for stage, make in stages:
            done = f"{self.path}/progress/{run}/{stage}.json"
            if manifests.read_json(self.spark, done) is None:
                rows = make(touched, dict(earlier))
                rows.write.mode("overwrite").partitionBy("company_id").parquet(self._folder(stage, run))
                schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
                written = [n.removeprefix("company_id=") for n in manifests.names(self.spark, self._folder(stage, run)) if n.startswith("company_id=")]
                manifests.write_json(self.spark, done, {"schema": schema, "companies": written})
                ran.append(stage)
            told = manifests.read_json(self.spark, done)
            schemas[stage] = told["schema"]
            mine = {c: run for c in told["companies"]}
            made[stage] = {c: r for c, r in last["made"].get(stage, {}).items() if c in now and c not in todo} | mine
            earlier[stage] = self._rows(stage, told["schema"], mine)
        manifests.write_json(self.spark, f"{self.path}/runs/{run}.json", {"number": last["number"] + 1, "name": name, "versions": now, "made": made, "schemas": schemas})
        return ran


def versions_of(documents: DataFrame) -> DataFrame:
    """company_id and version: a digest of the contents (sha256) of each company's documents, whatever their order."""
    each = documents.select("company_id", "sha256").distinct()
    return each.groupBy("company_id").agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64("sha256")).cast("string")), 256).alias("version"))
