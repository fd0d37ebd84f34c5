"""What the text operators share: scratch tables, word hashing, shingles, bounded samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 8 << 20
WORD = re.compile(r"\w+")
_U64 = np.uint64


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Only where that setting is absent and the master is local (tests) a temporary folder is made and set.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df; sets the session's Arrow batches to BATCH_BYTES at most, as a worker holds several copies of one as it goes
    from Arrow to Python and back, and texts differ a thousandfold in length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema: T.StructType | str, pandas: bool = False) -> DataFrame:
    """mapInArrow (or mapInPandas) over small batches; a worker, which lives on for other tasks, gives its buffers back."""

    def go(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    df = small_batches(df)
    return df.mapInPandas(go, schema) if pandas else df.mapInArrow(go, schema)


def map_columns(df: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterator[dict]], ddl: str) -> DataFrame:
    """mapInArrow for functions from columns to columns as Python lists: integers with nulls stay integers."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batch.to_pydict() for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return map_batches(df, go, ddl)


def held_out(doc_id="doc_id"):
    """True for documents that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything once it holds `most` words, so memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else ()
    return np.fromiter(map(cache.__getitem__, words), dtype=_U64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply, xor-shift) over unsigned arrays."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS, whole_if_short: bool = True) -> np.ndarray:
    """Hashes of all runs of `size` words, in order, repeats kept.

    A shorter text is one shingle of all its words if whole_if_short, else it has none.
    """
    n = len(words)
    if n < size:
        if not n or not whole_if_short:
            return np.empty(0, dtype=_U64)
        size = n
    out = words[: n - size + 1].copy()
    for k in range(1, size):
        out *= _U64(0x9E3779B97F4A7C15)
        out ^= words[k : n - size + 1 + k]
        out ^= out >> _U64(29)
    return mix64(out)


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in [0, 1)."""
    return (x >> _U64(11)).astype(np.float64) * (1.0 / (1 << 53))


def bounded_sample(df: DataFrame, key: str, rows: int, salt: str) -> DataFrame:
    """The `rows` rows whose salted key hashes lowest: the same rows at every partitioning.

    It finds the keys first (a top-n of two small columns), then fetches their rows by a broadcast of
    those at most `rows` keys.
    """
    rank = F.xxhash64(F.col(key), F.lit(salt))
    keys = df.select(F.col(key).alias("__key"), rank.alias("__rank")).orderBy("__rank", "__key").limit(rows)
    return df.join(F.broadcast(keys.select("__key").distinct()), F.col(key) == F.col("__key"), "left_semi")
