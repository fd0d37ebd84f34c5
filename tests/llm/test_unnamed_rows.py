"""Rows without doc_id are examined and packed like others."""

import zlib

import corpus_pipeline
import numpy as np
from ledgerloom.llm import containment, packing

from .helpers import SF, docs
from .test_packing import expected


def test_packed_whole(spark):
    rows = [(None, "row without id", "en"), (None, None, "en"), ((1 << 60) + 1, "an id beyond doubles", "en"), *[(7, "a row loaded often " * 400, "en")] * 3]
    out = packing.best_fit_packing(docs(spark, rows), group=4).collect()
    want = [(-1 if i is None else i, k, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for i, t, _ in rows for k, p in enumerate(expected(t))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == sorted(want)


def test_benchmark_passages_go_without_an_id_too(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()
    rows = [(None, "before it " + items[0].text + " after it", "en"), (None, "a clean row of some words here", "en"), (3, items[1].text, "en"), (3, "clean under the same id", "en"), (4, None, "en")]
    left = corpus_pipeline.without_benchmark(spark, docs(spark, rows), SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, rows[1][1]), (3, rows[3][1]), (4, "")]
    table = spark.createDataFrame(items)
    assert containment.without_contained(docs(spark, rows), table, block_items=1).count() == 3
