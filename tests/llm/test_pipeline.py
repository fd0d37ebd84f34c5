import shutil

import corpus_pipeline
from ledgerloom.llm import toxicity
from ledgerloom.llm.common import table

from .helpers import AWKWARD, SF, docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    frame = docs(spark, [*AWKWARD, (60, "before it " + item + " after it", "en"), (61, "token=abcdefgh12 stays", "en")]).select(COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, frame, str(tmp_path))
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 9, 10, 12, 13, 60, 61]
    kept = stages["decontamination"](spark, kept, str(tmp_path))
    assert kept.columns == COLUMNS and 60 not in {r.doc_id for r in kept.collect()} and kept.count() == 10
    clean = stages["secrets"](spark, kept, str(tmp_path))
    assert {r.doc_id: r.text for r in clean.collect()}[61] == "[SECRET] stays" and clean.count() == 10
    assert {r.doc_id for r in stages["packing"](spark, clean, str(tmp_path)).collect()} == {None, 1, 4, 5, 7, 9, 10, 12, 13, 61}


def test_toxic_documents_go(spark):
    frame = table(spark, SF, "documents")
    scores = toxicity.toxicity(frame, table(spark, SF, "labels")).where("predicted = 0").count()
    assert corpus_pipeline.STAGES[0][1](spark, frame, SF).count() == scores < frame.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where("offset + length > 2048").count() == 0 and out.count() > 100


def test_one_row_of_exact_copies_stays(spark):
    rows = [*[(5, "the very same text that was loaded again", "en")] * 4, *[(None, "the very same text that was loaded again", "en")] * 2, *[(None, "one more text without any id", "en")] * 3]
    rows += [*[(8, None, "en")] * 2, *[(None, None, "en")] * 2, (9, "a text that stands alone here", "en")]
    kept = corpus_pipeline.one_of_each_class(spark, docs(spark, rows).select(COLUMNS), SF)
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())) == sorted(
        [(5, rows[0][1]), (0, rows[6][1]), (8, ""), (0, ""), (0, ""), (9, rows[-1][1])]
    )
