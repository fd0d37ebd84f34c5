"""The registered queries opN_<name>, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment, dart_minhash, edit_counts, filter_audit, language_crf, packing, pseudonyms, rp_forest, secrets, shards, simhash, toxicity, whitening
from .common import scratch_path, table

#: The queries' key; a real one comes from a secret store.
PSEUDONYM_KEY = "example-key"


def op1_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen arrivals of `documents` appended, compacted and read back by the newest manifest."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, scratch_path(spark, "shards"))
    store.append_each(docs, shards.arrivals())
    store.compact(docs.schema)
    store.vacuum()
    return store.read(docs.schema).select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.language(table(spark, sf_dir, "documents"))


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def example_edits(doc_id: Column, text: Column) -> Column:
    """Three edits that a row determines: a word inserted at a hashed place, a stretch cut at another, a tail."""
    place = lambda salt: F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.length(text) + 1)
    edit = lambda start, remove, insert: F.struct(start.cast("long").alias("start"), remove.cast("long").alias("remove"), insert.alias("insert"))
    return F.when(
        text.isNotNull(),
        F.array(edit(place("insert"), F.lit(0), F.concat(F.lit(" edited"), doc_id.cast("string"))), edit(place("cut"), F.lit(25), F.lit("")), edit(F.length(text) + 1000, F.lit(0), F.lit(" The end."))),
    )


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    state = edit_counts.build_state(docs.select("doc_id", "text", example_edits(F.col("doc_id"), F.col("text")).alias("edits")))
    return edit_counts.apply_edits(state).select("doc_id", "tokens_before", "tokens_after", "n_edits", "encoded_chars", F.length("text").cast("long").alias("chars_after"))


def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "shingles", F.round("containment", 6).alias("containment"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op9_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_size_tiered_shards, op2_language_crf, op3_secret_links, op4_edit_counts, op5_benchmark_containment, op6_dart_minhash,
        op7_pseudonyms, op8_best_fit_packing, op9_toxicity_ftrl, op10_projection_forest, op11_filter_shapley, op12_bit_sliced_simhash, op13_jacobi_whitening, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op1_size_tiered_shards": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op5_benchmark_containment": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(list_distinct([array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w) - 3)])) AS s FROM d WHERE len(w) >= 5),
isx AS (SELECT item_id, unnest(list_distinct([array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w) - 3)])) AS s FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS shingles FROM isx GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN isx USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(shared AS INTEGER) AS shared, CAST(shingles AS INTEGER) AS shingles, round(CAST(shared AS DOUBLE) / shingles, 6) AS containment
FROM m JOIN n USING (item_id) WHERE shared * 5 >= shingles * 4
UNION ALL SELECT doc_id, item_id, 1, 1, CAST(1 AS DOUBLE) FROM d JOIN (SELECT item_id, array_to_string(w, ' ') AS phrase, len(w) AS n FROM i WHERE len(w) BETWEEN 1 AND 4)
  ON list_contains([array_to_string(d.w[k:k+n-1], ' ') FOR k IN range(1, len(d.w) - n + 2)], phrase)""",
    "op6_dart_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep_id, w FROM d),
s AS (SELECT doc_id AS id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w) - 3)]
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM reps WHERE doc_id = rep_id),
c AS (SELECT id, s, count(*) AS n FROM s GROUP BY 1, 2),
t AS (SELECT id, sum(n) AS total FROM c GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE shared * 5 >= (x.total + y.total - shared) * 4),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, x.b FROM reach r JOIN pairs x ON r.b = x.a),
cls AS (SELECT a AS id, least(a, min(b)) AS class_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(class_id, rep_id) AS class_id, rep_id FROM reps LEFT JOIN cls ON rep_id = id
UNION ALL SELECT doc_id, doc_id, doc_id FROM documents WHERE text IS NULL""",
    "op11_filter_shapley": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY 1, 2),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, array_to_string([substr('ABCDE', v, 1) FOR v IN o], '') AS filter_order, k AS step, o[k] AS own, n, good, bad, fails[o[k]] AS here,
  list_bool_or([fails[v] FOR v IN o[:k-1]]) AS before, len([v FOR v IN fails IF v]) = 1 AS alone FROM x, o, i),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
  CAST(coalesce(sum(n) FILTER (WHERE NOT (here OR coalesce(before, false))), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE here AND NOT coalesce(before, false)), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE here AND before), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE here AND alone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE here AND NOT coalesce(before, false)), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (WHERE here AND NOT coalesce(before, false)), 0) AS BIGINT) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
