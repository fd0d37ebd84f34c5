import numpy as np

from ledgerloom.llm import rp_forest as R

SCHEMA = "vec_id long, embedding array<float>, label int, x int, rank int"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(ids, x, q, k=10):
    d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
    d[q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[j]), d[j]) for j in order if np.isfinite(d[j])]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 32)) * 2
    x = (centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 32))).astype(np.float32)
    ids = np.arange(3000)
    out = R.nearest(frame(spark, ids, x), "vec_id % 100 = 0", block=7, sample=1500).collect()
    hits = 0
    for q in range(0, 3000, 100):
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12 for _, v, s in mine)
        assert [s for *_, s in mine] == sorted(s for *_, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in brute(ids, x, q)})
    assert hits >= 0.9 * 300


def test_ties_copies_and_bad_vectors(spark):
    vectors = [[1, 0]] * 40 + [[0, 1]] * 5 + [None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], []]
    ids = list(range(100, 100 + len(vectors)))
    out = R.nearest(frame(spark, ids, vectors), "vec_id in (100, 144, 145, 146)").collect()
    assert {r.query_id for r in out} == {100, 144}
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 100] == list(range(101, 111))
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 144][:4] == [(i, 0.0) for i in (140, 141, 142, 143)]


def test_few_and_no_rows(spark):
    assert R.nearest(frame(spark, [], []), "vec_id % 100 = 0").count() == 0
    assert R.nearest(frame(spark, [0], [[1, 2]]), "vec_id % 100 = 0").count() == 0
    assert R.nearest(frame(spark, [0, 1, 2], [[1, 2], [2, 1], [5, 5]]), "vec_id % 100 = 0").count() == 2


def test_calibrated_leaves_hold_the_neighbours():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1000, 16))
    forest = [R.grow(x, 32, rng) for _ in range(6)]
    assert all(np.isclose(t.sizes.sum(), 1) for t in forest)
    share = R.calibrate(forest, x, 10, 0.95, 100, rng)
    assert 0 < share <= 7
    taken = R.search(forest, x[0], share)
    assert len(set(taken)) == len(taken) and (0, int(forest[0].leaves(x[:1])[0])) in taken


def test_repeated_rows_and_hot_vectors(spark):
    """Rows that stand twice, queries among them, and a vector that half of the rows share."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[rng.permutation(400)[:200]] = x[0]
    ids = np.concatenate([np.arange(400), [0, 0, 100, 7]])
    out = R.nearest(frame(spark, ids, x[ids]), "vec_id % 100 = 0", block=2, rows_block=16, sample=300, leaf=8).collect()
    recall = 0
    for q in range(0, 400, 100):
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        want = brute(np.arange(400), x, q)
        assert [r for r, *_ in mine] == list(range(1, 11)) and len({v for _, v, _ in mine}) == 10
        recall += len({v for _, v, _ in mine} & {v for v, _ in want})
        if (x[q] == x[0]).all():
            assert [(v, s) for _, v, s in mine] == want
    assert recall >= 36


def test_recall_on_the_table(spark):
    """The registered query over the whole test table, against brute force."""
    from ledgerloom.llm.queries import op10_projection_forest

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = {(r.query_id, r.vec_id) for r in op10_projection_forest(spark, "/root/testdata/sf0.1").collect()}
    queries = np.flatnonzero(ids % 100 == 0)
    want = {(int(ids[q]), v) for q in queries for v, _ in brute(ids, x, q)}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)


def test_work_is_that_of_the_taken_leaves(spark):
    """Pairs compared: far fewer than rows by queries, where neighbours lie close."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((200, 8)) * 20, 20, axis=0) + rng.standard_normal((4000, 8))
    forest = [R.grow(x, 32, rng) for _ in range(4)]
    share = R.calibrate(forest, x, 10, R.RECALL, 100, rng)
    met = sum((t.leaves(x) == leaf).sum() for q in x[::100] for n, leaf in R.search(forest, q, share) for t in [forest[n]])
    assert met < 0.25 * 4000 * 40
