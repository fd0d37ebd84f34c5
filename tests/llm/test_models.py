"""Toxicity and language: held-out accuracy on the test tables, and awkward rows."""

import numpy as np

from ledgerloom.llm import language_crf as L
from ledgerloom.llm import toxicity as T

from .helpers import AWKWARD, docs

BIG = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].mean() - order[~pos].mean()) / len(score) + 0.5


def test_toxicity_on_held_out_rows(spark):
    frame, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    out = T.toxicity(frame, labels).where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").toPandas()
    assert auc(out["score"].to_numpy(), out["toxic"].to_numpy()) > 0.9
    assert (out["predicted"] == out["toxic"]).mean() > 0.9


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (7, 0), (None, 1), (10, 0), (2, 5)], "doc_id long, toxic int")
    out = T.toxicity(docs(spark, AWKWARD), labels).collect()
    assert len(out) == len(AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (4, 5, 6, 9)}) == 1
    none = T.toxicity(docs(spark, AWKWARD), labels.where("false")).collect()
    assert {r.predicted for r in none} == {0}
    assert T.reject_toxic(docs(spark, AWKWARD), T.train([])).count() == len(AWKWARD)


def test_ftrl_keeps_few_weights():
    rows = [(f"plain words number {i} and some more", 0) for i in range(200)] + [(f"plain awful number {i} and some more", 1) for i in range(200)]
    model = T.train(rows, bits=16, l1=1.0)
    assert len(model.places) < 60
    dense, cache = model.dense(), T.WordHashes()
    bad, good = T.logits(["plain awful number x and some more", "plain words number x and some more"], model, dense, cache)
    assert bad > 0 > good


def test_language_on_held_out_rows(spark):
    frame = spark.read.parquet(f"{BIG}/documents.parquet")
    out = L.language(frame).join(frame.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97


def test_language_awkward_rows(spark):
    out = {r.doc_id: r for r in L.language(docs(spark, AWKWARD)).collect()}
    assert len(out) == len({i for i, _, _ in AWKWARD})
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (4, 5, 6, 9, 13))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in L.language(docs(spark, [(i, t, None) for i, t, _ in AWKWARD])).collect()} == {"und"}
    assert L.language(docs(spark, [])).count() == 0


def test_words_of_a_mixed_text_get_their_languages():
    en, de = "the house and garden were very small", "das haus und der garten waren sehr klein"
    model = L.train([("en", en.split())] * 40 + [("de", de.split())] * 40, epochs=4)
    (words, p), = L.label_words([en + " " + de], model, L.Emissions(model))
    named = [model.languages[i] for i in p.argmax(axis=1)]
    assert named == ["en"] * 7 + ["de"] * 8
    assert np.allclose(p.sum(axis=1), 1)


def test_every_letter_of_a_long_run_counts():
    en, de = "thehouseandgardenwereverysmall", "dashausundgartenwarensehrklein"
    model = L.train([("en", L.chunked([en] * 4))] * 40 + [("de", L.chunked([de] * 4))] * 40, epochs=4)
    (words, p), (_, q) = L.label_words([en + de * 6, en + "ab" + de * 6], model, L.Emissions(model))
    assert len(words) == 1 and model.languages[p.mean(axis=0).argmax()] == model.languages[q.mean(axis=0).argmax()] == "de"
    for n in (12, 13, 14, 22, 23, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        parts = L.chunked([run])
        assert {run[i : i + 3] for i in range(n - 2)} == {c[i : i + 3] for c in parts for i in range(len(c) - 2)}


def test_every_language_has_a_state(spark):
    named = lambda k: " ".join(f"{chr(97 + k // 9)}{chr(107 + k % 9)}{x}" for x in ("ab", "cod", "ef", "gim", "op", "ur"))
    rows = [(100 * k + i, named(k), f"l{k:02}") for k in range(70) for i in range(5)]
    model = L.fit(docs(spark, rows), epochs=3)
    assert sorted(model.languages) == [f"l{k:02}" for k in range(70)]
    got = {(r.lang_pred, r.doc_id // 100) for r in L.identify(docs(spark, rows), model).collect()}
    assert sum(pred == f"l{k:02}" for pred, k in got) >= 68


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    emit, move = rng.random((4, 2, 3)), rng.random((3, 3))
    length = np.array([4, 2])
    p = L.marginals(*L.forward_backward(emit, length, move))
    for chain, n in enumerate(length):
        total = np.zeros((n, 3))
        for path in np.ndindex(*(3,) * n):
            weight = np.prod([emit[t, chain, s] for t, s in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            for t, s in enumerate(path):
                total[t, s] += weight
        assert np.allclose(p[:n, chain], total / total.sum(axis=1, keepdims=True))
        assert (p[n:, chain] == 0).all()


def plain_ftrl(rows, bits, alpha, beta, l1, l2, epochs, least, seed):
    """FTRL-proximal as it is published, a coordinate at a time with dicts."""
    cache = T.WordHashes()
    sets = [(sorted({*T.features(T.word_hashes(t, cache), bits).tolist()}), y) for t, y in rows]
    seen = {}
    for at, _ in sets:
        for i in at:
            seen[i] = seen.get(i, 0) + 1
    z, n = {}, {}

    def weight(i, penalty):
        x = z.get(i, 0.0)
        if penalty and abs(x) <= l1:
            return 0.0
        return -(x - (np.sign(x) * l1 if penalty else 0)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + (l2 if penalty else 0))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(sets)):
            at, y = sets[r]
            at = [i for i in at if seen[i] >= least] + ["bias"]
            w = {i: weight(i, i != "bias") for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: v for i in z if (v := weight(i, i != "bias"))}


def test_ftrl_like_plain_ftrl():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(" ".join(rng.choice(words[y * 15 :], 12)), y) for y in rng.integers(0, 2, 120).tolist()]
    args = dict(bits=12, alpha=0.5, beta=1.0, l1=0.3, l2=0.1, epochs=3, least=2, seed=4)
    model, want = T.train(rows, **args), plain_ftrl(rows, **args)
    got = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
    bias = want.pop("bias")
    assert abs(model.bias - bias) < 1e-9 and got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_training_rows_are_bounded_where_ids_repeat(spark):
    rows = [(i % 40, f"text {i} of words", "en") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    plain, T.train = T.train, lambda found, **_: seen.extend(found) or plain([])
    try:
        T.fit(docs(spark, rows), labels, rows=12)
        few = len(seen)
        T.fit(docs(spark, rows), labels, rows=12, chars=60)
    finally:
        T.train = plain
    assert few <= 12 and 0 < sum(len(t) for t, _ in seen[few:]) <= 60


def test_language_repeated_rows_and_batches(spark):
    """A row that stands twice returns twice alike; texts labelled together equal texts labelled alone."""
    frame = spark.read.parquet(f"{BIG}/documents.parquet").limit(300)
    model = L.fit(frame)
    rounded = lambda found: sorted((r.doc_id, r.lang_pred, round(r.score, 9), r.n_words, r.switches) for r in found.collect())
    once = rounded(L.identify(frame, model))
    assert rounded(L.identify(frame.union(frame), model)) == sorted(once * 2)
    texts = [r.text for r in frame.limit(20).collect()]
    cache = L.Emissions(model)
    together, alone = L.label_words(texts, model, cache), [L.label_words([t], model, cache)[0] for t in texts]
    assert all(a[0] == b[0] and np.allclose(a[1], b[1]) for a, b in zip(together, alone, strict=True))


def test_a_long_chain_in_blocks_equals_the_whole(monkeypatch, spark):
    en, de = "the house and garden were very small", "das haus und der garten waren sehr klein"
    model = L.train([("en", en.split())] * 40 + [("de", de.split())] * 40, epochs=4)
    rng = np.random.default_rng(1)
    pieces = [en, de, "thehouseandgardenwereverysmall" * 3, "hausundgarten", "12 ...", "ÄHNLICH", "x"]
    for n in (0, 1, 5, 60):
        text = " ".join(pieces[int(rng.integers(len(pieces)))] for _ in range(n))
        ((words, p),) = L.label_words([text], model, L.Emissions(model))
        for block in (1, 7, 64, 10_000):
            n_words, mean, switches = L.long_chain(text, model, L.Emissions(model), block)
            assert n_words == len(words)
            if p.size:
                top = p.argmax(axis=1)
                assert np.allclose(mean, p.mean(axis=0)) and switches == int((top[1:] != top[:-1]).sum())
            else:
                assert not mean.size and not switches
    rows = [(1, " ".join([en, de] * 30), "en"), (2, "... " * 900, None), (3, de, "de"), (4, en, "en")]
    plain = sorted(map(tuple, L.identify(docs(spark, rows), model).collect()))
    monkeypatch.setattr(L, "LONG", 300)
    monkeypatch.setattr(L, "BLOCK", 11)
    # tasks import the module anew, so the blocks are forced in this process
    cache = L.Emissions(model)
    n_words, mean, switches = L.long_chain(rows[0][1], model, cache, 11)
    assert (n_words, switches) == plain[0][3:] and abs(float(mean.max()) - plain[0][2]) < 1e-9


def test_a_very_long_text_is_labelled(spark):
    model = L.train([("en", ["the", "house"])] * 40 + [("de", ["das", "haus"])] * 40, epochs=2)
    rows = [(1, "the house " * 60_000, None), (2, "dashaus" * 80_000, None), (3, "das haus", None)]
    out = {r.doc_id: r for r in L.identify(docs(spark, rows), model).collect()}
    assert (out[1].lang_pred, out[1].n_words, out[1].switches) == ("en", 120_000, 0) and out[2].n_words == 1 and out[3].lang_pred == "de"
