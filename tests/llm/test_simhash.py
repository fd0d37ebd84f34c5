"""SimHash: fingerprints against a plain count, components against all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash

from .helpers import AWKWARD, LONG, SF, docs


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Each print's part, by all pairs."""
    part = {p: p for p in prints}

    def root(p):
        while part[p] != p:
            p = part[p]
        return p

    each = sorted(part)
    for k, a in enumerate(each):
        for b in each[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                part[root(a)] = root(b)
    return {p: root(p) for p in part}


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    part = components(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[part[p]] = min(i, least.get(part[p], i))
    return sorted(((i, f"{p:016x}", least.get(part[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, _ in AWKWARD]
    got = simhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert simhash.near_duplicates(docs(spark, AWKWARD).limit(0)).count() == 0


def test_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(table).collect()
    assert sorted(map(tuple, got), key=str) == expected([tuple(r) for r in table.select("doc_id", "text").collect()])


def test_unnamed_rows(spark):
    texts = ["one two three four", "one two three four", "quite other words here"]
    got = simhash.near_duplicates(spark.createDataFrame([(None, t) for t in texts] + [(9, texts[0])], "doc_id long, text string"))
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str) == [(9, 9), (None, 9), (None, 9), (None, None)]


def test_hash_is_sparks(spark):
    text = "some words of ümlaut 漢字 text"
    assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h & (1 << 64) - 1 == simhash._hash(text.encode())


def test_runs_of_a_long_text(monkeypatch):
    whole = simhash.fingerprint(LONG.encode())
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(LONG.encode()) == whole


def near(rng, n, groups):
    """n random prints, and groups of prints a few bits from each other."""
    out = {rng.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1, 7}
    for _ in range(groups):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(p)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
    return sorted(out)


def test_words_of_pairs_equal_all_pairs():
    rng = random.Random(4)
    for n in (1, 2, 63, 64, 65, 200):
        prints = near(rng, n, n // 8)
        for radius in (0, 1, 2, 3):
            i, w, bits = simhash.near_pairs(np.array(prints, dtype=np.uint64), radius)
            row, bit = np.nonzero(simhash.bits_of(bits)) if len(bits) else ((), ())
            got = {(int(i[r]), int(w[r]) * 64 + int(b)) for r, b in zip(row, bit, strict=True)}
            assert got == {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= radius}


def test_links_connect_all_pairs(spark):
    """Also where buckets are refined (dense) and dealt into slices (block)."""
    prints = near(random.Random(5), 500, 60)
    # a bucket far beyond a block: prints that share their upper half, neighbours one bit apart
    prints = sorted({*prints, *((0xABCDEF12 << 32) | k * 8 for k in range(300))})
    want = components(prints)
    table = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    for block, slice_, dense in ((2048, 1024, 1024), (40, 20, 1024), (16, 8, 1e-3), (2048, 1024, 1e-9)):
        found = simhash.links(table, len(prints), 3, block, slice_, dense).collect()
        part = {p: p for p in prints}

        def root(p, part=part):
            while part[p] != p:
                p = part[p]
            return p

        for r in found:
            a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
            assert (a ^ b).bit_count() <= 3
            part[root(a)] = root(b)
        groups = lambda f: sorted(sorted(p for p in prints if f(p) == x) for x in {f(p) for p in prints})
        assert groups(root) == groups(want.__getitem__)


def test_dense_bucket_makes_few_links(spark):
    """4,096 prints within 12 free bits: all in one component, links a few for each print, not pairs."""
    table = spark.range(4096).select(F.col("id").alias("fp"))
    found = simhash.links(table, 4096)
    assert found.count() < 4096 * 60 < 4096 * 298 // 2  # 298 neighbours each
