"""Near-duplicates by DartMinHash: weighted signatures, banded joining, exact checks, classes.

A text is the multiset of its five-word shingles. Every shingle throws hashed darts into the dyadic
regions of (weight, rank) space that its weight covers; each dart has a coordinate, and a coordinate keeps
its dart of least rank. Two texts agree in a coordinate with probability equal to their weighted Jaccard
similarity, so bands of coordinates are join keys.

What is compared are the different texts, each under a number of its own. Null texts have no class but their
doc_id's. Equal texts (empty ones too) share a class. Texts under five words are one shingle of all their words;
texts without words are linked to equal texts only. All rows of a doc_id are one document, so several texts under
one doc_id are linked. A class id is the smallest doc_id of the class. A repeated row returns as often as it
stands; rows without doc_id have no result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, WordHashes, map_batches, map_columns, materialize, mix64, shingle_hashes, uniform, word_hashes

BANDS, ROWS = 24, 4
#: Buckets of up to so many different texts are compared pair by pair; larger ones through hubs.
SMALL_BUCKET = 12
#: Frequent elements that the order of prefixes knows.
KNOWN_ELEMENTS = 100_000
#: Rows from which a join key counts as hot, and hot keys that are broadcast at most; beyond that Spark's skew join is left to it.
HOT, MOST_HOT = 1_000, 500_000
#: Texts that one call sketches together.
AT_ONCE = 64
_U64 = np.uint64


@lru_cache(256)
def _poisson_cdf(area: float) -> np.ndarray:
    top = int(area + 12 * math.sqrt(area) + 16)
    logs = np.cumsum(np.concatenate([[-area], math.log(area) - np.log(np.arange(1, top))]))
    return np.cumsum(np.exp(logs))


def _region(level: int) -> tuple[float, float]:
    """Lower end and width of a dyadic region: [0,1), [1,2), [2,4), [4,8) ..."""
    return (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))


def sketch(ids: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, size: int) -> np.ndarray:
    """The (sets, size) dart hashes of several weighted sets at once.

    owner names the set of each element, ascending from 0; each set has an element at least. A set's rank
    limit is doubled until each of its coordinates holds a dart; the limit doesn't change which is earliest.
    """
    out = np.zeros((sets, size), dtype=_U64)
    limit = size * (math.log(size) + 2) / np.bincount(owner, weights, minlength=sets)
    todo = np.ones(sets, dtype=bool)
    while todo.any():
        found, ranks, cells = [], [], []
        open_ = todo[owner]
        nu = 0
        while (at_w := np.flatnonzero(open_ & (weights > _region(nu)[0]))).size:
            low_w, wide_w = _region(nu)
            rho = 0
            while (at := at_w[limit[owner[at_w]] > _region(rho)[0]]).size:
                low_r, wide_r = _region(rho)
                base = mix64(ids[at] + _U64((0x9E3779B97F4A7C15 * (1 + nu * 64 + rho)) & 0xFFFFFFFFFFFFFFFF))
                count = np.searchsorted(_poisson_cdf(wide_w * wide_r), uniform(base), side="right")
                which = np.repeat(np.arange(at.size), count)
                nth = np.arange(which.size) - np.repeat(np.cumsum(count) - count, count)
                dart = mix64(base[which] ^ ((nth.astype(_U64) + _U64(1)) * _U64(0xD6E8FEB86659FD93)))
                which = at[which]
                rank = low_r + wide_r * uniform(mix64(dart + _U64(1)))
                keep = (rank < limit[owner[which]]) & (low_w + wide_w * uniform(mix64(dart + _U64(2))) < weights[which])
                dart, which = dart[keep], which[keep]
                found.append(dart)
                ranks.append(rank[keep])
                cells.append(owner[which] * size + (mix64(dart + _U64(3)) % _U64(size)).astype(np.int64))
                rho += 1
            nu += 1
        dart, rank, cell = np.concatenate(found), np.concatenate(ranks), np.concatenate(cells)
        order = np.argsort(-rank, kind="stable")
        out.reshape(-1)[cell[order]] = dart[order]  # the last one written is the earliest dart
        filled = np.zeros(sets * size, dtype=bool)
        filled[cell] = True
        todo &= ~filled.reshape(sets, size).all(axis=1)
        limit[todo] *= 2
    return out


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) join keys of (sets, bands * rows) signatures."""
    keys = np.tile(np.arange(1, bands + 1, dtype=_U64) * _U64(0xA24BAED4963EE407), (len(sigs), 1))
    grid = sigs.reshape(len(sigs), bands, rows)
    for k in range(rows):
        keys = mix64(keys ^ grid[:, :, k]) + _U64(k + 1)
    return keys.view(np.int64)


def weighted_set(text: str | None, cache: WordHashes, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(word_hashes(text, cache), size), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two weighted sets (0 if either is empty)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def printed(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of the exact text (16 bytes) and text, of rows that have both."""
    known = docs.where("doc_id is not null and text is not null")
    return known.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("fp"), "text")


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint of the text, band keys (empty if there are no words)."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        cache = WordHashes()
        for batch in batches:
            for at in range(0, len(batch["text"]), AT_ONCE):
                sets = [weighted_set(text, cache, size) for text in batch["text"][at : at + AT_ONCE]]
                full = [s for s in sets if len(s[0])]
                keys: Iterator[np.ndarray] = iter(())
                if full:
                    ids, counts = np.concatenate([s[0] for s in full]), np.concatenate([s[1] for s in full])
                    owner = np.repeat(np.arange(len(full)), [len(s[0]) for s in full])
                    keys = iter(band_keys(sketch(ids, counts.astype(np.float64), owner, len(full), bands * rows), bands, rows))
                yield {"doc_id": batch["doc_id"][at : at + AT_ONCE], "fp": batch["fp"][at : at + AT_ONCE], "bands": [next(keys) if len(s[0]) else [] for s in sets]}

    return map_columns(printed(docs), run, "doc_id long, fp binary, bands array<long>")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and text of these distinct texts; ids: id and fp.

    Equal texts are reduced to one in each task before they are shuffled, the only time that texts of all documents
    are. The ids grow with the input, so this is a merge join at every size.
    """
    texts = printed(docs).groupBy("fp").agg(F.first("text").alias("text"))
    return materialize(texts.join(ids.hint("merge"), "fp").select("id", "text"), "near-texts")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar enough, by their exact shingle multisets."""
    both = pairs.hint("merge").join(texts.toDF("a", "text_a"), "a").hint("merge").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        last: tuple[str | None, tuple] = (None, ())
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["text_a"], pdf["text_b"], strict=True):
                if last[0] != y:
                    last = (y, weighted_set(y, cache, size))
                keep.append(similarity(weighted_set(x, cache, size), last[1]) >= threshold)
            yield pdf.loc[keep, ["a", "b"]]

    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long", pandas=True)


def hot_keys(counts: DataFrame) -> DataFrame | None:
    """The keys with more than HOT rows, from counts (key, n); None if there are none or more than MOST_HOT."""
    hot = materialize(counts.where(F.col("n") > HOT).select("key"), "near-hot")
    n = hot.limit(MOST_HOT + 1).count()
    return hot if 0 < n <= MOST_HOT else None


def join_keys(rows: DataFrame, side: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined on key with side, which has a row a key. Rows of hot keys stay where they are and meet a broadcast of
    side's rows for these, at most MOST_HOT; so no task gets all rows of a hot key."""
    if hot is None:
        return rows.join(side, "key", how)
    few = F.broadcast(hot)
    there = rows.join(few, "key", "left_semi").join(F.broadcast(side.join(few, "key", "left_semi")), "key", how)
    return there.unionByName(rows.join(few, "key", "left_anti").join(side, "key", how))


def components(edges: DataFrame) -> DataFrame:
    """id -> cls, the least id that the undirected edges (a, b) reach.

    Each round takes the least label among neighbours and then jumps to that label's own label; every
    round is a written table, so a lost executor costs one round.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    hubs = hot_keys(both.groupBy(F.col("b").alias("key")).agg(F.count("*").alias("n")))
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("cls")).withColumnRenamed("a", "id"), "near-labels")
    while True:
        least = join_keys(both.select("a", F.col("b").alias("key")), labels.toDF("key", "cls_b"), hubs).groupBy("a").agg(F.min("cls_b").alias("near"))
        lower = materialize(labels.join(least, labels.id == least.a).select("id", "cls", F.least("cls", "near").alias("key")), "near-lower")
        led = hot_keys(lower.groupBy("key").agg(F.count("*").alias("n")))
        met = join_keys(lower, labels.toDF("key", "cls_to"), led)
        new = materialize(met.select("id", F.least("key", "cls_to").alias("cls"), (F.least("key", "cls_to") < F.col("cls")).alias("moved")), "near-labels")
        labels = new.select("id", "cls")
        if not new.where("moved").limit(1).count():
            return labels


def across(rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Rows (key, id, cls, ...) of the keys whose members aren't all of one class."""
    mixed = rows.groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least <> most")
    return join_keys(rows, mixed.select("key"), hot, "left_semi")


def elements(text: str | None, cache: WordHashes, size: int) -> np.ndarray:
    """A text's shingle multiset as a set: the k-th copy of a shingle is an element of its own."""
    ids, counts = weighted_set(text, cache, size)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix64(np.repeat(ids, counts) ^ (nth.astype(_U64) * _U64(0xD6E8FEB86659FD93)))


def prefix_pairs(rows: DataFrame, texts: DataFrame, threshold: float, size: int, known: int = KNOWN_ELEMENTS) -> DataFrame:
    """Distinct pairs (a, b) of different classes that can be similar enough. rows: id and cls.

    Prefix filtering: with elements in one order for all texts, similar sets share an element among their
    first n - ceil(threshold * n) + 1, and from the first they share on each must have as many elements left
    as similar sets have in common. Any order is right; rare elements first leaves few pairs, so the
    `known` most frequent ones come last. Edits of one text that have strayed apart start with their own
    edits, and meet nobody.
    """
    texts = materialize(rows.hint("merge").join(texts, "id"), "near-mixed-texts")

    def tally(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        cache = WordHashes()
        for batch in batches:
            every = [elements(text, cache, size) for text in batch["text"]]
            ids, counts = np.unique(np.concatenate(every), return_counts=True) if every else (np.empty(0, dtype=_U64),) * 2
            yield {"e": ids[counts > 1].view(np.int64), "n": counts[counts > 1].astype(np.int64)}

    counts = map_columns(texts.select("text"), tally, "e long, n long").groupBy("e").agg(F.sum("n").alias("n"))
    often = [r["e"] for r in counts.orderBy(F.desc("n"), "e").limit(known).collect()]  # at most `known` numbers
    shared = texts.sparkSession.sparkContext.broadcast(np.array(often[::-1], dtype=np.int64).view(_U64))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        cache, often = WordHashes(), shared.value
        place = np.argsort(often)
        for batch in batches:
            prefixes, lengths = [], []
            for text in batch["text"]:
                own = elements(text, cache, size)
                at = np.searchsorted(often, own, sorter=place)
                rank = place[np.minimum(at, len(often) - 1)] if len(often) else at
                rank = np.where(often[rank] == own, rank + 1, 0) if len(often) else np.zeros(len(own), dtype=np.int64)
                keep = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1 if len(own) else 0
                prefixes.append(own[np.lexsort((own, rank))[:keep]].view(np.int64))
                lengths.append(len(own))
            yield {"id": batch["id"], "cls": batch["cls"], "n": lengths, "prefix": prefixes}

    sides = map_columns(texts, run, "id long, cls long, n long, prefix array<long>")
    sides = across(materialize(sides.select(F.posexplode("prefix").alias("at", "key"), "id", "cls", "n"), "near-prefixes")).select("key", "id", "cls", "n", "at")
    x, y = sides.toDF("key", "a", "cls_a", "n_a", "at_a"), sides.toDF("key", "b", "cls_b", "n_b", "at_b")
    enough = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6
    apart = (F.col("a") < F.col("b")) & (F.col("cls_a") != F.col("cls_b")) & enough
    return x.join(y, (x.key == y.key) & apart).select("a", "b").distinct()


def links(reps: DataFrame, docs: DataFrame, threshold: float, size: int, small: int = SMALL_BUCKET) -> DataFrame:
    """Verified pairs (a, b) that connect all texts whose class a shared bucket can tell; reps: id, fp and
    bands, a row for each different text.

    Buckets of at most `small` texts give all their pairs. A larger bucket gives its members' pairs with a
    hub, the member that shares most buckets with others. Whoever is in such a bucket with members of
    another class after that is compared by prefix_pairs, which misses no similar pair.
    """
    rows = materialize(reps.select("id", F.explode("bands").alias("key")), "near-bands")
    counts = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-counts")
    hot = hot_keys(counts)
    sized = join_keys(rows, counts, hot)
    sized = materialize(sized.withColumn("central", F.sum("n").over(Window.partitionBy("id"))), "near-buckets")
    few = sized.where(F.col("n") <= small).select("key", "id")
    pairs = few.toDF("key", "a").join(few.toDF("key", "b"), "key").where("a < b").select("a", "b")
    many = sized.where(F.col("n") > small)
    hubs = many.groupBy("key").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("hub"))
    rays = join_keys(many, hubs, hot).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    todo = materialize(pairs.union(rays).distinct(), "near-candidates")
    texts = texts_of(reps.select("id", "fp").join(sized.select("id").distinct().hint("merge"), "id", "left_semi"), docs)
    found = materialize(verified(todo, texts, threshold, size), "near-links")
    if not many.limit(1).count():
        return found
    named = many.select("key", "id").join(components(found), "id", "left").select("key", "id", F.coalesce("cls", "id").alias("cls"))
    left = materialize(across(named, hot).select("id", "cls").distinct(), "near-mixed")
    more = prefix_pairs(left, texts, threshold, size).join(todo, ["a", "b"], "left_anti")
    return found.union(verified(materialize(more, "near-candidates"), texts, threshold, size))


def same_documents(sigs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of texts that stand under one doc_id, each with the document's least; None if there are none."""
    print_ = F.xxhash64("fp")
    several = sigs.groupBy("doc_id").agg(F.min(print_).alias("least"), F.max(print_).alias("most")).where("least <> most").select("doc_id")
    several = materialize(several, "near-several")
    if not several.limit(1).count():
        return None
    theirs = materialize(sigs.select("doc_id", "fp").join(several, "doc_id", "left_semi").distinct().join(reps.select("fp", "id"), "fp").select("doc_id", "id"), "near-several")
    least = theirs.groupBy("doc_id").agg(F.min("id").alias("a"))
    return theirs.join(least, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, size: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), rep_id (least doc_id with the same text)."""
    sigs = materialize(signatures(docs, bands, rows, size), "near-signatures")
    reps = sigs.groupBy("fp").agg(F.min("doc_id").alias("rep_id"), F.first("bands").alias("bands"))
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "near-reps")
    edges = links(reps.select("id", "fp", "bands"), docs, threshold, size)
    more = same_documents(sigs, reps)
    linked = reps.select("id", "rep_id").join(components(edges if more is None else edges.union(more)), "id")
    least = linked.groupBy("cls").agg(F.min("rep_id").alias("class_id"))
    classes = materialize(linked.join(least, "cls").select("id", "class_id"), "near-classes")
    named = reps.select("fp", "id", "rep_id").join(classes, "id", "left").select("fp", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"))
    members = sigs.select("doc_id", "fp").join(named, "fp").select("doc_id", "class_id", "rep_id")
    bare = docs.where("doc_id is not null and text is null").select("doc_id")
    if more is None and not bare.limit(1).count():
        return members
    own = members.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    bare = bare.join(own, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"))
    return members.union(bare)
