"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by their number of different five-word shingles (powers of two). For a partition
whose items have at most u shingles, a document is cut into blocks of u shingles, and each two neighbouring
blocks are a window, so a passage falls into few windows whatever the document's length. A window whose
MinHash agrees with an item's under any of the permutations makes the document a candidate; its exact
containment (share of the item's shingles that the whole document has) decides.

An item under five words is one shingle of all its words, which is looked up among the document's runs of as many
words; without_contained takes it only where the document has no other words, as a phrase of a few words stands in
clean texts too.

Items come in blocks of bounded size, dealt by a row number, so repeated items spread. Each block meets all
documents in one scan and is done before the next is read; nothing is shuffled. Null texts and texts without words
have no shingles and give no rows. Columns other than the ids and text are ignored. Equal items and repeated
documents return a row for each. contained_items leaves out rows without doc_id; without_contained decides for each
row by its own text, with or without an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, WordHashes, map_batches, map_columns, materialize, mix64, shingle_hashes, word_hashes

PERMUTATIONS = 64
#: Bounds of one block of items: rows and characters, as expected values of a hash split.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32_000_000
#: Texts that are searched together.
AT_ONCE = 128
_U64 = np.uint64
MATCHES = "doc_id long, item_id long, shared int, shingles int, containment double"


class ItemIndex:
    """The MinHash tables of one block of items, a table for each size partition."""

    def __init__(self, items: list[tuple[int, str]], permutations: int = PERMUTATIONS):
        cache = WordHashes()
        self.multipliers = (mix64(np.arange(1, permutations + 1, dtype=_U64)) | _U64(1)).tolist()
        self.ids, self.sets, keys, which = [], [], [], []
        self.uppers: list[int] = []
        self.short: dict[int, dict[int, list[int]]] = {}  # number of words -> hash of them -> places of items
        for item_id, text in items:
            words = word_hashes(text, cache)
            s = np.unique(shingle_hashes(words, whole_if_short=False))
            if 0 < len(words) < SHINGLE_WORDS:
                whole = shingle_hashes(words)
                self.short.setdefault(len(words), {}).setdefault(int(whole[0]), []).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(whole)
            if len(s):
                upper = 1 << (len(s) - 1).bit_length()
                self.uppers = sorted({*self.uppers, upper})
                for k, m in enumerate(self.multipliers):
                    keys.append(int(self.key(np.array([(s * _U64(m)).min()], dtype=_U64), k, upper)[0]))
                    which.append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(s)
        order = np.argsort(np.array(keys, dtype=_U64), kind="stable")
        self.keys, self.which = np.array(keys, dtype=_U64)[order], np.array(which, dtype=np.int64)[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)  # a filter before the search in the sorted keys
        self.maybe[(self.keys & _U64((1 << 22) - 1)).astype(np.int64)] = True

    @staticmethod
    def key(minima: np.ndarray, k: int, upper: int) -> np.ndarray:
        return mix64(minima + _U64((k * 64 + upper.bit_length()) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))

    def candidates(self, shingles: list[np.ndarray]) -> set[tuple[int, int]]:
        """(place of a document, place of an item) pairs. Each array of shingles has one at least."""
        found: set[tuple[int, int]] = set()
        lengths = np.array([len(s) for s in shingles])
        every = np.concatenate(shingles)
        levels = []
        below, last = lengths, 1
        for upper in self.uppers:  # starts of each level's blocks among those of the level below
            step, last = upper // last, upper
            counts = -(-below // step)
            owner = np.repeat(np.arange(len(counts)), counts)
            first = np.cumsum(below) - below
            starts = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
            levels.append((upper, starts, owner))
            below = counts
        for k, m in enumerate(self.multipliers):
            minima = every * _U64(m)
            for upper, starts, owner in levels:
                minima = np.minimum.reduceat(minima, starts)
                windows = minima.copy()
                same = owner[1:] == owner[:-1]
                windows[:-1][same] = np.minimum(minima[:-1], minima[1:])[same]
                keys = self.key(windows, k, upper)
                at = np.flatnonzero(self.maybe[(keys & _U64((1 << 22) - 1)).astype(np.int64)])
                low, high = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
                for i in np.flatnonzero(high > low):
                    found.update((int(owner[at[i]]), int(j)) for j in self.which[low[i] : high[i]])
        return found


def matches(index: ItemIndex, texts: list[str | None], cache: WordHashes, threshold: float, whole: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(place of a text, place of an item, shared shingles, the item's shingles) of containments over the threshold.

    whole: items under five words count only in texts of just their words.
    """
    for at in range(0, len(texts) if index.ids else 0, AT_ONCE):
        words = [(k, word_hashes(t, cache)) for k, t in enumerate(texts[at : at + AT_ONCE], at)]
        for size, items in index.short.items():
            for k, w in words:
                if len(w) == size or len(w) > size and not whole:
                    for h in np.intersect1d(shingle_hashes(w, size), np.fromiter(items, dtype=_U64, count=len(items))).tolist():
                        yield from ((k, j, 1, 1) for j in items[h])
        sets = [(k, s) for k, w in words if len(s := shingle_hashes(w, whole_if_short=False))]
        for i, j in sorted(index.candidates([s for _, s in sets])) if sets else ():
            n, both = len(index.sets[j]), int(np.isin(index.sets[j], sets[i][1]).sum())
            if both >= threshold * n - 1e-9:
                yield sets[i][0], j, both, n


def item_blocks(items: DataFrame, permutations: int, block_items: int, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """The indexes of the blocks of items, one after another, and whether more follow. One is given up with the next."""
    items = materialize(items.where("item_id is not null and text is not null").select("item_id", "text", F.monotonically_increasing_id().alias("row")), "items")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // block_chars))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("item_id", "text").collect()
        shared = items.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in part], permutations))
        yield shared, b + 1 < blocks
        if b + 1 < blocks:
            shared.unpersist()


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, permutations: int = PERMUTATIONS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item with containment of at least `threshold`. With several blocks each one's rows are written."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    out: DataFrame | None = None
    for shared, more in item_blocks(items, permutations, block_items, block_chars):

        def run(batches: Iterator[dict[str, list]], shared=shared) -> Iterator[dict]:
            index: ItemIndex = shared.value
            cache = WordHashes()
            for batch in batches:
                rows = [(batch["doc_id"][k], index.ids[j], both, n, both / n) for k, j, both, n in matches(index, batch["text"], cache, threshold)]
                yield dict(zip(("doc_id", "item_id", "shared", "shingles", "containment"), zip(*rows, strict=True) if rows else [[]] * 5, strict=True))

        found = map_columns(texts, run, MATCHES)
        found = materialize(found, "contained") if more else found
        out = found if out is None else out.union(found)
    return out


def without_contained(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, permutations: int = PERMUTATIONS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows whose own text holds an item; nothing is joined. What a block leaves is written before the next."""
    out = docs
    for shared, more in item_blocks(items, permutations, block_items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[k for k, *_ in matches(shared.value, batch.column("text").to_pylist(), cache, threshold, whole=True)]] = False
                yield batch.filter(pa.array(keep))

        out = map_batches(out, run, docs.schema)
        out = materialize(out, "uncontained") if more else out
    return out
