"""Vector best-fit packing of tokenised documents into sequences.

A piece takes up three capacities of a sequence: tokens, a place among its documents, and attention cost (the
square of its length in whole tiles, as a kernel computes it). Pieces are placed longest first; of the open
sequences with room in every capacity, the chosen one has the least weighted residual norm after it ("norm") or the
largest weighted dot product of piece and residual ("dot"), and of equal ones the one opened first. A full-length
piece fits by itself; documents bind where a sequence would hold over 256 tiny ones, attention where tiny ones fill up
a long one's sequence: a tile is 1/256 of a full piece's cost, of which a sequence takes 1.25.

Null and empty texts are one end token. Rows without doc_id are packed like others, under a null doc_id. A repeated
row is packed as often as it stands, under the same doc_id and piece. An empty table gives no rows. Columns other
than doc_id and text are ignored, whatever their names. A text is encoded whole, with its ids (4 bytes each) in the
task's memory, and gives as many pieces as it needs; a group of pieces has a bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialize
from .word_bpe import default_vocabulary, word_bpe

SEQUENCE = 2048
#: Pieces that one task packs together; a group leaves about one sequence unfilled.
GROUP = 8192
#: Documents of a sequence at most, tokens of an attention tile's side, and the capacities' weights. Attention may cost
#: a quarter more than that of one full-length piece.
DOCUMENTS, TILE, WEIGHTS = 256, 128, (1.0, 0.05, 0.1)
#: Characters of texts that are encoded together; a longer text goes alone.
AT_ONCE = 8_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def groups(texts: list[str | None], most: int = AT_ONCE) -> Iterator[slice]:
    """Runs of texts with about `most` characters together."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def pieces(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Each document's ids and then end_id, cut only where longer than `most`."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        words = word_bpe(vocabulary)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for part in groups(batch["text"]):
                for doc_id, ids in zip(batch["doc_id"][part], words.ids_of(batch["text"][part]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[at : at + 4 * most]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True) if rows else [[]] * 5, strict=True))

    return map_columns(docs.select("doc_id", "text"), run, PIECES)


def sizes_of(length: np.ndarray) -> np.ndarray:
    """What pieces of these lengths take up: tokens, documents, attention."""
    return np.column_stack([length, np.ones_like(length), (np.ceil(length / TILE) * TILE) ** 2])


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each row of `sizes` (pieces by capacities), rows in placing order."""
    n = len(sizes)
    bins, offsets = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    smallest = np.minimum.accumulate(sizes[::-1], axis=0)[::-1]  # of what is still to come
    w = weights / capacity
    open_ids, residual, used = np.empty(0, dtype=np.int64), np.empty((0, sizes.shape[1])), np.empty(0, dtype=np.int64)
    count = 0
    for i in range(n):
        size = sizes[i]
        fits = np.flatnonzero((residual >= size).all(axis=1)) if len(residual) else ()
        if len(fits):
            left = residual[fits] - size
            score = -(residual[fits] * w * (size * w)).sum(axis=1) if rule == "dot" else ((left * w) ** 2).sum(axis=1)
            at = fits[int(np.argmin(score))]
            residual[at] -= size
        elif (capacity - size >= smallest[min(i + 1, n - 1)]).all():
            at = len(residual)
            open_ids, used = np.append(open_ids, count), np.append(used, 0)
            residual = np.vstack([residual, capacity - size])
            count += 1
        else:  # nothing to come fits beside it
            bins[i] = count
            count += 1
            continue
        bins[i], offsets[i] = open_ids[at], used[at]
        used[at] += int(size[0])
        if i % 64 == 0 and i + 1 < n:
            live = (residual >= smallest[i + 1]).all(axis=1)
            open_ids, residual, used = open_ids[live], residual[live], used[live]
    return bins, offsets


def pack(
    cut: DataFrame, tokens: int = SEQUENCE, documents: int = DOCUMENTS, attention: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP
) -> DataFrame:
    """The pieces with sequence_id and offset. The pieces are dealt into even groups by a hash of their number in the
    written table, not of doc_id, which may be null or stand on many rows; so the work of a group is bounded and
    the groups grow in number only. What is shuffled is a few numbers a piece."""
    cut = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    parts = max(1, -(-cut.count() // group))
    capacity = np.array([tokens, documents, attention or 1.25 * tokens**2], dtype=np.float64)
    share = np.array(weights, dtype=np.float64)

    def run(key: tuple, rows: pa.Table) -> pa.Table:  # Arrow keeps integers beside nulls
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = rows["length"].to_numpy().astype(np.float64)
        bins, offsets = best_fit(sizes_of(length), capacity, share, rule)
        rows = rows.drop_columns(["row", "part"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32)))
        return rows.append_column("offset", pa.array(offsets))

    part = F.pmod(F.xxhash64("row"), F.lit(parts))
    return cut.withColumn("part", part).groupBy("part").applyInArrow(run, PACKED)


def best_fit_packing(docs: DataFrame, vocabulary: str | None = None, **limits) -> DataFrame:
    most = limits.get("tokens", SEQUENCE)
    return pack(pieces(docs, vocabulary or default_vocabulary(), most), **limits)
