"""Near-duplicates by SimHash: fingerprints that differ in few bits are found by bit-sliced comparison.

A text's words, A to Z in lower case, end at ASCII white space; its three-word shingles, repeats included (of fewer words
the whole sequence), are hashed by XXH64, and a bit of the fingerprint is 1 where over half of the hashes have it. A
text without words has fingerprint zero and is linked like any other.

Different fingerprints meet in buckets: of two that differ in at most three bits, one of four equal parts agrees. With
very many fingerprints buckets go by a part of the 48 bits that are left as well, and so on. Buckets are packed into
blocks and compared there with bit planes stored vertically: a word holds one bit of 64 fingerprints, carry-save
counters add up the differences of 64 pairs at once, and a word of pairs is abandoned once all of them exceed the
radius. A block gives the links of a spanning forest, never all pairs; a bucket beyond a block is dealt into
slices, any two of which meet in a block, so no link is lost.

Null texts are empty. Rows without doc_id have a fingerprint and a component, whose id is the least doc_id in it (null if
there is none). Several texts of one doc_id are rows of their own. Repeated rows return as often as they stand; other
columns are ignored. A text is held whole with its words, its shingles in runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .dart_minhash import MOST_HOT, components, hot_keys, join_keys

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a block, and those of a bucket's slice.
BLOCK, SLICE = 2048, 1024
#: Shingles whose bits are counted together.
AT_ONCE = 1 << 15
#: Bit planes between two looks at which pairs are still near.
LOOK = 8
#: Average fingerprints of a bucket from which buckets go by one part more.
DENSE = 1024
_U64 = np.uint64
ALL = _U64(0xFFFFFFFFFFFFFFFF)
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def bits_of(values: np.ndarray) -> np.ndarray:
    """(n, 64) bits of unsigned values, the lowest first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(len(values), 8), axis=1, bitorder="little")


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else ()  # of bytes: only A to Z change, only ASCII white space divides
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return _hash(b" ".join(words)) if words else 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        run = words[at : at + AT_ONCE + SHINGLE - 1]
        hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(run[k:] for k in range(SHINGLE)), strict=False))), dtype=_U64, count=len(run) - SHINGLE + 1)
        ones += bits_of(hashes).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), dtype=_U64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, fp long")


def near_pairs(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of near pairs: (i, w, bits), where bit b says that prints i and 64 w + b, the later one, are within the radius."""
    m = len(prints)
    words = -(-m // 64)
    each = bits_of(prints)
    planes = np.zeros((BITS, words * 64), dtype=np.uint8)
    planes[:, :m] = each.T
    planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    flips = np.where(each.T != 0, ALL, _U64(0))
    i, w = np.nonzero(np.arange(words) * 64 + 63 > np.arange(m)[:, None])
    width = radius.bit_length()
    spare = (1 << width) - 1 - radius  # counters start here, so that they overflow beyond the radius
    sums = [np.full(len(i), ALL if spare >> k & 1 else 0, dtype=_U64) for k in range(width)]
    beyond = np.zeros(words, dtype=_U64)
    beyond[-1] = ~_U64(0) << _U64(m - (words - 1) * 64) if m % 64 else _U64(0)
    over = beyond[w]
    for at in range(0, BITS, LOOK):
        for b in range(at, at + LOOK):
            carry = planes[b][w] ^ flips[b][i]
            for s in sums:
                s ^= carry
                carry &= ~s  # both were set: it carries
            over |= carry
        live = over != ALL
        if live.sum() * 4 < 3 * len(live):
            i, w, over, sums = i[live], w[live], over[live], [s[live] for s in sums]
        if not len(i):
            break
    later = np.where(w > i // 64, ALL, ALL << (i % 64 + 1).astype(_U64))
    near = ~over & later
    found = near != 0
    return i[found], w[found], near[found]


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near prints that connect all that near pairs connect: one less than members for each component."""
    m, (i, w, near) = len(prints), near_pairs(prints, radius)
    touch = np.zeros((m, -(-m // 64), 64), dtype=bool)
    touch[i, w] = bits_of(near)
    touch = touch.reshape(m, -1)[:, :m]
    touch = touch | touch.T
    free, left, right = touch.any(axis=1), [], []
    for start in np.flatnonzero(free):
        if free[start]:
            free[start], todo = False, [start]
            while todo:
                now = todo.pop()
                new = np.flatnonzero(touch[now] & free)
                free[new] = False
                todo += new.tolist()
                left += [now] * len(new)
                right += new.tolist()
    return prints[np.array(left, dtype=np.int64)], prints[np.array(right, dtype=np.int64)]


def parted(rows: DataFrame, width: int) -> DataFrame:
    """Each row (fp, key, rest) under every quarter of its `width` bits of rest; the other three quarters are left as rest."""
    part = width // 4
    shifted = lambda n: F.shiftrightunsigned("rest", n) if n < BITS else F.lit(0).cast("long")

    def quarter(j: int):
        own = shifted(part * j).bitwiseAND(F.lit((1 << part) - 1).cast("long"))
        low = F.col("rest").bitwiseAND(F.lit((1 << part * j) - 1).cast("long"))
        high = F.shiftleft(shifted(part * (j + 1)), part * j)
        return F.struct(F.xxhash64("key", F.lit(j), own).alias("key"), high.bitwiseOR(low).alias("rest"))

    return rows.select("fp", F.explode(F.array(*(quarter(j) for j in range(4)))).alias("q")).select("fp", "q.*")


def buckets(prints: DataFrame, n: int, block: int = BLOCK, slice_: int = SLICE, dense: int = DENSE) -> DataFrame:
    """fp and key: prints (fp) within three bits share a key, and at most about `block` have one key."""
    rows = prints.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    width, cells = BITS, 1
    while True:
        rows, cells = parted(rows, width), cells << width // 4
        width -= width // 4
        if n <= dense * cells or width < 32:
            break
    rows = materialize(rows.select("fp", "key"), "simhash-buckets")
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    counts = materialize(counts, "simhash-counts")
    large = counts.where(F.col("n") > block).select("key", F.ceil(F.col("n") / slice_).cast("int").alias("slices"))
    few = large.limit(MOST_HOT + 1).count()
    if not few:
        return rows
    large = F.broadcast(large) if few <= MOST_HOT else large
    own = F.pmod(F.xxhash64("fp", F.lit("slice")), F.col("slices")).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: s != F.col("own")))
    dealt = rows.join(large, "key").withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    return rows.join(large.select("key"), "key", "left_anti").select("fp", "key").union(dealt)


def blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[np.ndarray]:
    """From rows sorted by key: prints of whole buckets together, about `block` of them; who is alone in a bucket goes."""
    held, ready, size = np.empty((0, 2), dtype=np.int64), [], 0

    def whole(rows: np.ndarray) -> Iterator[np.ndarray]:
        nonlocal ready, size
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        ends = np.r_[starts[1:], len(rows)]
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            if size and size + b - a > block:
                yield np.concatenate(ready)
                ready, size = [], 0
            ready.append(rows[a:b, 1])
            size += b - a

    for batch in batches:
        held = np.concatenate([held, np.column_stack([batch.column("key").to_numpy(), batch.column("fp").to_numpy()])])
        last = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0  # its bucket may go on
        yield from whole(held[:last]) if last else ()
        held = held[last:]
    yield from whole(held) if len(held) else ()
    if ready:
        yield np.concatenate(ready)


def links(prints: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK, slice_: int = SLICE, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of n different fingerprints within the radius that connect all that such pairs connect."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"buckets by quarters find differences of up to {RADIUS} bits")
    rows = buckets(prints, n, block, slice_, dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks(batches, block):
            a, b = forest(np.unique(some).view(_U64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return map_batches(rows.repartition("key").sortWithinPartitions("key"), run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links of at most `radius` bits reach."""
    rows = materialize(fingerprints(docs).withColumnRenamed("fp", "key"), "simhash-prints")
    groups = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-groups")
    found = materialize(links(groups.select(F.col("key").alias("fp")), groups.count(), radius).distinct(), "simhash-links")
    labels = components(found).withColumnRenamed("id", "key")
    named = materialize(groups.select("key", "rep").join(labels, "key", "left").select("key", "rep", F.coalesce("cls", "key").alias("cls")), "simhash-named")
    least = named.where("cls is not null").groupBy("cls").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "cls").select("key", "component_id")
    out = join_keys(rows, ids, hot_keys(groups.select("key", "n")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("key")), 16, "0").alias("fingerprint"), "component_id")
