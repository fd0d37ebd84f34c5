"""The likest texts of a block, found by bounds: the same as if all pairs were rated, with few of them rated.

How many characters two texts can have in common, in order, is bounded by the characters that they share, whatever their
order, and by the pairs of neighbours that they share: of a common subsequence of L characters all but n + m - 2L of its
L - 1 neighbours are neighbours in both texts. Candidates are rated best bound first, until no bound passes the last that counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lcs_length

#: Texts of a block that one task takes from the left and from the right.
LEFTS, RIGHTS = 2_000, 20_000
#: Places for characters and for pairs of neighbours; several may share one, which only makes a bound larger.
CHARACTERS, NEIGHBOURS = 64, 256
#: Candidates that are rated before the first look at bounds by neighbours.
FIRST = 8


def counts(texts: list[str], gram: int, places: int) -> np.ndarray:
    """(texts, places): how often runs of `gram` characters fall into each place."""
    out = np.zeros((len(texts), places), dtype=np.int16)
    for row, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        if gram == 2:
            codes = codes[:-1] * 31 + codes[1:]
        np.add.at(out[row], codes % places, 1)
    return out


class Block:
    """Right texts with what bounds need."""

    def __init__(self, texts: list[str]):
        self.texts = sorted(texts)
        self.length = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.single, self.double = counts(self.texts, 1, CHARACTERS), counts(self.texts, 2, NEIGHBOURS)
        self.rated = 0

    def likest(self, text: str, ranks: int, floor: float) -> list[tuple[float, str]]:
        """The `ranks` best (ratio, text) of at least `floor`; equal ones by text."""
        n = len(text)
        whole = np.maximum(self.length + n, 1)
        bound = 200.0 * np.minimum(self.single, counts([text], 1, CHARACTERS)[0]).sum(axis=1) / whole
        best: list[tuple[float, int]] = []  # (-ratio, place), ascending; texts are sorted, so places are their order

        def rate(at: int) -> None:
            self.rated += 1
            ratio = 200.0 * lcs_length(text, self.texts[at]) / whole[at]
            if ratio >= floor:
                best.append((-ratio, at))
                best.sort()
                del best[ranks:]

        def passes(limits: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Which of the places may still be among the best."""
            if len(best) < ranks:
                return limits >= floor
            last, place = -best[-1][0], best[-1][1]
            return (limits > last) | ((limits == last) & (at < place))

        first = np.argsort(-bound, kind="stable")[:FIRST] if len(bound) <= 4 * FIRST else np.argpartition(-bound, FIRST)[:FIRST]
        for at in first[bound[first] >= floor]:
            rate(int(at))
        at = np.flatnonzero(passes(bound, np.arange(len(bound))))
        at = at[~np.isin(at, first)]
        shared = np.minimum(self.double[at], counts([text], 2, NEIGHBOURS)[0]).sum(axis=1)
        closer = np.minimum(bound[at], 200.0 * ((shared + 1 + n + self.length[at]) // 3) / whole[at])
        for k in np.lexsort((at, -closer)):
            if passes(closer[k : k + 1], at[k : k + 1])[0]:
                rate(int(at[k]))
            elif len(best) == ranks and closer[k] < -best[-1][0]:
                break
        return [(-r, self.texts[at]) for r, at in best]


def searched(left: DataFrame, right: DataFrame, large: DataFrame, keys: list[str], ranks: int, floor: float) -> DataFrame:
    """keys, l_no, r_no, ratio: at least the `ranks` likest right texts of each left one, for the blocks of large (keys, lefts,
    rights). A block is dealt into tasks of so many lefts and rights; each gives its own best."""
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sized = large.select(*keys, parts("lefts", LEFTS).alias("ls"), parts("rights", RIGHTS).alias("rs"))
    own = lambda df, no, mine, theirs, a, b: (
        df.join(sized, keys).withColumn(a, F.pmod(F.xxhash64(no), F.col(mine)).cast("int")).withColumn(b, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).select(*keys, "a", "b", no).toDF(*keys, "a", "b", no)
    )
    group = [*keys, "a", "b"]
    ddl = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys) + ", l_no string, r_no string, ratio double"

    def run(key: tuple, lefts: pa.Table, rights: pa.Table) -> pa.Table:
        block, rows = Block(rights["r_no"].to_pylist()), []
        for text in lefts["l_no"].to_pylist():
            rows += [(text, other, ratio) for ratio, other in block.likest(text, ranks, floor)]
        columns = [pa.array([k.as_py()] * len(rows), k.type) for k in key[: len(keys)]] + [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
        return pa.Table.from_arrays(columns, names=[*keys, "l_no", "r_no", "ratio"])

    one, two = own(left, "l_no", "ls", "rs", "a", "b"), own(right, "r_no", "rs", "ls", "b", "a")
    return one.groupBy(*group).cogroup(two.groupBy(*group)).applyInArrow(run, ddl)
