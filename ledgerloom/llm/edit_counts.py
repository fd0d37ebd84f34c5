"""Edit-aware token counts: a segment tree of pre-token runs per document.

A text is cut only where every pre-token ends whatever stands around: at a single space between two other
characters, and after a letter that no letter follows (so texts without spaces have cuts too). There the token counts
of the runs add up to the text's count. The leaves of a document's tree hold the
characters and tokens of one run each, its inner nodes the sums. An edit finds the leaves that it touches
by their character sums, takes in neighbours while a border isn't such a space any more, re-encodes this
region alone, and updates the sums above.

Null texts keep null and count 0; edits to them have no effect. Edits apply in order, each to the text as
the earlier ones left it; positions and lengths are cut to the text. An edit that holds a null inserts or
deletes nothing there. Other columns are ignored. Repeated rows return as often as they stand.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Characters that a leaf holds at least, and the multiple at which a document's tree is built anew.
LEAF, REBUILD = 512, 8
#: Where a cut may be: before anything but a letter.
CUT = re.compile(r"[\W\d_]|[^\x00-\x7f]")
EDITS = "array<struct<start:long,remove:long,insert:string>>"
STATE = "doc_id long, text string, chars array<int>, tokens array<int>"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Counts a string's tokens under a file of byte-pair ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def is_border(text: str, at: int) -> bool:
    """Whether pre-tokens end before position `at`: after a letter without a letter behind it, or at a lone space
    between two characters that aren't white."""
    if not 0 < at < len(text):
        return False
    before, here = text[at - 1], text[at]
    if before.isalpha() and not here.isalpha():
        return unicodedata.category(here) != "Cn"  # a later version of Unicode might call it a letter
    return here == " " and at < len(text) - 1 and not before.isspace() and not text[at + 1].isspace()


def runs(text: str, leaf: int = LEAF) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = next((m.start() for m in CUT.finditer(text, at + leaf) if is_border(text, m.start())), len(text))
        out.append(text[at:end])
        at = end
    return out


class Tree:
    """Sums over leaves in an array: node i has children 2i and 2i+1, leaf k stands at size + k."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = np.array(chars, dtype=np.int64), np.array(tokens, dtype=np.int64)
        self.size = len(self.chars) // 2

    @classmethod
    def build(cls, text: str, count: Counter, leaf: int = LEAF) -> Tree:
        parts = runs(text, leaf)
        size = 1 << max(0, len(parts) - 1).bit_length()
        chars, tokens = np.zeros(2 * size, dtype=np.int64), np.zeros(2 * size, dtype=np.int64)
        for k, part in enumerate(parts):
            chars[size + k], tokens[size + k] = len(part), count(part)
        at = size
        while at > 1:
            for a in (chars, tokens):
                a[at // 2 : at] = a[at : 2 * at : 2] + a[at + 1 : 2 * at : 2]
            at //= 2
        return cls(chars, tokens)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds this character, and where the leaf starts. Past the end: the last leaf in use."""
        position = max(0, min(position, int(self.chars[1]) - 1))
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        more, others = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more
            self.tokens[node] += others
            node //= 2

    def edit(self, text: str, start: int, remove: int, insert: str, count: Counter, leaf: int = LEAF) -> tuple[str, int]:
        """The text after the edit, and the characters encoded for it."""
        start = max(0, min(start, len(text)))
        end = max(start, min(start + remove, len(text)))
        new = text[:start] + insert + text[end:]
        shift = len(new) - len(text)
        (first, low), (last, high) = self.find(start - 1), self.find(end)
        high += int(self.chars[self.size + last])
        while low > 0 and not is_border(new, low):
            first, low = self.find(low - 1)
        while high < len(text) and not is_border(new, high + shift):
            last, at = self.find(high)
            high = at + int(self.chars[self.size + last])
        region = new[low : high + shift]
        if len(region) > REBUILD * leaf * (last - first + 1):
            fresh = Tree.build(new, count, leaf)
            self.chars, self.tokens, self.size = fresh.chars, fresh.tokens, fresh.size
            return new, len(new)
        parts = runs(region, leaf)
        slots = last - first + 1
        parts = [*parts[: slots - 1], "".join(parts[slots - 1 :])] + [""] * (slots - len(parts))
        for k, part in enumerate(parts[:slots]):
            self.put(first + k, len(part), count(part))
        return new, len(region)


def build_state(docs: DataFrame, vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, text and the two arrays of its tree, and the column edits if docs has it."""
    path = vocabulary or vocabulary_path()
    more = [c for c in docs.columns if c == "edits"]

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        count = Counter(path)
        for batch in batches:
            trees = [Tree.build(text or "", count, leaf) for text in batch["text"]]
            yield batch | {"chars": [t.chars for t in trees], "tokens": [t.tokens for t in trees]}

    return map_columns(docs.select("doc_id", "text", *more), run, STATE + f", edits {EDITS}" * bool(more))


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """state with its edits in order. edits: doc_id, seq, start, remove, insert, a row each."""
    grouped = edits.groupBy(F.col("doc_id").alias("edited")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "remove", "insert"))).alias("e"))
    grouped = grouped.select("edited", F.transform("e", lambda x: F.struct(x["start"].cast("long").alias("start"), x["remove"].cast("long").alias("remove"), x["insert"].alias("insert"))).alias("edits"))
    return state.join(grouped, state.doc_id == grouped.edited, "left").drop("edited")


def apply_edits(state: DataFrame, vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """state after its edits, and tokens_before, tokens_after, n_edits, encoded_chars (what was re-encoded)."""
    path = vocabulary or vocabulary_path()

    names = ("doc_id", "text", "chars", "tokens", "tokens_before", "tokens_after", "n_edits", "encoded_chars")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        count = Counter(path)
        for batch in batches:
            rows = []
            for doc_id, text, chars, tokens, edits in zip(*(batch[c] for c in ("doc_id", "text", "chars", "tokens", "edits")), strict=True):
                tree, before, encoded, done = Tree(chars, tokens), int(tokens[1]), 0, 0
                for e in edits or () if text is not None else ():
                    if e is None:
                        continue
                    text, n = tree.edit(text, int(e["start"] or 0), int(e["remove"] or 0), e["insert"] or "", count, leaf)
                    encoded, done = encoded + n, done + 1
                rows.append((doc_id, text, tree.chars, tree.tokens, before, int(tree.tokens[1]), done, encoded))
            yield dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))

    return map_columns(state.select("doc_id", "text", "chars", "tokens", "edits"), run, STATE + ", tokens_before long, tokens_after long, n_edits int, encoded_chars long")
