"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Base spans are assignments, access identifiers and long hex runs. Besides these a credential's parts may be
weak alone: user or client identifiers, unlabelled mixed tokens, endpoints. Parts are joined where their
intervals begin in one scope (a paragraph), however long it is. A weak identifier counts beside a secret, a weak
secret beside an identifier or an endpoint, and an endpoint beside a linked secret and an identifier.

The join looks sorted intervals up by scope: parts of different documents never meet, so nothing is shuffled, and the time
a text takes grows with its length and its parts, not with their pairs. Null texts are empty. Rows return as often
as they stand, also without doc_id; an empty table gives no rows. `scan` ignores other columns, `redact`
keeps them, whatever their names. A text is held whole with its parts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_columns

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")  # runs are taken whole, so shorter ones need no look
KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")

WEAK_ID = re.compile(r"""\b(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]*://[^\s"'<>]+|\b(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.IGNORECASE | re.ASCII)
SCOPE_END = re.compile(r"\n[ \t]*\n")
LEAST_BITS = 3.2

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]


def bits(token: str) -> float:
    """Shannon entropy of its characters."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


class Parts:
    """The intervals of one part of credentials in a text, sorted, to be joined with others within scopes."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans, key=lambda s: s[1:])
        self.starts = [s[1] for s in self.spans]
        self.furthest = list(accumulate((s[2] for s in self.spans), max, initial=0))  # the largest end of the first k

    def beside(self, span: Span, scopes: list[int]) -> bool:
        """Whether an interval of these, other than the span's own, begins in the span's scope."""
        k = bisect_right(scopes, span[1])
        low = bisect_left(self.starts, scopes[k - 1] if k else 0)
        high = bisect_left(self.starts, scopes[k]) if k < len(scopes) else len(self.starts)
        return low < high and (self.spans[low][1:] != span[1:] or self.spans[high - 1][1:] != span[1:])


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    weak_id = [("link_id", m.start(), m.end()) for m in WEAK_ID.finditer(text)]
    endpoint = [("link_endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    strong_id = [s for s in base if s[0] == "access"]
    if not (weak_id or endpoint or strong_id):
        return []
    strong = [s for s in base if s[0] != "access"]
    taken = Parts(base + endpoint)
    weak_secret = []
    for m in WEAK_SECRET.finditer(text):
        token = m[0]
        if re.search(r"\d", token) and re.search(r"[A-Za-z]", token) and bits(token) >= LEAST_BITS:
            if taken.furthest[bisect_left(taken.starts, m.end())] <= m.start():
                weak_secret.append(("link_secret", m.start(), m.end()))
    scopes = [m.end() for m in SCOPE_END.finditer(text)]
    ids, ends, secrets = Parts(strong_id + weak_id), Parts(endpoint), Parts(strong + weak_secret)
    found_id = [s for s in weak_id if secrets.beside(s, scopes)]
    found_secret = [s for s in weak_secret if ids.beside(s, scopes) or ends.beside(s, scopes)]
    sure = Parts(strong + found_secret)
    return found_id + found_secret + [s for s in endpoint if sure.beside(s, scopes) and ids.beside(s, scopes)]


def listed(spans: list[Span]) -> str:
    """kind:start:end in order of start, then of the kinds as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, its base spans and all spans as lists of kind:start:end (code points, end exclusive)."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "base": [], "base_sha256": [], "spans": []}
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                out["base"].append(listed(base))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(base + linked_spans(text, base)))
            yield out

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, base string, base_sha256 string, spans string")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), "base_sha256", "spans")


def without_spans(text: str | None, mark: str) -> str | None:
    """The text with every span replaced by the mark; overlapping spans share one."""
    if not text:
        return text
    base = base_spans(text)
    at, out = 0, []
    for _, a, b in sorted(base + linked_spans(text, base), key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with their secrets replaced by the mark, and n_chars, if there is one, following."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_spans(text, mark) for text in batch.column("text").to_pylist()]
            batch = batch.set_column(names.index("text"), "text", pa.array(texts, type=batch.schema.field("text").type))
            if "n_chars" in names:
                n = pa.array([None if t is None else len(t) for t in texts], type=batch.schema.field("n_chars").type)
                batch = batch.set_column(names.index("n_chars"), "n_chars", n)
            yield batch

    return map_batches(docs, run, docs.schema)
