"""Language identification by a linear-chain conditional random field over words.

Each word has features of its own (affixes, character n-grams, the word itself, lexicon membership), hashed
into a table of weights per language; learned transitions tie neighbours together. Forward-backward gives
every word's language probabilities, and a text's language is the one with the largest mean probability.

Training takes snippets of a bounded sample of documents outside the held-out fold, spliced pairwise so that
switches inside a text are seen and transitions learned. Words are runs of letters, lower-cased. A run of more
than TRIGRAMS letters (a compound, or text without spaces) goes into the chain as consecutive chunks, so features
see every letter of it and long runs weigh by their length.

Every value of lang that a row outside the held-out fold has is a state. Up to MANY languages the model has
2^BITS places and TRAIN_ROWS documents of each; beyond that places, documents and what runs at once shrink in
proportion (a document of each at least), so that memory stays what it is with MANY.

Texts that are null or have no letter are `und` with score 0. Without any labelled document all texts are
`und`. Rows return as often as they stand; other columns are ignored. Texts of over LONG characters go through the
chain in blocks: a pass forward keeps a vector a block, a pass backward counts; so besides the text itself memory is bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_columns

LETTERS = re.compile(r"[^\W\d_]+")
#: Documents that train at most for each language, snippets of each, words of a snippet.
TRAIN_ROWS, SNIPPETS, SNIPPET = 250, 6, 24
#: Languages up to which tables have their full size.
MANY = 64
#: Groups by a hash in which a language's documents are first ranked.
RANKED = 64
#: Hash places, lexicon words of a language, trigrams of a word at most and characters that these take.
BITS, LEXICON = 17, 400
TRIGRAMS, WIDTH = 12, 13
SLOTS = 10 + TRIGRAMS
#: Texts whose chains run side by side, and numbers (positions by languages) that they may hold, but for one long text.
AT_ONCE, CELLS = 512, 2_000_000
#: Characters from which a text's chain runs in blocks, and positions of a block.
LONG, BLOCK = 400_000, 16_384
#: Steps between rescalings of the sums: a step takes e^-40 at most, so they can't vanish.
RESCALE = 8


def share(full: int, languages: int) -> int:
    """A size for so many languages: `full` up to MANY, then in inverse proportion."""
    return full if languages <= MANY else max(1, full * MANY // languages)


def chunked(words: list[str]) -> list[str]:
    """The positions of a chain: words, those beyond TRIGRAMS letters in chunks. Neighbouring chunks share two
    letters, so that each trigram of the word lies in one of them."""
    if not words or len(max(words, key=len)) <= TRIGRAMS:
        return words
    step = TRIGRAMS - 2
    return [c for w in words for c in ((w,) if len(w) <= TRIGRAMS else [w[a : a + TRIGRAMS] for a in range(0, len(w) - 2, step)])]


def word_features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """(words, SLOTS) hash places: the word, its length, affixes, trigrams with the ends marked, lexicon entry.

    What a word hasn't stands at the last place. All words go together, as chunked() gives them: a matrix of their
    first WIDTH characters (all, with the end's mark) and one of their last.
    """
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    start = np.cumsum(n) - n
    place = start[:, None] + np.arange(WIDTH)
    head = np.where(np.arange(WIDTH) < n[:, None], flat[np.minimum(place, len(flat) - 1)], np.uint64(2))
    tail = [flat[start + np.maximum(n - k, 0)] for k in (1, 2, 3, 4)]
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    named = np.fromiter((lexicon.get(w, -1) + 1 for w in words), dtype=np.int64, count=len(words))
    out = np.full((len(words), SLOTS), 1 << BITS, dtype=np.int64)
    slot = 0

    def put(kind: int, codes: list[np.ndarray], there: np.ndarray | bool = True) -> None:
        nonlocal slot
        x = np.full(len(words), kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for c in codes:
            x = (x ^ c) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        out[:, slot] = np.where(there, (x >> np.uint64(64 - BITS)).astype(np.int64), 1 << BITS)
        slot += 1

    put(1, [whole])
    put(2, [np.minimum(n, 12).astype(np.uint64)])
    put(3, [named.astype(np.uint64)], named > 0)
    for k in (1, 2, 3):
        put(10 + k, [head[:, i] for i in range(k)], n >= k)
    for k in (1, 2, 3, 4):
        put(20 + k, tail[:k], n >= k)
    first = np.full(len(words), 1, dtype=np.uint64)
    for i in range(TRIGRAMS):
        put(30, [head[:, i - 1] if i else first, head[:, i], head[:, i + 1]], n > i)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (places + 1, languages); the last place is for padding and stays 0
    transitions: np.ndarray
    lexicon: dict[str, int]
    shift: int = 0  # places are the hash places without so many low bits


class Emissions(dict):
    """word -> row of exp(score) by language, in a growing table that is emptied at `most` words."""

    def __init__(self, model: Model, most: int = 200_000):
        super().__init__()
        self.model, self.most, self.part = model, share(most, len(model.languages)), share(20_000, len(model.languages))
        self.table = np.empty((1024, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        """Adds the words that aren't in it, all at once."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(dict.fromkeys(words))
        while len(self) + len(new) > len(self.table):
            self.table = np.vstack([self.table, np.empty_like(self.table)])
        for at in range(0, len(new), self.part):
            part = new[at : at + self.part]
            score = self.model.weights[word_features(part, self.model.lexicon) >> self.model.shift].sum(axis=1)
            self.table[len(self) : len(self) + len(part)] = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30))
            self.update(zip(part, range(len(self), len(self) + len(part)), strict=True))

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def forward_backward(emit: np.ndarray, length: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums up to a factor of each position, and 0 past a chain's end.

    emit: (time, chains, states), chains sorted by length, longest first; transition is exponentiated. If the chains are
    parts of longer ones, before and after (chains, states) are the forward sums of the positions before them and the backward
    sums of their last positions.
    """
    steps, chains, states = emit.shape
    live = np.searchsorted(-length, -np.arange(steps), side="left")  # chains longer than t
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    a = emit[0] if before is None else (before @ transition) * emit[0]
    a = a / a.sum(axis=1, keepdims=True)
    alpha[0] = a
    for t in range(1, steps):
        a = (a[: live[t]] @ transition) * emit[t, : live[t]]
        if t % RESCALE == 0:
            a /= a.sum(axis=1, keepdims=True)
        alpha[t, : live[t]] = a
    b = np.full((chains, states), 1 / states) if after is None else after.copy()
    for t in range(steps - 1, -1, -1):
        n = live[t]
        beta[t, :n] = b[:n]
        if t:
            back = (emit[t, :n] * b[:n]) @ transition.T
            b[:n] = back / back.sum(axis=1, keepdims=True) if t % RESCALE == 0 else back
    return alpha, beta


def marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Each position's probabilities of the states; 0 past a chain's end."""
    p = alpha * beta
    total = p.sum(axis=2, keepdims=True)
    return np.divide(p, total, out=p, where=total > 0)


def train(snippets: list[tuple[str, list[str]]], epochs: int = 4, batch: int = 64, rate: float = 0.3, l2: float = 1e-5, seed: int = 11) -> Model:
    """Maximum likelihood by AdaGrad on (language, words) snippets; pairs of snippets are spliced at random."""
    languages = [x for x, _ in sorted(Counter(x for x, _ in snippets).items(), key=lambda x: (-x[1], x[0]))]
    number = {x: i for i, x in enumerate(languages)}
    data = [(number[x], words) for x, words in snippets if words]
    counts: dict[int, Counter] = {i: Counter() for i in number.values()}
    for y, words in data:
        counts[y].update(words)
    totals = {y: sum(c.values()) or 1 for y, c in counts.items()}
    first, second = {}, {}  # a word's greatest share of a language's words, and the greatest beside that
    for y, c in counts.items():
        for word, n in c.items():
            low = min(n / totals[y], first.get(word, (0.0, -1))[0])
            if n / totals[y] > first.get(word, (0.0, -1))[0]:
                first[word] = (n / totals[y], y)
            second[word] = max(second.get(word, 0.0), low)
    lexicon: dict[str, int] = {}
    for y, c in counts.items():
        for word, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if first[word][1] == y and n / totals[y] > 3 * second[word]:
                lexicon[word] = y
    states = len(languages)
    shift = max(0, min(BITS - 10, (max(1, -(-states // MANY)) - 1).bit_length()))
    places = (1 << BITS - shift) + 1
    w, w_sum = np.zeros((places, states)), np.full((places, states), 1e-2)
    t, t_sum = np.zeros((states, states)), np.full((states, states), 1e-2)
    coded = [(y, word_features(words, lexicon) >> shift) for y, words in data]
    rng = np.random.default_rng(seed)
    for _ in range(epochs if coded else 0):
        order = rng.permutation(len(coded))
        for start in range(0, len(order), batch):
            chains = []
            for i in order[start : start + batch]:
                y, at = coded[i]
                if rng.random() < 0.5:
                    z, other = coded[int(rng.integers(len(coded)))]
                    cut, from_ = int(rng.integers(1, len(at) + 1)), int(rng.integers(0, len(other)))
                    chains.append((np.concatenate([np.full(cut, y), np.full(len(other) - from_, z)]), np.concatenate([at[:cut], other[from_:]])))
                else:
                    chains.append((np.full(len(at), y), at))
            chains.sort(key=lambda c: -len(c[0]))
            length = np.array([len(c[0]) for c in chains])
            at = np.full((length[0], len(chains), SLOTS), places - 1, dtype=np.int64)
            gold = np.zeros((length[0], len(chains), states))
            for k, (y, f) in enumerate(chains):
                at[: len(y), k] = f
                gold[np.arange(len(y)), k, y] = 1
            score = sum(w[at[:, :, k]] for k in range(SLOTS))
            emit = np.exp(score - score.max(axis=2, keepdims=True))
            move = np.exp(t - t.max())
            alpha, beta = forward_backward(emit, length, move)
            g = (marginals(alpha, beta) - gold).reshape(-1, states) / len(chains)
            used, where = np.unique(at, return_inverse=True)
            grad = np.column_stack([np.bincount(where.reshape(-1), np.repeat(g[:, s], SLOTS), len(used)) for s in range(states)])
            grad[used == places - 1] = 0
            here, there = alpha[:-1].reshape(-1, states), (emit * beta)[1:].reshape(-1, states)
            norm = ((here @ move) * there).sum(axis=1, keepdims=True)
            here = np.divide(here, norm, out=np.zeros_like(here), where=norm > 0)
            t_grad = (move * (here.T @ there) - np.einsum("tci,tcj->ij", gold[:-1], gold[1:])) / len(chains)
            grad += l2 * w[used]
            w_sum[used] += grad * grad
            w[used] -= rate * grad / np.sqrt(w_sum[used])
            t_sum += t_grad * t_grad
            t -= rate * t_grad / np.sqrt(t_sum)
    return Model(languages, w.astype(np.float32), t, lexicon, shift)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, **settings) -> Model:
    """Learns from text and lang of documents outside the held-out fold.

    A language's sample is its `rows` documents (its share of them beyond MANY languages) whose salted id hashes
    lowest, each giving SNIPPETS runs of words from all over its text. Documents are ranked within RANKED groups of
    a language first, so that the last ranking of one sees a bounded number.
    """
    known = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out()).select("doc_id", "text", "lang")
    languages = known.select("lang").distinct().count()
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros((0, 0)), {})
    rows = share(rows, languages)
    ranked = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit("language")).alias("rank"))
    for group in (["lang", F.pmod("rank", F.lit(RANKED))], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("rank", "doc_id"))
        ranked = ranked.withColumn("nth", nth).where(F.col("nth") <= rows).drop("nth")
    sample = known.join(F.broadcast(ranked.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            out: list[tuple[int, str, list[str]]] = []
            for doc_id, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True):
                words = chunked(LETTERS.findall(text.lower()))
                starts = np.random.default_rng(doc_id & 0x7FFFFFFF).integers(0, max(1, len(words) - SNIPPET + 1), SNIPPETS)
                out += [(doc_id, lang, words[a : a + SNIPPET]) for a in sorted({*starts.tolist()}) if words]
            yield dict(zip(("doc_id", "lang", "words"), zip(*out, strict=True) if out else [[]] * 3, strict=True))

    found = map_columns(sample, run, "doc_id long, lang string, words array<string>").collect()
    return train([(r["lang"], r["words"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["lang"], r["words"]))], **settings)


def label_words(texts: list[str | None], model: Model, cache: Emissions) -> list[tuple[list[str], np.ndarray]]:
    """Each text's words and the (positions, languages) probabilities of the languages of its chain's positions."""
    whole = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    if not model.languages:
        return [(w, np.zeros((len(w), 0))) for w in whole]
    words = [chunked(w) for w in whole]
    cache.learn([x for w in words for x in w])
    flat = [cache.rows(w) for w in words]
    order = sorted((i for i in range(len(texts)) if words[i]), key=lambda i: -len(words[i]))
    out = [(w, np.zeros((len(w), len(model.languages)))) for w in whole]
    if not order:
        return out
    move = np.exp(model.transitions - model.transitions.max())
    at = 0
    while at < len(order):  # chains of a round differ at most twofold in length, so little is padded
        top = len(words[order[at]])
        most = max(1, CELLS // (top * len(model.languages)))
        part = [i for i in order[at : at + most] if 2 * len(words[i]) >= top or top <= 64]
        at += len(part)
        length = np.array([len(words[i]) for i in part])
        emit = np.ones((top, len(part), len(model.languages)))
        for k, i in enumerate(part):
            emit[: length[k], k] = cache.table[flat[i]]
        p = marginals(*forward_backward(emit, length, move))
        for k, i in enumerate(part):
            out[i] = (whole[i], p[: length[k], k])
    return out


def positions(low: str, at: int = 0, skip: int = 0) -> Iterator[tuple[str, int, int]]:
    """The positions of a lower-cased text's chain, as chunked() gives them, from the word at `at` and its letter `skip` on: each with
    these two places."""
    for m in LETTERS.finditer(low, at):
        start, n = m.start(), m.end() - m.start()
        if n <= TRIGRAMS:
            yield low[start : start + n], start, 0
        else:
            for a in range(skip, n - 2, TRIGRAMS - 2):
                yield low[start + a : start + min(a + TRIGRAMS, n)], start, a
        skip = 0


def long_chain(text: str, model: Model, cache: Emissions, block: int = BLOCK) -> tuple[int, np.ndarray, int]:
    """A text's words, the mean probabilities of its positions and its switches, as label_words would give them, block by block."""
    low, states = text.lower(), len(model.languages)
    starts, befores, n_words, n = [(0, 0)], [None], 0, 0
    if not states:
        return sum(1 for _ in LETTERS.finditer(low)), np.zeros(0), 0
    move = np.exp(model.transitions - model.transitions.max())

    def emissions(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cache.learn(words)
        return cache.table[cache.rows(words)][:, None, :], np.array([len(words)])

    while True:
        part = list(islice(positions(low, *starts[-1]), block + 1))
        n_words += sum(a == 0 for _, _, a in part[:block])
        n += len(part[:block])
        if len(part) <= block:
            break
        alpha, _ = forward_backward(*emissions([w for w, _, _ in part[:block]]), move, befores[-1])
        befores.append(alpha[-1] / alpha[-1].sum(axis=1, keepdims=True))
        starts.append(part[block][1:])
    total, switches, after, next_top = np.zeros(states), 0, None, None
    if not n:
        return 0, np.zeros(0), 0
    for start, before in zip(reversed(starts), reversed(befores), strict=True):
        emit, length = emissions([w for w, _, _ in islice(positions(low, *start), block)])
        alpha, beta = forward_backward(emit, length, move, before, after)
        p = marginals(alpha, beta)[:, 0]
        top = p.argmax(axis=1)
        total += p.sum(axis=0)
        switches += int((top[1:] != top[:-1]).sum()) + (next_top is not None and int(top[-1] != next_top))
        next_top = top[0]
        after = (emit[0] * beta[0]) @ move.T
        after /= after.sum(axis=1, keepdims=True)
    return n_words, total / n, switches


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_words and switches (neighbouring positions of different likeliest languages)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        model = shared.value
        cache, at_once = Emissions(model), share(AT_ONCE, len(model.languages))
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "lang_pred": [], "score": [], "n_words": [], "switches": []}
            for at in range(0, len(batch["text"]), at_once):
                texts = batch["text"][at : at + at_once]
                long = {i for i, t in enumerate(texts) if t and len(t) > LONG}
                short = label_words([None if i in long else t for i, t in enumerate(texts)], model, cache)
                for i, (words, p) in enumerate(short):
                    if i in long:
                        n_words, mean, switches = long_chain(texts[i], model, cache)
                    else:
                        top = p.argmax(axis=1) if p.size else np.empty(0)
                        n_words, mean, switches = len(words), p.mean(axis=0) if p.size else np.zeros(0), int((top[1:] != top[:-1]).sum())
                    best = int(mean.argmax()) if mean.size else -1
                    out["n_words"].append(n_words)
                    out["lang_pred"].append(model.languages[best] if mean.size else "und")
                    out["score"].append(min(1.0, float(mean[best])) if mean.size else 0.0)
                    out["switches"].append(switches)
            yield out

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, n_words int, switches int")


def language(docs: DataFrame, **settings) -> DataFrame:
    found = identify(docs, fit(docs, **settings))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "switches")
