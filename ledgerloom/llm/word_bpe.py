"""Token ids of a word-level BPE vocabulary, a pre-token at a time through a bounded cache."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The vocabulary lower-cases, drops white space and splits into contractions, letter runs, single digits and
#: runs of other marks. In texts of these characters only, blanks around all but the letters split as it does.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÿ]*")
MARKS = r"('s|'t|'re|'ve|'m|'ll|'d|[^\sa-zß-öø-ÿ0-9]+|[0-9])"
#: Pre-tokens encoded in one call; longer ones than KEPT don't stay in the cache.
AT_ONCE, KEPT = 5000, 64


class WordBpe:
    """Ids as little-endian unsigned 32-bit numbers.

    The different pre-tokens of a group of texts that aren't in the cache go through the vocabulary's model in a few
    calls, where the mark that ends a word tells whose ids are whose. Texts with other characters, or with a special
    token's own spelling, are encoded whole. A cache that `most` entries fill is emptied.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.bare = Tokenizer.from_str(json.dumps(rules | {"normalizer": None}))  # for what is lower-case and split
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most = most
        self.words: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) == len(part):
                flat = ids.tobytes()
                self.words.update(zip(part, map(flat.__getitem__, map(slice, [0, *stops[:-1].tolist()], stops.tolist())), strict=True))
            else:  # a vocabulary without that mark
                self.words.update((w, self._encode(w)) for w in part)

    def _ids_of_plain(self, texts: list[str]) -> list[bytes]:
        marked = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, type=pa.large_string())), MARKS, r" \1 ")
        split = pc.ascii_split_whitespace(marked)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.most:
            self.words = {w: self.words[w] for w in set(words).difference(new)}
        self._learn(new)
        self.words[""] = b""
        parts = list(map(self.words.__getitem__, words))
        for w in new:
            if len(w) > KEPT:
                del self.words[w]
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        pool, at = np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        n = size[codes]
        end = np.cumsum(n)
        flat = pool[np.repeat(at[codes] - (end - n), n) + np.arange(int(n.sum()))].tobytes()
        ends = (4 * np.concatenate([[0], end])[split.offsets.to_numpy()]).tolist()
        return list(map(flat.__getitem__, map(slice, ends[:-1], ends[1:])))

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        out = [b""] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and "<|" not in t and PLAIN.fullmatch(t)]
        for k, ids in zip(plain, self._ids_of_plain([texts[k] for k in plain]) if plain else (), strict=True):
            out[k] = ids
        for k in {k for k, t in enumerate(texts) if t}.difference(plain):
            out[k] = self._encode(texts[k])
        return out

    def ids(self, text: str | None) -> bytes:
        return self.ids_of([text])[0]


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    """One for each worker process, whose tasks share its caches."""
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
