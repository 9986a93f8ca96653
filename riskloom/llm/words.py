"""Ids of texts under a public tokenizer that lower-cases and drops white space, each distinct word encoded once per task."""

from __future__ import annotations

import json
import os
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = " \\t\\n\\v\\f\\r"
MOST = 1_000_000
"""Words that a task remembers; beyond that it starts anew."""
SLICE = 10_000_000
"""Bytes of text that are encoded at once."""
LINE = 4000
"""Words that go through the tokenizer as one text."""


def single(word: str) -> bool:
    """Whether the tokenizer's pattern takes the word as one: letters alone, or ASCII signs without an apostrophe."""
    if word.isascii():
        return word.isalpha() or (word.isprintable() and "'" not in word and not any(map(str.isalnum, word)))
    return is_normalized("NFC", word) and word.isalpha() and word.lower().isalpha()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of slices, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordIds:
    """Encodes texts word by word. White space of ASCII separates words, and so does the place between a letter and a mark that ends
    a word, where the tokenizer's own pattern cuts, too. Texts that could name a special token go through the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own cost memory and wait
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Puts words behind those that are known."""
        alone = [w for w in new if single(w)]
        rest = [w for w in new if not single(w)]
        ids, sizes = [self.ids], [self.sizes]
        lines = [alone[i:i + LINE] for i in range(0, len(alone), LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            own = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[own]) + 1
            if len(cuts) != len(line):
                rest += line
                continue
            self.known.update(zip(line, range(len(self.known), len(self.known) + len(line))))
            ids.append(own)
            sizes.append(np.diff(cuts, prepend=0))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[w] = len(self.known)
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text starts in them (one place more than texts)."""
        texts = texts.fill_null("")
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        if len(odd):
            whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            texts = pc.if_else(pc.match_substring(texts, "<|"), "", texts)
        marked = pc.replace_substring_regex(pc.ascii_lower(texts), rf"([a-z])([.,;:!?])([{BLANKS}]|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(marked)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > MOST:
            self.forget()
        self.learn([w for w in words if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        size = self.sizes[at]
        ids = self.ids[spread((np.cumsum(self.sizes) - self.sizes)[at], size)]
        starts = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]]
        if len(odd):
            parts = np.split(ids, starts[1:-1])
            for i, own in zip(odd, whole):
                parts[i] = own
            ids, starts = np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
        return ids, starts

    def slices(self, texts: pa.Array):
        """``first, ids, starts`` of runs of texts of about ``SLICE`` bytes."""
        n = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        of = np.cumsum(n) // SLICE
        for first, last in zip(np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), np.r_[np.flatnonzero(of[1:] != of[:-1]) + 1, len(n)]):
            yield int(first), *self.encode(texts.slice(int(first), int(last - first)))
