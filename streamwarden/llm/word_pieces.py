"""Reads word-end BPE vocabularies (``word_bpe_*.json``) and splits texts as they ask for.

Lower-casing, NFC and the split pattern below are those that the vocabulary file
states; they are checked when it is read. A piece never crosses white space, so each
white-space chunk is tokenized once and kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import regex

SPACE = r"\t-\r \x85\xa0  -     　"
_ODD = re.compile("[\x1c-\x1f]")
_CHUNKS = re.compile(f"[^{SPACE}]+")
CHUNKS, WORDS = 500_000, 1_000_000  # most that a worker keeps
CACHED_CHARS = 100
SLICE = 64


class Vocabulary:
    """A vocabulary file: pattern, merge ranks, ids and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} is not a lower-casing word-end BPE vocabulary")
        self.path, self.model = path, spec["model"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.ranks = {tuple(m): i for i, m in enumerate(self.model["merges"])}
        self.alphabet = byte_alphabet()

    def parts(self, text: str):
        """(special string or None, chunks of plain text) in order."""
        if "<|" not in text:
            yield None, chunks(text)
            return
        for part in self._specials.split(text):
            if part in self.special:
                yield part, ()
            elif part:
                yield None, chunks(part)

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, each byte written as a letter of the byte alphabet."""
        head = chunk.rstrip(".,;:!?")
        if head.isalpha():  # letters, then perhaps marks without a rule of their own
            found = [head, chunk[len(head):]] if len(head) < len(chunk) else [head]
        else:
            found = self.pattern.findall(chunk)
        if chunk.isascii() and chunk.isprintable():
            return found
        return ["".join(map(self.alphabet.__getitem__, w.encode())) for w in found]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def chunks(text: str) -> list[str]:
    """White-space chunks of the normalised text."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # a capital sigma has one small form here, wherever it stands
    text = text.lower()
    return _CHUNKS.findall(text) if _ODD.search(text) else text.split()


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo:
    """Values of words and of white-space chunks, both bounded, kept by a worker between its tasks.

    ``of_words`` gives the values of new words; ``join`` makes a chunk's value from its words' values.
    """

    def __init__(self, path: str, of_words, join):
        self.v, self.of_words, self.join = vocabulary(path), of_words, join
        self.chunks: dict = {}
        self.words: dict = {}

    def values(self, texts: list[str | None]):
        """For each text its parts: (special string or None, values of its chunks)."""
        for first in range(0, len(texts), SLICE):
            split = [list(self.v.parts(t)) if t else () for t in texts[first:first + SLICE]]
            seen = list(set().union(*(c for parts in split for _, c in parts)))
            known = dict(zip(seen, map(self.chunks.get, seen)))  # small, so that it stays near the processor
            new = [c for c, value in known.items() if value is None]
            learned = self._learn(new)
            known.update(learned)
            if len(self.chunks) + len(new) > CHUNKS:
                self.chunks.clear()
            self.chunks.update((c, value) for c, value in learned if len(c) <= CACHED_CHARS)
            get = known.__getitem__
            for parts in split:
                yield [(special, map(get, c)) for special, c in parts]

    def _learn(self, new: list[str]) -> list[tuple]:
        cut = [(c, self.v.words(c)) for c in new]
        seen = list(set().union(*(w for _, w in cut)))
        known = dict(zip(seen, map(self.words.get, seen)))
        fresh = [w for w, value in known.items() if value is None]
        values = self.of_words(self.v, fresh)
        known.update(zip(fresh, values))
        if len(self.words) + len(fresh) > WORDS:
            self.words.clear()
        self.words.update((w, value) for w, value in zip(fresh, values) if len(w) <= CACHED_CHARS)
        get, join = known.__getitem__, self.join
        return [(c, get(w[0]) if len(w) == 1 else join(map(get, w))) for c, w in cut]
