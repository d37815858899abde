"""Vocabulary and pre-tokens of byte-level BPE files in the ``tokenizers``
JSON format.

A text falls into *chunks* (an optional space and a run of non-spaces, or
white space); no pre-token crosses a chunk, so everything learnt about a
chunk can be kept and reused in the same worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from contextlib import suppress
from functools import lru_cache

import numpy as np
import regex

# The public pre-token pattern of byte-level BPE, and the white
# space characters of Unicode (property White_Space).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
# the pattern of the lower-case word vocabulary over Latin-1 lines; a line
# feed comes out as an item of its own
LOWER_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
ASCII_WORDS = re.compile(PRETOKEN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
                         .replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII)
_LATER = re.compile("[^\x00-\u036f]")  # characters that a Unicode version may add to
WORDS = regex.compile(PRETOKEN.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]")
                      .replace(r"\S", f"[^{SPACES}]"))


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand
    for themselves, the others take the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4096)
def _stand_in(char: str) -> str:
    """A long-assigned character of the class that the tokenizer gives
    ``char``; the ``regex`` module may follow another Unicode version."""
    from tokenizers import pre_tokenizers
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    return "a" if len(split("a" + char)) == 1 else "1" if len(split("1" + char)) == 1 else "\u0378"


def pretokens(chunk: str) -> list[str]:
    """Pre-tokens of one chunk.  Characters that Python's Unicode version
    doesn't know yet are classed by the tokenizer itself."""
    if chunk.isascii():
        return ASCII_WORDS.findall(chunk)
    if not _LATER.search(chunk):
        return WORDS.findall(chunk)
    shown = "".join(_stand_in(c) if c > "\u0370" and unicodedata.category(c) == "Cn" else c for c in chunk)
    return [chunk[m.start():m.end()] for m in WORDS.finditer(shown)]


class ByteVocabulary:
    """Ids, merges and added tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        chars = byte_characters()
        value = {c: b for b, c in enumerate(chars)}
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in chars], dtype=np.int64)
        suffix = model.get("end_of_word_suffix") or ""
        # the symbol of a byte that ends a word, where the vocabulary has such
        self.end_ids = np.array([ids[c + suffix] for c in chars], dtype=np.int64) if suffix else None
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(value[c] for c in token.removesuffix(suffix))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self._added = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None

    def segments(self, text: str) -> list:
        """Stretches of ordinary text (str) and ids of added tokens (int)."""
        if self._added is None or not self._added.search(text):
            return [text]
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [text[at:m.start()], self.added[m.group()]]
            at = m.end()
        return out + [text[at:]]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteVocabulary:
    """The vocabulary at ``path``, read once per worker process."""
    return ByteVocabulary(path)


class _Known(dict):
    """Values of chunks; a chunk without one reads as None and is noted."""

    def __init__(self):
        super().__init__()
        self.new: dict[str, None] = {}

    def __missing__(self, chunk: str) -> None:
        self.new[chunk] = None


class Chunks:
    """What is known of each chunk: ``value(chunk) = learn([chunks])[i]``.

    Kept per worker and emptied when it holds ``limit`` entries, so that
    memory is bounded; a forgotten chunk is learnt again.
    """

    def __init__(self, learn, limit: int = 400_000):
        self.learn, self.limit, self.known = learn, limit, _Known()

    def values(self, chunks: list[list[str]]) -> list[list]:
        """The values of lists of chunks, list by list."""
        known = self.known
        found = [list(map(known.__getitem__, c)) for c in chunks]
        if known.new:
            new = list(known.new)
            known.new = {}
            fresh = dict(zip(new, self.learn(new)))
            if len(known) + len(fresh) > self.limit:
                known.clear()
            known.update(fresh)
            for words, values in zip(chunks, found):
                at = -1
                with suppress(ValueError):  # when no further value is open
                    while True:
                        at = values.index(None, at + 1)
                        values[at] = fresh[words[at]]
        return found
