"""Token ids of whole texts through a cache of words in front of a public tokenizer.

The tokenizer first splits a text into letters, single digits and runs of other marks, and its ids are
the ids of these units in a row. Each worker process keeps the ids of the units it saw last; only new
units reach the tokenizer. Where a text holds characters for which the split is not plainly known, it is
split at white space alone, which no unit spans.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Units that one of the two generations of the cache holds.
KEEP = 500_000
#: Bytes of text that are split at once.
WINDOW = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The split of the tokenizer file for lower-cased ASCII, with all other bytes counting as letters.
_UNITS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\x20\x09-\x0Da-z0-9\x80-\xff]+").findall
_ASCII = frozenset(map(chr, range(128)))


@lru_cache(1 << 16)
def _plain_letter(c: str) -> bool:
    """A letter that stays letters when lower-cased."""
    return all(unicodedata.category(x)[0] == "L" for x in c + c.lower())


def units(text: bytes) -> list[bytes]:
    if b"<|" not in text:
        if text.isascii():
            return _UNITS(text.lower())
        s = text.decode("utf-8", "replace")
        if unicodedata.is_normalized("NFC", s) and all(map(_plain_letter, set(s) - _ASCII)):
            return _UNITS(text.lower())
    return text.split()


def windows(text: bytes):
    """The text in parts of about WINDOW bytes, cut at white space."""
    at = 0
    while len(text) - at > WINDOW:
        m = _SPACE.search(text, at + WINDOW)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, else the next
    free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


_LETTERS = _byte_letters()


def _one_piece(word: bytes) -> str | None:
    """The word as the merging model sees it, if it is letters that normalising leaves alone."""
    if word.isalpha():
        return word.decode() if word.islower() else None
    s = word.decode("utf-8", "replace")
    if s.isalpha() and max(s) < "\u0180" and s == s.lower() and unicodedata.is_normalized("NFC", s):
        return word.decode("latin-1").translate(_LETTERS)
    return None


class UnitTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.raw: list[bytes] | None = None
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        e = self.tok.encode([w.decode("utf-8", "replace") for w in words], is_pretokenized=True, add_special_tokens=False)
        ids, word = np.array(e.ids, self.kind), np.array(e.word_ids, np.int64)
        n = self.kind.itemsize
        at = (np.searchsorted(word, np.arange(len(words) + 1)) * n).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, words: set[bytes]) -> None:
        """Make sure that all the words are in the young generation."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > KEEP:
            self.old, self.young, new = self.young, {}, words
        if self.old and new:
            old = self.old
            known = [w for w in new if w in old]
            self.young.update((w, old[w]) for w in known)
            new = new.difference(known)
        if new:
            if self.raw is None:
                self.raw = [self.kind.type(i).tobytes() for i in range(self.tok.get_vocab_size())]
            merge, raw, rest = self.model.tokenize, self.raw, []
            for w in new:
                piece = _one_piece(w)
                if piece is None:
                    rest.append(w)
                else:  # letters alone are one piece: straight to the merges, which is twice as fast
                    self.young[w] = b"".join([raw[t.id] for t in merge(piece)])
            if rest:
                self.young.update(zip(rest, self._encode(rest), strict=True))

    def _flush(self, batch: list[bytes]) -> list[np.ndarray]:
        parts = [units(t) for t in batch]
        self.learn(set().union(*parts))
        get = self.young.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), self.kind) for p in parts]

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        out: list[np.ndarray] = []
        batch: list[bytes] = []
        size = 0
        for t in texts:
            t = t or b""
            if batch and size + len(t) > WINDOW:
                out += self._flush(batch)
                batch, size = [], 0
            if len(t) > WINDOW:
                out.append(np.concatenate([x for w in windows(t) for x in self._flush([w])]))
            else:
                batch.append(t)
                size += len(t)
        return out + (self._flush(batch) if batch else [])


@lru_cache(2)
def tokenizer(path: str) -> UnitTokenizer:
    return UnitTokenizer(path)
