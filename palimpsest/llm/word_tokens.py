"""Ids of whole texts by a vocabulary file of the tokenizers library, with a bounded memory of words.

The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in turn. A Python worker
encodes each distinct word once; a memory that has grown too large is emptied.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache
from itertools import chain

import numpy as np

END_ID = 1
#: Marks that make a piece of their own after letters; the apostrophe doesn't always.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _letters(word: bytes) -> bool:
    """Whether a word is one piece of letters, before and after the tokenizer's normalisation."""
    s = word.decode("utf-8", "replace")
    return s.isalpha() and unicodedata.normalize("NFC", s).lower().isalpha()


class Encoder:
    """``encode`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        """Letters and the marks after them are separate pieces to the tokenizer, so "word," is "word" and ",".
        Words of letters are encoded some at a time: each ends with the one token that ends a word."""
        known, plain, others, compound = self.known, set(), set(), []
        for w in new:
            if w.isalpha():  # of ASCII letters
                plain.add(w)
                continue
            core = w.rstrip(MARKS)
            if not core.isalpha() and not _letters(core):
                others.add(w)
                continue
            if core not in known:
                plain.add(core)
            if len(core) < len(w):
                tail = w[len(core) :]
                compound.append((w, core, tail))
                if tail not in known:
                    others.add(tail)
        words = list(plain)
        for i in range(0, len(words), 1024):
            some = words[i : i + 1024]
            ids = self._ids([b" ".join(some).decode("utf-8", "replace")])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                others.update(some)
                continue
            data, cuts = ids.tobytes(), (4 * cuts).tolist()
            known.update(zip(some, [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        words = list(others)
        for i in range(0, len(words), 1024):
            some = words[i : i + 1024]
            ids = self._ids([w.decode("utf-8", "replace") for w in some])
            known.update(zip(some, [x.tobytes() for x in ids], strict=True))
        known.update([(w, known[core] + known[tail]) for w, core, tail in compound])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # the tokenizer ignores case, but for the text of its special tokens
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        known = self.known
        if len(known) > self.most:
            known.clear()
        self._learn({w for w in set(chain.from_iterable(words)) if w not in known})
        get = known.__getitem__
        return [b"".join(map(get, own)) for own in words]


@cache
def encoder_of(path: str) -> Encoder:
    """One vocabulary, and one memory of words, for all tasks that a Python worker runs."""
    return Encoder(path)


def with_end(ids: bytes) -> bytes:
    return ids + END_ID.to_bytes(4, "little")
