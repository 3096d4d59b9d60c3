"""Ids of a public word-level BPE vocabulary, encoded once per distinct word.

The vocabulary's own library is the authority. It looks at words one by one: white space
separates them, and the pre-tokenizer cuts letters, digits and the rest apart. So ids are looked
up by what stands between white space (lower case), then by word, and only new words go to the
library. Texts with characters beyond the range below, where this cutting is stated, and texts
that may hold a special token go to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

MOST_WORDS = 600_000  # kept per worker; a full table is emptied, which costs time only

# White space, printable ASCII, Latin-1 and Latin Extended-A without U+0130, whose
# lower case is two characters. All are stable under NFC. The words are those of the vocabulary's
# pre-tokenizer in that range.
PLAIN = re.compile("[\t-\r -~\xa0-įı-ſ]*")
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+"
)

# Byte-level vocabularies write a byte as the Latin-1 character where that is visible, and the
# other bytes, in order, as the characters from 256 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
HIDDEN = [byte for byte in range(256) if byte not in VISIBLE]
SHOWN = {byte: chr(256 + n) for n, byte in enumerate(HIDDEN)}


class WordIds:
    """Texts to ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def ids_of(self, word: str) -> bytes:
        """One word of the pre-tokenizer, straight through the vocabulary's merges."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
        return b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(mapped)])

    def learn(self, chunks: set[str]) -> None:
        """Take in what stands between white space, by the words it is made of."""
        known = self.words
        for chunk in chunks:
            if chunk not in known:
                words = WORD.findall(chunk)
                for word in words:
                    if word not in known:
                        known[word] = self.ids_of(word)
                if len(words) != 1:
                    known[chunk] = b"".join([known[word] for word in words])

    def encode(self, text: str) -> bytes:
        if "<|" in text or PLAIN.fullmatch(text) is None:
            return self.whole(text)
        chunks = text.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, chunks))
        except KeyError:
            if len(self.words) > MOST_WORDS:
                self.words.clear()
            self.learn(set(chunks).difference(self.words))
            return b"".join(map(self.words.__getitem__, chunks))


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """The encoder of a vocabulary file, one per worker process."""
    return WordIds(path)
