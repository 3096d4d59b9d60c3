"""Token counts of a unigram vocabulary by dynamic programming over a trie of pre-tokens.

A pre-token is what stands between white space, with the vocabulary's word mark before it. Its
segmentation is the one of greatest total score (of equal scores, the one with fewest tokens),
where the score of a piece is the one the vocabulary file states. The best score of a prefix
depends on the prefix alone, so pre-tokens that begin alike share it: a task takes the distinct
pre-tokens of a stretch of its texts in sorted order, which walks their trie depth first, keeps
the forward scores of the current path, and computes a prefix's score once, when its node is
entered. The count at a terminal node is stored and looked up for every occurrence.

A character that no piece covers counts as its UTF-8 bytes, at the vocabulary's byte scores.
Memory holds one path and the counts of one stretch, whatever the length of the texts; stored
counts are carried on to the next stretch up to `MOST_STORED`. Null texts and texts of white
space have no tokens. Texts are never cut.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 4 << 20  # characters whose pre-tokens are walked together
MOST_STORED = 400_000
MARK = "▁"
COUNTS = "n_pretokens long, n_tokens long"


class Vocabulary:
    """Scores of pieces, and of bytes for characters that no piece covers."""

    def __init__(self, pieces: dict[str, float], byte_scores: list[float]):
        self.pieces, self.byte_scores = pieces, byte_scores
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces, byte_scores = {}, [0.0] * 256
        for n in range(model.get_piece_size()):
            if model.is_byte(n):
                byte_scores[int(model.id_to_piece(n)[1:-1], 16)] = model.get_score(n)
            elif not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n)):
                pieces[model.id_to_piece(n)] = model.get_score(n)
        return cls(pieces, byte_scores)

    def fallback(self, character: str) -> tuple[float, int]:
        """Score and number of the bytes that stand for a character."""
        data = character.encode("utf-8", "surrogatepass")
        return sum(self.byte_scores[byte] for byte in data), len(data)


class Trie:
    """Counts of pre-tokens; the trie is walked path by path and not kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.stored: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Store the counts of `words`, which are sorted and marked."""
        pieces, longest = self.vocabulary.pieces, self.vocabulary.longest
        scores, counts, last = [0.0], [0], ""
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del scores[shared + 1 :], counts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, count = None, 0
                for start in range(max(0, end - longest), end):
                    piece = pieces.get(word[start:end])
                    if piece is not None:
                        score = scores[start] + piece
                        if best is None or score > best or (
                            score == best and counts[start] + 1 < count
                        ):
                            best, count = score, counts[start] + 1
                if word[end - 1] not in pieces:
                    score, size = self.vocabulary.fallback(word[end - 1])
                    score, size = scores[end - 1] + score, counts[end - 1] + size
                    if best is None or score > best or (score == best and size < count):
                        best, count = score, size
                scores.append(best)
                counts.append(count)
            self.stored[word[1:]] = counts[-1]
            last = word

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        if len(self.stored) > MOST_STORED:
            self.stored.clear()
        new = set()
        for text in texts:
            new.update(text.split())
        self.insert(sorted(MARK + word for word in new.difference(self.stored)))
        found = []
        for text in texts:
            words = text.split()
            found.append((len(words), sum(map(self.stored.__getitem__, words))))
        return found


def stretches(texts: list[str]):
    """The texts in order, by lists of about `STRETCH` characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= STRETCH:
            yield part
            part, size = [], 0
    if part:
        yield part


@lru_cache(maxsize=4)
def trie(path: str) -> Trie:
    """The trie of a vocabulary file, one per worker process."""
    return Trie(Vocabulary.from_file(path))


def counter(path: str):
    """A column function: text to its numbers of pre-tokens and tokens."""

    @F.pandas_udf(COUNTS)
    def count(texts: pd.Series) -> pd.DataFrame:
        whole = [text or "" for text in texts]
        found = [pair for part in stretches(whole) for pair in trie(path).count(part)]
        return pd.DataFrame(found, columns=["n_pretokens", "n_tokens"], dtype="int64")

    return count


def counted(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document."""
    return documents.select("doc_id", counter(path)("text").alias("found")).select(
        "doc_id", "found.n_pretokens", "found.n_tokens"
    )
