"""Search words and trigram similarity as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the search box.
SHORTEST_TOKEN = 2
MOST_TOKENS = 8
SHORTEST_QUERY = 2
LONGEST_QUERY = 100
SIMILAR_FROM = 0.3


def search_text(q: str | None) -> str | None:
    """The trimmed query, None when blank; one character or an overlong one is refused."""
    if q is None or not q.strip():
        return None
    text = q.strip()
    if not SHORTEST_QUERY <= len(text) <= LONGEST_QUERY:
        raise ValueError(f"a search takes {SHORTEST_QUERY} to {LONGEST_QUERY} characters")
    return text


def tokens(q: str) -> list[str]:
    """Distinct lower-case words without pattern characters, the first eight."""
    bare = (word.translate(dict.fromkeys(map(ord, "%_\\"))) for word in q.lower().split())
    return list(dict.fromkeys(w for w in bare if len(w) >= SHORTEST_TOKEN))[:MOST_TOKENS]


def tokens_column(text: Column) -> Column:
    """`tokens` for a column of queries."""
    words = F.split(F.lower(text), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[%_\\]", ""))
    kept = F.filter(bare, lambda w: F.length(w) >= SHORTEST_TOKEN)
    return F.slice(F.array_distinct(kept), 1, MOST_TOKENS)


def contains_all(text: Column, words: list[str]) -> Column | None:
    """True where every word occurs in the text, ignoring case; None without words."""
    found = None
    for word in words:
        hit = F.contains(F.lower(text), F.lit(word))
        found = hit if found is None else found & hit
    return found


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def trigrams(text: Column) -> Column:
    """Trigrams of each word in text order: two blanks before the word, one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda at: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), at, F.lit(3)),
        ),
    )
    return F.flatten(grams)


def _share(left: Column, right: Column) -> Column:
    both = F.size(F.array_intersect(left, right))
    either = F.size(F.array_union(left, right))
    return F.when(either > 0, both / either).otherwise(0.0)


def similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of both texts."""
    return _share(trigrams(left), trigrams(right))


def word_similarity(query: Column, text: Column) -> Column:
    """Best trigram share of the query against any contiguous extent of the text.

    Only extents that start and end on a trigram of the query are tried: trimming an
    unshared end never lowers the share.
    """
    wanted = F.array_distinct(trigrams(query))

    def best(grams: Column, wanted: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(1), F.size(grams)),
            lambda i: F.array_contains(wanted, F.element_at(grams, i)),
        )
        shares = F.flatten(
            F.transform(
                at,
                lambda i: F.transform(
                    F.filter(at, lambda j: j >= i),
                    lambda j: _share(wanted, F.slice(grams, i, j - i + 1)),
                ),
            )
        )
        return F.coalesce(F.array_max(shares), F.lit(0.0))

    grams = trigrams(text)
    empty = (F.size(grams) == 0) | (F.size(wanted) == 0)
    return F.when(empty, 0.0).otherwise(best(grams, wanted))
