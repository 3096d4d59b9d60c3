"""I-Match fingerprints over several randomised lexicons, by DataFrame functions only.

Terms are runs of letters and digits in lower case. The lexicon holds the terms of a band of
inverse document frequency: those that at least `LEAST` documents and the share `RAREST` of them
hold, and at most the share `COMMONEST`. So it has at most (mean distinct terms a document) /
`RAREST` terms, however many documents there are: some hundred thousand short words. Counted to be
at most `MOST_SENT`, they are sent to the texts, whose terms are then looked up where they are;
a longer lexicon is joined as Spark sees fit, with the same result.

The distinct terms of a text that are in the lexicon are sorted and hashed, and so are those in
randomised subsets of the lexicon: `SERIES` nested series by the digits of each term's MD5, whose
members keep one term in 2^k for every k of `HALVINGS`. Near copies agree in the sparse subsets,
copies of the same terms in all. A fingerprint lists all hashes; one without terms is empty. The
likeness of two fingerprints is the share of equal hashes among the subsets in which either text has
terms. A text without any term of the lexicon has a hash of the text itself instead, so only its
copies are like it. A repeated row counts as a document of its own; ties are none, for a fingerprint
depends on the text and the lexicon alone. Null and empty texts are equal and have no terms; texts
of any length are read whole; an empty table has an empty result. Only doc_id and text are read, so
further columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.llm.common import kept, shuffle_partitions
from shelfindex.operators.ordered import range_number, splitters

LEAST, RAREST, COMMONEST = 2, 1 / 2000, 0.1
MOST_SENT = 2_000_000  # terms
SERIES, HALVINGS = 8, (3, 5, 7, 9, 11)
TERM = r"[\p{L}\p{N}]+"
RANGES = 8  # of the document order, per shuffle partition
ROWS = 64  # that make a range at least


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def depths(term: Column) -> Column:
    """Three bits per series: in how many of its subsets the term is."""
    digest = F.md5(term)
    packed = F.lit(0)
    for n in range(SERIES):
        drawn = F.conv(F.substring(digest, 4 * n + 1, 4), 16, 10).cast("int")
        depth = sum(((drawn < (1 << (16 - k))).cast("int") for k in HALVINGS), F.lit(0))
        packed = packed + depth * (1 << (3 * n))
    return packed


def lexicon(documents: DataFrame) -> DataFrame:
    """term and its depths, of the terms within the band, and the empty term; kept."""
    total = documents.count()
    least, most = max(LEAST, RAREST * total), max(LEAST, COMMONEST * total)
    counted = (
        documents.select(F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .filter(F.col("df").between(least, most))
    )
    known = counted.select("term", depths(F.col("term")).alias("depths"))
    empty = documents.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).alias("depths"))
    return kept(known.unionByName(empty), "lexicon")


def hash_of(listed: Column) -> Column:
    joined = F.array_join(F.transform(listed, lambda t: t["term"]), " ")
    return F.when(F.size(listed) > 0, F.substring(F.md5(joined), 1, 8)).otherwise("")


def at_least(listed: Column, series: Column, depth: Column) -> Column:
    """The terms that are in the first `depth` subsets of a series."""
    kept_bits = lambda t: F.floor(t["depths"] / F.pow(F.lit(8), series)) % 8
    return F.filter(listed, lambda t: kept_bits(t) >= depth)


def with_fingerprints(
    df: DataFrame, keys: Sequence[str], texts: Sequence[str], known: DataFrame
) -> DataFrame:
    """`df`, whose rows have distinct `keys`, with the hashes of each text column in its place.

    Rows are grouped by `keys` once their terms are looked up; where `df` is laid out by some of
    the keys already, nothing is shuffled.
    """
    others = [c for c in df.columns if c not in (*keys, *texts)]
    carried = F.struct(*others, *[F.md5(F.coalesce(t, F.lit(""))).alias(t) for t in texts])
    nothing = F.lit(None).cast(df.select(carried.alias("c")).schema["c"].dataType)
    # The empty term stands for the row itself: it brings the other columns along.
    parts = [F.array(F.struct(F.lit(-1).alias("which"), F.lit("").alias("term"), carried.alias("row")))]

    def entries(which: int) -> Column:
        one = lambda t: F.struct(
            F.lit(which).alias("which"), t.alias("term"), nothing.alias("row")
        )
        return F.transform(terms(F.coalesce(texts[which], F.lit(""))), one)

    parts += [entries(which) for which in range(len(texts))]
    spread = df.select(*keys, F.explode(F.concat(*parts)).alias("e")).select(*keys, "e.*")
    if known.count() <= MOST_SENT:
        known = F.broadcast(known)
    entry = F.struct("term", "depths")
    grouped = (
        spread.join(known, "term")
        .groupBy(*keys)
        .agg(
            F.first("row", ignorenulls=True).alias("row"),
            *[
                F.collect_list(F.when(F.col("which") == n, entry)).alias(f"terms{n}")
                for n in range(len(texts))
            ],
        )
        .select(*keys, "row", *[F.sort_array(f"terms{n}").alias(f"terms{n}") for n in range(len(texts))])
    )

    def series(n: int) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(SERIES - 1))
        return F.transform(numbers, lambda r: at_least(F.col(f"terms{n}"), r, F.lit(1)))

    first = grouped.select(
        *keys,
        *[F.col("row")[name].alias(name) for name in others],
        *[F.col("row")[text].alias(f"md5_{n}") for n, text in enumerate(texts)],
        *[f"terms{n}" for n in range(len(texts))],
        *[series(n).alias(f"series{n}") for n in range(len(texts))],
    )
    steps = F.sequence(F.lit(1), F.lit(len(HALVINGS)))

    def hashes(n: int) -> Column:
        own = F.concat(F.lit("~"), F.substring(f"md5_{n}", 1, 8))
        whole = F.when(F.size(f"terms{n}") > 0, hash_of(F.col(f"terms{n}"))).otherwise(own)
        subsets = F.transform(
            F.col(f"series{n}"),
            lambda listed, r: F.transform(steps, lambda k: hash_of(at_least(listed, r, k))),
        )
        return F.concat(F.array(whole), F.flatten(subsets))

    return first.select(*keys, *others, *[hashes(n).alias(text) for n, text in enumerate(texts)])


def likeness(one: Column, other: Column) -> Column:
    """The share of equal hashes among those that either fingerprint has."""
    pairs = F.arrays_zip(one.alias("a"), other.alias("b"))
    some = F.size(F.filter(pairs, lambda p: (p["a"] != "") | (p["b"] != "")))
    equal = F.size(F.filter(pairs, lambda p: (p["a"] != "") & (p["a"] == p["b"])))
    return equal / some


def beside_next(documents: DataFrame) -> DataFrame:
    """Documents with the text of the next one by descending id, the first following the last.

    Ids that are null come last and equal ids are ordered by the MD5 of their texts, so rows have
    one number: id, then digits of that digest. Ranges of it are cut at counted values, an id held
    by very many rows across several ranges, and each range is given the first row of the next
    one as a `guest`, so the texts are shuffled once and no window sees more than a range.
    """
    base = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = documents.count()
    low, high = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    wide = "decimal(38,0)"
    last = (high - low + 1) if high is not None else 0
    down = F.coalesce(F.lit(high).cast(wide) - F.col("doc_id"), F.lit(str(last)).cast(wide))
    digits = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast(wide)
    placed = base.withColumn("place", (down * F.lit(str(1 << 60)).cast(wide) + digits).cast(wide))
    parts = min(RANGES * shuffle_partitions(documents.sparkSession), -(-rows // ROWS))
    ranged = placed.withColumn(
        "range", range_number(F.col("place"), splitters(placed, "place", parts))
    )
    firsts = ranged.groupBy("range").agg(F.min("place").alias("place"))
    in_order = W.orderBy("range")
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # One number per range, so at most RANGES times the shuffle partitions.
    following = firsts.select(
        F.col("range").alias("host"),
        F.coalesce(F.lead("place").over(in_order), F.first("place").over(whole)).alias("place"),
    )
    guests = (
        ranged.join(F.broadcast(following), "place")
        .dropDuplicates(["place"])
        .select("doc_id", "text", "place", F.col("host").alias("range"), F.lit(True).alias("guest"))
    )
    seats = W.partitionBy("range").orderBy("guest", "place")
    return (
        ranged.withColumn("guest", F.lit(False))
        .unionByName(guests)
        .select(
            "range",
            F.row_number().over(seats).alias("seat"),
            "guest",
            "doc_id",
            "text",
            F.lead("text").over(seats).alias("next_text"),
        )
    )


def fingerprinted(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of the text that its neighbour's beginning edits.

    In the edited text the last half of the code points is replaced by as many from the beginning
    of the next document. `fingerprint`, `edited` are lists of hashes; `near_edited` and `near_next`
    are the likeness of the first to the second and to the next document's.
    """
    n_chars = F.length("text").cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - half),
        F.substring("next_text", F.lit(1), half),
    )
    pairs = beside_next(documents).select(
        "range", "seat", "guest", "doc_id", n_chars.alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"), F.col("text").alias("fingerprint"),
        edited.alias("edited"),
    )
    found = with_fingerprints(pairs, ["range", "seat"], ["fingerprint", "edited"], lexicon(documents))
    seats = W.partitionBy("range").orderBy("seat")
    return (
        found.withColumn("next", F.lead("fingerprint").over(seats))
        .filter(~F.col("guest"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited",
            likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        )
    )
