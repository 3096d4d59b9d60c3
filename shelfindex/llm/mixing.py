"""Mixing to target weights with soft membership, in DataFrame functions only.

1. Domains are the values of a label column (`lang` by default). A naive Bayes classifier on
   hashed words is counted over at most `SAMPLE` labelled documents.
2. It gives every document posteriors, so a document whose label is missing or wrong counts for
   the domains its words speak for. The evidence of long texts is scaled to `EVIDENCE` words, as
   words of one text are not independent.
3. Rates r >= 0 are sought for which the expected tokens of each domain, the sum over documents
   of r x tokens x posterior, are the target shares of the budget. That is least squares under
   r >= 0, solved by projected gradient from r = 1: a round is one aggregation over a slim table
   that gives the domains' totals, and the next rates follow from the residuals, document by
   document. A document's rate depends on its posteriors alone, so it is computed from the list
   of residuals wherever it is needed, and nothing is stored between rounds.
4. A document is repeated floor(rate) times, and once more with the rate's fraction as chance,
   decided by the hash of its id and text.

The budget is the corpus's own number of tokens unless given. Tokens are runs of non-space
characters. Null and empty texts have no tokens; their posteriors are the priors. Domains are
those of the targets; labels outside them, and missing labels, do not train. Without labelled
documents all posteriors are equal. A domain that no document speaks for cannot reach its target;
the others do. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import kept

SAMPLE = 20_000
BUCKETS = 4_096
SMOOTHING = 0.5
EVIDENCE = 32.0
ROUNDS = 200
CLOSE = 1e-6  # of the budget, at which the totals are on target
WORD_BREAK = r"[^\p{L}]+"


def buckets(text: Column) -> Column:
    """The hashed words of a text."""
    words = F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def literal(values: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def word_counts(documents: DataFrame, label: str, domains: list[str]) -> list:
    """Words per domain and bucket over the sample: at most domains x `BUCKETS` rows."""
    labelled = documents.select(
        "doc_id", "text", F.col(label).cast("string").alias("domain")
    ).filter(F.col("domain").isin(domains) & F.col("text").isNotNull())
    chosen = (
        labelled.filter(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("chosen"))
        .distinct()
        .orderBy(F.xxhash64("chosen"), "chosen")
        .limit(SAMPLE)
    )
    sample = labelled.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi")
    return (
        sample.select("domain", F.explode(buckets(F.col("text"))).alias("bucket"))
        .groupBy("domain", "bucket")
        .count()
        .collect()
    )


def learn(documents: DataFrame, label: str, domains: list[str]) -> list[list[float]]:
    """Log likelihood of each bucket, for every domain."""
    counts = [[SMOOTHING] * BUCKETS for _ in domains]
    for row in word_counts(documents, label, domains):
        counts[domains.index(row["domain"])][row["bucket"]] += row["count"]
    sums = [math.log(sum(own)) for own in counts]
    return [[math.log(c) - whole for c in own] for own, whole in zip(counts, sums, strict=True)]


def with_shares(documents: DataFrame, model: list[list[float]]) -> DataFrame:
    """row (the document as a struct), tokens, and shares: the posteriors of the domains.

    Every step is a column of its own: an expression named in a lambda would be evaluated once
    for every element.
    """

    def evidence(own: list[float]) -> Column:
        table, size = literal(own), F.size("found")
        total = F.aggregate("found", F.lit(0.0), lambda s, b: s + F.get(table, b))
        return total * F.when(size > EVIDENCE, F.lit(EVIDENCE) / size).otherwise(F.lit(1.0))

    text = F.coalesce("text", F.lit(""))
    return (
        documents.select(
            F.struct(*[F.col(c) for c in documents.columns]).alias("row"),
            tokens(text).alias("tokens"),
            buckets(text).alias("found"),
        )
        .select("row", "tokens", F.array(*[evidence(own) for own in model]).alias("logs"))
        .select("row", "tokens", "logs", F.array_max("logs").alias("best"))
        .select(
            "row", "tokens",
            F.transform("logs", lambda x: F.exp(x - F.col("best"))).alias("odds"),
        )
        .select(
            "row", "tokens", "odds",
            F.aggregate("odds", F.lit(0.0), lambda s, x: s + x).alias("whole"),
        )
        .select("row", "tokens", F.transform("odds", lambda x: x / F.col("whole")).alias("shares"))
    )


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def rate(shares: Column, steps: list[list[float]]) -> Column:
    """The rate after all `steps`: each moves it against a residual, and it stays at 0 or above."""
    if not steps:
        return F.lit(1.0)
    rows = F.array(*[literal(step) for step in steps])

    def moved(r: Column, step: Column) -> Column:
        pull = F.aggregate(
            F.zip_with(shares, step, lambda p, s: p * s), F.lit(0.0), lambda s, x: s + x
        )
        return F.greatest(F.lit(0.0), r - pull)

    return F.aggregate(rows, F.lit(1.0), moved)


def solve(slim: DataFrame, targets: list[float], budget: float | None) -> list[list[float]]:
    """The steps of projected gradient; `slim` has tokens and shares."""
    n = len(targets)
    share = [F.col("shares")[d] for d in range(n)]
    own = [F.sum(F.col("tokens") * s) for s in share]
    curve = [F.sum(F.col("tokens") * s * s) for s in share]
    first = slim.agg(F.sum("tokens").cast("double"), *own, *curve).first()
    total = first[0] or 0.0
    if not total:
        return []
    budget = budget or total
    wanted = [t / sum(targets) * budget for t in targets]
    curves = [c or 0.0 for c in first[1 + n :]]
    have, steps = [float(x or 0.0) for x in first[1 : 1 + n]], []
    while len(steps) < ROUNDS:
        off = [h - w for h, w in zip(have, wanted, strict=True)]
        if max(abs(x) for x, c in zip(off, curves, strict=True) if c > 0) <= CLOSE * budget:
            break
        steps.append([x / c if c > 0 else 0.0 for x, c in zip(off, curves, strict=True)])
        weight = F.col("tokens") * rate(F.col("shares"), steps)
        before = have
        have = [float(x) for x in slim.agg(*[F.sum(weight * s) for s in share]).first()]
        if max(abs(a - b) for a, b in zip(have, before, strict=True)) <= 1e-9 * budget:
            break
    return steps


def chance() -> Column:
    """A number from 0 to 1 that depends on the document's id and text."""
    return F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1 << 30)) / float(1 << 30)


def fitted(documents: DataFrame, targets: Mapping[str, float], label: str, budget: float | None):
    """The classifier, the steps, and the slim table they were found on."""
    domains = sorted(targets)
    model = learn(documents, label, domains)
    slim = kept(
        with_shares(documents, model).select(
            F.col("row.doc_id").alias("doc_id"), "tokens", "shares", chance().alias("chance")
        ),
        "mixing",
    )
    return model, solve(slim, [float(targets[d]) for d in domains], budget), slim


def copies(rate_of: Column, drawn: Column) -> Column:
    whole = F.floor(rate_of)
    return (whole + (drawn < rate_of - whole).cast("long")).cast("int")


def rated(
    documents: DataFrame,
    targets: Mapping[str, float],
    label: str = "lang",
    budget: float | None = None,
) -> DataFrame:
    """doc_id, tokens, one share per domain, rate and copies of every document."""
    _, steps, slim = fitted(documents, targets, label, budget)
    return slim.select(
        "doc_id",
        "tokens",
        *[F.col("shares")[d].alias(f"share_{name}") for d, name in enumerate(sorted(targets))],
        rate(F.col("shares"), steps).alias("rate"),
        "chance",
    ).select("*", copies(F.col("rate"), F.col("chance")).alias("copies")).drop("chance")


def mixed(
    documents: DataFrame,
    targets: Mapping[str, float],
    label: str = "lang",
    budget: float | None = None,
) -> DataFrame:
    """The documents, each as often as its rate asks, with their columns as they came."""
    model, steps, _ = fitted(documents, targets, label, budget)
    often = copies(rate(F.col("shares"), steps), chance())
    return (
        with_shares(documents, model)
        .select("row", F.explode(F.array_repeat(F.lit(1), often)).alias("copy"))
        .select("row.*")
    )
