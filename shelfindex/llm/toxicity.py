"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its lower-case words and the beginnings of longer words, each as a 32-bit
hash, present or absent. The machine learns a weight for each term and a short vector for each, whose
inner products are weights of pairs: an insult that is harmless alone and toxic beside a mention of a
group gets its weight as a pair, which additive weights cannot give. It is fitted on at most `SAMPLE`
labelled documents, as distinct sets of terms with the rows and toxic rows of each, so that copies
are one set. Terms enter if `LEAST_DOCUMENTS` of these hold them and their toxic share lies at least
`EVIDENCE` standard deviations from the whole share, either way. That is far less than it takes to
tell anything alone, but terms with less evidence stay out: given all terms, the machine learns the
rare words of single documents by heart. There is no limit to the number of terms.

The score is the logistic of the machine's output, so it lies between 0 and 1. Null and empty
texts have no terms and score the bias alone. Scores depend on the text only, so equal texts have
equal scores, ties included; ids, languages, sources and labels are never inputs. Texts are read
whole whatever their length, a document repeated in the sample counts as often as it occurs, and
repeated rows stay rows. Without labelled documents of both labels every score is the share of label
1 (0 if there are no labels); an empty table gives an empty result. Only doc_id and text are read,
so further columns and their names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import crc_remainder, kept, labelled_sample

SAMPLE = 20_000  # most labelled documents that the machine is fitted on
LEAST_DOCUMENTS = 5  # of the sample that a term must occur in
EVIDENCE = 3.5  # standard deviations of a term's toxic share
FACTORS = 8
STEPS, BATCH, RATE, DECAY = 2_500, 256, 0.03, 1e-5
DROP = 0.3  # of a document's terms at each visit: no term is learned only beside others
STARTS = (4, 5, 6)
MODULUS, HELD_OUT, CUT = 4, 2, 0.3
WORD = re.compile(r"\w+")


def terms(text: str | None) -> list[int]:
    """The distinct hashed terms of a text."""
    words = set(WORD.findall((text or "").lower()))
    starts = {f"{word[:n]}*" for n in STARTS for word in words if len(word) > n}
    return list({crc32(term.encode("utf-8", "replace")) for term in words | starts})


def term_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(terms=[terms(text) for text in batch.pop("text")])


def cut_to(known: np.ndarray):
    """Rows of term sets with each set cut to the places of its terms among the sorted `known`."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["terms"] = [
                np.searchsorted(known, found[np.isin(found, known)]).tolist()
                for found in (np.asarray(row, dtype=np.int64) for row in batch["terms"])
            ]
            yield batch

    return cut


@dataclass(frozen=True)
class Machine:
    """Weights of known terms: `hashes` is sorted; row i of `weights`, `vectors` is hash i's."""

    bias: float
    hashes: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def known(self, found: list[int]) -> np.ndarray:
        """Rows of the terms that the machine knows."""
        if not len(self.hashes) or not found:
            return np.array([], dtype=int)
        at = np.searchsorted(self.hashes, found)
        at[at == len(self.hashes)] = 0
        return at[self.hashes[at] == found]

    def output(self, rows: np.ndarray) -> float:
        vectors = self.vectors[rows]
        total = vectors.sum(axis=0)
        pairs = 0.5 * float(total @ total - (vectors * vectors).sum())
        return self.bias + float(self.weights[rows].sum()) + pairs

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.output(self.known(terms(text)))))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(
    rows: list[np.ndarray], labels: np.ndarray, size: int, counts: np.ndarray | None = None,
    seed: int = 5,
):
    """bias, weights and vectors by Adam on the logistic loss; `rows` are known terms.

    `labels` are shares of label 1 among the `counts` documents of each row.
    """
    draw = np.random.default_rng(seed)
    often = np.ones(len(rows)) if counts is None else np.asarray(counts, dtype=float)
    upto = np.cumsum(often)
    share = float(np.clip((labels * often).sum() / upto[-1], 1e-3, 1 - 1e-3))
    values = [
        np.array([np.log(share / (1 - share))]),
        np.zeros(size),
        draw.normal(0, 0.05, (size, FACTORS)),
    ]
    first, second = [[np.zeros_like(v) for v in values] for _ in range(2)]
    for step in range(1, STEPS + 1):
        batch = np.searchsorted(upto, draw.random(BATCH) * upto[-1], side="right")
        owner = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
        flat = np.concatenate([rows[i] for i in batch]).astype(int)
        stays = draw.random(len(flat)) >= DROP
        owner, flat = owner[stays], flat[stays]
        weights, vectors = values[1][flat], values[2][flat]
        total = np.zeros((len(batch), FACTORS))
        np.add.at(total, owner, vectors)
        own = np.bincount(owner, (vectors * vectors).sum(axis=1), len(batch))
        output = values[0][0] + np.bincount(owner, weights, len(batch))
        output = output + 0.5 * ((total * total).sum(axis=1) - own)
        error = (sigmoid(output) - labels[batch]) / len(batch)
        by_term = error[owner]
        slopes = [np.array([error.sum()]), DECAY * values[1], DECAY * values[2]]
        slopes[1] += np.bincount(flat, by_term, size)
        pull = by_term[:, None] * (total[owner] - vectors)
        for k in range(FACTORS):
            slopes[2][:, k] += np.bincount(flat, pull[:, k], size)
        for value, slope, m, v in zip(values, slopes, first, second, strict=True):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            lift = np.sqrt(v / (1 - 0.999**step)) + 1e-8
            value -= RATE * m / (1 - 0.9**step) / lift
    return float(values[0][0]), values[1], values[2]


def telling(sample: DataFrame, positive: float, total: int) -> DataFrame:
    """The terms whose toxic share differs from the whole share by more than chance would have it."""
    counts = (
        sample.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    )
    share = positive / total
    spread = F.sqrt(F.col("n") * (share * (1 - share)))
    return counts.filter(
        (F.col("n") >= LEAST_DOCUMENTS)
        & (F.abs(F.col("k") - F.col("n") * share) >= spread * EVIDENCE)
    ).select("term")


def learn(documents: DataFrame, labels: DataFrame) -> Machine:
    """Fit the machine on labelled documents outside the held-out remainder."""
    chosen = labelled_sample(documents, labels, "toxic", MODULUS, HELD_OUT, SAMPLE)
    sample = kept(
        chosen.select("label", "text").mapInPandas(term_rows, "label double, terms array<long>"),
        "toxic-sample",
    )
    total, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    none = np.array([], dtype=np.int64)
    if not 0 < positive < total:
        share = np.clip(positive / total if total else 0.0, 1e-9, 1 - 1e-9)
        bias = float(np.log(share / (1 - share)))
        return Machine(bias, none, np.zeros(0), np.zeros((0, FACTORS)))
    told = [row["term"] for row in telling(sample, positive, total).collect()]
    hashes = np.sort(np.array(told, dtype=np.int64))
    # At most SAMPLE sets, of the known terms alone.
    rows = (
        sample.mapInPandas(cut_to(hashes), "label double, terms array<long>")
        .groupBy("terms")
        .agg(F.count("*").alias("n"), F.sum("label").alias("k"))
        .orderBy("terms")
        .collect()
    )
    counts = np.array([row["n"] for row in rows], dtype=float)
    target = np.array([row["k"] for row in rows]) / counts
    found = [np.array(row["terms"], dtype=int) for row in rows]
    bias, weights, vectors = fit(found, target, len(hashes), counts)
    return Machine(bias, hashes, weights, vectors)


def scorer(machine: Machine):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([machine.score(text) for text in texts], dtype="float64")

    return score


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = scorer(learn(documents, labels))
    return documents.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they came."""
    return documents.filter(scorer(learn(documents, labels))("text") < CUT)
