"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Every text gives a short vector of statistics (`NAMES`). They are standardised, and `FEATURES`
random cosines of them approximate a Gaussian kernel. Ridge weights come from the normal
equations, whose sums each partition makes and Spark adds up; isotonic regression over the
scores' bins, counted by Spark, turns ridge scores into shares of label 1.

The model is fitted on at most `SAMPLE` labelled documents. Scores lie between 0 and 1 and depend
on the text only, so equal texts have equal scores; ids, languages, sources and labels are never
inputs. A null text is taken as empty, whose statistics are all 0. Without labelled documents
every score is 1, so that nothing is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import crc_remainder, kept, labelled_sample

SAMPLE = 50_000  # most labelled documents that the model is fitted on
FEATURES = 160
RIDGE = 1e-3
REACH = 4.0  # standard deviations beyond which statistics are held
BINS = 500
MODULUS, HELD_OUT, CUT = 5, 0, 0.3

LOWER, UPPER, LETTER, DIGIT, SPACE, BREAK, MARK, SYMBOL = range(8)
NAMES = (
    "length", "upper", "digit", "symbol", "mark", "space", "breaks", "word_length", "long_words",
    "distinct_words", "common_word", "symbol_ends", "symbol_words", "distinct_lines",
)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each character of the basic plane."""
    def kind(c: str) -> int:
        if c == "\n":
            return BREAK
        if c.isspace():
            return SPACE
        if c.islower():
            return LOWER
        if c.isupper():
            return UPPER
        if c.isalpha():
            return LETTER
        if c.isnumeric():
            return DIGIT
        return MARK if c in ".,;:'\"-()?¿¡’“”«»" else SYMBOL

    return np.array([kind(chr(n)) for n in range(1 << 16)], dtype=np.uint8)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text, in the order of `NAMES`."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds()[np.where(codes < 1 << 16, codes, 0xFFFD)]
    count = np.bincount(kind, minlength=8)
    size = len(codes)
    letters = max(1, count[LOWER] + count[UPPER] + count[LETTER])
    words = text.split()
    blank = (kind == SPACE) | (kind == BREAK)
    end = np.flatnonzero(~blank & np.append(blank[1:], True))
    begin = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    lengths = end - begin + 1
    n = max(1, len(words))
    odd = np.concatenate([[0], np.cumsum(kind == SYMBOL)])
    has_odd = odd[end + 1] > odd[begin]
    lines = [line for line in text.split("\n") if line.strip()]
    out[:] = (
        np.log1p(size), count[UPPER] / letters, count[DIGIT] / size, count[SYMBOL] / size,
        count[MARK] / size, count[SPACE] / size, count[BREAK] / size,
        lengths.mean() if len(lengths) else 0.0, (lengths > 20).sum() / n,
        len(set(words)) / n, (max(Counter(words).values()) if words else 0) / n,
        (kind[end] == SYMBOL).sum() / n, has_odd.sum() / n,
        len(set(lines)) / len(lines) if lines else 0.0,
    )
    return out


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            {"label": batch["label"], "stats": [statistics(text) for text in batch["text"]]}
        )


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([1.0]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        held = np.clip((stats - self.centre) / self.spread, -REACH, REACH)
        cosines = np.sqrt(2 / len(self.shifts)) * np.cos(held @ self.waves + self.shifts)
        return np.hstack([np.ones((len(stats), 1)), cosines])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.steps)


def isotonic(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to `values` under `counts`: pool adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, length
    for value, count in zip(values, counts, strict=True):
        blocks.append([float(value), float(count), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, weight, length = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + mean * weight) / (last[1] + weight)
            last[1], last[2] = last[1] + weight, last[2] + length
    return np.concatenate([np.full(int(length), mean) for mean, _, length in blocks])


def equations(model: Model):
    """A function for mapInPandas: a partition's normal equations, a row of the matrix each."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(model.shifts) + 1
        total = np.zeros((width, width + 1))
        for batch in batches:
            if len(batch):
                made = model.features(np.stack(batch["stats"]))
                total += made.T @ np.hstack([made, batch["label"].to_numpy()[:, None]])
        yield pd.DataFrame({"row": range(width), "sums": list(total)})

    return sums


def added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": rows["row"].iloc[:1], "sums": [np.stack(rows["sums"]).sum(axis=0)]})


def learn(documents: DataFrame, labels: DataFrame, seed: int = 3) -> Model | None:
    """Fit the model on labelled documents outside the held-out remainder; None without any."""
    chosen = labelled_sample(documents, labels, "quality", MODULUS, HELD_OUT, SAMPLE)
    sample = kept(
        chosen.select("label", "text").mapInPandas(rows_of, "label double, stats array<double>"),
        "quality-sample",
    )
    if sample.isEmpty():
        return None
    each = [F.col("stats")[i] for i in range(len(NAMES))]
    moments = sample.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    size = len(NAMES)
    spread = np.array(moments[size:], dtype=float)
    draw = np.random.default_rng(seed)
    model = Model(
        np.array(moments[:size], dtype=float),
        np.where(spread > 1e-9, spread, 1.0),
        draw.normal(0, 1 / np.sqrt(size), (size, FEATURES)),
        draw.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1),
    )
    form = "row int, sums array<double>"
    summed = sample.mapInPandas(equations(model), form).groupBy("row").applyInPandas(added, form)
    matrix = np.stack([row["sums"] for row in summed.orderBy("row").collect()])
    penalty = RIDGE * matrix[0, 0] * np.eye(FEATURES + 1)
    penalty[0, 0] = 0.0
    weights = np.linalg.solve(matrix[:, :-1] + penalty, matrix[:, -1])
    fitted = Model(model.centre, model.spread, model.waves, model.shifts, weights)

    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(fitted.raw(np.stack(stats))) if len(stats) else pd.Series([], dtype=float)

    binned = (
        sample.select("label", raw("stats").alias("raw"))
        .groupBy(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "raw")) * BINS).alias("bin"))
        .agg(F.avg("raw").alias("raw"), F.avg("label").alias("share"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()  # at most 3 x BINS + 1 rows
    )
    at, share, n = (np.array([row[c] for row in binned]) for c in ("raw", "share", "n"))
    steps = (at, isotonic(share, n))
    return Model(model.centre, model.spread, model.waves, model.shifts, weights, steps)


def scorer(model: Model | None):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.ones(len(texts)))
        return pd.Series(model.score(np.stack([statistics(text) for text in texts])))

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
    """The documents that are not predicted to be of low quality, with their columns."""
    return documents.filter(scorer(learn(documents, labels))("text") >= CUT)
