"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import col, query, saved, table

FEATURES = (
    "log_mean_word", "log_word_spread", "upper", "digit", "symbol", "bar", "end_symbol", "repeated_words", "top_word", "echoes",
    "short_lines", "repeated_lines",
)

#: A share is taken as if a text had so many more plain characters, words and lines: short texts lean to ordinary values.
MORE_CHARS, MORE_WORDS, MORE_LINES = 120, 20, 3

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
# ASCII marks that ordinary sentences are not made of.
_SYMBOL = b"!#$%&*+/<=>@[\\]^_`{|}~"


def _share(part: float, whole: float) -> float:
    return math.sqrt(part / whole)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text: logs of lengths, square roots of shares."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m, k = len(words), len(lines)
    sizes = np.fromiter(map(len, words), np.float64, m)
    solid = int(sizes.sum())
    tally = Counter(words)
    chars, many, rows = solid + MORE_CHARS, m + MORE_WORDS, k + MORE_LINES
    without = lambda marks: len(text) - len(text.translate(None, marks))
    return [
        math.log1p(chars / many), math.log1p(float(sizes.std()) * m / many if m else 0.0),
        _share(without(_UPPER), chars), _share(without(_DIGIT), chars), _share(without(_SYMBOL), chars), _share(text.count(b"|"), chars),
        _share(sum(w[-1] in _SYMBOL for w in words), many),
        _share(m - len(tally), many), _share(max(tally.values(), default=0), many), _share(sum(map(eq, words, words[1:])), many),
        _share(sum(len(x) < 30 for x in lines), rows), _share(k - len(set(lines)), rows),
    ]


def features(text: Column) -> Column:
    """``FEATURES`` of a text as an array of doubles; null counts as empty."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        flat = [statistics(t.as_py() or b"") for t in texts.cast(pa.binary())]
        values = pa.array(np.array(flat, np.float64).reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)), values)

    return measure(text)


@dataclass
class Discriminant:
    """Two Gaussians over standardised statistics with their Cholesky factors kept."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class x feature
    factors: np.ndarray  # inverse of each class's Cholesky factor
    offsets: np.ndarray  # log prior minus half the log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of ``x``."""
        z = (x - self.center) / self.scale
        log = [o - 0.5 * np.square((z - m) @ f.T).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _solve(n: np.ndarray, first: np.ndarray, second: np.ndarray, pooled: float, ridge: float) -> Discriminant:
    """From counts, sums and sums of products per class."""
    d = first.shape[1]
    total = max(n.sum(), 1.0)
    center = first.sum(axis=0) / total
    spread = np.sqrt(np.maximum(np.diagonal(second.sum(axis=0)) / total - center**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for k in range(2):
        if n[k]:
            mean = first[k] / n[k]
            means[k] = (mean - center) / scale
            scatter[k] = (second[k] - n[k] * np.outer(mean, mean)) / np.outer(scale, scale)
    both = scatter.sum(axis=0) / total
    factors, offsets = [], []
    for k in range(2):
        own = scatter[k] / n[k] if n[k] else both
        cov = (1 - pooled) * own + pooled * both
        cov = (1 - ridge) * cov + ridge * np.eye(d) * max(np.trace(cov) / d, 1e-6)
        lower = np.linalg.cholesky((cov + cov.T) / 2 + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log((n[k] + 1) / (total + 2)) - np.log(np.diagonal(lower)).sum())
    return Discriminant(center, scale, means, np.array(factors), np.array(offsets))


def fit(labelled: DataFrame, stats: str, label: str, pooled: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """The discriminant of all rows whose ``label`` is 0 or 1; ``stats`` is an array of doubles.

    Spark sums counts, values and products per class, so only these sums reach the driver.
    Each class covariance is shrunk towards the pooled one (``pooled``) and then towards a
    multiple of the identity (``ridge``). A class without rows takes the centre and the pooled
    covariance; without any row every score is one half.
    """
    d = len(FEATURES)
    x = F.col("x")
    cross = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    rows = labelled.where(col(label).isin(0, 1)).select(col(label).cast("int").alias("k"), col(stats).alias("x"))
    sums = rows.select("k", F.posexplode(F.concat(F.array(F.lit(1.0)), x, cross))).groupBy("k", "pos").agg(F.sum("col").alias("s"))
    flat = np.zeros((2, 1 + d + d * d))
    for k, pos, s in sums.collect():  # 2 x (1 + d + d^2) rows
        flat[k, pos] = s
    return _solve(flat[:, 0], flat[:, 1 : d + 1], flat[:, d + 1 :].reshape(2, d, d), pooled, ridge)


def score(stats: Column, model: Discriminant) -> Column:
    """Probability of label 1 from an array of statistics."""

    @F.arrow_udf("double")
    def probability(values: pa.Array) -> pa.Array:
        flat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.array(model.scores(flat))

    return probability(stats)


def held_out(id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.encode(F.coalesce(id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, Discriminant]:
    """``(id, held_out, stats, score)`` for every row of ``docs``, and the model.

    The model learns from all labelled rows that are not held out; a row with several labels
    counts once for each, null labels and ids teach nothing. Null and empty texts get the
    statistics of an empty text and a score like any other. Repeated rows stay repeated.
    """
    seen = saved(docs.select(col(id).alias("id"), held_out(col(id)).alias("held_out"), features(col(text)).alias("stats")))
    marks = labels.select(col(id).alias("id"), col(label).alias("label")).where("label IN (0, 1)")
    model = fit(seen.where(~F.col("held_out")).join(marks, "id"), "stats", "label")
    return seen.withColumn("score", score(F.col("stats"), model)), model


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with the columns they came with."""
    _, model = judge(docs, labels, id, text)
    return docs.where(score(features(col(text)), model) >= least)


@query("op10_quality")
def op10_quality(spark, sf):
    """Score of every document and the decision at one half."""
    scored, _ = judge(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "quality"))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int")
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", predicted.alias("predicted"))
