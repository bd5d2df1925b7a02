"""Document quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, held_out, map_arrow, stored

STATISTICS = ["word_length", "word_spread", "short_words", "distinct_words", "runs", "distinct_lines",
              "upper", "digits", "stops", "shouts", "bars", "symbols", "ends"]
THRESHOLD = 0.7
FLOOR = 0.01
STEADY = 80           # words at which a text's own statistics weigh as much as the average of all texts
_COLUMNS = [f"s{i}" for i in range(len(STATISTICS))]


def _class(chars: bytes) -> np.ndarray:
    member = np.zeros(256)
    member[list(chars)] = 1
    return member


_KINDS = np.stack([_class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:"), _class(b"!?"), _class(b"|/\\_"),
                   _class(b"#*$%&<>@^~=+{}[]"), _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)))])


_STOPS = bytes(0x53 if c in b".,;:!?" else 0x20 if c in b" \t\n\v\f\r" else 0x78 for c in range(256))


def statistics(text: bytes) -> np.ndarray | None:
    """The number of words and the transformed statistics of a whole text: logarithms of lengths and of shares; None without a word."""
    words = text.split()
    n = len(words)
    if not n:
        return None
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    upper, digits, stops, shouts, bars, symbols, letters = _KINDS @ np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    lines = [line for line in text.split(b"\n") if line.strip()]
    shares = np.array([
        np.count_nonzero(sizes <= 3) / n, len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, len(set(lines)) / len(lines),
        upper / max(letters, 1), digits / len(text), stops / n, shouts / n, bars / n, symbols / n,
        (text + b" ").translate(_STOPS).count(b"S ") / n])
    return np.concatenate([[n, np.log(sizes.mean()), np.log(1 + sizes.std())], np.log(FLOOR + shares)])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
        nothing = [None] * (1 + len(STATISTICS))
        columns = zip(*[nothing if r is None else r for r in rows], strict=True) if rows else [[] for _ in nothing]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), pa.float64()) for c in columns], *batch.columns[2:]],
                                         names=["doc_id", "n", *_COLUMNS, *batch.schema.names[2:]])


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverted Cholesky factors of the shrunken covariances, and log constants; made once and sent to all tasks."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the difference of the log densities."""
        density = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            white = (x / self.scale - mean) @ factor.T
            density.append(constant - 0.5 * (white * white).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = 0.05, round_: float = 0.01) -> Discriminant:
    """Discriminant from each class's count, sum and sum of outer products.

    A class covariance is drawn towards the pooled one (by `pooled`, and more where the class is small) and then
    by `round_` towards a multiple of the identity, so its Cholesky factor always exists.
    """
    d = sums.shape[1]
    means = sums / counts[:, None]
    inner = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    scale = np.sqrt(np.maximum(np.diag(inner.sum(axis=0)) / counts.sum(), 1e-6))
    inner = inner / np.outer(scale, scale)
    common = inner.sum(axis=0) / counts.sum()
    factors, constants = [], []
    for n, own in zip(counts, inner, strict=True):
        to_pooled = max(pooled, d / (d + n))
        cov = (1 - to_pooled) * own / n + to_pooled * common
        cov = (1 - round_) * cov + round_ * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n / counts.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means / scale, np.stack(factors), np.array(constants), scale)


def steadied(measured: DataFrame, *more: str) -> DataFrame:
    """Statistics of short texts drawn towards the averages of all texts: few words say little."""
    mean = measured.agg(*[F.avg(c).alias(c) for c in _COLUMNS]).first()
    weight = F.col("n") / (F.col("n") + STEADY)
    return measured.select("doc_id", *[(F.lit(mean[c]).cast("double") + (F.col(c) - F.lit(mean[c]).cast("double")) * weight).alias(c) for c in _COLUMNS], *more)


def train(measured: DataFrame, labels: DataFrame) -> Discriminant | float:
    """Sums per class over all labelled documents that are not held out; a constant score where a class has none.

    A document with contradictory labels, or with none of 0 and 1, teaches nothing.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").alias("y"), F.max("quality").alias("other")).where("y = other").select("doc_id", "y")
    rows = measured.where(~held_out() & F.col("s0").isNotNull()).join(known, "doc_id")
    d = len(_COLUMNS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = {r["y"]: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"t_{c}") for c in _COLUMNS],
                                                      *[F.sum(F.col(_COLUMNS[i]) * F.col(_COLUMNS[j])).alias(f"p_{i}_{j}") for i, j in pairs]).collect()}
    if len(found) < 2:
        return float(next(iter(found), 0.5))
    products = np.zeros((2, d, d))
    for y in (0, 1):
        for i, j in pairs:
            products[y, i, j] = products[y, j, i] = found[y][f"p_{i}_{j}"]
    return fit(np.array([float(found[y]["n"]) for y in (0, 1)]), np.array([[found[y][f"t_{c}"] for c in _COLUMNS] for y in (0, 1)]), products)


def _scorer(model: Discriminant | float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:2 + len(_COLUMNS)]], axis=1)
            some = ~np.isnan(x[:, 0])
            scores = np.zeros(len(x))
            if some.any():
                scores[some] = model if isinstance(model, float) else model.score(x[some])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)),
                                              *batch.columns[2 + len(_COLUMNS):]],
                                             names=["doc_id", "held_out", "score", "predicted", *batch.schema.names[2 + len(_COLUMNS):]])
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score (0 to 1), predicted (score >= 0.7), and the columns `more`.

    Texts are read once, whole; labels are learned only from documents that are not held out. Texts without a
    word (null, empty, blank) score 0. With labels of one class only, that class is the score of all others; without
    any it is 0.5. Repeated rows score alike.
    """
    rows = columns_of(docs, "doc_id", "text", *more).select(F.col("doc_id").cast("bigint"), "text", *more)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in more]
    measured = map_arrow(rows, _measure, ", ".join(["doc_id bigint, n double", *[f"{c} double" for c in _COLUMNS], *kinds]))
    measured = steadied(stored(measured, "statistics"), *more)
    model = train(measured, columns_of(labels, "doc_id", "quality"))
    return map_arrow(measured.select("doc_id", held_out().alias("held_out"), *_COLUMNS, *more), _scorer(model),
                     ", ".join(["doc_id bigint, held_out boolean, score double, predicted int", *kinds]))
