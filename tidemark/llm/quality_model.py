"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of a text are transformed to be roughly normal. For each class, a
mean and a covariance come from sums over all labelled rows; the covariance is
shrunk towards the pooled one and that towards its diagonal. A score is the
difference of the classes' Mahalanobis log-densities, with Cholesky factors
computed once, through the logistic function.

Texts are read once, to a table of statistics in the shared folder. Sums of
products, some hundred numbers for each class, are what reaches the driver.

Defined results: a null or empty text has the statistics of no words and a score
like any other. Labels other than 0 and 1 are ignored, and so are ids whose
labels disagree. If a class has no labelled rows, every score is 0.5. Rows with
null ids are scored and not held out. Equal rows get equal scores; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, whole_text

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Shrinkage towards the pooled covariance, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.5
#: Log-density differences are divided by this: statistics of one text depend on
#: each other more than the normal model knows.
TEMPERATURE = 2.0
_LETTER_CLASS = bytes(0 if c in b" \t\n\r\x0b\x0c" else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 3 if 48 <= c <= 57 else 4 if c in b"#*$%&|<>" else 5 if c in b"!?" else 6 for c in range(256))
NAMES = ("log_words", "word_bytes", "upper", "digits", "symbols", "shouts", "marks", "distinct", "again", "dup_lines", "line_words", "longest_word", "top_word", "entropy")


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    kinds = np.bincount(np.frombuffer(raw.translate(_LETTER_CLASS), dtype=np.uint8), minlength=7)
    size = max(1, int(kinds[1:].sum()))
    counts = Counter(found)
    again = sum(map(bytes.__eq__, found, found[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / max(n, 1)
    entropy = float(-(share * np.log(share)).sum()) if n else 0.0
    part = lambda x, of, least=0.002: float(np.log(least + x / max(of, 1)))
    return [
        float(np.log1p(n)), float(np.log((size + 5) / (n + 1))), part(kinds[1], size), part(kinds[3], size), part(kinds[4], n), part(kinds[5], n), part(kinds[6], n),
        len(counts) / max(n, 1) ** 0.9 if n else 1.0, part(again, n), part(len(lines) - len(set(lines)), len(lines), 0.02), float(np.log1p(n / max(len(lines), 1))),
        float(np.log1p(max(map(len, found), default=0))), part(max(counts.values(), default=0), n, 0.01), entropy / np.log(n + 2) if n else 0.0,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the array x of every row."""
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, x array<double>")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


@dataclass(frozen=True)
class Discriminant:
    """For each class: mean, inverse Cholesky factor, and log-density constant
    with its prior."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -40, 40)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant | None:
    """From each class's number of rows, sums and sums of products."""
    if not (n > 0).all():
        return None
    means = sums / n[:, None]
    scatter = products - np.einsum("k,ki,kj->kij", n, means, means)
    pooled = scatter.sum(0) / max(n.sum() - 2, 1)
    spread = np.diag(pooled) + 1e-6
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(spread)
    factors, constants = [], []
    for k in (0, 1):
        a = max(TO_POOLED, len(spread) / (len(spread) + n[k]))
        cov = (1 - a) * scatter[k] / max(n[k] - 1, 1) + a * pooled + 1e-6 * np.diag(spread)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constants.append(float(-np.log(np.diag(low)).sum() + np.log(n[k] / n.sum())))
    return Discriminant((means[0], means[1]), (factors[0], factors[1]), (constants[0], constants[1]))


def fit(stats: DataFrame, labels: DataFrame, name: str = "quality") -> Discriminant | None:
    """The discriminant of statistics (doc_id, x) labelled by labels, without
    the held-out fold."""
    known = labels.where(F.col(name).isin(0, 1)).groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("label")).where("low = label")
    rows = stats.where(remainder(F.col("doc_id")) != HELD_OUT).join(known, "doc_id").select(F.col("label").cast("int").alias("label"), "x")
    d = len(NAMES)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, any_row = np.zeros((2, 1 + d + d * d)), False
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            any_row |= len(y) > 0
            for k in (0, 1):
                own = x[y == k]
                out[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["cell", "v"])

    cells = dict(rows.mapInArrow(total, "cell long, v double").groupBy("cell").agg(F.sum("v")).collect())
    flat = np.array([cells.get(i, 0.0) for i in range(2 * (1 + d + d * d))]).reshape(2, -1)
    return discriminant(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    stats = cut(measured(docs))
    model = fit(stats, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, len(NAMES)))
            yield pd.Series(model.score(x) if model else np.full(len(x), 0.5))

    out = stats.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold_of(doc_id: object) -> int:
    """remainder() in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
