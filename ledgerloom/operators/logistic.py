"""Penalised logistic regression with Wald intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    """A fitted model: weights by position in the feature vector, and the intercept."""

    coefficients: DenseVector
    intercept: float


def fit(train: DataFrame, label: str, n: int, inverse_penalty: float, dense_width: int = 2000, steps: int = 6) -> Fit:
    """L2 penalty 1/C on the summed loss; the intercept is not penalised.

    Spark averages the loss over rows, hence the division by n. Its solver stops by the change of the loss, which leaves
    the weights good to some six digits; up to `dense_width` features, Newton steps from there make them good to rounding.
    """
    model = LogisticRegression(
        featuresCol="features", labelCol=label, regParam=1.0 / (inverse_penalty * n), elasticNetParam=0.0,
        standardization=False, fitIntercept=True, maxIter=2000, tol=1e-9).fit(train)
    found = Fit(DenseVector(model.coefficients.toArray()), float(model.intercept))
    width = len(found.coefficients)
    if width > dense_width or not math.isfinite(found.intercept):
        return found
    penalty = np.append(np.full(width, 1.0 / inverse_penalty), 0.0)
    for _ in range(steps):
        w = np.append(found.coefficients.toArray(), found.intercept)
        curve, slope = derivatives(found, train, penalty, label)
        try:
            move = np.linalg.solve(curve, slope + penalty * w)
        except np.linalg.LinAlgError:
            return found
        found = Fit(DenseVector((w - move)[:-1]), float((w - move)[-1]))
        if np.abs(move).max() < 1e-11:
            break
    return found


def probability(model: Fit, vector: str = "features") -> Column:
    """Probability of the outcome for a vector column."""
    weights = F.lit(model.coefficients.toArray())
    dot = F.aggregate(F.zip_with(vector_to_array(vector), weights, lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
    return 1 / (1 + F.exp(-(dot + F.lit(model.intercept))))


def scored(model: Fit, df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, probability(model))


def derivatives(model: Fit, train: DataFrame, penalty: np.ndarray, label: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Curvature of the fitted objective and slope of its unpenalised part, coefficients first and the intercept last.

    The objective is the summed log loss plus half of `penalty` times the squared coefficients, so its curvature is the
    sum of p(1-p) x x' over the rows, with the penalty on the diagonal, and the slope of the loss the sum of (p-y) x. A
    task adds its rows up to one matrix and the cells are summed by key, so only (width + 1) * width numbers are collected.
    """
    width = len(penalty)
    miss = F.col("_p") - F.col(label) if label else F.lit(0.0)
    rows = scored(model, train, "_p").select(
        vector_to_array("features").alias("x"), (F.col("_p") * (1 - F.col("_p"))).alias("w"), miss.alias("e"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width))
        for b in batches:
            if len(b):
                x = np.hstack([np.array(b["x"].tolist()), np.ones((len(b), 1))])
                total[:width] += x.T @ (x * b["w"].to_numpy()[:, None])
                total[width] += b["e"].to_numpy() @ x
        yield pd.DataFrame({"cell": np.arange(total.size), "v": total.ravel()})

    sums = rows.mapInPandas(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width + 1, width))
    for r in sums:
        out[divmod(r["cell"], width)] = r["v"]
    return out[:width] + np.diag(penalty), out[width]


def entries(batch: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the entries of a batch of vectors, each with a 1 behind for the intercept."""
    at, value = [], []
    for v in batch:
        at += [np.arange(width - 1) if v["indices"] is None else v["indices"], [width - 1]]
        value += [v["values"], [1.0]]
    sizes = [len(a) + 1 for a in at[::2]]
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(at).astype(int), np.concatenate(value)


def curved(model: Fit, train: DataFrame, penalty: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Curvature of the fitted objective times the columns of `v`, in one pass over the rows' nonzero entries."""
    width, b, across = len(penalty), np.append(model.coefficients.toArray(), model.intercept), v.shape[1]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, across))
        for batch in batches:
            if not len(batch):
                continue
            row, at, value = entries(batch["features"], width)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            p = 1 / (1 + np.exp(-np.add.reduceat(value * b[at], first)))
            dots = np.add.reduceat(value[:, None] * v[at], first) * (p * (1 - p))[:, None]
            np.add.at(total, at, value[:, None] * dots[row])
        used = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"at": used, "v": list(total[used])})

    parts = train.select("features").mapInPandas(partial, "at long, v array<double>").select("at", F.posexplode("v"))
    out = penalty[:, None] * v
    for r in parts.groupBy("at", "pos").agg(F.sum("col").alias("v")).collect():
        out[r["at"], r["pos"]] += r["v"]
    return out


def errors_by_gradients(model: Fit, train: DataFrame, penalty: np.ndarray, cells: int = 4_000_000, tol: float = 1e-9) -> np.ndarray:
    """Standard errors without the matrix of all pairs of features, by conjugate gradients on the unit vectors.

    The error of a feature is the root of its own place in the curvature's inverse. As many unit vectors are solved for
    together as make `cells` numbers, which is what the driver and a task hold; every step is one pass over the rows.
    """
    width = len(penalty)
    block = max(1, min(width, cells // width))
    out = np.empty(width)
    for start in range(0, width, block):
        here = np.arange(start, min(start + block, width))
        x = np.zeros((width, len(here)))
        rest = np.zeros_like(x)
        rest[here, np.arange(len(here))] = 1.0
        way, size = rest.copy(), np.ones(len(here))
        for _ in range(10 * width):
            moved = curved(model, train, penalty, way)
            bend = (way * moved).sum(axis=0)
            if (bend[size > tol ** 2] <= 0).any():
                raise ValueError("the curvature is singular: some features are combinations of others")
            step = np.where(bend > 0, size / np.where(bend > 0, bend, 1.0), 0.0)
            x, rest = x + step * way, rest - step * moved
            now = (rest ** 2).sum(axis=0)
            if np.sqrt(now.max()) < tol:
                break
            way, size = rest + way * np.where(size > 0, now / np.where(size > 0, size, 1.0), 0.0), now
        out[here] = np.sqrt(x[here, np.arange(len(here))])
    return out


def errors_by_factor(model: Fit, train: DataFrame, penalty: np.ndarray) -> np.ndarray:
    """Standard errors from the factored curvature.

    The covariance is the inverse L'^-1 L^-1, so a variance is the squared length of a column of L^-1.
    """
    try:
        factor = np.linalg.cholesky(derivatives(model, train, penalty)[0])
    except np.linalg.LinAlgError as e:
        raise ValueError("the curvature is singular: some features are combinations of others") from e
    return np.linalg.norm(np.linalg.solve(factor, np.eye(len(penalty))), axis=0)


def coefficient_table(spark: SparkSession, model: Fit, train: DataFrame, names: Sequence[str],
                      inverse_penalty: float, level: float = 0.95, dense_width: int = 2000) -> DataFrame:
    """feature, coef, std_err, odds ratio with its Wald interval at `level`, z, significance.

    Up to `dense_width` features the matrix of all their pairs is factored on the driver; wider models never hold it and
    get the same errors by conjugate gradients. Features that are linear combinations of others without a penalty have no
    standard error, which is said.
    """
    if inverse_penalty <= 0:
        raise ValueError("the inverse penalty must be positive")
    penalty = np.append(np.full(len(names), 1.0 / inverse_penalty), 0.0)
    errors = (errors_by_factor if len(names) <= dense_width else errors_by_gradients)(model, train, penalty)
    rows = [(name, float(c), float(e)) for name, c, e in zip(names, model.coefficients.toArray(), errors)]
    reach = NormalDist().inv_cdf(0.5 + level / 2)
    b, se = F.col("coef"), F.col("std_err")
    return spark.createDataFrame(rows, "feature string, coef double, std_err double").select(
        "feature", "coef", "std_err", F.exp(b).alias("odds_ratio"), F.exp(b - se * reach).alias("ci_low"),
        F.exp(b + se * reach).alias("ci_high"), (b / se).alias("z"), (F.abs(b / se) > reach).alias("significant"))
