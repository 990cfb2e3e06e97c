"""k-means with restarts, silhouettes and a planar projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_kmeans(vectors: DataFrame, k: int, restarts: int, seed: int) -> KMeansModel:
    """The restart with the lowest within-cluster sum of squares."""
    fits = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="segment_id").fit(vectors)
            for i in range(restarts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


@dataclass(frozen=True)
class Clusters:
    """Centres of one seeded run of k-means and the within-cluster sum of squares of its last pass."""

    centres: np.ndarray
    cost: float


def seeded_start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """Spark's k-means|| start, before any step."""
    model = KMeans(k=k, seed=seed, maxIter=0, featuresCol="features", predictionCol="segment_id").fit(vectors)
    return np.array(model.clusterCenters())


def pass_sums(rows: DataFrame, runs: Sequence[np.ndarray]) -> np.ndarray:
    """One pass over the rows for any number of runs: per centre the sum and number of its rows, and their squared distances.

    A task adds its rows up to one number per cell and the cells are summed by key, so what is collected is bounded by the
    centres of all runs times the width, whatever the rows.
    """
    every, ends = np.vstack(runs), np.cumsum([len(r) for r in runs])
    width, norms = every.shape[1], (every ** 2).sum(axis=1)
    spans = [(end - len(r), end) for r, end in zip(runs, ends)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(every), width + 2))
        for b in batches:
            held = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            # As many rows at a time as keep their distances in a core's cache.
            for x in (held[i:i + 512] for i in range(0, len(held), 512)):
                far = every @ (-2.0 * x.T) + norms[:, None] + (x ** 2).sum(axis=1)
                mine = np.zeros_like(far)
                for first, end in spans:
                    mine[first + far[first:end].argmin(axis=0), np.arange(len(x))] = 1.0
                total[:, :width] += mine @ x
                total[:, width] += mine.sum(axis=1)
                total[:, width + 1] += np.einsum("ij,ij->i", mine, np.maximum(far, 0.0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    out = np.zeros((len(every), width + 2))
    for r in rows.select("x").mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[divmod(r["cell"], width + 2)] = r["v"]
    return out


def lloyd(vectors: DataFrame, starts: Sequence[np.ndarray], steps: int = 20, tol: float = 1e-4) -> list[Clusters]:
    """Runs of k-means from several starts, stepped together: a pass over the rows moves all that have not settled.

    Steps, tolerance, centres without rows (they stay) and the cost, which is that of the last pass, are those of Spark's
    estimator, so each run ends where fitting it alone would; there are as many passes as the longest run has, not as all have.
    """
    centres, costs, moving = list(starts), [0.0] * len(starts), list(range(len(starts)))
    # Plain arrays in memory go to the tasks without being made into vectors in every pass.
    rows = vectors.select(vector_to_array("features").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(steps):
        if not moving:
            break
        sums, first, left = pass_sums(rows, [centres[i] for i in moving]), 0, []
        for i in moving:
            part, first = sums[first:first + len(centres[i])], first + len(centres[i])
            n, old = part[:, -2:-1], centres[i]
            centres[i] = np.where(n > 0, part[:, :-2] / np.maximum(n, 1.0), old)
            costs[i] = float(part[:, -1].sum())
            if (((centres[i] - old) ** 2).sum(axis=1) > tol ** 2).any():
                left.append(i)
        moving = left
    rows.unpersist()
    return [Clusters(c, v) for c, v in zip(centres, costs)]


def runs_of(vectors: DataFrame, wanted: Sequence[tuple[int, int]]) -> list[Clusters]:
    """A run for each (k, seed). A start keeps its rows in memory itself, faster than it would read them from a held frame."""
    return lloyd(vectors, [seeded_start(vectors, k, seed) for k, seed in wanted])


def lowest(found: Sequence[Clusters]) -> Clusters:
    return min(found, key=lambda c: c.cost)


def assigned(vectors: DataFrame, found: Clusters, name: str = "segment_id") -> DataFrame:
    """Adds the number of the nearest centre; the smaller one wins a tie."""
    centres = F.lit(found.centres.tolist())
    far = F.transform(centres, lambda c, i: F.struct(
        F.aggregate(F.zip_with("_x", c, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda a, v: a + v).alias("d"), i.alias("i")))
    return vectors.withColumn("_x", vector_to_array("features")).withColumn(name, F.array_min(far)["i"].cast("int")).drop("_x")


def silhouette_points(points: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """Silhouette of every point by mean squared distances to its own and to the nearest other cluster.

    The mean squared distance to a cluster follows from its count, vector sum and sum of squared norms, so the work is
    linear in the points: one small aggregate with a row per cluster, and a pass over the points.
    """
    norm = F.aggregate(F.col(vector), F.lit(0.0), lambda a, v: a + v * v)
    own = points.select(ident, label, F.col(vector).alias("_x"), norm.alias("_q"))
    sums = (own.select(label, F.posexplode("_x")).groupBy(label, "pos").agg(F.sum("col").alias("v"))
            .groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("s")))
    clusters = (own.groupBy(label).agg(F.count("*").alias("n"), F.sum("_q").alias("q")).join(sums, label)
                .agg(F.collect_list(F.struct(F.col(label).alias("c"), "n", "q", "s")).alias("_clusters")))

    def reach(c: Column, others: Column) -> Column:
        dot = F.aggregate(F.zip_with("_x", c["s"], lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v)
        return (F.col("_q") * c["n"] + c["q"] - 2 * dot) / others

    met = own.crossJoin(F.broadcast(clusters)).select(
        ident, label,
        F.filter(F.transform("_clusters", lambda c: F.struct(
            (c["c"] == F.col(label)).alias("mine"), c["n"].alias("n"), reach(c, F.when(c["c"] == F.col(label), F.nullif(c["n"] - 1, F.lit(0)))
                                                                               .otherwise(c["n"])).alias("d"))), lambda c: c["d"].isNotNull()).alias("_d"))
    a = F.array_min(F.transform(F.filter("_d", lambda c: c["mine"]), lambda c: F.greatest(c["d"], F.lit(0.0))))
    b = F.array_min(F.transform(F.filter("_d", lambda c: ~c["mine"]), lambda c: F.greatest(c["d"], F.lit(0.0))))
    return met.select(ident, label, F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def k_selection(vectors: DataFrame, ks: Sequence[int], restarts: int, seed: int) -> tuple[list[dict], dict[int, list[Clusters]]]:
    """Inertia and silhouette over all rows for every k, and the runs of every k by restart."""
    every = iter(runs_of(vectors, [(k, seed + i) for k in ks for i in range(restarts)]))
    runs = {k: [next(every) for _ in range(restarts)] for k in ks}
    out = []
    for k in ks:
        best = lowest(runs[k])
        s = ClusteringEvaluator(featuresCol="features", predictionCol="segment_id").evaluate(assigned(vectors, best))
        out.append({"k": k, "silhouette": round(float(s), 4), "inertia": round(best.cost, 1)})
    return out, runs


def more_restarts(vectors: DataFrame, k: int, runs: Sequence[Clusters], restarts: int, seed: int) -> Clusters:
    """The best of the first `restarts` runs at k, of which the first `runs` are known already."""
    later = runs_of(vectors, [(k, seed + i) for i in range(len(runs), restarts)])
    return lowest([*runs[:restarts], *later])


def planar(vectors: DataFrame, ident: str) -> tuple[DataFrame, list[float]]:
    """First two principal coordinates (input already centred) and explained variance."""
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vectors)
    pc = vector_to_array("pc")
    coords = model.transform(vectors).select(ident, pc[0].alias("pc1"), pc[1].alias("pc2"))
    return coords, [float(v) for v in model.explainedVariance.toArray()]
