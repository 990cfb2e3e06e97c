"""Model code against direct numpy definitions."""

import itertools

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerloom.operators import clustering, logistic
from ledgerloom.operators.preprocess import category_levels, indicators, level_index, median_imputed, one_hot, scales, standardised
from ledgerloom.operators.ranking_metrics import decile_lift, quantile_bins, ranking_metrics


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    p = 1 / (1 + np.exp(-(x @ [1.2, -0.7, 0.0] - 0.5)))
    return x, (rng.random(400) < p).astype(float)


@pytest.fixture(scope="module")
def fitted(spark, sample):
    x, y = sample
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["y", "features"]).repartition(4)
    return df, logistic.fit(df, "y", len(y), 1.0)


def newton(x, y, c=1.0):
    z = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0] + [1 / c] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        hess = z.T @ (z * (p * (1 - p))[:, None]) + ridge
        w = w - np.linalg.solve(hess, z.T @ (p - y) + ridge @ w)
    return w, np.sqrt(np.diag(np.linalg.inv(hess)))


def test_logistic_is_the_penalised_optimum(sample, fitted):
    x, y = sample
    _, model = fitted
    w = np.r_[model.intercept, model.coefficients.toArray()]
    z = np.column_stack([np.ones(len(x)), x])
    grad = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.r_[0, w[1:]]
    assert np.abs(grad).max() < 1e-8
    assert np.allclose(w, newton(x, y)[0], atol=1e-9)


def test_wald_table(spark, sample, fitted):
    x, y = sample
    df, model = fitted
    w, se = newton(x, y)
    rows = {r.feature: r for r in logistic.coefficient_table(spark, model, df, ["a", "b", "c"], 1.0).collect()}
    for i, n in enumerate("abc", start=1):
        assert rows[n].coef == pytest.approx(w[i], abs=1e-5) and rows[n].std_err == pytest.approx(se[i], abs=1e-5)
        assert rows[n].odds_ratio == pytest.approx(np.exp(w[i]), rel=1e-4)
        assert rows[n].significant == (abs(w[i] / se[i]) > 1.96)


def test_ranking_metrics_by_counting_pairs(spark, staging):
    rng = np.random.default_rng(9)
    s, y = np.round(rng.random(300), 2), (rng.random(300) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    got = ranking_metrics(df, staging, "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    pairs = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])
    ap, prev = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        ap, prev = ap + (recall - prev) * precision, recall
    assert got.roc_auc == pytest.approx(pairs, abs=1e-6)
    assert got.average_precision == pytest.approx(ap, abs=1e-6)
    assert got.brier == pytest.approx(np.mean((s - y) ** 2), abs=1e-6)


def test_quantile_bins_are_right_closed_and_merge_equal_edges(spark, staging):
    df = spark.createDataFrame([(float(v),) for v in [0] * 30 + list(range(1, 21))], "s double")
    got = {r.s: r.decile for r in quantile_bins(df, staging, "s", 10).distinct().collect()}
    edges = sorted(set(np.quantile([0] * 30 + list(range(1, 21)), np.linspace(0, 1, 11))))
    for v, b in got.items():
        assert b == 1 + sum(v > e for e in edges[1:-1])


def test_lift_of_a_perfect_score(spark, staging):
    df = spark.range(100).select((F.col("id") / 100).alias("s"), (F.col("id") >= 90).cast("int").alias("y"))
    got = {r.decile: r.lift_vs_base for r in decile_lift(df, staging, "s", "y").collect()}
    assert got[10] == 10.0 and got[1] == 0.0 and len(got) == 10


@pytest.mark.parametrize("n", [40, 1700])
def test_silhouette_by_brute_force(spark, n):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1, size=(n, 4)) for c in (0, 2, 5)] + [[[9.0] * 4]])
    y = np.r_[np.repeat([0, 1, 2], n), 3]
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))],
                               "id long, x array<double>, c int")
    got = {r.id: r.silhouette for r in clustering.silhouette_points(df, "id", "x", "c").collect()}
    assert len(got) == len(x) and got[len(x) - 1] == 0.0
    for i in range(0, len(x) - 1, max(n // 20, 1)):
        d = ((x - x[i]) ** 2).sum(-1)
        a = d[y == y[i]].sum() / (np.sum(y == y[i]) - 1)
        b = min(d[y == c].mean() for c in set(y.tolist()) - {int(y[i])})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)


def test_inertia_falls_with_k(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(Vectors.dense(r),) for r in rng.normal(size=(200, 2))], ["features"])
    costs = [clustering.best_kmeans(df, k, 2, 7).summary.trainingCost for k in (2, 4, 6)]
    assert costs[0] > costs[1] > costs[2]


def test_runs_stepped_together_end_where_spark_ends_alone(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 1, size=(150, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["id", "features"]).coalesce(3).cache()
    wanted = [(3, 7), (5, 7), (5, 8)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lloyd", "all runs")
    starts = [clustering.seeded_start(df, k, s) for k, s in wanted]
    before = len(jobs.getJobIdsForGroup("lloyd"))
    found = clustering.lloyd(df, starts)
    # A pass is one job and a shuffle's job, however many runs there are.
    passed = len(jobs.getJobIdsForGroup("lloyd")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert passed <= 2 * 20
    for (k, s), got in zip(wanted, found):
        alone = clustering.KMeans(k=k, seed=s, predictionCol="segment_id").fit(df)
        assert got.cost == pytest.approx(alone.summary.trainingCost, rel=1e-9)
        assert np.allclose(got.centres, np.array(alone.clusterCenters()), atol=1e-9)
        assert alone.transform(df).select("id", "segment_id").exceptAll(clustering.assigned(df, got).select("id", "segment_id")).isEmpty()


def test_a_centre_without_rows_stays(spark):
    df = spark.createDataFrame([(Vectors.dense([0.0]),), (Vectors.dense([1.0]),)], ["features"])
    got = clustering.lloyd(df, [np.array([[0.0], [50.0]])])[0]
    assert got.centres.tolist() == [[0.5], [50.0]] and got.cost == pytest.approx(0.5)


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = [tuple(r) for r in df.select(*standardised(df, scales(df, ["a", "b"]))).collect()]
    assert sorted(got) == [(-1.0, 0.0), (1.0, 0.0)]


def test_intervals_without_the_matrix_of_pairs(spark, sample, fitted):
    df, model = fitted
    penalty = np.array([1.0, 1.0, 1.0, 0.0])
    for cells in (4, 8, 1000):
        assert np.allclose(logistic.errors_by_gradients(model, df, penalty, cells), logistic.errors_by_factor(model, df, penalty), atol=1e-7)
    wide = logistic.coefficient_table(spark, model, df, ["a", "b", "c"], 1.0, dense_width=2)
    dense = logistic.coefficient_table(spark, model, df, ["a", "b", "c"], 1.0)
    for a, b in zip(wide.collect(), dense.collect()):
        assert a.std_err == pytest.approx(b.std_err, abs=1e-7) and a.significant == b.significant


def test_intervals_of_sparse_vectors(spark):
    rng = np.random.default_rng(8)
    at, y = rng.integers(0, 12, 300), (rng.random(300) < 0.4).astype(float)
    df = spark.createDataFrame([(float(b), Vectors.sparse(12, [int(a)], [1.0])) for a, b in zip(at, y)], ["y", "features"])
    model = logistic.fit(df, "y", len(y), 1.0)
    penalty = np.append(np.ones(12), 0.0)
    assert np.allclose(logistic.errors_by_gradients(model, df, penalty, 40), logistic.errors_by_factor(model, df, penalty), atol=1e-7)


def test_indicators_drop_the_first_level_and_ignore_unknown(spark, staging):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string")
    index = level_index(df, staging, ["k"])
    levels = category_levels(index, ["k"])
    assert levels == {"k": ["b", "c"]}
    new = spark.createDataFrame([("zzz",), ("c",), ("a",), (None,)], "k string")
    assert [tuple(r) for r in new.select(*indicators(levels)).collect()] == [(0.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
    coded = one_hot(new, df, index, ["k"], "v").collect()
    assert {r.k: r.v.toArray().tolist() for r in coded} == {"zzz": [0, 0], "c": [0, 1], "a": [0, 0], None: [0, 0]}


def test_any_number_of_levels(spark, staging):
    df = spark.range(1001).select(F.format_string("%04d", "id").alias("k"), F.lit("same").alias("one"), F.col("id"))
    index = level_index(df, staging, ["k", "one"])
    assert index.count() == 1000
    coded = {r.id: r.v for r in one_hot(df, df, index, ["k", "one"], "v").collect()}
    assert len(coded) == 1001 and coded[0].numNonzeros() == 0
    assert all(v.size == 1000 and (i == 0 or v[i - 1] == 1.0) for i, v in coded.items())
    assert one_hot(df, df, level_index(df, staging, ["one"]), ["one"], "v").columns == df.columns


def test_text_that_is_not_a_number_is_imputed(spark, staging):
    df = spark.createDataFrame([("1", 1), ("x", 2), ("4", 3)], "v string, id int")
    assert [r.v for r in median_imputed(df, staging, ["v"]).orderBy("id").collect()] == [1.0, 2.5, 4.0]
