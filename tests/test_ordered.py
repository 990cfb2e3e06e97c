"""Order statistics spread over tasks against their one-task definitions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.preprocess import hash_sample, stratified_split
from ledgerloom.operators.quantiles import column_medians, grouped_medians, spread_quantiles
from ledgerloom.operators.ranking import Tile, assign_tiles, running_totals, with_rank
from ledgerloom.params import Params
from ledgerloom.plans.rollups import attempt_counts, issuer_day, issuer_month, ticket_medians


@pytest.mark.parametrize("n,k", [(1, 5), (3, 5), (10, 10), (103, 10), (997, 7)])
def test_tiles_equal_ntile(spark, staging, n, k):
    # a third of the keys are one value, some are NULL
    df = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 11 == 0, None)
        .otherwise((F.col("id") * 37 % 101).cast("double")).alias("key"))
    got = assign_tiles(df, staging, "id", {"tile": Tile("key", k)}, partitions=4)
    want = df.select("id", F.ntile(k).over(Window.orderBy(F.col("key").asc_nulls_last(), "id")).alias("want"))
    assert got.join(want, "id").filter("tile <> want").count() == 0
    assert got.count() == n


def test_several_tiles_in_one_pass(spark, staging):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("a"),
                                 F.expr("date_add(DATE '2024-01-01', cast(id % 13 as int))").alias("d"))
    got = assign_tiles(df, staging, "id", {"x": Tile("a", 4), "y": Tile("d", 5)}, partitions=3)
    want = df.select("id", F.ntile(4).over(Window.orderBy("a", "id")).alias("wx"),
                     F.ntile(5).over(Window.orderBy("d", "id")).alias("wy"))
    assert got.join(want, "id").filter("x <> wx or y <> wy").count() == 0


def test_running_totals_with_one_group_holding_most_rows(spark, staging):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
        F.col("id").alias("k"), (F.col("id") % 9).alias("w"))
    got = running_totals(df, staging, ["g"], [F.col("k")], {"cum": F.col("w")}, partitions=8)
    run = Window.partitionBy("g").orderBy("k")
    want = df.select("k", F.sum("w").over(run).alias("want"), F.sum("w").over(Window.partitionBy("g")).alias("whole"))
    assert got.join(want, "k").filter("cum <> want or cum_all <> whole").count() == 0
    assert got.count() == 2000


def test_null_group_is_a_group(spark, staging):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, k int")
    got = {(r.g, r.k): (r.rn, r.rn_all) for r in with_rank(df, staging, ["g"], [F.col("k")], 2).collect()}
    assert got == {(None, 1): (1, 2), (None, 2): (2, 2), ("a", 3): (1, 1)}


def test_spread_quantiles_equal_numpy(spark, staging):
    rng = np.random.default_rng(3)
    values = [("hot", float(v)) for v in rng.normal(size=700)] + [("hot", 0.25)] * 500
    values += [(f"g{i % 20}", float(v)) for i, v in enumerate(rng.integers(0, 9, size=300))]
    df = spark.createDataFrame(values, "g string, v double")
    qs = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0}
    for r in spread_quantiles(df, staging, ["g"], "v", qs, partitions=6).collect():
        mine = [v for g, v in values if g == r.g]
        for name, q in qs.items():
            assert r[name] == pytest.approx(np.quantile(mine, q), abs=1e-12)


def test_medians_skip_nulls_and_allow_empty_columns(spark, staging):
    df = spark.createDataFrame([(1, 1.0, None), (1, None, None), (2, 4.0, None)], "s int, a double, b double")
    assert column_medians(df, staging, ["a", "b"]) == {"a": 2.5, "b": None}
    got = {r.s: (r.a, r.b) for r in grouped_medians(df, staging, "s", ["a", "b"]).collect()}
    assert got == {1: (1.0, None), 2: (4.0, None)}


def test_hot_merchant_month_takes_the_spread_path(spark, staging):
    rows = [("hot", 1 + i % 28, float(i * 13 % 97) / 4 + 1, "SUCCESS") for i in range(301)]
    rows += [(f"m{i % 40}", 1 + i % 28, float(i % 11) + 0.01, "SUCCESS" if i % 5 else "FAILED") for i in range(200)]
    tx = spark.createDataFrame(rows, "merchant_id string, d int, amount_inr double, status string").select(
        "merchant_id", F.lit("A").alias("issuer_bank"), "amount_inr", "status", F.lit(None).cast("string").alias("failure_reason"),
        F.make_date(F.lit(2024), F.lit(3), "d").alias("txn_date"),
        F.expr("DATE '2024-03-01'").alias("txn_month"))
    months = issuer_month(issuer_day(attempt_counts(tx)))

    def medians(limit):
        return {tuple(r) for r in ticket_medians(attempt_counts(tx), months, staging, Params(hot_group_rows=limit)).collect()}
    # Which path a group takes changes nothing: the hot group lies above, at and below these limits.
    assert medians(1_000_000) == medians(3) == medians(300) == medians(301) == medians(302)
    assert len(medians(3)) == 33   # eight of the forty never succeed


def test_median_of_an_even_group_rounds_half_up(spark, staging):
    tx = spark.createDataFrame([("m", 10.01, "SUCCESS"), ("m", 10.02, "SUCCESS")],
                               "merchant_id string, amount_inr double, status string").select(
        "*", F.lit("A").alias("issuer_bank"), F.lit(None).cast("string").alias("failure_reason"), F.expr("DATE '2024-03-05'").alias("txn_date"),
        F.expr("DATE '2024-03-01'").alias("txn_month"))
    got = ticket_medians(attempt_counts(tx), issuer_month(issuer_day(attempt_counts(tx))), staging, Params()).first()
    assert got.median_ticket_inr == 10.02


def test_stratified_split_takes_the_share_of_each_class(spark, staging):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("double").alias("y"))
    got = stratified_split(df, staging, "id", "y", 0.3, 7, partitions=5)
    counts = {r.y: r.n for r in got.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {0.0: 270, 1.0: 30}


def test_hash_sample_is_repeatable(spark):
    df = spark.range(500)
    a = [r.id for r in hash_sample(df, "id", 50, 7).collect()]
    b = [r.id for r in hash_sample(df.repartition(7), "id", 50, 7).collect()]
    assert a == b and len(set(a)) == 50
