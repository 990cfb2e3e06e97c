"""Monthly TPV forecasts per issuer, always beside naive benchmarks."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exact import ratio, sum_rupees
from ledgerloom.operators import series as S
from ledgerloom.params import Params

NAIVE = "naive_last_value"
Z80 = 1.2815515655446004   # normal quantile of a two-sided 80 % interval


def last_full_month(observed: dt.date) -> dt.date:
    """The observation month counts only when it is complete."""
    if (observed + dt.timedelta(days=1)).day == 1:
        return observed.replace(day=1)
    return (observed.replace(day=1) - dt.timedelta(days=1)).replace(day=1)


def issuer_series(bank_months: DataFrame, observed: dt.date, params: Params) -> DataFrame:
    """series, month, y, success_rate, x: gap-free monthly TPV per issuer."""
    last = last_full_month(observed)
    cells = bank_months.filter(F.col("month") <= F.lit(last)).groupBy(
        F.col("issuer_bank").alias("series"), "month").agg(
        sum_rupees(F.col("tpv_inr")).alias("y"),
        ratio(F.sum("successful_txns"), F.sum("attempted_txns"), 6).alias("success_rate"))
    return _with_dummy(S.fill_months(cells, "series", ["y", "success_rate"], F.lit(last)), params)


def network_series(health: DataFrame, observed: dt.date, params: Params) -> DataFrame:
    """The whole network as one series."""
    last = last_full_month(observed)
    rows = health.filter(F.col("month") <= F.lit(last)).select(
        F.lit("network").alias("series"), "month", F.col("tpv_inr").alias("y"), "success_rate")
    return _with_dummy(S.fill_months(rows, "series", ["y", "success_rate"], F.lit(last)), params)


def _with_dummy(panel: DataFrame, params: Params) -> DataFrame:
    return panel.select(
        "series", "month", F.coalesce("y", F.lit(0.0)).alias("y"), "success_rate",
        S.low_rate_dummy(F.col("success_rate"), params.low_sr).alias("x"))


def paths(arrays: DataFrame, h: int, params: Params, models: str = "all") -> DataFrame:
    """One row per series and model with its path of h months."""
    base = S.baseline_paths(arrays, h, params.season_months)
    if models == "baseline":
        return base
    fitted = [S.holt_paths(arrays, h, params), S.arima_paths(arrays, h, params),
              S.arima_paths(arrays, h, params, intervention=True)]
    return reduce(DataFrame.unionByName, fitted, base)


def holdout_predictions(panel: DataFrame, params: Params, models: str = "all",
                        partitions: int | None = None) -> DataFrame:
    """Predicted beside actual for the held-out months."""
    h = params.holdout_months
    rows = paths(S.as_arrays(panel, "series", h, partitions=partitions), h, params, models)
    return beside_actuals(rows).drop("origin", "lo80", "hi80")


def beside_actuals(rows: DataFrame) -> DataFrame:
    return rows.select(
        "series", "model", "origin", "sigma", F.posexplode(F.arrays_zip("actuals", "path", "spread"))).select(
        "series", "model", "origin", (F.col("pos") + 1).cast("bigint").alias("step"),
        F.add_months("origin", F.col("pos") + 1).alias("month"),
        F.col("col.actuals").alias("y"), F.round("col.path", 2).alias("predicted"), *interval())


def rolling_predictions(panel: DataFrame, params: Params, partitions: int | None = None) -> DataFrame:
    """Predicted beside actual after each of the last origins that leave a whole holdout.

    Every model is fitted again at every origin on the months up to it. A series with its origins is a few short arrays, so
    origins are rows of the same fold and spread like series.
    """
    h = params.holdout_months
    return beside_actuals(paths(S.as_arrays(panel, "series", h, partitions=partitions, origins=params.rolling_origins), h, params))


def rolling_errors(predictions: DataFrame) -> DataFrame:
    """Errors of each series and model over all its origins, and how many of these it had."""
    origins = predictions.groupBy("series", "model").agg(F.count_distinct("origin").alias("origins"))
    return forecast_errors(predictions).join(origins, ["series", "model"])


def interval_coverage(predictions: DataFrame) -> DataFrame:
    """How many actual values lie inside the 80 % interval, by model and step ahead."""
    inside = F.count_if(F.col("y").between(F.col("lo80"), F.col("hi80")))
    return predictions.filter(F.col("lo80").isNotNull()).groupBy("model", "step").agg(
        F.count("*").alias("points"), inside.alias("inside"), ratio(inside, F.count("*"), 4).alias("coverage"))


def forecast_errors(predictions: DataFrame) -> DataFrame:
    """MAPE over months with a non-zero actual, and MAE, per series and model."""
    miss = F.abs(F.col("y") - F.col("predicted"))
    ape = F.round(miss / F.nullif(F.abs(F.col("y")), F.lit(0.0)), 8).cast("decimal(20,8)")
    n = F.count(ape).cast("decimal(20,0)")
    return predictions.groupBy("series", "model").agg(
        F.round(F.sum(ape) * 100 / F.nullif(n, F.lit(0).cast("decimal(20,0)")), 3).cast("double").alias("mape_pct"),
        F.round(F.sum(F.round(miss, 2).cast("decimal(28,2)")) / F.count("*").cast("decimal(20,0)"), 0)
        .cast("double").alias("mae_inr"))


def leaderboard(errors: DataFrame) -> DataFrame:
    """Best model per series, and whether it beats the last value."""
    order = F.struct(F.coalesce("mape_pct", F.lit(float("inf"))), F.col("model"))
    naive = F.max(F.when(F.col("model") == NAIVE, F.col("mape_pct")))
    best = errors.groupBy("series").agg(
        F.min_by("model", order).alias("best_model"), F.min("mape_pct").alias("best_mape_pct"),
        naive.alias("naive_mape_pct"), F.count("*").alias("models"))
    return best.withColumn("beats_naive", F.col("best_mape_pct") < F.col("naive_mape_pct"))


def top_models(errors: DataFrame, k: int = 3) -> DataFrame:
    by_error = Window.partitionBy("series").orderBy("mape_pct", "model")
    return errors.withColumn("rank", F.row_number().over(by_error)).filter(F.col("rank") <= k)


def projection(panel: DataFrame, board: DataFrame, params: Params,
               partitions: int | None = None) -> DataFrame:
    """The winning model refitted on the whole series, with an 80 % interval."""
    h = params.horizon_months
    rows = paths(S.as_arrays(panel, "series", 0, h, partitions), h, params)
    won = rows.join(board.select("series", F.col("best_model").alias("model")), ["series", "model"])
    ahead = F.col("pos") + 1
    return won.select("series", "model", "origin", "sigma", F.posexplode(F.arrays_zip("path", "spread"))).select(
        "series", "model", ahead.cast("bigint").alias("step"), F.add_months("origin", ahead).alias("month"),
        F.round("col.path", 2).alias("tpv_inr"), *interval())


def interval() -> list[Column]:
    """Bounds of a step, its error as wide as the model's moving-average form makes it."""
    half = F.lit(Z80) * F.col("sigma") * F.col("col.spread")
    return [F.round(F.col("col.path") - half, 2).alias("lo80"), F.round(F.col("col.path") + half, 2).alias("hi80")]


def forecast_bridge(panel: DataFrame, projected: DataFrame) -> DataFrame:
    """Last actual followed by the forecast, so a chart joins up."""
    newest = panel.groupBy("series").agg(F.max("month").alias("month"), F.max_by("y", "month").alias("y"))
    return newest.select("series", "month", F.col("y").alias("tpv_inr")).unionByName(
        projected.select("series", "month", "tpv_inr"))
