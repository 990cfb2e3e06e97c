"""Features as they were known at several dates, and a model that is judged on a later date than it learned from."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exact import ratio, rupees
from ledgerloom.operators import logistic
from ledgerloom.operators.preprocess import scales, standardised
from ledgerloom.operators.ranking_metrics import ranking_metrics
from ledgerloom.params import Params
from ledgerloom.sources.staging import Staging

INPUTS = ["recency_days", "tenure_days", "attempted_txns", "active_issuer_days", "success_rate", "success_trend", "tpv_inr"]


def cutoffs(observed: dt.date, params: Params) -> list[dt.date]:
    """Dates in ascending order, the last one early enough that its whole outcome window was observed."""
    last = observed - dt.timedelta(days=params.outcome_days)
    return [last - dt.timedelta(days=params.cutoff_step_days * i) for i in reversed(range(params.cutoffs))]


def point_in_time(days: DataFrame, dates: list[dt.date], params: Params) -> DataFrame:
    """merchant_id, cutoff, inputs and outcome of every merchant with an attempt in the window that ends at the cutoff.

    An input takes only days up to its cutoff, the outcome only days after it: churned is a merchant without a success in
    `outcome_days`. Instead of a join of days with cutoffs, which would copy every day to each later cutoff, the few
    cutoffs are conditions of one aggregate by merchant, so a day is read once and, on a table bucketed by merchant,
    nothing is shuffled. Without a success so far, recency counts from the first attempt; without attempts in the window
    before, the trend is 0.
    """
    day, tried, won = F.col("txn_date"), F.col("attempted_txns"), F.col("successful_txns")
    none, width = F.lit(0).cast("bigint"), params.prior_window_days
    aggregates, rows = [], []
    for i, cut in enumerate(dates):
        def within(lo: int, hi: int, cut: dt.date = cut):
            """Days after `lo` and up to `hi` days from the cutoff."""
            return (day > F.lit(cut + dt.timedelta(days=lo))) & (day <= F.lit(cut + dt.timedelta(days=hi)))

        def total(cond, value):
            return F.coalesce(F.sum(F.when(cond, value)), none)

        now, before, later = within(-width, 0), within(-2 * width, -width), within(0, params.outcome_days)
        past = day <= F.lit(cut)
        parts = {
            "first": F.min(F.when(past, day)), "won_at": F.max(F.when(past & (won > 0), day)),
            "tried": total(now, tried), "won": total(now, won), "cells": F.count_if(now), "tpv": total(now, F.col("tpv_paise")),
            "tried0": total(before, tried), "won0": total(before, won), "won1": total(later, won)}
        aggregates += [a.alias(f"_{name}_{i}") for name, a in parts.items()]
        c = {name: F.col(f"_{name}_{i}") for name in parts}
        rate = ratio(c["won"], c["tried"], 6)
        rows.append(F.struct(
            F.lit(cut).alias("cutoff"),
            F.datediff(F.lit(cut), F.coalesce(c["won_at"], c["first"])).cast("bigint").alias("recency_days"),
            F.datediff(F.lit(cut), c["first"]).cast("bigint").alias("tenure_days"),
            c["tried"].alias("attempted_txns"), c["cells"].alias("active_issuer_days"), rate.alias("success_rate"),
            F.coalesce(rate - ratio(c["won0"], c["tried0"], 6), F.lit(0.0)).alias("success_trend"),
            rupees(c["tpv"]).alias("tpv_inr"), (c["won1"] == 0).cast("int").alias("churned"),
            F.lit(cut == dates[-1]).alias("is_test")))
    per = days.groupBy("merchant_id").agg(*aggregates)
    return per.select("merchant_id", F.inline(F.array(*rows))).filter(F.col("attempted_txns") > 0)


def temporal_scores(frame: DataFrame, staging: Staging, params: Params) -> DataFrame:
    """merchant_id, cutoff, churned, is_test and the probability by a model of the earlier cutoffs only, its scales included."""
    train = frame.filter(~F.col("is_test"))
    wide = frame.select("merchant_id", "cutoff", F.col("churned").cast("double").alias("churned"), "is_test",
                        *standardised(frame, scales(train, INPUTS)))
    vectors = staging.write(VectorAssembler(inputCols=INPUTS, outputCol="features").transform(wide).drop(*INPUTS), "temporal_vectors")
    known = vectors.filter(~F.col("is_test"))
    model = logistic.fit(known, "churned", known.count(), params.inverse_penalty)
    return staging.write(vectors.select("merchant_id", "cutoff", "churned", "is_test",
                                        F.round(logistic.probability(model), 9).alias("score")), "temporal_scores")


def temporal_metrics(scores: DataFrame, staging: Staging) -> DataFrame:
    """One row: sizes and base rates of both sides, and the quality of the scores at the last cutoff."""
    def rate(cond):
        return F.round(F.avg(F.when(cond, F.col("churned"))), 4)

    held = F.col("is_test")
    sides = scores.agg(F.count_if(~held).alias("n_train"), F.count_if(held).alias("n_test"),
                       rate(~held).alias("train_base_rate"), rate(held).alias("test_base_rate"))
    return sides.crossJoin(F.broadcast(ranking_metrics(scores.filter(held), staging, "score", "churned").drop("n", "positives")))
