"""Data-quality rules as one-row frames: check_name, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _named(name: str, df: DataFrame, violations: Column) -> DataFrame:
    return df.agg(violations.cast("bigint").alias("violations")).select(
        F.lit(name).alias("check_name"), "violations")


def flow_identity(health: DataFrame) -> DataFrame:
    """Net merchant adds must equal the change in the active base; one row per month."""
    change = F.col("active_merchants") - F.lag("active_merchants").over(Window.orderBy("month"))
    rows = health.select("net_merchant_adds", change.alias("change"))
    return _named("flow_identity", rows, F.count_if(F.col("net_merchant_adds") != F.col("change")))


def rate_bounds(facts: DataFrame) -> DataFrame:
    return _named("rate_bounds", facts, F.count_if(~F.col("success_rate").between(0.0, 1.0)))


def tpv_bound(facts: DataFrame) -> DataFrame:
    over = F.col("tpv_inr") > F.col("attempted_value_inr") + 0.01
    return _named("tpv_bound", facts, F.count_if(over))


def no_leak(features: DataFrame, truncated: DataFrame) -> DataFrame:
    """Feature columns must not change when everything from the label window on is deleted."""
    inputs = [c for c in truncated.columns if c not in ("churned", "r_score", "f_score", "m_score")]
    a, b = features.select(*inputs), truncated.select(*inputs)
    changed = a.exceptAll(b).unionByName(b.exceptAll(a))
    return _named("no_leak", changed, F.count("*"))


def recency_varies(features: DataFrame, at_least: int = 50) -> DataFrame:
    """A recency that is nearly constant says nothing: more than `at_least` values, however many merchants."""
    return _named("recency_varies", features, F.when(F.count_distinct("recency_days") > at_least, 0).otherwise(1))


def exposure_sums(exposure: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Shares of each merchant must add to one."""
    total = F.sum(F.rint(F.col("exposure_share") * 1e6).cast("bigint"))
    per = exposure.groupBy("merchant_id").agg(total.alias("s"))
    return _named("exposure_sums", per, F.count_if(F.abs(F.col("s") / 1e6 - 1.0) > tolerance))


def definitions_disagree(comparison: DataFrame) -> DataFrame:
    """If two rules flag equally many merchants there was nothing to compare."""
    return _named("definitions_disagree", comparison, F.count_if(F.col("d1_flagged") == F.col("d2_flagged")))


def contribution_closes(bank_month: DataFrame, contribution: DataFrame, baseline: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Every month's effects must add up to the network's change against its baseline.

    An issuer of the baseline without attempts in the month enters with share 0, so its whole effect is the mix it
    takes away; over all issuers of the baseline these sum to 0, so what is missing is minus what the present ones have.
    An issuer that the baseline lacks enters with baseline share 0. `tolerance` covers the rounding of 1e-6 of the inputs.
    """
    cells = bank_month.join(F.broadcast(baseline), "issuer_bank", "left")
    net0 = F.max(F.max("network_sr_baseline")).over(Window.partitionBy())
    old = F.coalesce(F.sum(F.col("share_baseline") * (F.col("sr_baseline") - F.col("network_sr_baseline"))), F.lit(0.0))
    new_share = F.sum(F.when(F.col("share_baseline").isNull(), F.col("volume_share")))
    new_won = F.sum(F.when(F.col("share_baseline").isNull(), F.col("volume_share") * F.col("success_rate")))
    months = cells.groupBy("month").agg(
        (F.sum("successful_txns") / F.sum("attempted_txns")).alias("sr"), old.alias("old"),
        F.coalesce(new_share, F.lit(0.0)).alias("new_share"), F.coalesce(new_won, F.lit(0.0)).alias("new_won"), net0.alias("net0"))
    effects = contribution.groupBy("month").agg(
        F.sum(F.col("rate_effect") + F.col("mix_effect") + F.col("interaction_effect")).alias("effects"))
    whole = F.col("sr") - F.col("net0")
    parts = F.coalesce("effects", F.lit(0.0)) + F.col("old") + F.col("new_won") - F.col("new_share") * F.col("net0")
    return _named("contribution_closes", months.join(effects, "month", "left"), F.count_if(F.abs(parts - whole) > tolerance))
