"""Behavioural segments of merchants still active at the cutoff."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exact import paise, ratio
from ledgerloom.operators import clustering
from ledgerloom.operators.preprocess import log_scaled, median_imputed, scales, standardised
from ledgerloom.operators.quantiles import column_medians, grouped_medians
from ledgerloom.params import Params
from ledgerloom.plans.drivers import eligible
from ledgerloom.sources.staging import Staging

# The clustering inputs, those that are log scaled, and the profile columns.
INPUTS = [
    "recency_days", "avg_monthly_tpv", "success_rate_3m_at_cutoff", "sr_trend",
    "avg_settlement_delay_days", "tickets_unresolved", "p90_gap_days", "tenure_months",
    "tpv_cv", "degraded_issuer_exposure",
]
LOGGED = ["avg_monthly_tpv", "recency_days", "p90_gap_days"]
PROFILED = [
    "avg_monthly_tpv", "avg_monthly_txns", "success_rate_3m_at_cutoff", "sr_trend", "recency_days",
    "tenure_months", "p90_gap_days", "tickets_unresolved", "degraded_issuer_exposure",
]


def segment_inputs(features: DataFrame, staging: Staging) -> DataFrame:
    """Imputed, log-scaled, standardised inputs, one column each."""
    filled = median_imputed(eligible(features).select("merchant_id", *INPUTS), staging, INPUTS)
    logged = filled.select("merchant_id", *[log_scaled(c) if c in LOGGED else F.col(c) for c in INPUTS])
    return logged.select("merchant_id", *standardised(logged, scales(logged, INPUTS)))


def segment_name(row: dict[str, Column], medians: dict[str, float | None]) -> Column:
    """A label from how a segment compares with the population medians."""
    def than(name: str, sign: str) -> Column:
        mid = F.lit(medians[name])
        return F.coalesce(row[name] > mid if sign == ">" else row[name] < mid, F.lit(False))

    # The six names and the order in which they apply.
    big, poor = than("avg_monthly_tpv", ">"), than("success_rate_3m_at_cutoff", "<")
    falling = F.coalesce(row["sr_trend"] < 0, F.lit(False))
    stale, young = than("recency_days", ">"), than("tenure_months", "<")
    return (
        F.when(big & poor & falling, "High-value, payments-impaired")
        .when(big & ~poor, "Core healthy volume")
        .when(stale & ~big, "Fading long-tail")
        .when(young & ~stale, "New and ramping")
        .when(poor, "Low-volume, poor experience")
        .otherwise("Steady long-tail")
    )


def number_duplicates(named: DataFrame) -> DataFrame:
    """Second and later uses of a name get a number; one row per segment here."""
    nth = F.row_number().over(Window.partitionBy("segment_name").orderBy("segment_id"))
    return named.withColumn("_nth", nth).withColumn(
        "segment_name", F.when(F.col("_nth") == 1, F.col("segment_name"))
        .otherwise(F.format_string("%s (%d)", "segment_name", "_nth"))).drop("_nth")


def segment_profile(features: DataFrame, assigned: DataFrame, staging: Staging) -> DataFrame:
    """Size, medians, churn, name and share of TPV per segment."""
    rows = eligible(features).join(assigned.select("merchant_id", "segment_id"), "merchant_id")
    medians = column_medians(rows, staging, INPUTS)
    middle = grouped_medians(rows, staging, "segment_id", PROFILED)
    sizes = rows.groupBy("segment_id").agg(
        F.count("*").alias("merchants"), ratio(F.sum("churned"), F.count("churned"), 6).alias("churn_rate"),
        F.sum(paise(F.col("avg_monthly_tpv"))).alias("_tpv"))
    profile = sizes.join(middle, "segment_id")
    named = number_duplicates(profile.withColumn(
        "segment_name", segment_name({c: F.col(c) for c in PROFILED}, medians)))
    share = ratio(F.col("_tpv"), F.sum("_tpv").over(Window.partitionBy()), 4)
    return named.select("segment_id", "segment_name", "merchants", *PROFILED, "churn_rate",
                        share.alias("tpv_share"))


@dataclass
class Segmentation:
    features: DataFrame
    staging: Staging
    params: Params

    @cached_property
    def vectors(self) -> DataFrame:
        inputs = segment_inputs(self.features, self.staging)
        vec = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(inputs)
        return self.staging.write(vec.select("merchant_id", "features"), "segment_vectors")

    @cached_property
    def search(self) -> tuple[list[dict], dict[int, list[clustering.Clusters]]]:
        p = self.params
        return clustering.k_selection(self.vectors, p.k_range, p.k_restarts, p.cluster_seed)

    @property
    def selection(self) -> list[dict]:
        return self.search[0]

    @property
    def chosen_k(self) -> int:
        """Highest silhouette; the smaller k wins a tie."""
        return max(self.selection, key=lambda r: (r["silhouette"], -r["k"]))["k"]

    def k_selection(self) -> DataFrame:
        spark = self.features.sparkSession
        rows = [(r["k"], r["silhouette"], r["inertia"], r["k"] == self.chosen_k)
                for r in self.selection]
        return spark.createDataFrame(
            rows, "k int, silhouette double, inertia double, chosen boolean")

    @cached_property
    def assignment(self) -> DataFrame:
        p, k = self.params, self.chosen_k
        best = clustering.more_restarts(self.vectors, k, self.search[1][k], p.final_restarts, p.cluster_seed)
        return self.staging.write(clustering.assigned(self.vectors, best).select("merchant_id", "segment_id"), "segments")

    def profile(self) -> DataFrame:
        return segment_profile(self.features, self.assignment, self.staging)

    def plane(self) -> DataFrame:
        coords, explained = clustering.planar(self.vectors, "merchant_id")
        return coords.select("*", F.lit(explained[0]).alias("explained_1"), F.lit(explained[1]).alias("explained_2"))
