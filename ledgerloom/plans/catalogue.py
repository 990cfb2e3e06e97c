"""Every query by name, bound to a folder of order-book tables."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.display import plain_numbers
from ledgerloom.params import Params
from ledgerloom.operators import clustering, preprocess, ranking_metrics, series, smoothing
from ledgerloom.operators.quantiles import grouped_medians
from ledgerloom.operators.ranking import Tile, assign_tiles
from ledgerloom.plans import (
    checks, churn, cohorts, drivers, evaluation, features, forecasts, issuers, reports, revenue, segments, temporal)
from ledgerloom.plans.warehouse import Warehouse
from ledgerloom.sources import orderbook, sinks
from ledgerloom.sources.tables import Sources

# The median merchant of the order book has 3 baseline attempts, so the guard
# against noisy shares is lower than the default for payment data.
ORDERBOOK = Params(min_baseline_attempts=5)

_open: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """One warehouse per application and folder: marts are built once and shared."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Warehouse(spark, lambda staging: orderbook.bind(spark, folder, staging), ORDERBOOK)
        _open[key].folder = folder
    return _open[key]


def forget() -> None:
    """Drop shared warehouses and what they staged, so that the next query builds from the sources."""
    for w in _open.values():
        for cut in w._held.values():
            if isinstance(cut, Warehouse):
                cut.staging.release()
        w.staging.release()
    _open.clear()


def driver_model(w: Warehouse) -> drivers.DriverModel:
    return w.once("driver_model", lambda: drivers.DriverModel(w["model_frame"], w.staging, w.params))


def segmentation(w: Warehouse) -> segments.Segmentation:
    return w.once("segmentation", lambda: segments.Segmentation(w["merchant_features"], w.staging, w.params))


def temporal_scores(w: Warehouse) -> DataFrame:
    return w.once("temporal_scores", lambda: temporal.temporal_scores(w["temporal_features"], w.staging, w.params))


def fixed_score(w: Warehouse) -> DataFrame:
    """A score written as a formula, so that ranking metrics can be checked exactly."""
    rows = drivers.eligible(w["merchant_features"])
    return rows.select("merchant_id", F.round(F.col("recency_days") / (F.col("recency_days") + 30.0), 6).alias("score"),
                       F.col("churned").cast("int").alias("churned"))


def given_segments(w: Warehouse) -> DataFrame:
    """Money quintiles as segment ids."""
    return w["merchant_features"].select("merchant_id", (F.col("m_score") - 1).cast("int").alias("segment_id"))


def deleted_label_window(w: Warehouse) -> DataFrame:
    """Features rebuilt from sources that end where the label window starts."""
    start = w.split.label_start
    before = F.lit(start)
    cut = Warehouse(w.spark, Sources(
        transactions=w.sources.transactions.filter(F.col("txn_date") < before),
        merchants=w.sources.merchants,
        support_tickets=w.sources.support_tickets.filter(F.col("ticket_month") < before),
        settlements=w.sources.settlements.filter(F.col("settle_month") < before),
        one_delay=w.sources.one_delay), replace(w.params, buckets=w.staging.buckets))
    # The split is where the cut was made; the degraded issuer and all else are found again.
    cut.split = w.split
    w.once("cut", lambda: cut)
    return cut["merchant_features_base"].drop("last_success_before")


def labelled_silhouette(w: Warehouse) -> DataFrame:
    points = orderbook.table(w.spark, w.folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"))
    per = clustering.silhouette_points(points, "vec_id", "x", "label")
    return per.groupBy("label").agg(F.count("*").alias("points"), F.round(F.avg("silhouette"), 5).alias("silhouette"))


def monthly_parts(w: Warehouse) -> DataFrame:
    path = f"{w.staging.root}/transactions_by_month"
    sinks.write_monthly_parts(w["transactions"], path)
    return w.spark.read.parquet(path)


def exported(w: Warehouse) -> DataFrame:
    """Rows and content of every exported mart as read back from its CSV files."""
    places = sinks.export_marts({n: w[n] for n in sinks.EXPORTED}, f"{w.staging.root}/exports")
    counts = None
    for name, path in places.items():
        back = w.spark.read.option("header", True).schema(w[name].schema).csv(path)
        one = sinks.content_digest(back).select(F.lit(name).alias("mart"), "n_rows", "content")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def csv_sample(w: Warehouse, name: str, df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows of a table as a CSV file, read back."""
    path = f"{w.staging.root}/{name}"
    sinks.write_csv(sinks.head_sample(df, n, *order), path)
    return w.spark.read.option("header", True).schema(df.schema).csv(path)


def known_outcomes(w: Warehouse) -> DataFrame:
    """A table of known outcomes: accounts overdrawn are closed, nearly empty ones dormant."""
    return orderbook.table(w.spark, w.folder, "customer").select(
        F.col("c_custkey").alias("merchant_id"), F.when(F.col("c_acctbal") < 0, 0).otherwise(-1).alias("true_churn_month_index"),
        F.col("c_acctbal").between(0, 1000).alias("dormant_at_end"))


def health_export(w: Warehouse) -> DataFrame:
    path = f"{w.staging.root}/health_csv"
    sinks.write_csv(w["network_health_monthly"].select("month", "active_merchants", "success_rate"), path)
    return w.spark.read.schema("month string, active_merchants bigint, success_rate double").option(
        "header", True).csv(path)


def manifest(w: Warehouse) -> DataFrame:
    tables = {n: orderbook.table(w.spark, w.folder, n) for n in ("customer", "lineitem", "nation", "orders", "supplier")}
    return sinks.manifest(tables)


def digests(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n_rows, content) of every part of a document that was read back."""
    rows = [sinks.content_digest(plain_numbers(df)).select(F.lit(name).alias("part"), "n_rows", "content") for name, df in parts.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def read_back(w: Warehouse, card: DataFrame, name: str) -> DataFrame:
    path = f"{w.staging.root}/{name}"
    sinks.write_json(card, path)
    return w.spark.read.schema(card.schema).json(path)


def churn_scorecard(w: Warehouse) -> DataFrame:
    """The evaluation as one nested JSON document, every part of it read back. Its parts are grids of the parameters."""
    single = {"summary": evaluation.evaluation_summary(w["asof_status"], w["fixed_window_sweep"]),
              "false_positives": evaluation.false_positive_profile(w["asof_status"], w.params)}
    many = {"rules": w["best_rules"], "tiers": w["two_tier_point"], "fixed_sweep": w["fixed_window_sweep"], "adaptive_sweep": w["adaptive_sweep"]}
    back = read_back(w, sinks.scorecard(single, many), "churn_scorecard")
    return digests({**{n: back.select(f"{n}.*") for n in single}, **{n: back.select(F.inline(n)) for n in many}})


def forecast_scorecard(w: Warehouse) -> DataFrame:
    """Winner, scores and projection of every series, one JSON line per series, read back."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        # At most the models, or the models times the months ahead.
        return df.groupBy("series").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "series"]))).alias(name))

    board = forecasts.leaderboard(w["forecast_errors"])
    card = board.join(listed(w["forecast_errors"], "scores"), "series", "left").join(listed(w["forecast_projection"], "forecast"), "series", "left")
    back = read_back(w, card, "forecast_scorecard")
    return digests({"series": back.select(*board.columns), "scores": back.select("series", F.inline("scores")),
                    "forecast": back.select("series", F.inline("forecast"))})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to the digits that a fit settles."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def driver_scorecard(w: Warehouse) -> DataFrame:
    """Model metrics, sign recovery and lift as JSON, the coefficients as CSV, every part of them read back."""
    m = driver_model(w)
    coefficients, path = rounded(m.coefficients), f"{w.staging.root}/driver_coefficients"
    sinks.write_csv(coefficients, path)
    many = {"coefficient_recovery": drivers.sign_recovery(m.coefficients, w.params.expected_signs), "decile_lift": m.lift()}
    back = read_back(w, sinks.scorecard({"logistic": m.metrics()}, many), "driver_scorecard")
    return digests({"logistic": back.select("logistic.*"), **{n: back.select(F.inline(n)) for n in many},
                    "coefficients": w.spark.read.option("header", True).schema(coefficients.schema).csv(path)})


def segment_scorecard(w: Warehouse) -> DataFrame:
    """The k search and the profile as JSON; profile and assignment as CSV."""
    s = segmentation(w)
    profile = s.profile()
    sinks.write_csv(profile, f"{w.staging.root}/segment_profile")
    sinks.write_csv(s.assignment, f"{w.staging.root}/segment_assignment")
    card = sinks.scorecard({}, {"k_selection": s.k_selection(), "segments": profile})
    return read_back(w, card, "segment_scorecard").select(
        *[F.size(c).alias(c) for c in ("k_selection", "segments")])


def top_months(w: Warehouse) -> DataFrame:
    """Each merchant's three latest months, newest first."""
    latest = Window.partitionBy("merchant_id").orderBy(F.col("month").desc())
    return w["merchant_month"].select("merchant_id", "month", "tpv_inr", F.row_number().over(latest).alias("rn")).filter(
        F.col("rn") <= 3)


Query = Callable[[Warehouse], DataFrame]

QUERIES: dict[str, Query] = {
    "transactions_typed": lambda w: w["transactions"],
    "merchants": lambda w: w["merchants"],
    "tickets_typed": lambda w: w["support_tickets"],
    "settlements_typed": lambda w: w["settlements"],
    "analysis_window": lambda w: w["analysis_window"],
    "merchant_month": lambda w: w["merchant_month"],
    "merchant_bank_month": lambda w: w["merchant_bank_month"],
    "merchant_month_dense": lambda w: w["merchant_month_dense"],
    "merchant_activity_gaps": lambda w: w["merchant_activity_gaps"],
    "gap_baseline": lambda w: churn.gap_baseline(w["merchant_activity_gaps"], w.observed, w.params),
    "last_seen": lambda w: churn.last_seen(w["issuer_day"]),
    "recent_value": lambda w: churn.recent_value(w["issuer_day"], w.observed, w.params),
    "merchant_churn_status": lambda w: w["merchant_churn_status"],
    "churn_definition_comparison": lambda w: w["churn_definition_comparison"],
    "cohort_retention": lambda w: w["cohort_retention"],
    "cohort_m3_retention": lambda w: w["cohort_m3_retention"],
    "merchant_transitions": lambda w: cohorts.merchant_transitions(w["merchant_month_dense"]),
    "network_health_monthly": lambda w: w["network_health_monthly"],
    "bank_month_sr": lambda w: w["bank_month_sr"],
    "sr_baseline": lambda w: issuers.issuer_baseline(w["bank_month_sr"], w.params.baseline_months),
    "sr_contribution": lambda w: w["sr_contribution"],
    "impact_order": lambda w: issuers.impact_order(w["sr_contribution"]),
    "incident_culprit_ranking": lambda w: w["incident_culprit_ranking"],
    "degraded_issuer": lambda w: w["degraded_issuer"],
    "failure_reason_mix": lambda w: w["failure_reason_mix"],
    "merchant_bank_exposure": lambda w: w["merchant_bank_exposure"],
    "feature_split": lambda w: w["feature_split"],
    "merchant_features": lambda w: w["merchant_features"],
    "sr_trend": lambda w: features.sr_trend(w["merchant_month"], w.split.label_start),
    "rfm_scores": lambda w: features.rfm_scored(w.first_of("merchant_features_base", "rfm_base"), w.staging, w.params).select(
        "merchant_id", "r_score", "f_score", "m_score"),
    "exposure_vs_churn": lambda w: w["exposure_vs_churn"],
    "realised_failure_loss": lambda w: w["realised_failure_loss"],
    "run_rate": lambda w: revenue.run_rate(w["merchant_month"], w.params).drop("run_rate_units"),
    "revenue_at_risk": lambda w: w["revenue_at_risk"],

    "asof_status": lambda w: w["asof_status"],
    "rule_score": lambda w: evaluation.rule_score(w["asof_status"]),
    "lifecycle_status": lambda w: evaluation.lifecycle_status(w["merchant_churn_status"], known_outcomes(w)).select(
        "merchant_id", "churn_d1_naive", "churn_d2_adaptive", "churn_d3_value_decay", "actual", "dormant"),
    "rule_score_known": lambda w: evaluation.rule_score(evaluation.lifecycle_status(w["merchant_churn_status"], known_outcomes(w))),
    "fixed_window_sweep": lambda w: w["fixed_window_sweep"],
    "adaptive_sweep": lambda w: w["adaptive_sweep"],
    "best_rules": lambda w: w["best_rules"],
    "two_tier_point": lambda w: w["two_tier_point"],
    "false_positive_profile": lambda w: evaluation.false_positive_profile(w["asof_status"], w.params),
    "rate_by_category": lambda w: evaluation.false_positive_rate_by(w["asof_status"], "category", w.params),
    "evaluation_summary": lambda w: evaluation.evaluation_summary(w["asof_status"], w["fixed_window_sweep"]),
    "rule_comparison": lambda w: evaluation.rule_comparison(w["best_rules"], w["two_tier_point"]),

    "holdout_split": lambda w: series.holdout_split(w["issuer_series"], "series", w.params.holdout_months),
    "low_sr_dummy": lambda w: w["issuer_series"].select("series", "month", "success_rate", "x"),
    "forecast_baselines": lambda w: forecasts.holdout_predictions(w["issuer_series"], w.params, "baseline"),
    "forecast_holdout": lambda w: w["forecast_holdout"],
    "forecast_errors": lambda w: w["forecast_errors"],
    "forecast_leaderboard": lambda w: forecasts.leaderboard(w["forecast_errors"]),
    "forecast_top_models": lambda w: forecasts.top_models(w["forecast_errors"]),
    "forecast_rolling_holdout": lambda w: w["forecast_rolling"],
    "forecast_coverage": lambda w: forecasts.interval_coverage(w["forecast_rolling"]),
    "forecast_rolling": lambda w: forecasts.rolling_errors(w["forecast_rolling"]),
    "forecast_rolling_leaderboard": lambda w: forecasts.leaderboard(forecasts.rolling_errors(w["forecast_rolling"])),
    "forecast_projection": lambda w: w["forecast_projection"],
    "forecast_bridge": lambda w: forecasts.forecast_bridge(w["issuer_series"], w["forecast_projection"]),
    "forecast_network": lambda w: forecasts.forecast_errors(forecasts.holdout_predictions(
        forecasts.network_series(w["network_health_monthly"], w.observed, w.params), w.params)),

    "ntile_scalable": lambda w: assign_tiles(
        w["merchant_features"].select("merchant_id", "attempted_txns"), w.staging, "merchant_id",
        {"tile": Tile("attempted_txns", 10)}),
    "first_k_months_semi": lambda w: w["bank_month_sr"].join(
        F.broadcast(issuers.first_months(w["bank_month_sr"], w.params.baseline_months)), "month", "left_semi")
        .select("month", "issuer_bank", "attempted_txns"),
    "top_k_per_merchant": top_months,
    "share_of_total": lambda w: smoothing.share_of_total(
        w["merchant_bank_month"], "issuer_bank", "attempted_value_inr", "value_share"),
    "hash_sample": lambda w: preprocess.hash_sample(w["merchants"].select("merchant_id", "category"), "merchant_id", 400, 7),
    "ewma_success_rate": lambda w: smoothing.trailing_rate(
        w["merchant_month_dense"], "success_rate", w.params.ewma_weight, "trailing_rate"),
    "median_by_segment": lambda w: grouped_medians(
        w["merchant_features"], w.staging, "m_score", ["avg_monthly_txns", "recency_days", "success_rate"]),

    "ranking_metrics": lambda w: ranking_metrics.ranking_metrics(fixed_score(w), w.staging, "score", "churned"),
    "decile_lift": lambda w: ranking_metrics.decile_lift(fixed_score(w), w.staging, "score", "churned"),
    "stratified_split": lambda w: w["model_frame"].select("merchant_id", "churned", "is_test"),
    "median_imputed": lambda w: w["model_frame"].select("merchant_id", *drivers.NUMERIC),
    "standardised_features": lambda w: segments.segment_inputs(w["merchant_features"], w.staging).select(
        "merchant_id", *[F.round(c, 5).alias(c) for c in segments.INPUTS]),
    "one_hot_features": lambda w: w["model_frame"].select("merchant_id", *preprocess.indicators(
        preprocess.category_levels(preprocess.level_index(w["model_frame"], w.staging, drivers.CATEGORICAL), drivers.CATEGORICAL))),
    "driver_coefficients": lambda w: rounded(driver_model(w).coefficients),
    "driver_metrics": lambda w: driver_model(w).metrics(),
    "driver_scores": lambda w: driver_model(w).scores,
    "driver_lift": lambda w: driver_model(w).lift(),
    "boosted_metrics": lambda w: driver_model(w).metrics(boosted=True),
    "benchmark_gap": lambda w: drivers.benchmark_gap(driver_model(w).metrics(), driver_model(w).metrics(boosted=True)),
    "sign_recovery": lambda w: drivers.sign_recovery(driver_model(w).coefficients, w.params.expected_signs),
    "top_drivers": lambda w: rounded(drivers.top_drivers(driver_model(w).coefficients)),
    "largest_effects": lambda w: rounded(drivers.top_drivers(driver_model(w).coefficients, significant_only=False)),

    "temporal_features": lambda w: w["temporal_features"],
    "temporal_scores": temporal_scores,
    "temporal_metrics": lambda w: temporal.temporal_metrics(temporal_scores(w), w.staging),

    "kmeans_k_selection": lambda w: segmentation(w).k_selection(),
    "segment_assignment": lambda w: segmentation(w).assignment,
    "segment_profile": lambda w: segmentation(w).profile(),
    "pca_2d": lambda w: segmentation(w).plane(),
    "segment_naming": lambda w: segments.segment_profile(w["merchant_features"], given_segments(w), w.staging),
    "silhouette_labelled": labelled_silhouette,

    "kpi_row": lambda w: reports.kpi_row(w["bank_month_sr"], w["network_health_monthly"],
                                         w["churn_definition_comparison"], w["revenue_at_risk"]),
    "cohort_triangle_pivot": lambda w: reports.cohort_triangle(w["cohort_retention"]),
    "flow_series": lambda w: reports.flow_series(w["network_health_monthly"]),
    "issuer_ranking": lambda w: reports.issuer_ranking(w["incident_culprit_ranking"]),
    "growth_vs_m3": lambda w: reports.growth_and_retention(w["network_health_monthly"], w["cohort_m3_retention"]),
    "issuer_month_heatmap": lambda w: reports.issuer_heatmap(w["bank_month_sr"]),
    "failure_reason_mix_for_issuer": lambda w: reports.reason_mix_of(w["failure_reason_mix"], w.worst_issuer),
    "sr_sliced_issuer": lambda w: issuers.sliced_success_rate(w["issuer_month"], w["merchants"], issuer=w.worst_issuer, city_tier="tier_1"),
    "sr_sliced": lambda w: issuers.sliced_success_rate(
        w["issuer_month"], w["merchants"], city_tier="tier_3", category="BUILDING"),
    "export_headlines": lambda w: reports.headline_metrics(w["network_health_monthly"], w.params.low_sr),

    "check_flow_identity": lambda w: checks.flow_identity(w["network_health_monthly"]),
    "check_rate_bounds": lambda w: checks.rate_bounds(w["merchant_month"]),
    "check_tpv_bound": lambda w: checks.tpv_bound(w["merchant_month"]),
    "check_no_leak": lambda w: checks.no_leak(w["merchant_features"], deleted_label_window(w)),
    "check_recency_cardinality": lambda w: checks.recency_varies(w["merchant_features"]),
    "check_exposure_sums": lambda w: checks.exposure_sums(w["merchant_bank_exposure"]),
    "check_definitions_disagree": lambda w: checks.definitions_disagree(w["churn_definition_comparison"]),
    "check_contribution_closes": lambda w: checks.contribution_closes(
        w["bank_month_sr"], w["sr_contribution"], issuers.issuer_baseline(w["bank_month_sr"], w.params.baseline_months)),

    "transactions_by_month_part": monthly_parts,
    "export_marts": exported,
    "export_health_csv": health_export,
    "manifest": manifest,
    "churn_scorecard": churn_scorecard,
    "forecast_scorecard": forecast_scorecard,
    "driver_scorecard": driver_scorecard,
    "segment_scorecard": segment_scorecard,
    "mart_row_counts": lambda w: w.row_counts(),
    "transactions_sample": lambda w: csv_sample(
        w, "transactions_sample", w["transactions"].select("merchant_id", "txn_date", "issuer_bank", "amount_inr"), 2000,
        "txn_date", "merchant_id", "issuer_bank", "amount_inr"),
    "merchants_sample": lambda w: csv_sample(
        w, "merchants_sample", w["merchants"].select("merchant_id", "category", "city_tier", "state", "gst_registered"), 500, "merchant_id"),
    "adhoc_sql": lambda w: w.sql(
        "SELECT category, count(*) AS merchants, sum(churn_d1_naive) AS silent "
        "FROM merchant_churn_status GROUP BY category"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plain_numbers(query(warehouse(spark, folder)))
    return {name: bound(q) for name, q in QUERIES.items()}
