"""What drives churn: signed effects with intervals, and a boosted benchmark."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.display import strip_encoder_prefix
from ledgerloom.operators import logistic
from ledgerloom.operators.preprocess import (
    category_levels, level_index, median_imputed, one_hot, scales, standardised, stratified_split)
from ledgerloom.operators.ranking_metrics import decile_lift, ranking_metrics
from ledgerloom.params import Params
from ledgerloom.sources.staging import Staging

# The model's inputs.
NUMERIC = [
    "success_rate_3m_at_cutoff", "sr_trend", "avg_settlement_delay_days", "tickets_unresolved",
    "tickets_payment_failure", "tenure_months", "competitor_density", "avg_monthly_txns",
    "avg_monthly_tpv", "tpv_cv", "avg_ticket_inr", "p90_gap_days", "degraded_issuer_exposure",
    "avg_active_days",
]
CATEGORICAL = ["category", "city_tier", "acquisition_channel", "device_type"]


def eligible(features: DataFrame) -> DataFrame:
    """Merchants still transacting at the cutoff; the rest had already gone."""
    return features.filter(F.col("success_rate_3m_at_cutoff").isNotNull())


def model_frame(features: DataFrame, staging: Staging, params: Params) -> DataFrame:
    """Imputed inputs, outcome and the seeded split."""
    rows = eligible(features).select("merchant_id", *NUMERIC, *CATEGORICAL,
                                     F.col("churned").cast("double").alias("churned"))
    filled = median_imputed(rows, staging, NUMERIC)
    return stratified_split(filled, staging, "merchant_id", "churned", params.test_share, params.split_seed)


@dataclass
class DriverModel:
    """Both models fitted on the training rows of a staged model frame."""

    frame: DataFrame
    staging: Staging
    params: Params

    @property
    def _train(self) -> DataFrame:
        return self.frame.filter(~F.col("is_test"))

    @cached_property
    def index(self) -> DataFrame:
        return level_index(self._train, self.staging, CATEGORICAL)

    @cached_property
    def levels(self) -> dict[str, list[str]]:
        return category_levels(self.index, CATEGORICAL)

    @cached_property
    def names(self) -> list[str]:
        return [f"num__{c}" for c in NUMERIC] + [
            f"cat__{c}_{v}" for c, vs in self.levels.items() for v in vs]

    @cached_property
    def n_train(self) -> int:
        return self._train.count()

    def assembled(self, scale: bool) -> DataFrame:
        numeric = (standardised(self.frame, scales(self._train, NUMERIC), "num__") if scale
                   else [F.col(c).alias(f"num__{c}") for c in NUMERIC])
        coded = one_hot(self.frame.select("merchant_id", "churned", "is_test", *CATEGORICAL, *numeric),
                        self._train, self.index, CATEGORICAL, "_coded")
        inputs = [f"num__{c}" for c in NUMERIC] + (["_coded"] if any(self.levels.values()) else [])
        vec = VectorAssembler(inputCols=inputs, outputCol="features")
        return vec.transform(coded).select("merchant_id", "churned", "is_test", "features")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.staging.write(self.assembled(scale=True), "driver_vectors")

    @cached_property
    def logistic(self):
        return logistic.fit(self.vectors.filter(~F.col("is_test")), "churned", self.n_train,
                            self.params.inverse_penalty)

    @cached_property
    def coefficients(self) -> DataFrame:
        spark = self.frame.sparkSession
        return logistic.coefficient_table(spark, self.logistic, self.vectors.filter(~F.col("is_test")),
                                          self.names, self.params.inverse_penalty)

    @cached_property
    def scores(self) -> DataFrame:
        """Predicted churn probability of every eligible merchant, to nine decimals: beyond these a fit is not settled."""
        score = F.round(logistic.probability(self.logistic), 9).alias("score")
        out = self.vectors.select("merchant_id", "churned", "is_test", score)
        return self.staging.write(out, "driver_scores")

    @cached_property
    def boosted_scores(self) -> DataFrame:
        p = self.params
        rows = self.staging.write(self.assembled(scale=False), "boost_vectors")
        model = GBTClassifier(featuresCol="features", labelCol="churned", maxIter=p.boost_rounds,
                              stepSize=p.boost_step, maxDepth=p.boost_depth, seed=p.split_seed).fit(
            rows.filter(~F.col("is_test")))
        out = model.transform(rows).select("merchant_id", "churned", "is_test", vector_to_array("probability")[1].alias("score"))
        return self.staging.write(out, "boosted_scores")

    def metrics(self, boosted: bool = False) -> DataFrame:
        scores = self.boosted_scores if boosted else self.scores
        held = scores.filter("is_test")
        rates = scores.agg(F.count_if(~F.col("is_test")).alias("n_train"),
                           F.count_if("is_test").alias("n_test"),
                           F.round(F.avg("churned"), 4).alias("base_rate"))
        name = "boosted" if boosted else "logistic"
        quality = ranking_metrics(held, self.staging, "score", "churned").drop("n", "positives")
        return rates.crossJoin(F.broadcast(quality)).select(F.lit(name).alias("model"), "*")

    def lift(self) -> DataFrame:
        return decile_lift(self.scores.filter("is_test"), self.staging, "score", "churned")


def benchmark_gap(logistic_metrics: DataFrame, boosted_metrics: DataFrame) -> DataFrame:
    """What a non-linear model buys."""
    a = logistic_metrics.select(F.col("roc_auc").alias("logistic_auc"))
    b = boosted_metrics.select(F.col("roc_auc").alias("boosted_auc"))
    return a.crossJoin(F.broadcast(b)).withColumn(
        "auc_gap", F.round(F.col("boosted_auc") - F.col("logistic_auc"), 6))


def sign_recovery(coefficients: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Expected beside recovered sign for features someone has a prior about."""
    spark = coefficients.sparkSession
    prior = spark.createDataFrame([(f"num__{k}", k, v) for k, v in expected.items()],
                                  "feature string, name string, want int")

    def sign(positive):
        return F.when(positive, "+").otherwise("-")
    up = F.col("coef") > 0
    return coefficients.join(F.broadcast(prior), "feature").select(
        F.col("name").alias("feature"), sign(F.col("want") > 0).alias("expected_sign"),
        F.round("coef", 4).alias("recovered_coef"), sign(up).alias("recovered_sign"),
        (up == (F.col("want") > 0)).alias("sign_matches"), "significant")


def top_drivers(coefficients: DataFrame, k: int = 12, significant_only: bool = True) -> DataFrame:
    """Largest effects with the extents of their error bars."""
    rows = coefficients.filter("significant") if significant_only else coefficients
    return rows.orderBy(F.abs("coef").desc()).limit(k).select(
        strip_encoder_prefix(F.col("feature")).alias("driver"), "coef", "odds_ratio",
        (F.col("ci_high") - F.col("odds_ratio")).alias("reach_up"),
        (F.col("odds_ratio") - F.col("ci_low")).alias("reach_down"))
