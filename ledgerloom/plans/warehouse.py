"""Named marts, what they need, and the order they are built in."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.params import Params
from ledgerloom.plans import (
    churn, cohorts, drivers, evaluation, facts, features, forecasts, issuers, revenue, rollups, temporal)
from ledgerloom.sources.staging import Staging
from ledgerloom.sources.tables import Sources


@dataclass(frozen=True)
class Mart:
    """`stage` marts are written once per warehouse; `key` is their bucket column."""

    step: str
    make: Callable[["Warehouse"], DataFrame]
    stage: bool = False
    key: str | None = None
    public: bool = True


class Warehouse:
    """Builds marts on first use and keeps them for the life of the object."""

    def __init__(self, spark: SparkSession, sources: Sources | Callable[[Staging], Sources], params: Params | None = None,
                 root: str | None = None):
        """`sources` may be made on first use, with the staging of this warehouse for what several of them share."""
        self.spark = spark
        self._sources = sources
        self.params = params or Params()
        self.staging = Staging(spark, self.params.buckets, root)
        self.folder: str | None = None
        self._built: dict[str, DataFrame] = {}
        self._held: dict[str, object] = {}

    @cached_property
    def sources(self) -> Sources:
        return self._sources if isinstance(self._sources, Sources) else self._sources(self.staging)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            mart = MARTS[name]
            df = mart.make(self)
            self._built[name] = self.staging.write(df, name, mart.key) if mart.stage else df
        return self._built[name]

    def sized(self, name: str) -> DataFrame:
        """A staged mart whose rows settle how many buckets the keyed marts made from it have."""
        self.staging.size_for(self[name].count())
        return self[name]

    def first_of(self, *names: str) -> DataFrame:
        """The first of these marts that is there already, else the last one, which is the least work to make."""
        return self[next((n for n in names if n in self._built), names[-1])]

    def once(self, name: str, make: Callable[[], object]):
        """An object such as a fitted model, made on first use."""
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    # One-row facts, collected once and used as literals so that date filters
    # reach the scan.

    @cached_property
    def observed(self) -> dt.date:
        return self["analysis_window"].first()["observation_date"]

    @cached_property
    def split(self) -> features.Split:
        return features.Split(**self["feature_split"].first().asDict())

    @cached_property
    def early_months(self) -> list[dt.date]:
        rows = issuers.first_months(self["bank_month_sr"], self.params.baseline_months).collect()
        return [r["month"] for r in rows]

    @cached_property
    def worst_issuer(self) -> str | None:
        return self["degraded_issuer"].first()["issuer_bank"]

    def build(self, only: str | None = None) -> dict[str, DataFrame]:
        """Every public mart, or those of the steps starting with `only`, as temp views.

        The schema step always comes along, because its views are session objects.
        """
        steps = [s for s in STEPS if only is None or s.startswith(only)]
        if not steps:
            raise ValueError(f"no step starts with {only!r}; steps are {', '.join(STEPS)}")
        if STEPS[0] not in steps:
            steps.insert(0, STEPS[0])
        done = {}
        for name, mart in MARTS.items():
            if mart.step in steps and mart.public:
                done[name] = self[name]
                done[name].createOrReplaceTempView(name)
        return done

    def sql(self, text: str) -> DataFrame:
        """Ad-hoc SQL over the marts it names after FROM or JOIN, bound to this warehouse whatever views the session has."""
        used = {m.lower() for m in re.findall(r"\b(?:from|join)\s+`?(\w+)`?", text, re.I)}
        named = {name: self[name] for name, mart in MARTS.items() if mart.public and name in used}
        bound = re.sub(r"(\b(?:from|join)\s+)`?(\w+)`?", lambda m: f"{m[1]}{{{m[2].lower()}}} {m[2]}" if m[2].lower() in named else m[0], text, flags=re.I)
        return self.spark.sql(bound, **named) if named else self.spark.sql(text)

    def row_counts(self) -> DataFrame:
        """Row count of every staged public mart, in one job."""
        counts = None
        for name, mart in MARTS.items():
            if mart.stage and mart.public:
                one = self[name].agg(F.count("*").alias("n_rows")).select(
                    F.lit(name).alias("table_name"), "n_rows")
                counts = one if counts is None else counts.unionByName(one)
        return counts


STEPS = ["schema", "facts", "churn", "cohorts", "incident", "features", "revenue",
         "evaluation", "drivers", "forecasts"]

MERCHANT = "merchant_id"

MARTS: dict[str, Mart] = {
    "transactions": Mart("schema", lambda w: w.sources.transactions),
    "merchants": Mart("schema", lambda w: w.sources.merchants),
    "support_tickets": Mart("schema", lambda w: w.sources.support_tickets),
    "settlements": Mart("schema", lambda w: w.sources.settlements),
    "attempt_counts": Mart("schema", lambda w: rollups.attempt_counts(w["transactions"]), stage=True, public=False),
    "issuer_day": Mart("schema", lambda w: rollups.issuer_day(w.sized("attempt_counts")),
                       stage=True, key=MERCHANT, public=False),
    "analysis_window": Mart("schema", lambda w: churn.analysis_window(w["issuer_day"])),

    "issuer_month": Mart("facts", lambda w: rollups.issuer_month(w["issuer_day"]),
                         stage=True, key=MERCHANT, public=False),
    "merchant_bank_month": Mart("facts", lambda w: facts.merchant_bank_month(w["issuer_month"])),
    "merchant_month": Mart("facts", lambda w: facts.merchant_month(
        w["issuer_month"],
        rollups.ticket_medians(w["attempt_counts"], w["issuer_month"], w.staging, w.params),
        w["support_tickets"], w["settlements"], w.staging.buckets, w.sources.one_delay), stage=True, key=MERCHANT),
    "merchant_month_dense": Mart("facts", lambda w: facts.merchant_month_dense(
        w["merchant_month"], w.observed.replace(day=1), w.params.trailing_months),
        stage=True, key=MERCHANT),

    "merchant_activity_gaps": Mart("churn", lambda w: churn.merchant_activity_gaps(w["issuer_day"]),
                                   stage=True, key=MERCHANT),
    "merchant_churn_status": Mart("churn", lambda w: churn.merchant_churn_status(
        w["merchants"], w["issuer_day"], w["merchant_activity_gaps"], w.observed, w.params),
        stage=True, key=MERCHANT),
    "churn_definition_comparison": Mart("churn", lambda w: churn.churn_definition_comparison(
        w["merchant_churn_status"])),

    "cohort_retention": Mart("cohorts", lambda w: cohorts.cohort_retention(w["merchant_month"]), stage=True),
    "cohort_m3_retention": Mart("cohorts", lambda w: cohorts.cohort_retention_at(
        w["cohort_retention"], w.params.retention_index)),
    "network_health_monthly": Mart("cohorts", lambda w: cohorts.network_health_monthly(
        w["merchant_month"], w["merchant_month_dense"]), stage=True),

    "bank_month_sr": Mart("incident", lambda w: issuers.bank_month_sr(w["merchant_bank_month"]), stage=True),
    "sr_contribution": Mart("incident", lambda w: issuers.sr_contribution(
        w["bank_month_sr"], w.params.baseline_months), stage=True),
    "incident_culprit_ranking": Mart("incident", lambda w: issuers.incident_culprit_ranking(
        w["sr_contribution"])),
    "failure_reason_mix": Mart("incident", lambda w: issuers.failure_reason_mix(w["attempt_counts"]), stage=True),
    "merchant_bank_exposure": Mart("incident", lambda w: issuers.merchant_bank_exposure(
        w["merchant_bank_month"], w.early_months), stage=True, key=MERCHANT),

    "feature_split": Mart("features", lambda w: features.feature_split(
        w["bank_month_sr"], w["analysis_window"], w.params.label_months)),
    "degraded_issuer": Mart("features", lambda w: issuers.degraded_issuer(
        issuers.incident_culprit_ranking(w["sr_contribution"].filter(F.col("month") < w.split.label_start))
        if w.params.issuer_as_of_label else w["incident_culprit_ranking"])),
    # The medians of merchant_month are no features, and all attempts are dealt anew for them.
    "feature_months": Mart("features", lambda w: facts.merchant_month(
        w["issuer_month"], None, w["support_tickets"], w["settlements"], w.staging.buckets, w.sources.one_delay)
        .filter(F.col("month") < F.lit(w.split.label_start)).select(*features.FACTS),
        stage=True, key=MERCHANT, public=False),
    "merchant_features_base": Mart("features", lambda w: features.merchant_features_base(
        w["merchants"], w.first_of("merchant_month", "feature_months"), w["issuer_day"],
        w["merchant_activity_gaps"], w["merchant_bank_exposure"], w.worst_issuer, w.split, w.params),
        stage=True, key=MERCHANT, public=False),
    # RFM scores alone need none of the other feature columns.
    "rfm_base": Mart("features", lambda w: features.rfm_base(
        w["merchants"], w["issuer_month"], w["issuer_day"], w.split, w.params), stage=True, key=MERCHANT, public=False),
    # The scores are a projection of the staged base, so they need no copy of their own.
    "merchant_features": Mart("features", lambda w: features.merchant_features(
        w["merchant_features_base"], w.staging, w.params)),
    "exposure_vs_churn": Mart("features", lambda w: features.exposure_vs_churn(features.exposure_tiles(
        w["merchant_features"], w["merchant_bank_exposure"], w.staging, w.params))),

    "revenue_params": Mart("revenue", lambda w: revenue.revenue_params(w.spark, w.params)),
    "realised_failure_loss": Mart("revenue", lambda w: revenue.realised_failure_loss(
        w["network_health_monthly"], w.params), stage=True),
    "revenue_at_risk": Mart("revenue", lambda w: revenue.revenue_at_risk(
        w["merchant_churn_status"], w["merchant_month"], w["merchant_features"], w.params), stage=True),

    "asof_status": Mart("evaluation", lambda w: evaluation.asof_status(
        w["merchants"], w["issuer_day"], w["merchant_activity_gaps"], w.observed, w.params),
        stage=True, key=MERCHANT),
    "fixed_window_sweep": Mart("evaluation", lambda w: evaluation.fixed_window_sweep(
        w["asof_status"], w.params), stage=True),
    "adaptive_sweep": Mart("evaluation", lambda w: evaluation.adaptive_sweep(
        w["asof_status"], w.params), stage=True),
    "best_rules": Mart("evaluation", lambda w: evaluation.best_rules(
        w["fixed_window_sweep"], w["adaptive_sweep"], w.params)),
    "two_tier_point": Mart("evaluation", lambda w: evaluation.two_tier_point(
        w["asof_status"], w["fixed_window_sweep"], w.params)),

    "model_frame": Mart("drivers", lambda w: drivers.model_frame(
        w["merchant_features"], w.staging, w.params), stage=True, key=MERCHANT, public=False),

    "temporal_features": Mart("features", lambda w: temporal.point_in_time(
        w["issuer_day"], temporal.cutoffs(w.observed, w.params), w.params), stage=True, key=MERCHANT, public=False),

    "issuer_series": Mart("forecasts", lambda w: forecasts.issuer_series(
        w["merchant_bank_month"], w.observed, w.params), stage=True),
    "forecast_holdout": Mart("forecasts", lambda w: forecasts.holdout_predictions(
        w["issuer_series"], w.params, partitions=w.staging.buckets), stage=True),
    "forecast_rolling": Mart("forecasts", lambda w: forecasts.rolling_predictions(
        w["issuer_series"], w.params, partitions=w.staging.buckets), stage=True, public=False),
    "forecast_errors": Mart("forecasts", lambda w: forecasts.forecast_errors(w["forecast_holdout"])),
    "forecast_projection": Mart("forecasts", lambda w: forecasts.projection(
        w["issuer_series"], forecasts.leaderboard(w["forecast_errors"]), w.params, w.staging.buckets),
        stage=True),
}
