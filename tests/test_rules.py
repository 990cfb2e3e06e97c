"""Boundary rows of the churn, flow, issuer and revenue rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import series as S
from ledgerloom.operators.scoring import confusion
from ledgerloom.params import Params
from ledgerloom.plans import checks, churn, cohorts, evaluation, facts, features, forecasts, issuers, revenue, segments
from tests.conftest import day

OBS = dt.date(2024, 12, 31)
P = Params()


def ago(n):
    return OBS - dt.timedelta(days=n)


def status_of(make_days, make_merchants, rows, params=P):
    days = make_days(rows)
    gaps = churn.merchant_activity_gaps(days)
    ids = sorted({r[0] for r in rows})
    out = churn.merchant_churn_status(make_merchants(*ids), days, gaps, OBS, params).collect()
    return {r.merchant_id: r for r in out}


def test_silence_edges(make_days, make_merchants):
    rows = [(f"s{n}", ago(n)) for n in (29, 30, 64, 65)] + [("never", ago(40), "A", 1, 0, 0, 100)]
    got = status_of(make_days, make_merchants, rows)
    assert [got[f"s{n}"].churn_d1_naive for n in (29, 30, 64, 65)] == [0, 1, 1, 1]
    # attempts without a success leave silence unknown, so nothing is flagged
    assert got["never"].days_since_last_success is None
    assert (got["never"].churn_d1_naive, got["never"].churn_d2_adaptive) == (0, 0)


def test_merchants_without_transactions_are_not_scored(make_days, make_merchants):
    days = make_days([("a", ago(3))])
    gaps = churn.merchant_activity_gaps(days)
    got = churn.merchant_churn_status(make_merchants("a", "idle"), days, gaps, OBS, P)
    assert [r.merchant_id for r in got.collect()] == ["a"]


def regular(m, every, count, last):
    return [(m, ago(last + every * i)) for i in range(count)]


def test_adaptive_rule_needs_five_gaps(make_days, make_merchants):
    # 40 days silent; four gaps fall back to 30 days, five use 2 x p90 = 60 days
    got = status_of(make_days, make_merchants, regular("four", 30, 5, 40) + regular("five", 30, 6, 40))
    assert (got["four"].baseline_gap_count, got["four"].churn_d2_adaptive) == (4, 1)
    assert (got["five"].baseline_gap_count, got["five"].churn_d2_adaptive) == (5, 0)


def test_silence_equal_to_the_threshold_is_not_churn(make_days, make_merchants):
    got = status_of(make_days, make_merchants, regular("at", 25, 8, 50) + regular("over", 25, 8, 51))
    assert (got["at"].churn_d2_adaptive, got["over"].churn_d2_adaptive) == (0, 1)
    assert got["at"].adaptive_threshold_days == 50.0


def test_threshold_floor(make_days, make_merchants):
    got = status_of(make_days, make_merchants, regular("at", 1, 40, 35))
    assert got["at"].adaptive_threshold_days == 21.0 and got["at"].churn_d2_adaptive == 1


def test_gap_closing_on_the_window_edge_is_left_out(make_days):
    days = make_days([("a", ago(50)), ("a", ago(40)), ("a", ago(30))])
    base = churn.gap_baseline(churn.merchant_activity_gaps(days), OBS, P).first()
    assert base.baseline_gap_count == 1


def test_decay_edges(make_days, make_merchants):
    rows = [("quarter", ago(5), "A", 1, 1, 25, 25), ("quarter", ago(60), "A", 1, 1, 300, 300),
            ("below", ago(5), "A", 1, 1, 24, 24), ("below", ago(60), "A", 1, 1, 300, 300),
            ("fresh", ago(5), "A", 1, 1, 10, 10)]
    got = status_of(make_days, make_merchants, rows)
    assert (got["quarter"].tpv_run_rate_ratio, got["quarter"].churn_d3_value_decay) == (0.25, 0)
    assert got["below"].churn_d3_value_decay == 1
    assert got["fresh"].tpv_run_rate_ratio is None and got["fresh"].churn_d3_value_decay == 0


@pytest.fixture
def month_facts(spark):
    def make(rows):
        """(merchant, month number from Jan 2024, tried, won, rupees)"""
        full = [(m, dt.date(2024 + k // 12, k % 12 + 1, 1), t, w, round(w / t, 6), v, v + (t - w), float(t - w), 0, 0, None)
                for m, k, t, w, v in rows]
        return spark.createDataFrame(full, (
            "merchant_id string, month date, attempted_txns bigint, successful_txns bigint, success_rate double, "
            "tpv_inr double, attempted_value_inr double, failed_value_inr double, tickets_raised bigint, "
            "tickets_unresolved bigint, avg_settlement_delay_days double"))
    return make


def test_dense_calendar_and_trailing_rates(month_facts):
    f = month_facts([("a", 0, 4, 2, 10.0), ("a", 3, 10, 10, 30.0)])
    rows = facts.merchant_month_dense(f, dt.date(2024, 5, 1)).orderBy("month").collect()
    assert [r.was_active for r in rows] == [1, 0, 0, 1, 0]
    assert [r.tenure_months for r in rows] == [1, 2, 3, 4, 5]
    assert [r.active_months_to_date for r in rows] == [1, 1, 1, 2, 2]
    assert [r.success_rate_3m for r in rows] == [0.5, 0.5, 0.5, 1.0, 1.0]
    assert rows[1].success_rate is None and rows[1].tpv_inr == 0.0
    assert rows[1].tpv_mom_pct == -1.0 and rows[2].tpv_mom_pct is None


def test_three_silent_months_have_no_trailing_rate(month_facts):
    rows = facts.merchant_month_dense(month_facts([("a", 0, 4, 2, 10.0)]), dt.date(2024, 4, 1)).orderBy("month").collect()
    assert [r.success_rate_3m for r in rows] == [0.5, 0.5, 0.5, None]


def test_flow_edges(month_facts):
    f = month_facts([("steady", k, 1, 1, 1.0) for k in range(6)]
                    + [("nap", k, 1, 1, 1.0) for k in (0, 2, 3, 4, 5)]       # one silent month
                    + [("gone", k, 1, 1, 1.0) for k in (0, 1)]               # two silent months and more
                    + [("late", k, 1, 1, 1.0) for k in range(5)]             # silent only in the last month
                    + [("once", 3, 1, 1, 1.0)])
    dense = facts.merchant_month_dense(f, dt.date(2024, 6, 1))
    rows = cohorts.network_health_monthly(f, dense).orderBy("month").collect()
    assert [r.new_merchants for r in rows] == [4, 0, 0, 1, 0, 0]
    assert [r.reactivated_merchants for r in rows] == [0, 0, 1, 0, 0, 0]
    assert [r.went_silent_merchants for r in rows] == [0, 1, 1, 0, 1, 1]
    assert [r.churned_merchants for r in rows] == [0, 0, 1, 0, 1, 0]
    assert [r.is_censored_boundary for r in rows] == [1, 0, 0, 0, 0, 1]
    active = [r.active_merchants for r in rows]
    assert [r.net_merchant_adds for r in rows][1:] == [b - a for a, b in zip(active, active[1:])]


def test_month_index_crosses_a_year(month_facts):
    f = month_facts([("a", 10, 1, 1, 100.0), ("a", 13, 1, 1, 50.0), ("b", 10, 1, 1, 100.0)])
    rows = {r.month_index: r for r in cohorts.cohort_retention(f).collect()}
    assert set(rows) == {0, 3}
    assert (rows[3].logo_retention, rows[3].tpv_retention, rows[0].cohort_size) == (0.5, 0.25, 2)


def test_contribution_closes_and_names_the_culprit(spark):
    rows = []
    for k in range(8):
        bad = k >= 6
        rows += [("m", dt.date(2024, k + 1, 1), "BIG", 800, 400 if bad else 760, 1.0, 2.0),
                 ("m", dt.date(2024, k + 1, 1), "SMALL", 200, 100, 1.0, 2.0)]
    months = spark.createDataFrame(rows, "merchant_id string, month date, issuer_bank string, attempted_txns bigint, "
                                         "successful_txns bigint, tpv_inr double, attempted_value_inr double")
    sr = issuers.bank_month_sr(months)
    con = issuers.sr_contribution(sr, 6)
    base = issuers.issuer_baseline(sr, 6)
    assert checks.contribution_closes(sr, con, base).first().violations == 0
    # An issuer without attempts in a month, and one that the baseline lacks, still close; a wrong effect does not.
    late = spark.createDataFrame([("m", dt.date(2024, 9, 1), "NEW", 300, 30, 1.0, 2.0), ("m", dt.date(2024, 9, 1), "BIG", 700, 600, 1.0, 2.0)], months.schema)
    sr9 = issuers.bank_month_sr(months.union(late))
    con9 = issuers.sr_contribution(sr9, 6)
    assert checks.contribution_closes(sr9, con9, base).first().violations == 0
    wrong = con9.withColumn("mix_effect", F.col("mix_effect") + F.when(F.col("issuer_bank") == "BIG", 0.01).otherwise(0.0))
    assert checks.contribution_closes(sr9, wrong, base).first().violations == 9
    rank = {r.issuer_bank: r for r in issuers.incident_culprit_ranking(con).collect()}
    assert rank["SMALL"].rank_by_worst_sr == 1 and rank["BIG"].rank_by_network_impact == 1
    assert issuers.degraded_issuer(issuers.incident_culprit_ranking(con)).first().issuer_bank == "BIG"


def test_exposure_guard(spark, staging):
    def merchant(m, n):
        return (m, "A", n, 1.0)
    exposure = spark.createDataFrame([merchant("49", 49), merchant("50", 50), merchant("51", 51)],
                                     "merchant_id string, issuer_bank string, attempts_pre bigint, exposure_share double")
    feats = spark.createDataFrame([(m, 0.5, 0, "tier_3", 0.9) for m in ("49", "50", "51", "late")],
                                  "merchant_id string, degraded_issuer_exposure double, churned int, city_tier string, "
                                  "success_rate_3m_at_cutoff double")
    got = features.exposure_tiles(feats, exposure, staging, P)
    assert sorted(r.merchant_id for r in got.collect()) == ["50", "51"]


def test_status_tiers(spark):
    df = spark.createDataFrame([(29,), (30,), (64,), (65,), (None,)], "d int")
    got = [r.s for r in df.select(revenue.merchant_status(F.col("d"), P).alias("s")).collect()]
    assert got == ["active", "at_risk", "at_risk", "confirmed_churn", "active"]


def test_run_rate_uses_the_last_three_active_months(month_facts):
    f = month_facts([("a", k, 1, 1, float(v)) for k, v in [(0, 999), (1, 10), (5, 20), (9, 31)]]
                    + [("b", 0, 1, 1, 7.0)])
    got = {r.merchant_id: r for r in revenue.run_rate(f, P).collect()}
    assert got["a"].monthly_tpv_run_rate == pytest.approx(61 / 3) and got["a"].run_rate_units == 6100 * 2
    assert got["b"].run_rate_units == 700 * 6


def test_scores_read_zero_when_undefined(spark):
    df = spark.createDataFrame([("none", None, False), ("none", False, False), ("some", True, True), ("some", True, False)],
                               "g string, p boolean, a boolean")
    got = {r.g: r for r in confusion(df, ["g"], F.col("p"), F.col("a")).collect()}
    assert (got["none"].tn, got["none"].precision, got["none"].recall, got["none"].f1) == (2, 0.0, 0.0, 0.0)
    assert (got["some"].precision, got["some"].recall, got["some"].f1) == (0.5, 1.0, 0.6667)


def test_two_tier_both_branches(spark):
    def sweep(rows):
        df = spark.createDataFrame(rows, "days_since_last_success int, actual boolean")
        return evaluation.two_tier_point(df, evaluation.fixed_window_sweep(df, P), P).filter("tier = 'confirmed'").first()
    clean = sweep([(40, False)] * 5 + [(70, True)] * 20 + [(5, False)] * 5)
    assert clean.window_days == 45 and clean.precision == 1.0
    noisy = sweep([(119, False)] * 5 + [(119, True)] * 5 + [(40, False)] * 5)
    assert noisy.window_days == 45 and noisy.precision == 0.5


@pytest.fixture
def panel(spark):
    def make(values, x=None, name="s"):
        rows = [(name, dt.date(2023 + k // 12, k % 12 + 1, 1), float(v), (x or [0] * len(values))[k])
                for k, v in enumerate(values)]
        return spark.createDataFrame(rows, "series string, month date, y double, x int")
    return make


def test_seasonal_naive_needs_more_than_a_year_of_training(panel):
    def models(n):
        got = forecasts.holdout_predictions(panel(range(1, n + 1)), P, "baseline")
        return {r.model for r in got.select("model").distinct().collect()}
    assert "seasonal_naive" not in models(12 + P.holdout_months)
    assert "seasonal_naive" in models(13 + P.holdout_months)


def test_baselines_on_a_straight_line(panel):
    got = forecasts.holdout_predictions(panel(range(10, 40)), P, "baseline")
    err = {r.model: r for r in forecasts.forecast_errors(got).collect()}
    assert err["drift"].mape_pct == 0.0 and err["naive_last_value"].mae_inr == 3.0 and err["seasonal_naive"].mae_inr == 12.0
    board = forecasts.leaderboard(forecasts.forecast_errors(got)).first()
    assert board.best_model == "drift" and board.beats_naive


def test_zero_actuals_are_left_out_of_mape(panel):
    got = forecasts.forecast_errors(forecasts.holdout_predictions(panel([10.0] * 20 + [10, 0, 0, 0, 20]), P, "baseline"))
    assert {r.model: r.mape_pct for r in got.collect()}["naive_last_value"] == 25.0


def test_intervention_shift_is_removed_again(panel):
    x = [1 if 10 <= k < 14 else 0 for k in range(30)]
    y = [100.0 + 2 * k - 40 * x[k] for k in range(30)]
    got = {r.model: r for r in forecasts.forecast_errors(forecasts.holdout_predictions(panel(y, x), P)).collect()}
    assert got["arima_with_intervention"].mape_pct < got["arima"].mape_pct + 5
    assert got["holt_damped"].mape_pct < got["naive_last_value"].mape_pct


def test_projection_starts_after_the_last_month(panel):
    p = panel(range(10, 40))
    board = forecasts.leaderboard(forecasts.forecast_errors(forecasts.holdout_predictions(p, P)))
    rows = forecasts.projection(p, board, P).orderBy("step").collect()
    assert [r.month for r in rows][:2] == [dt.date(2025, 7, 1), dt.date(2025, 8, 1)] and len(rows) == P.horizon_months
    assert all(r.lo80 <= r.tpv_inr <= r.hi80 for r in rows)
    assert forecasts.forecast_bridge(p, forecasts.projection(p, board, P)).count() == P.horizon_months + 1


def test_missing_months_are_filled(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, 1), 5.0), ("s", dt.date(2024, 4, 1), 7.0)], "s string, month date, y double")
    got = S.fill_months(df, "s", ["y"], F.lit(dt.date(2024, 5, 1))).orderBy("month").collect()
    assert [r.y for r in got] == [5.0, None, None, 7.0, None]


def test_last_full_month():
    assert forecasts.last_full_month(dt.date(2024, 2, 29)) == dt.date(2024, 2, 1)
    assert forecasts.last_full_month(dt.date(2024, 2, 28)) == dt.date(2024, 1, 1)


def test_segment_names_and_duplicates(spark):
    mid = {"avg_monthly_tpv": 10.0, "success_rate_3m_at_cutoff": 0.9, "recency_days": 10.0, "tenure_months": 10.0}
    rows = [(0, 20.0, 0.8, -0.1, 5.0, 20.0), (1, 20.0, 0.95, 0.0, 5.0, 20.0), (2, 5.0, 0.95, 0.0, 20.0, 20.0),
            (3, 5.0, 0.95, 0.0, 5.0, 5.0), (4, 5.0, 0.8, 0.0, 5.0, 20.0), (5, 5.0, 0.95, 0.0, 5.0, 20.0),
            (6, 20.0, 0.96, 0.0, 5.0, 20.0)]
    cols = ["avg_monthly_tpv", "success_rate_3m_at_cutoff", "sr_trend", "recency_days", "tenure_months"]
    df = spark.createDataFrame(rows, ["segment_id", *cols])
    named = df.withColumn("segment_name", segments.segment_name({c: F.col(c) for c in cols}, mid))
    got = {r.segment_id: r.segment_name for r in segments.number_duplicates(named).collect()}
    assert got == {0: "High-value, payments-impaired", 1: "Core healthy volume", 2: "Fading long-tail",
                   3: "New and ramping", 4: "Low-volume, poor experience", 5: "Steady long-tail",
                   6: "Core healthy volume (2)"}


def test_day_helper():
    assert day(31) == dt.date(2024, 2, 1)


def test_no_leak_twin_sees_a_leak():
    """The SQL that rebuilds features from cut sources counts rows once a feature reads a month of the label window."""
    from parity import oracle
    from parity.check import connect

    con = connect("/root/testdata/sf0.001")
    sql = oracle.sql_for("check_no_leak")
    assert con.execute(sql).fetchall() == [("no_leak", 0)]
    leaky = sql.replace("FROM mm, cut WHERE mm.month < cut.l0", "FROM mm, cut WHERE mm.month <= cut.l0", 1)
    assert leaky != sql and con.execute(leaky).fetchall()[0][1] > 0
