"""Features as of several dates and rolling origins: nothing after a date may be seen at that date."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import series as S
from ledgerloom.params import Params
from ledgerloom.plans import forecasts, temporal
from tests.conftest import day

P = Params(cutoffs=3, cutoff_step_days=40, outcome_days=30, prior_window_days=30)
LAST = day(400)
DATES = temporal.cutoffs(LAST, P)


@pytest.fixture
def days(make_days):
    rng = np.random.default_rng(11)
    rows = [(f"m{m}", day(int(d)), "AB"[int(i)], 2, int(w), 100 * int(w), 300)
            for m in range(25) for d, i, w in zip(rng.integers(150, 401, 12), rng.integers(0, 2, 12), rng.integers(0, 3, 12))]
    return make_days(sorted(set(rows), key=repr)).dropDuplicates(["merchant_id", "txn_date", "issuer_bank"]).cache()


def as_of(rows, cut):
    """Inputs and outcome of every merchant at one date, row by row."""
    out = {}
    for m in {r.merchant_id for r in rows}:
        mine = [r for r in rows if r.merchant_id == m]
        past = [r for r in mine if r.txn_date <= cut]
        now = [r for r in past if r.txn_date > cut - dt.timedelta(days=30)]
        before = [r for r in past if cut - dt.timedelta(days=60) < r.txn_date <= cut - dt.timedelta(days=30)]
        if not now:
            continue
        won = [r.txn_date for r in past if r.successful_txns]

        def rate(part):
            tried = sum(r.attempted_txns for r in part)
            return sum(r.successful_txns for r in part) / tried if tried else None
        out[m] = ((cut - max(won or [min(r.txn_date for r in past)])).days, (cut - min(r.txn_date for r in past)).days,
                  sum(r.attempted_txns for r in now), len(now), pytest.approx(rate(now), abs=1e-6),
                  pytest.approx(0 if rate(before) is None else rate(now) - rate(before), abs=2e-6),
                  sum(r.tpv_paise or 0 for r in now) / 100,
                  int(not any(r.successful_txns for r in mine if cut < r.txn_date <= cut + dt.timedelta(days=30))))
    return out


def test_cutoffs_leave_a_whole_outcome_window():
    assert DATES == [LAST - dt.timedelta(days=n) for n in (110, 70, 30)]


def test_inputs_and_outcomes_by_hand(days):
    rows, got = days.collect(), temporal.point_in_time(days, DATES, P).collect()
    for cut in DATES:
        want = as_of(rows, cut)
        here = {r.merchant_id: (*[r[c] for c in temporal.INPUTS], r.churned) for r in got if r.cutoff == cut}
        assert here == want and len(want) > 5
        assert all(r.is_test == (cut == DATES[-1]) for r in got if r.cutoff == cut)


def test_inputs_do_not_change_when_the_future_is_deleted(days):
    full = temporal.point_in_time(days, DATES, P)
    for cut in DATES:
        past = temporal.point_in_time(days.filter(F.col("txn_date") <= F.lit(cut)), DATES, P)
        keep = ["merchant_id", "cutoff", *temporal.INPUTS]
        assert sorted(past.filter(F.col("cutoff") <= F.lit(cut)).select(*keep).collect()) == sorted(
            full.filter(F.col("cutoff") <= F.lit(cut)).select(*keep).collect())


def test_one_aggregate_and_no_join(spark, days):
    plain = spark.createDataFrame(days.collect(), days.schema)
    plan = temporal.point_in_time(plain, DATES, P)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_the_last_cutoff_is_not_learned_from(days, staging):
    frame = temporal.point_in_time(days, DATES, P)
    swapped = frame.withColumn("churned", F.when(F.col("is_test"), 1 - F.col("churned")).otherwise(F.col("churned")))
    a, b = (temporal.temporal_scores(f, staging, P) for f in (frame, swapped))
    pick = ["merchant_id", "cutoff", "score"]
    assert sorted(a.select(*pick).collect()) == sorted(b.select(*pick).collect())
    m = temporal.temporal_metrics(a, staging).first()
    assert m.n_test == frame.filter("is_test").count() and m.n_train + m.n_test == frame.count()


def test_no_days_make_no_rows(days):
    assert temporal.point_in_time(days.limit(0), DATES, P).count() == 0


def test_rolling_origins_see_only_their_past(spark):
    y = [float(v) for v in (10, 12, 9, 15, 20, 14, 18, 25, 22, 30, 28, 26, 33, 31, 40, 38, 35, 44, 41, 50)]
    rows = [("s", dt.date(2023 + k // 12, k % 12 + 1, 1), v, 0) for k, v in enumerate(y)]
    panel = spark.createDataFrame(rows, "series string, month date, y double, x int")
    p = Params(holdout_months=3, rolling_origins=4)
    got = forecasts.rolling_predictions(panel, p).collect()
    for back in range(4):
        cut = panel.filter(F.col("month") <= F.lit(rows[len(y) - 1 - back][1]))
        alone = forecasts.holdout_predictions(cut, p).collect()
        origin = rows[len(y) - 4 - back][1]
        assert sorted(tuple(r[c] for c in ("model", "step", "month", "y", "predicted")) for r in got if r.origin == origin) == sorted(
            tuple(r[c] for c in ("model", "step", "month", "y", "predicted")) for r in alone)
    errors = forecasts.rolling_errors(forecasts.rolling_predictions(panel, p)).collect()
    assert {r.model: r.origins for r in errors}["drift"] == 4
    short = S.as_arrays(panel.filter("month < '2023-06-01'"), "series", 3, origins=4)
    assert sorted(len(r.ys) for r in short.collect()) == [1, 2]


def test_spreads_are_how_an_error_reaches_later_months(spark):
    """With one grid point a fit is linear: what a last value larger by one adds to the path are the weights."""
    p = Params(holt_grid=(0.3,), damping_grid=(0.9,), arma_grid=(0.6,))
    y = [float(v) for v in (10, 12, 9, 15, 20, 14, 18, 25, 22, 30, 28, 26, 33, 31, 40)]

    def found(values):
        rows = [("s", dt.date(2023 + k // 12, k % 12 + 1, 1), v, 0) for k, v in enumerate(values)]
        arrays = S.as_arrays(spark.createDataFrame(rows, "series string, month date, y double, x int"), "series", 0, 6)
        return {r.model: r for r in forecasts.paths(arrays, 6, p).collect()}

    base, moved = found(y), found([*y[:-1], y[-1] + 1])
    for model in ("naive_last_value", "holt_damped", "arima", "arima_with_intervention"):
        weights = np.r_[1.0, np.subtract(moved[model].path, base[model].path)[:-1]]
        assert base[model].spread == pytest.approx(np.sqrt(np.cumsum(weights ** 2)))
    assert base["seasonal_naive"].spread == [1.0] * 6
    n = len(y)
    assert base["drift"].spread == pytest.approx([np.sqrt(h * (1 + h / (n - 1))) for h in range(1, 7)])
