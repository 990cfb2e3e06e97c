"""What a task holds and what is moved must not grow faster than the input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom import Params, Warehouse
from ledgerloom.plans import catalogue, facts, features
from ledgerloom.plans.warehouse import MARTS
from ledgerloom.sources import orderbook, staging as staged
from ledgerloom.sources.staging import Staging

FOLDER = "/root/testdata/sf0.001"
JAN, FEB = dt.date(2024, 1, 1), dt.date(2024, 2, 1)


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(staged, "BUCKET_ROWS", 100)
    w = Warehouse(spark, orderbook.bind(spark, FOLDER))
    cores = w.staging.buckets
    assert w["attempt_counts"].count() > 100 * cores
    w["issuer_month"]
    assert w.staging.buckets == -(-w["attempt_counts"].count() // 100)
    assert w["issuer_month"].groupBy("merchant_id").count().rdd.getNumPartitions() > cores
    assert Staging(spark, buckets=3).buckets == 3
    given = Warehouse(spark, orderbook.bind(spark, FOLDER), Params(buckets=3))
    given["issuer_day"]
    assert given.staging.buckets == 3


def test_merchant_months_do_not_move_the_rollup(spark):
    w = Warehouse(spark, lambda s: orderbook.bind(spark, FOLDER, s))
    w["issuer_month"]
    plan = MARTS["merchant_month"].make(w).repartition(w.staging.buckets, "merchant_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange" not in plan[:plan.index("Union")]


@pytest.fixture
def sides(spark):
    month = ("merchant_id string, month date, issuer_bank string, attempted_txns bigint, successful_txns bigint, failed_txns bigint, "
             "tpv_paise bigint, attempted_paise bigint, day_bits int, first_txn_date date, last_txn_date date")
    rows = [(m, d, b, 2, 1, 1, 100, 300, 1, d, d) for m, d, b in
            [("a", JAN, "X"), ("a", JAN, "Y"), ("a", FEB, "X"), ("b", JAN, "X"), (None, JAN, "X"), ("c", None, "X")]]
    medians = spark.createDataFrame([("a", JAN, 1.5), (None, JAN, 9.0), ("z", JAN, 2.0)], "merchant_id string, month date, median_ticket_inr double")
    tickets = spark.createDataFrame(
        [("a", JAN, "PAYMENT_FAILURE", False), ("a", JAN, "OTHER", True), (None, JAN, "OTHER", True), ("c", None, "OTHER", True), ("z", FEB, "OTHER", True)],
        "merchant_id string, ticket_month date, ticket_category string, resolved boolean")
    settled = spark.createDataFrame([("a", JAN, 0.5), ("a", JAN, 2.5), ("a", JAN, None), ("b", JAN, None), (None, JAN, 7.0), ("z", JAN, 1.0)],
                                    "merchant_id string, settle_month date, avg_settlement_delay_days double")
    return spark.createDataFrame(rows, month), medians, tickets, settled


def test_merchant_months_meet_as_a_left_join_would(sides):
    def found(settled, one):
        return sorted([(r.merchant_id, r.month, r.attempted_txns, r.distinct_issuers, r.median_ticket_inr, r.tickets_raised, r.tickets_unresolved,
                        r.avg_settlement_delay_days) for r in facts.merchant_month(*sides[:3], settled, 3, one).collect()], key=str)

    rest = [("a", FEB, 2, 1, None, 0, 0, None), ("b", JAN, 2, 1, None, 0, 0, None), (None, JAN, 2, 1, None, 0, 0, None),
            ("c", None, 2, 1, None, 0, 0, None)]
    every = [("a", JAN, 4, 2, 1.5, 2, 1, d) for d in (0.5, 2.5, None)]
    assert found(sides[3], False) == sorted(every + rest, key=str)
    single = sides[3].filter("coalesce(avg_settlement_delay_days, 0) <> 2.5 and not (merchant_id = 'a' and avg_settlement_delay_days is null)")
    assert found(single, True) == found(single, False) == sorted(every[:1] + rest, key=str)


def test_staged_tables_are_packed_with_zstd(spark, staging):
    for key in (None, "id"):
        files = staging.write(spark.range(100), "packed", key).inputFiles()
        assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_features_need_neither_medians_nor_the_calendar(spark):
    """both were built in full for columns that the feature months give."""
    w = Warehouse(spark, lambda s: orderbook.bind(spark, FOLDER, s), catalogue.ORDERBOOK)
    found = w["merchant_features_base"]
    assert not {"merchant_month", "merchant_month_dense"} & set(w._built)
    cutoff = (w.split.label_start - dt.timedelta(days=1)).replace(day=1)
    at = w["merchant_month_dense"].filter(F.col("month") == F.lit(cutoff)).select("merchant_id", "success_rate_3m", "tenure_months")
    mine = found.select("merchant_id", "success_rate_3m_at_cutoff", "tenure_months")
    assert mine.count() > 100 and mine.exceptAll(at).isEmpty()
    assert mine.filter("success_rate_3m_at_cutoff is null").count() and mine.filter("success_rate_3m_at_cutoff < 1").count()
    # Where merchant_month is there, it is read, with the same result.
    again = MARTS["merchant_features_base"].make(w)
    assert found.exceptAll(again).isEmpty() and found.count() == again.count()


def test_trailing_rate_and_tenure_over_silent_months(spark):
    rows = [("a", m, t, ok) for m, t, ok in [(1, 4, 2), (3, 10, 7), (5, 2, 1), (7, 9, 9)]] + [("b", 2, 5, 5), ("c", 7, 1, 1)]
    f = spark.createDataFrame(
        [(m, dt.date(2024, k, 1), t, ok, 1.0, 1, 1.0, 0, 0, 0, None) for m, k, t, ok in rows],
        "merchant_id string, month date, attempted_txns bigint, successful_txns bigint, tpv_inr double, active_days bigint, avg_ticket_inr double, "
        "tickets_raised bigint, tickets_unresolved bigint, tickets_payment_failure bigint, avg_settlement_delay_days double")
    got = {r.merchant_id: (r.success_rate_3m_at_cutoff, r.tenure_months) for r in features.month_behaviour(f, dt.date(2024, 7, 1)).collect()}
    assert got == {"a": (0.5, 6), "b": (None, 5)}


def test_rfm_scores_are_made_from_the_rollups_alone(spark):
    """all features were built for three scores."""
    w = Warehouse(spark, lambda s: orderbook.bind(spark, FOLDER, s), catalogue.ORDERBOOK)
    scores = catalogue.QUERIES["rfm_scores"](w)
    assert not {"merchant_month", "merchant_month_dense", "merchant_activity_gaps", "merchant_features_base"} & set(w._built)
    whole = w["merchant_features"].select(*scores.columns)
    assert scores.count() == whole.count() and scores.exceptAll(whole).isEmpty()
