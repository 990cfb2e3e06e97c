"""Readers, writers, the build registry and the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom import Params, Warehouse
from ledgerloom.plans import issuers, rollups
from ledgerloom.functions.display import compact_money, iso_dates, strip_encoder_prefix
from ledgerloom.functions.exact import ratio
from ledgerloom.plans.warehouse import MARTS, STEPS
from ledgerloom.sources import orderbook, sinks, tables
from ledgerloom.sources.staging import Staging, shared_folder
from ledgerloom.streaming.monthly import file_by_month

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def raw(spark):
    rows = [(1, "m1", dt.datetime(2024, 1, 31, 23, 59), 10.5, "A", "SUCCESS", ""),
            (2, "m1", dt.datetime(2024, 2, 1, 0, 0), 20.0, "A", "FAILED", "ISSUER_DOWN"),
            (3, "m2", dt.datetime(2024, 2, 29, 12, 0), 5.25, "B", "SUCCESS", "")]
    return spark.createDataFrame(rows, "txn_id long, merchant_id string, txn_ts timestamp, amount_inr double, "
                                       "issuer_bank string, status string, failure_reason string")


def test_typed_transactions(raw):
    rows = tables.typed_transactions(raw).orderBy("txn_id").collect()
    assert [r.txn_month for r in rows] == [dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 2, 1)]
    assert [r.failure_reason for r in rows] == [None, "ISSUER_DOWN", None]


def source_folder(spark, raw, path):
    typed = tables.typed_transactions(raw.withColumn("amount_inr", F.col("amount_inr").cast("decimal(18,2)")))
    sinks.write_monthly_parts(typed.drop("txn_date"), f"{path}/transactions")
    who = [(m, "kirana", "tier_3", "referral", "pos", "KA", 0, True, False, 0.5, "2024-01", False) for m in ("m1", "m2")]
    spark.createDataFrame(who, tables.MERCHANTS).write.parquet(f"{path}/merchants.parquet")
    spark.createDataFrame([("m1", dt.datetime(2024, 2, 3), "PAYMENT_FAILURE", False)], tables.TICKETS).write.parquet(
        f"{path}/support_tickets.parquet")
    spark.createDataFrame([("m1", "2024-02", 1.5)], tables.SETTLEMENTS).write.parquet(f"{path}/settlements.parquet")
    return str(path)


def test_own_layout_builds_and_prunes(spark, raw, tmp_path):
    src = tables.read_sources(spark, source_folder(spark, raw, tmp_path))
    plan = src.transactions.filter(F.col("txn_month") == F.lit(dt.date(2024, 2, 1)))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan
    w = Warehouse(spark, src, Params(buckets=2))
    rows = {(r.merchant_id, r.month.month): r for r in w["merchant_month"].collect()}
    assert rows[("m1", 2)].tickets_unresolved == 1 and rows[("m1", 2)].avg_settlement_delay_days == 1.5
    assert rows[("m1", 2)].tpv_inr is None and rows[("m1", 2)].failed_value_inr == 20.0
    assert rows[("m1", 1)].tpv_inr == 10.5 and rows[("m2", 2)].median_ticket_inr == 5.25


def test_rewriting_a_month_leaves_the_others(spark, raw, tmp_path):
    path = f"{tmp_path}/tx"
    typed = tables.typed_transactions(raw)
    sinks.write_monthly_parts(typed, path)
    sinks.write_monthly_parts(typed.filter("txn_id = 3"), path)
    assert sorted(r.txn_id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_csv_falls_back_to_the_second_folder(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 3)], "month date, n int")
    sinks.write_csv(df, f"{tmp_path}/b/report")
    got = tables.read_csv_report(spark, "report", iso_dates(df).schema, f"{tmp_path}/a", f"{tmp_path}/b")
    assert got.first().month == "2024-01-01"
    with pytest.raises(FileNotFoundError):
        tables.read_csv_report(spark, "missing", df.schema, f"{tmp_path}/a")


def test_scorecard_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(3, 0.5)], "n int, r double")
    many = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sinks.write_json(sinks.scorecard({"summary": one}, {"rows": many}), f"{tmp_path}/card")
    got = tables.read_json_document(spark, f"{tmp_path}/card").first()
    assert got.summary.n == 3 and [r.k for r in got.rows] == [1, 2]


def test_build_one_step_brings_the_schema_step(spark):
    w = Warehouse(spark, orderbook.bind(spark, FOLDER), Params(min_baseline_attempts=5))
    done = w.build(only="churn")
    want = {n for n, m in MARTS.items() if m.public and m.step in ("schema", "churn")}
    assert set(done) == want
    assert w.sql("SELECT count(*) AS n FROM merchant_churn_status").first().n == done["merchant_churn_status"].count()
    with pytest.raises(ValueError):
        w.build(only="nothing")
    assert STEPS[0] == "schema"


def test_merchant_marts_are_grouped_without_a_shuffle(spark):
    w = Warehouse(spark, orderbook.bind(spark, FOLDER))
    plan = w["issuer_month"].groupBy("merchant_id", "month").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    joined = w["merchant_month"].groupBy("merchant_id").count().join(
        w["issuer_day"].groupBy("merchant_id").agg(F.max("txn_date")), "merchant_id")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()


def test_feature_joins_shuffle_only_the_merchant_dimension(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    w = Warehouse(spark, orderbook.bind(spark, FOLDER))
    w["merchant_features_base"]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = MARTS["merchant_features_base"].make(w)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(merchant_id" in x]
    assert "SortMergeJoin" in plan and len(moved) <= 1


def test_release_deletes_only_the_run(spark):
    a, b = Staging(spark, 2), Staging(spark, 2)
    kept = a.write(spark.range(5), "kept", "id")
    gone = b.write(spark.range(5), "gone", "id")
    assert gone.count() == 5
    b.release()
    assert not tables.path_exists(spark, b.root) and kept.count() == 5


def test_stream_files_by_month_once(spark, raw, tmp_path):
    arrivals, target = f"{tmp_path}/in", f"{tmp_path}/out"
    shaped = raw.select(*[F.col(f.name).cast(f.dataType) for f in tables.TRANSACTIONS.fields])
    shaped.filter("txn_id < 3").write.mode("append").parquet(arrivals)
    file_by_month(spark, arrivals, target, str(tmp_path / "progress")).awaitTermination(120)
    shaped.filter("txn_id = 3").write.mode("append").parquet(arrivals)
    file_by_month(spark, arrivals, target, str(tmp_path / "progress")).awaitTermination(120)
    file_by_month(spark, arrivals, target, str(tmp_path / "progress")).awaitTermination(120)
    rows = spark.read.parquet(target).orderBy("txn_id").collect()
    assert [r.txn_id for r in rows] == [1, 2, 3] and rows[2].txn_month == dt.date(2024, 2, 1)


def test_display_helpers(spark):
    df = spark.createDataFrame([(2.5e9,), (3.25e6,), (4200.0,), (999.0,)], "v double")
    assert [r.t for r in df.select(compact_money(F.col("v")).alias("t")).collect()] == ["₹2.50B", "₹3.3M", "₹4K", "₹999"]
    named = spark.createDataFrame([("num__a",), ("cat__b",), ("plain",)], "f string")
    assert [r.f for r in named.select(strip_encoder_prefix(F.col("f")).alias("f")).collect()] == ["a", "b", "plain"]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (-1, 2), (2 ** 60, 2 ** 61), (None, 4)], "n long, d long")
    got = [r.r for r in df.select(ratio(F.col("n"), F.col("d"), 4).alias("r")).collect()]
    assert got == [None, 0.3333, -0.5, 0.5, None]
    # One rule at every size: a tie is rounded half up on both sides of 2^61.
    big = spark.createDataFrame([(2 ** k + 5, 10 ** 7) for k in (40, 61, 62)] + [(5 * 10 ** 17 + 5, 10 ** 6)], "n long, d long")
    want = [float((2 * (2 ** k + 5) * 10 ** 4 + 10 ** 7) // (2 * 10 ** 7)) / 1e4 for k in (40, 61, 62)] + [500000000000.0]
    assert [r.r for r in big.select(ratio(F.col("n"), F.col("d"), 4).alias("r")).collect()] == want


def test_staging_needs_no_setting():
    class Conf:
        def get(self, name, default=None):
            return {"spark.sql.warehouse.dir": "file:/somewhere"}.get(name, default)

    class Session:
        conf = Conf()
    assert shared_folder(Session()) == "file:/somewhere"


def test_largest_join_runs_once(spark):
    """What is made of attempts reads their counts, and attempts and settlements read one written join."""
    w = Warehouse(spark, lambda staging: orderbook.bind(spark, FOLDER, staging), Params(min_baseline_attempts=5))
    made = [w["attempt_counts"], rollups.issuer_day(w["attempt_counts"]), issuers.failure_reason_mix(w["attempt_counts"]),
            rollups.ticket_medians(w["attempt_counts"], w["issuer_month"], w.staging, w.params), w["settlements"], w["transactions"]]
    for df in made:
        assert "/lineitem.parquet" not in " ".join(df.inputFiles())
    assert all("attempt_counts" in f for df in made[1:4] for f in df.inputFiles() if "issuer_month" not in f)
    plain = orderbook.bind(spark, FOLDER)
    assert any("/lineitem.parquet" in f for f in plain.transactions.inputFiles())
    assert w["transactions"].exceptAll(plain.transactions).isEmpty() and plain.settlements.exceptAll(w["settlements"]).isEmpty()
    w.staging.release()
