import datetime as dt

import pytest
from pyspark.sql import SparkSession

from ledgerloom.sources.staging import Staging


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def staging(spark):
    return Staging(spark, buckets=4)


@pytest.fixture
def make_days(spark):
    """Rows (merchant, day[, issuer, tried, won, paise won, paise tried]) as the daily rollup."""
    schema = ("merchant_id string, issuer_bank string, txn_date date, attempted_txns bigint, "
              "successful_txns bigint, failed_txns bigint, tpv_paise bigint, attempted_paise bigint")

    def make(rows):
        full = []
        for r in rows:
            m, day, issuer, tried, won, tpv, asked = (tuple(r) + ("A", 1, 1, 100, 100)[len(r) - 2:])
            full.append((m, issuer, day, tried, won, tried - won, tpv if won else None, asked))
        return spark.createDataFrame(full, schema)
    return make


@pytest.fixture
def make_merchants(spark):
    def make(*ids):
        return spark.createDataFrame(
            [(i, "kirana", "tier_3", "referral", "pos", "KA", True, 0.5) for i in ids],
            "merchant_id string, category string, city_tier string, acquisition_channel string, "
            "device_type string, state string, gst_registered boolean, competitor_density double")
    return make


def day(n: int, base: dt.date = dt.date(2024, 1, 1)) -> dt.date:
    return base + dt.timedelta(days=n)
