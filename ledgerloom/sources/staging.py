"""Written tables that cut lineage.

A staged table lives in the shared folder the cluster names in
`spark.checkpoint.dir`, so losing executors never loses it. Tables keyed by
merchant are bucketed on that key: later groupings, windows and joins on the
merchant then read co-located files and need no shuffle. Bucketing happens
after pre-aggregation, so one merchant holds at most days x issuers rows
however many attempts it made. The number of buckets follows the rows, so a
task that reads a bucket holds as much of a large input as of a small one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# A merchant's daily rows in one bucket: its windows and sorts take some 500 MB in a task.
BUCKET_ROWS = 1 << 18

# Staged tables are written once and read few times, so they are packed closer than Spark's default does.
CODEC = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one, else the session's own storage: its warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


class Staging:
    def __init__(self, spark: SparkSession, buckets: int | None = None, root: str | None = None,
                 database: str = "default"):
        self.spark = spark
        # Bucketed tables are registered here, in whichever catalog the session has, and dropped by release().
        self.database = database
        self.run = uuid.uuid4().hex[:12]
        self.root = f"{(root or shared_folder(spark)).rstrip('/')}/ledgerloom/{self.run}"
        # Until the rows are known, as many as the cluster has cores; a given number stays.
        self.given = buckets is not None
        self.buckets = buckets or spark.sparkContext.defaultParallelism
        self.tables: list[str] = []
        self._n = 0

    def write(self, df: DataFrame, name: str, key: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}_{name}"
        if key is None:
            df.write.mode("overwrite").option("compression", CODEC).parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        spread = df.repartition(self.buckets, key)
        table = f"{self.database}.stage_{self.run}_{self._n:03d}_{name}"
        (spread.write.mode("overwrite").format("parquet")
            .bucketBy(self.buckets, key).option("path", path).option("compression", CODEC).saveAsTable(table))
        self.tables.append(table)
        return self.spark.table(table)

    def size_for(self, rows: int) -> None:
        """Enough buckets for a keyed table of `rows` rows; called before the first one, for all must have the same number."""
        if not self.given:
            most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
            self.buckets = min(max(self.buckets, -(-rows // BUCKET_ROWS)), most)

    def release(self) -> None:
        """Deletes this run's own staged tables; marts built from them stop working."""
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.tables.clear()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
