"""Payment files that keep arriving, filed into the part-per-month layout.

The file sink commits whole micro-batches through its checkpoint, so a restarted
stream neither loses nor repeats rows, and a month gains rows whenever late
attempts for it arrive.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.tables import TRANSACTIONS, typed_transactions


def file_by_month(spark: SparkSession, arrivals: str, target: str, checkpoint: str,
                  files_per_batch: int = 1000) -> StreamingQuery:
    """Reads every new parquet file under `arrivals`, then stops; `checkpoint` is what a later run goes on from."""
    raw = (spark.readStream.schema(TRANSACTIONS)
           .option("maxFilesPerTrigger", files_per_batch).parquet(arrivals))
    return (
        typed_transactions(raw).drop("txn_date").writeStream.format("parquet")
        .partitionBy("txn_month")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
