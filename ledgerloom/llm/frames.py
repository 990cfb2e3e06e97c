"""Small helpers on frames: tables on shared storage, running totals over a sorted frame, tidy inputs."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` as a table written to the shared folder: cuts lineage and survives lost executors.

    Inside `scratch` it goes with the scope, or with the scope around that if it is to be kept; outside it stays until
    someone deletes it. What was shuffled for it goes when it is written, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    if scopes := _scratch.get()[:-1 if keep else None]:
        scopes[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes tables that `stage` returned and that nothing reads any more."""
    for table in tables:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged inside when it is left; what is made of them must have been written by then."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on documents whose extra columns may be named like its own work columns, which start with an underscore.

    Such columns have other names while the operator works and come back under their own. Its key, text and parameters
    name columns without an underscore in front.
    """
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c: f"extra_{i}_{uuid.uuid4().hex[:8]}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        if not taken:
            return operator(docs, *args, **kwargs)
        out = operator(docs.withColumnsRenamed(taken), *args, **kwargs)
        return out.withColumnsRenamed({new: c for c, new in taken.items()})
    return run


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = MAX_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` holds about `limit` bytes at most, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def numbered(df: DataFrame, order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """`df` with `ordinal` (0, 1, ...) by `order`, and with `before`: the sum of `weight` ahead of a row.

    One range exchange. Every task numbers its own sorted rows; the totals of the tasks (one row each)
    give the offsets. Rows with equal order values may take their numbers in either order, but the result
    is written down once, so later steps agree on it. An empty frame stays empty.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()),
                           T.StructField("_seq", T.LongType()), T.StructField("_sum", T.LongType())])
    target = arrow_schema(schema)

    def number(batches):
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            w = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64) if weight else np.zeros(b.num_rows, np.int64)
            upto = np.cumsum(w)
            cols = [*b.columns, pa.array(np.full(b.num_rows, part, np.int32)),
                    pa.array(np.arange(rows, rows + b.num_rows)), pa.array(upto - w + total)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)
            rows += b.num_rows
            total += int(upto[-1]) if b.num_rows else 0

    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(sorted_rows.mapInArrow(number, schema), name)
    w = F.col(weight) if weight else F.lit(0)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (staged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(w).alias("_w"))
              .select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
                      F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_w0")))
    out = (staged.join(F.broadcast(totals), "_part")
           .withColumn("ordinal", F.col("_seq") + F.col("_n0"))
           .withColumn("before", F.col("_sum") + F.col("_w0"))
           .drop("_part", "_seq", "_sum", "_n0", "_w0"))
    return out if weight else out.drop("before")
