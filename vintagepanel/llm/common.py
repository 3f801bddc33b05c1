"""What the operators share: tables, scratch tables in the shared folder, and running sums without a hot task."""

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark runs on one machine, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's scratch tables, within the shared one."""
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> bool:
    """Remove all scratch tables of this application; whether there were any. Results not yet read or written are lost, so call it last."""
    jvm = spark.sparkContext._jvm  # Spark has no call of its own to remove a folder of any store
    path = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and is computed once however often it is read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of whole texts, where the session has Spark's own default.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches by bytes: rows of whole texts differ in size by thousands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b"):
        spark.conf.set(key, BATCH_BYTES)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose task hands free memory back to the system at its end: Python workers outlive tasks, and all of an executor's share its limit."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def small_or_shuffled(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within limit; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def salted_join(large: DataFrame, small: DataFrame, on: str, rows: int, limit: int, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a small side with one row a key: broadcast if its counted rows are within limit, else shuffled with each key dealt over salts, so that a key that holds a third of large is no single task's."""
    if rows <= limit:
        return large.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns if c != on]), F.lit(salts)).cast("int")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", salt).join(spread, [on, "_salt"], how).drop("_salt")


#: Rows of a cell of running_sum, about.
CELL_ROWS = 10_000


def cells_for(rows: Column) -> Column:
    """The number of cells of a group of this many rows."""
    return F.greatest(F.ceil(rows / CELL_ROWS), F.lit(1)).cast("long")


def running_sum(df: DataFrame, group: list[str], order: list[Column], key: Column, cells: Column, value: Column, out: str) -> DataFrame:
    """Add out: the sum of value over the rows of the group that come before this row.

    The order within a group is by a cell of the row's key (a 64-bit hash, so cells are
    even), then by order. Each cell is summed by itself and cells are offset by a prefix
    sum over the table of cells, so that no task holds a whole group, however large.
    cells is each row's number of cells of its group, from the group's own count
    (cells_for): small groups are one cell. The table of cells is broadcast while small.
    """
    celled = df.withColumn("_cell", F.pmod(F.shiftrightunsigned(key, 20), cells))
    totals = celled.groupBy(*group, "_cell").agg(F.sum(value).alias("_sum"))
    ahead = F.sum("_sum").over(W.partitionBy(*group).orderBy("_cell")) - F.col("_sum")
    offsets = scratch_table(totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_cell").alias("_c"), ahead.alias("_offset")), "cells")
    on = F.col("_cell") == F.col("_c")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = W.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = celled.withColumn("_within", F.sum(value).over(within) - value)
    joined = summed.join(small_or_shuffled(offsets, offsets.count(), 100_000), on)
    return joined.select(*df.columns, (F.col("_offset") + F.col("_within")).alias(out))
