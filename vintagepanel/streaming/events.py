"""Incremental forms of the event operators, on Structured Streaming."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vintagepanel.sources.feeds import incremental_merge


def windowed_action_counts(events: DataFrame, time: str = "ts", key: str = "entity", action: str = "action", window: str = "7 days", slide: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Events of each action per key and sliding window; events later than `lateness` are left out. Works on a stream (append mode) as on a table."""
    late = events.withWatermark(time, lateness)
    counts = [F.count_if(F.col(action) == a).alias(f"n_{a}") for a in ("raise", "lower", "reaffirm", "initiate", "withdraw")]
    out = late.groupBy(key, F.window(time, window, slide).alias("w")).agg(F.count("*").alias("n"), *counts)
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", *[c for c in out.columns if c.startswith("n_")])


#: Buckets of a keyed table.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """bucket -> the epoch that wrote it, as of the last finished epoch (before the given one). A row a bucket; none where there is no table."""
    try:
        states = spark.read.schema("bucket int, epoch long, at long").parquet(f"{path}/state")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    states = states if before is None else states.filter(F.col("at") < before)
    last = states.agg(F.max("at")).first()[0]
    return {r["bucket"]: r["epoch"] for r in states.filter(F.col("at") == last).collect()} if last is not None else {}


def _rows(spark: SparkSession, path: str, state: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/rows/epoch={e}/bucket={b}" for b, e in sorted(state.items())]
    return spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None


def merge_batch(batch: DataFrame, epoch: int, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Merge a batch into a keyed table: its rows replace old ones of the same keys.

    Keys are dealt to buckets; only the buckets that the batch touches are read and written,
    into a folder of this epoch. The table's state, which epoch wrote each bucket, is
    written last, so a batch that fails changes nothing, and one that is run again starts
    from the state before it and gives the same table. Repeated keys of a batch all stay.
    """
    spark = batch.sparkSession
    dealt = batch.withColumn("bucket", _bucket(keys, buckets))
    touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]
    if not touched:
        return
    state = _state(spark, path, epoch)
    old = _rows(spark, path, {b: state[b] for b in touched if b in state})
    merged = batch if old is None else incremental_merge(old, batch, keys)
    merged.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/epoch={epoch}")
    now = state | dict.fromkeys(touched, epoch)
    spark.createDataFrame([(b, e) for b, e in now.items()], "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/state/at={epoch}")


def read_merged(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of its last finished batch; None where there is none."""
    return _rows(spark, path, _state(spark, path))


def merge_writer(stream: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Merges each micro-batch into a keyed table (merge_batch), to be read by read_merged."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: merge_batch(batch, epoch, path, keys, buckets)).option("checkpointLocation", checkpoint)
