"""Broadcasts of tables that a caller gives, only after their rows were counted; and lineage cut where a plan would be computed again and again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of the caller's (a code list, a mapping) that are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; reading stops at the row that decides it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir and read from there, so that what follows neither plans nor computes it anew; df itself where no such folder is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df
