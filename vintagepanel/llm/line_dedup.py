"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

A store of runs holds, for each line key, in how many documents it was seen. Documents are
added in batches. The distinct keys of a batch are counted, and those that are settled
already (seen often enough) are merge-anti-joined away. What is left is merge-anti-joined
with the runs: keys that no run holds are new; of the others the counts so far are added
up. Keys that reach the threshold are settled, the rest of the batch becomes a run of its
own, sorted by key. Once a level has fanout runs, they are compacted into one run of the
next level, without the keys that were settled meanwhile. The store lives in the shared
folder, a directory a run, so it outlives executors and can be filled over many jobs.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.llm.common import salted_join, scratch_path, scratch_table, text_of

#: Rows of the set of dropped keys (16 bytes of digest each) that are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
#: Bits of the map that tells suspect lines: BITS_PER_KEY for each dropped key, between these two.
BITS, MOST_BITS, BITS_PER_KEY = 1 << 20, 1 << 23, 16
#: Documents of a batch, and the fewest and most batches of a call.
BATCH_ROWS, BATCHES = 50_000_000, (4, 64)
_STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    """The line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased."""
    stripped = F.call_function("btrim", line, F.lit(_STRIPPED))
    return F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def digests(text: Column, min_length: int) -> Column:
    """The 128-bit digest of each line's key, as 16 bytes; null for keys of fewer code points."""
    keys = F.transform(_lines(text), line_key)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_length, F.unhex(F.md5(k))))


def distinct_keys(digests: Column) -> Column:
    """Each digest of a row once, nulls left out. Spark finds repeats of strings by hashing, of binaries by comparing all with all."""
    spelt = F.array_distinct(F.transform(F.array_compact(digests), F.hex))
    return F.transform(spelt, F.unhex)


class LineRuns:
    """Levelled sorted runs of (k, n_docs) in one folder, and the keys that are settled."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, fanout: int = 2, key_type: str = "string"):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.schema = f"k {key_type}, n_docs long, settled boolean"
        self.path = path or scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.settled_in: list[str] = []
        self._next = 0

    def _write(self, df: DataFrame) -> str:
        """A run: dealt by key, sorted within its files, settled keys last, so that a reader of either kind skips the other's row groups."""
        self._next += 1
        path = f"{self.path}/run-{self._next}"
        df.select("k", "n_docs", "settled").sortWithinPartitions("settled", "k").write.parquet(path)
        return path

    def _read(self, paths: list[str], settled: bool) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths).filter(F.col("settled") == settled).drop("settled")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def joined(self, keys: DataFrame) -> DataFrame:
        """What a batch (k, a row for each document and key) adds: k, n_docs, and whether k is settled by it."""
        counted = keys.groupBy("k").agg(F.count("*").alias("n_docs"))
        if self.settled_in:
            counted = counted.join(self._read(self.settled_in, True).select("k").hint("merge"), "k", "left_anti")
        if not self.runs():
            return counted.withColumn("settled", F.col("n_docs") >= self.min_docs)
        held = self._read(self.runs(), False)
        fresh = counted.join(held.select("k").hint("merge"), "k", "left_anti").withColumn("before", F.lit(0).cast("long"))
        again = counted.join(held.groupBy("k").agg(F.sum("n_docs").alias("before")).hint("merge"), "k")
        return fresh.unionByName(again).select("k", "n_docs", (F.col("before") + F.col("n_docs") >= self.min_docs).alias("settled"))

    def add_keys(self, keys: DataFrame) -> None:
        path = self._write(self.joined(keys))
        self.settled_in.append(path)
        self._push(0, path)

    def _push(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._read(runs, False).groupBy("k").agg(F.sum("n_docs").alias("n_docs"))
            merged = merged.join(self._read(self.settled_in, True).select("k").hint("merge"), "k", "left_anti")
            self._push(level + 1, self._write(merged.withColumn("settled", F.lit(False))))

    def common_keys(self) -> DataFrame:
        """The keys (k) found in at least min_docs documents of all batches."""
        return self._read(self.settled_in, True).select("k")


def _suspects(common: DataFrame, rows: int = 0) -> Column:
    """A map of bits, one set for each of the rows of common (k), as a constant: a digest whose bit is not set is none of them.

    Up to half a million keys, fewer than one other line in 16 is suspected. Beyond that
    the map grows no more and suspects more lines; it saves less work then, and results
    are the same.
    """
    size = BITS
    while size < min(rows * BITS_PER_KEY, MOST_BITS):
        size *= 2
    bit = F.pmod(F.xxhash64("k"), F.lit(size))
    one = F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))
    found = common.groupBy(F.shiftright(bit, 3).cast("int").alias("at")).agg(F.bit_or(one).cast("int").alias("bits")).toArrow()  # a row a byte of the map at most
    held = np.zeros(size // 8, np.uint8)
    held[found["at"].to_numpy()] = found["bits"].to_numpy()
    return F.lit(held.tobytes())


def _is_suspect(bits: Column, k: Column) -> Column:
    bit = F.pmod(F.xxhash64(k), F.octet_length(bits) * 8)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return k.isNotNull() & (F.getbit(byte, (bit % 8).cast("int")) == 1)


def _batch_ends(rows: DataFrame, batches: int) -> list[int]:
    """The last row of every batch but the last, about equally many rows each: runs of rows as they lie in the files, so that a batch reads its own part of them alone."""
    if batches < 2:
        return []
    ends = rows.agg(F.percentile_approx("_row", [b / batches for b in range(1, batches)])).first()[0]
    return list(ends or [-1] * (batches - 1))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_length: int = 1, batches: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text.

    Text is split at \\n (null or empty: one empty line). Lines whose key has at least
    min_length code points and stands in at least min_docs rows are dropped everywhere;
    the others stay in order, joined by \\n. Each row counts as a document, repeated rows
    and rows of one id too; null ids are kept. Other columns are not read. An empty table
    gives no rows. Only texts with a suspect line are shuffled; others stay where they are.
    Where more keys are dropped than may be broadcast, each is dealt over salts.
    """
    spark = docs.sparkSession
    read = docs.select(docs[f"`{id_col}`"].alias("_id"), text_of(f"`{text_col}`").alias("_text"))
    rows = scratch_table(read.select("_id", _lines(F.col("_text")).alias("_lines"), digests(F.col("_text"), min_length).alias("_keys"), F.monotonically_increasing_id().alias("_row")), "lines")
    if batches is None:
        batches = min(max(-(-rows.count() // BATCH_ROWS), BATCHES[0]), BATCHES[1])
    runs = LineRuns(spark, min_docs=min_docs, key_type="binary")
    ends = _batch_ends(rows, batches)
    for after, last in zip([None, *ends], [*ends, None], strict=True):
        batch = rows if after is None else rows.filter(F.col("_row") > after)
        batch = batch if last is None else batch.filter(F.col("_row") <= last)
        runs.add_keys(batch.select(F.explode(distinct_keys(F.col("_keys"))).alias("k")))
    common = scratch_table(runs.common_keys(), "common-lines")
    n_common = common.count()
    bits = _suspects(common, n_common)
    marks = rows.select("_row", F.posexplode("_keys").alias("pos", "k")).filter(_is_suspect(bits, F.col("k")))
    hits = salted_join(marks, common, "k", n_common, broadcast_rows, "inner")
    per_row = scratch_table(hits.groupBy("_row").agg(F.collect_list("pos").alias("_drop")), "dropped-lines")
    touched = F.exists("_keys", lambda k: _is_suspect(bits, k))
    columns = ["_id", "_lines", F.size("_keys").alias("_n")]
    some = rows.filter(touched).select("_row", *columns).join(per_row.hint("merge"), "_row", "left").drop("_row")
    rest = rows.filter(~touched).select(*columns, F.lit(None).cast("array<int>").alias("_drop"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_drop"))
    kept_lines = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(kept, lambda p: F.get(F.col("_lines"), p)))
    out = some.unionByName(rest)
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), F.concat_ws("\n", kept_lines).alias("kept_text"))


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = drop_common_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d),
keyed AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN k IN (SELECT k FROM common) THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY r, doc_id
"""
