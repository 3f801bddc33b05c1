"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a ring of 64-bit hashes. A row's place on the ring is
the hash of its key; it belongs to the shard of the next point clockwise. Every shard
takes a bounded number of rows, floor(n/s) or, for the first n mod s shards, one more.
Rows that reach a full shard continue clockwise to the next point with room.

Only counts travel to the driver: rows per arc between two points, a table whose size is
set by shards x vnodes. The walk round the ring over these counts says which ranks of
which arc go to which shard; rows get their rank within an arc by a running sum that
holds no arc in one task. DataFrame functions alone.
"""

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.llm.common import cells_for, running_sum, text_of


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, by point, on a ring of signed 64-bit hashes."""
    points = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(vnodes)]
    return sorted(points)


def walk(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[dict]:
    """Ranges of ranks of each arc and the shard and first slot they go to. counts: rows by arc (index of the point that ends it)."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    slot = [0] * shards
    out: list[dict] = []
    waiting: list[list[int]] = []  # [arc, first rank, rows] of what found no room so far, first come first served
    for lap in range(2):
        for arc, (_, shard) in enumerate(points):
            if lap == 0 and counts.get(arc):
                waiting.append([arc, 0, counts[arc]])
            while waiting and room[shard]:
                head = waiting[0]
                took = min(head[2], room[shard])
                out.append({"arc": head[0], "first": head[1], "last": head[1] + took - 1, "shard": shard, "slot": slot[shard]})
                room[shard] -= took
                slot[shard] += took
                head[1] += took
                head[2] -= took
                if not head[2]:
                    waiting.pop(0)
    assert not waiting, "two laps fill every shard"
    return out


def arcs_table(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """The ring's points as a table of shards x vnodes rows: low < place <= high belongs to arc."""
    last = (1 << 63) - 1
    rows = [{"arc": i, "low": points[i - 1][0] if i else -(1 << 63), "high": p, "head": i == 0} for i, (p, _) in enumerate(points)]
    rows.append({"arc": 0, "low": points[-1][0], "high": last, "head": False})
    return _local(spark, rows, "arc int, low long, high long, head boolean")


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, as a literal of the plan."""
    fields = ", ".join(x.replace(" ", ": ") for x in schema.split(", "))
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64, slices: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Counts of shards are at most one apart; slots count from 0 in each shard without
    gaps. The key is the id, so copies of a text spread evenly; a null id has the hash of
    null. Repeated rows each take a slot. A null text is empty: size 8. Other columns are
    not read. An empty table gives no rows.
    """
    points = ring(shards, vnodes)
    text = text_of(f"`{text_col}`")
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("_place", F.xxhash64("doc_id", F.lit("place")))
    # arcs by a join on slices of the ring: a slice is a fixed range of hashes, an arc spans the slices it touches
    bits = slices.bit_length() - 1
    arcs = arcs_table(docs.sparkSession, points)
    touched = arcs.withColumn("_slice", F.explode(F.sequence(F.shiftright("low", 64 - bits), F.shiftright("high", 64 - bits))))
    within = ((F.col("_place") > F.col("low")) | (F.col("head") & (F.col("_place") == F.col("low")))) & (F.col("_place") <= F.col("high"))
    placed = rows.withColumn("_slice", F.shiftright("_place", 64 - bits)).join(F.broadcast(touched), "_slice").filter(within).select(*rows.columns, "arc")
    counts = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    sizes = _local(docs.sparkSession, [{"arc": a, "n": n} for a, n in counts.items()], "arc int, n long").select("arc", cells_for(F.col("n")).alias("_cells"))
    ranked = running_sum(placed.join(F.broadcast(sizes), "arc"), ["arc"], [F.col("_place"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.xxhash64("doc_id", F.lit("cell")), F.col("_cells"), F.lit(1), "_rank")
    plan = _local(docs.sparkSession, walk(counts, points, shards), "arc int, first long, last long, shard int, slot long").withColumnRenamed("arc", "_arc")
    found = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("_arc")) & F.col("_rank").between(F.col("first"), F.col("last")))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("_rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
