"""Exact deduplication by skew-safe combining, in DataFrame functions alone.

Digests are counted first, without texts. Only texts whose digest occurs more than once
have anything to be compared with: of these, copies are removed locally (the map side of
the first aggregation, keyed by the full text), then within salted digest groups, then
the winners of the salts are combined. The full text is part of the key at every stage,
so two texts that share a digest stay apart.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vintagepanel.llm.common import salted_join, scratch_table, text_of

#: Rows of the table of repeated digests (about 150 bytes each) that are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000


def _winners(rows: DataFrame, salts: int, broadcast_rows: int) -> tuple[DataFrame, int, bool, bool]:
    """Per repeated text: _sha, _keep, _size, _ties (rows that carry the kept id), _variants (texts that share the digest)."""
    per_id = rows.groupBy("_sha", "_id").agg(F.count("*").alias("_n"))
    sizes = per_id.groupBy("_sha").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_sha")
    repeated = scratch_table(sizes, "repeated-digests")
    n = repeated.count()
    candidates = salted_join(rows, repeated, "_sha", n, broadcast_rows, "inner", salts)
    best = [F.max("_id").alias("_keep"), F.count("*").alias("_size")]
    salted = candidates.groupBy("_sha", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_text").agg(*best)
    combined = salted.groupBy("_sha", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    combined = combined.withColumn("_variants", F.count("*").over(W.partitionBy("_sha")))
    combined = combined.withColumn("_text", F.when(F.col("_variants") > 1, F.col("_text")))
    winners = scratch_table(combined, "winners")
    collided = winners.filter("_variants > 1").limit(1).count() > 0
    # a kept id that stands in several equal rows: one of them stays
    ties = scratch_table(per_id.filter("_n > 1"), "tied-ids").limit(1).count() > 0
    return winners, n, collided, ties


def _resolved(docs: DataFrame, id_col: str, text_col: str, salts: int, broadcast_rows: int) -> DataFrame:
    """Every row of docs as struct _row with _id, _sha, _keep, _size, _kept."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[f"`{id_col}`"].alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_sha", F.sha2("_text", 256))
    winners, n, collided, ties = _winners(rows.select("_id", "_text", "_sha"), salts, broadcast_rows)
    side = winners.select("_sha", F.lit(True).alias("_repeated"), "_keep", "_size", F.col("_text").alias("_w_text"))
    if collided:  # a digest may stand for several texts: one row a digest, its texts in a list
        side = side.groupBy("_sha", "_repeated").agg(F.collect_list(F.struct("_w_text", "_keep", "_size")).alias("_all"))
    out = salted_join(rows, side, "_sha", n if not collided else broadcast_rows + 1, broadcast_rows, "left", salts)
    if collided:
        own = F.filter("_all", lambda v: v["_w_text"].isNull() | (v["_w_text"] == F.col("_text")))
        out = out.withColumn("_own", F.get(own, F.lit(0))).withColumns({"_keep": F.col("_own._keep"), "_size": F.col("_own._size")})
    out = out.select("_row", "_id", "_sha", F.when(F.col("_repeated").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_size", F.lit(1).cast("long")).alias("_size"))
    is_kept = F.col("_id").eqNullSafe(F.col("_keep"))
    if ties:
        out = out.withColumn("_nth", F.row_number().over(W.partitionBy("_sha", "_id").orderBy(F.xxhash64("_row"))))
        is_kept = is_kept & (F.col("_nth") == 1)
    return out.withColumn("_kept", is_kept)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text is an empty one; of equal texts the row
    with the largest id stays. Null ids rank below all others (keep_id is null if a group
    has no id); of repeated rows with the kept id one stays. Other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    found = _resolved(docs.select(id_col, text_col), id_col, text_col, salts, broadcast_rows)
    return found.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns."""
    return _resolved(docs, id_col, text_col, salts, broadcast_rows).filter("_kept").select("_row.*")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
