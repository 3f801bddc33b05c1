"""N-gram Jaccard self-join: MinHash banding, then verification on full n-gram sets.

1. Every text gets its n-gram set's digest and band hashes. Equal sets are one class,
   represented once from here on; its copies are never expanded.
2. Classes are shuffled on their band hashes. Buckets of one class are dropped, and of
   buckets with the same members (near copies share most bands) the first is kept.
3. Buckets are cut into chunks of bounded size and the pairs of chunks dealt out as
   units, so no task holds a large bucket. A unit gets the full sets of its members and
   verifies all its pairs in matrix blocks. It returns link counts and a spanning forest
   of the links, not the pairs. A pair that meets in several bands counts in the first.
4. Components of the forest's edges are found by alternating large-star and small-star
   rounds, each written to the shared folder.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.llm import shingles
from vintagepanel.llm.common import giving_back, salted_join, scratch_table, small_batches, small_or_shuffled

#: Members and n-grams of a chunk at most (about), and candidate ids that are broadcast.
CHUNK_MEMBERS, CHUNK_GRAMS, BROADCAST_ROWS = 256, 400_000, 500_000
_COLUMNS = 8192


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """id, h, fp (digest of the set, null without n-grams), grams, bands of every row (id, text, h)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in shingles.parts([t or "" for t in batch.column(1).to_pylist()]):
                hashes, begins = shingles.gram_sets(part, n)
                signed = shingles.minhash_bands(hashes, begins, bands, rows).view(np.int64)
                sizes = np.diff(begins)
                fp = [shingles.set_digest(hashes[a:b]) if b > a else None for a, b in zip(begins[:-1], begins[1:], strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * bands, pa.int32()), pa.array(signed.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(fp, pa.binary()), pa.array(sizes.astype(np.int64)), listed], ["id", "h", "fp", "grams", "bands"])
                at += len(part)

    return docs.mapInArrow(giving_back(run), f"id {id_type}, h long, fp binary, grams long, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """fp and grams (sorted 64-bit hashes, binary) of every row that has n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.parts([t or "" for t in batch.column(0).to_pylist()]):
                hashes, begins = shingles.gram_sets(part, n)
                found = [hashes[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([shingles.set_digest(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["fp", "set"])

    return docs.select("text").mapInArrow(giving_back(run), "fp binary, set binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted distinct arrays, in blocks of columns."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # what one member holds alone meets nothing
    renumbered = np.full(len(values), -1)
    renumbered[shared] = np.arange(len(shared))
    column = renumbered[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m))  # blocks are exact in single precision, their sums need not be
    for low in range(0, len(shared), _COLUMNS):
        a, b = np.searchsorted(column, (low, low + _COLUMNS))
        block = np.zeros((m, min(_COLUMNS, len(shared) - low)), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        out += block @ block.T
    return out


def _forest(left: np.ndarray, right: np.ndarray, m: int) -> list[tuple[int, int]]:
    """A star for each component of the links among m members."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return [(i, int(r)) for i, r in enumerate(root) if i != r]


def verify_unit(band: int, same_chunk: bool, chunk: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, copies: np.ndarray, similarity: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Link counts of the members of a unit, in copies of the other side, and a spanning forest of the links first met in this band."""
    sizes = np.array([len(s) for s in sets], np.float64)
    met = overlaps(sets)
    linked = met >= similarity * (sizes[:, None] + sizes[None, :] - met) - 1e-9
    linked &= np.triu(np.ones_like(linked), 1)
    if not same_chunk:
        linked &= chunk[:, None] != chunk[None, :]
    left, right = np.nonzero(linked)
    fresh = ~(bands[left, :band] == bands[right, :band]).any(1)
    left, right = left[fresh], right[fresh]
    counts = np.zeros(len(sets), np.int64)
    np.add.at(counts, left, copies[right])
    np.add.at(counts, right, copies[left])
    return counts, _forest(left, right, len(sets))


def _verified(units: DataFrame, similarity: float) -> DataFrame:
    """Rows of units dealt and sorted by unit, in; a (fp), b (fp or null), links out: b null for a link count, else an edge."""
    cols = ["band", "bucket", "i", "j"]

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        band, _, i, j = rows[0][0]
        fps = [r[1] for r in rows]
        counts, edges = verify_unit(band, i == j, np.array([r[4] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[3] for r in rows]), np.array([r[5] for r in rows]), similarity)
        some = np.flatnonzero(counts)
        a = [fps[k] for k in some] + [fps[x] for x, _ in edges]
        b = [None] * len(some) + [fps[y] for _, y in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*counts[some].tolist(), *[0] * len(edges)], pa.int64())], ["a", "b", "links"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            c = [batch.column(batch.schema.get_field_index(n)) for n in (*cols, "fp", "set", "bands", "chunk", "copies")]
            for k in range(batch.num_rows):
                unit = tuple(x[k].as_py() for x in c[:4])
                if rows and rows[0][0] != unit:
                    if (out := flush(rows)) is not None:
                        yield out
                    rows = []
                rows.append((unit, *(x[k].as_py() for x in c[4:])))
        if (out := flush(rows)) is not None:
            yield out

    return units.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(giving_back(run), "a binary, b binary, links long")


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """(node, root) of the connected components of edges (a, b); root is a component's smallest node and is not listed itself.

    A hub has as many edges as its component has members: smallest neighbours are combined
    before the shuffle, and joined back to edges dealt over salts.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = scratch_table(pairs, "edges")
    seen = None
    while True:  # each round shortens the paths to the roots until nothing changes
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both.filter("b > a"), low, "a", 1, 0, "inner", salts).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, small_low, "a", 1, 0, "inner", salts).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small_low.select("a", F.col("m").alias("b"))).distinct()
        pairs = scratch_table(small, "edges")
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _row_classes(docs: DataFrame, id_col: str, text_col: str, n: int, similarity: float, recall: float, broadcast_rows: int) -> DataFrame:
    """id, h (hash of the text), first (the row that names the class: order, id, h), n_links of every row."""
    small_batches(docs.sparkSession)
    bands, rows = shingles.band_plan(similarity, recall)
    read = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"), F.xxhash64(docs[f"`{text_col}`"]).alias("h"))
    signed = scratch_table(_signatures(read, n, bands, rows), "signatures")
    name = F.struct(F.col("id").isNull().alias("unnamed"), "id", "h")
    classes = signed.filter("fp IS NOT NULL").groupBy("fp").agg(F.min(name).alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = scratch_table(classes, "classes")
    banded = classes.select("fp", F.col("rep.id").alias("rep"), "grams", F.posexplode("bands").alias("band", "bucket"))
    marks = [F.bit_xor(F.xxhash64("fp")).alias("x1"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("x2")]
    buckets = banded.groupBy("band", "bucket").agg(F.count("*").alias("members"), F.sum("grams").alias("weight"), *marks).filter("members > 1")
    key = F.struct("band", "bucket")
    first = scratch_table(buckets.groupBy("members", "weight", "x1", "x2").agg(F.min(key).alias("k")).select("k.band", "k.bucket", "members", "weight"), "buckets")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_MEMBERS), F.ceil(F.col("weight") / CHUNK_GRAMS)).cast("int")
    placed = banded.join(small_or_shuffled(first, first.count(), broadcast_rows), ["band", "bucket"])
    placed = placed.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fp", "band"), F.col("chunks")).cast("int"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j"))))
    placed = scratch_table(placed.select("fp", "rep", "band", "bucket", "chunk", unit.alias("u")).select("fp", "rep", "band", "bucket", "chunk", "u.i", "u.j"), "units")
    # the full sets of the candidates alone
    wanted = scratch_table(placed.select(F.col("rep").alias("want")).distinct(), "candidates")
    texts = read.join(small_or_shuffled(wanted, wanted.count(), broadcast_rows), F.col("id").eqNullSafe(F.col("want")), "left_semi")
    sets = scratch_table(_sets(texts, n).dropDuplicates(["fp"]).join(classes.select("fp", "bands", "copies"), "fp"), "sets")
    found = scratch_table(_verified(placed.drop("rep").join(sets, "fp"), similarity), "links")
    roots = components(found.filter("b IS NOT NULL"))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    joined = classes.select("fp", "rep", "copies").join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("rep").alias("first"))
    by_class = scratch_table(joined.join(named, "root").select(F.col("fp").alias("f"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "class-of")
    out = signed.select("id", "h", "fp").join(by_class, F.col("fp") == F.col("f"), "left")
    return out.select("id", "h", F.when(F.col("f").isNull(), name).otherwise(F.col("first")).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.999, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links.

    Two rows are linked if the Jaccard similarity of their n-gram sets is at least
    `similarity`. class_id is the smallest id of the connected component; n_links counts
    the other rows linked to this one, copies included. Rows without words have no
    links and their own class. Null ids have no say in class_id (it is null if a class
    has no id); each repeated row counts. Other columns are not read. An empty table
    gives no rows. Band count follows from `recall` at exactly this similarity.
    """
    rows = _row_classes(docs, id_col, text_col, n, similarity, recall, broadcast_rows)
    return rows.select(F.col("id").alias("doc_id"), F.col("first.id").alias("class_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.999, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, less those whose class has a row of smaller id (of equal ids, of smaller text hash).

    Rows with equal id and text stay or go together.
    """
    rows = _row_classes(docs, id_col, text_col, n, similarity, recall, broadcast_rows)
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    gone = scratch_table(rows.filter(~is_first).select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_h")).distinct(), "near-copies")
    on = docs[f"`{id_col}`"].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(docs[f"`{text_col}`"]) == F.col("_gone_h"))
    return docs.join(small_or_shuffled(gone, gone.count(), broadcast_rows), on, "left_anti")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicate_classes(docs)
