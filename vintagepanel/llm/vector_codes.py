"""Vector codes: vectors of integers, cut into parts, each coded by an entry of its part's codebook.

The vectors are dealt into chunks once. Within a chunk and a part position the parts are
sorted along a Hilbert curve and cut into flat blocks, each with the box that holds it
(least and greatest of every component) and its sums. In a round the distances from a
block's box to the codebook's entries give a shortlist: an entry whose nearest possible
distance exceeds the least of the farthest possible ones cannot be the nearest entry of
any part in the box. Only shortlisted entries meet the parts, in integers, so ties and
floors are exact; a block with one shortlisted entry is settled by its sums alone.

Chunks are written to the shared folder, a row each, and every round is one pass over
them: a task adds up counts and sums by entry, Spark adds up the tasks'. The codebooks,
whose size depends on the parameters alone, are all that the driver holds.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagepanel.llm.common import giving_back, salted_join, scratch_table

#: Parts of a vector, entries of a codebook, rounds, and the factor that makes components integers.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a chunk and parts of a block.
CHUNK_ROWS, BLOCK_ROWS = 8192, 32
#: Rows of the table of labels that are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000


def largest_component(dims: int) -> int:
    """The bound of integer components at which a whole vector's squared distance still is a 64-bit integer: 2^27 for 64 components."""
    return 1 << (62 - max(dims - 1, 1).bit_length()) // 2 - 1


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of non-negative integers below 2**bits (Skilling's transform, all rows at once)."""
    x = x.astype(np.uint64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] & np.uint64(1 << level)) != 0, flip ^ np.uint64((1 << level) - 1), flip)
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return out


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """The order of rows of integers along the curve; of many components the first 62 count, at as many bits as fit into 62."""
    x = points[:, :62].astype(np.float64)
    bits = max(1, min(10, 62 // x.shape[1]))
    low, high = x.min(0), x.max(0)
    cells = np.minimum((x - low) * ((1 << bits) / np.maximum(high - low, 1)), (1 << bits) - 1)
    return np.argsort(hilbert_index(cells, bits), kind="stable")


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each box (rows of low, high) and each entry whether it may be the nearest of a point in the box.

    An entry is out if it is farther than another from every point of the box: by the
    boxes' least and greatest distances, or because the entry nearest to the box's centre
    is nearer at each corner (the difference of two squared distances is linear).
    """
    nearest = np.zeros((len(low), len(entries)), np.int64)
    farthest, central = np.zeros_like(nearest), np.zeros_like(nearest)
    for j in range(entries.shape[1]):
        below, above = low[:, j, None] - entries[None, :, j], entries[None, :, j] - high[:, j, None]
        gap = np.maximum(np.maximum(below, above), 0)
        reach = np.maximum(np.abs(below), np.abs(above))
        nearest += gap * gap
        farthest += reach * reach
        central += (below - above) * (below - above)
    pivot = entries[central.argmin(1)]
    lead = np.zeros_like(nearest)  # the most by which the pivot is farther than the entry, over the box
    for j in range(entries.shape[1]):
        slope = 2 * (entries[None, :, j] - pivot[:, j, None])
        lead += np.maximum(slope * low[:, j, None], slope * high[:, j, None]) + pivot[:, j, None] ** 2 - entries[None, :, j] ** 2
    return (nearest <= farthest.min(1, keepdims=True)) & (lead >= 0)


def assign(points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, entries: np.ndarray, errors: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, int]:
    """For the parts of a chunk, in blocks: entry of each, its squared distance (if wanted), counts and sums by entry, and how many distances were computed."""
    listed = shortlist(low, high, entries)
    code, error = np.empty(len(points), np.int64), np.empty(len(points), np.int64) if errors else None
    count, total, done = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64), 0
    for b in range(len(low)):
        rows = slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS)
        some = np.flatnonzero(listed[b])
        part = points[rows]
        if len(some) == 1 and not errors:
            code[rows] = some[0]
            count[some[0]] += len(part)
            total[some[0]] += sums[b]
            continue
        distance = np.zeros((len(part), len(some)), np.int64)
        for j in range(entries.shape[1]):
            away = part[:, j, None] - entries[None, some, j]
            distance += away * away
        done += distance.size
        best = np.argmin(distance, 1)  # the first of equals: the lower index
        code[rows] = some[best]
        if errors:
            error[rows] = np.take_along_axis(distance, best[:, None], 1)[:, 0]
        else:
            np.add.at(count, some[best], 1)
            np.add.at(total, some[best], part)
    return code, error, count, total, done


_CHUNK = "ids array<long>, labels array<string>, points binary, at binary, low binary, high binary, sums binary"


def _chunks(vectors: DataFrame, dims: int, parts: int) -> DataFrame:
    """Rows (id, label, v) dealt into chunks: sorted and blocked by part position."""
    width, bound = dims // parts, largest_component(dims)

    def chunk(ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
        x = np.clip(np.floor(x * SCALE), -bound, bound).astype(np.int64)
        starts = np.arange(0, len(x), BLOCK_ROWS)
        points, at, low, high, sums = [], [], [], [], []
        for p in range(parts):
            part = x[:, p * width : (p + 1) * width]
            order = hilbert_order(part)
            part = part[order]
            points.append(part)
            at.append(order.astype(np.int32))
            low.append(np.minimum.reduceat(part, starts))
            high.append(np.maximum.reduceat(part, starts))
            sums.append(np.add.reduceat(part, starts))
        packed = [np.stack(a).tobytes() for a in (points, at, low, high, sums)]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), *[pa.array([b], pa.binary()) for b in packed]], ["ids", "labels", "points", "at", "low", "high", "sums"])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held, n = [], [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK_ROWS):
                piece = batch.slice(first, CHUNK_ROWS)
                ids += piece.column(0).to_pylist()
                labels += piece.column(1).to_pylist()
                held.append(piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, dims))
                n += piece.num_rows
                while n >= CHUNK_ROWS:
                    x = np.concatenate(held)
                    yield chunk(ids[:CHUNK_ROWS], labels[:CHUNK_ROWS], x[:CHUNK_ROWS])
                    ids, labels, held, n = ids[CHUNK_ROWS:], labels[CHUNK_ROWS:], [x[CHUNK_ROWS:]], n - CHUNK_ROWS
        if n:
            yield chunk(ids, labels, np.concatenate(held))

    return vectors.mapInArrow(run, _CHUNK)


class _Blocks:
    """The blocks of a chunk's row, by part position."""

    def __init__(self, batch: pa.RecordBatch, row: int, n: int, parts: int):
        self.n = n
        ints = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
        self.points = ints("points", np.int64).reshape(parts, n, -1)
        self.at = ints("at", np.int32).reshape(parts, n)
        blocks, width = -(-n // BLOCK_ROWS), self.points.shape[2]
        self.low, self.high, self.sums = (ints(name, np.int64).reshape(parts, blocks, width) for name in ("low", "high", "sums"))

    def assign(self, p: int, entries: np.ndarray, errors: bool) -> tuple:
        return assign(self.points[p], self.low[p], self.high[p], self.sums[p], entries, errors)


def refine(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the codebooks (parts x entries x width) after every part was assigned to its nearest entry."""
    parts, entries, width = books.shape
    shared = chunks.sparkSession.sparkContext.broadcast(books)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                blocks = _Blocks(batch, row, len(batch.column("ids")[row]), parts)
                for p in range(parts):
                    _, _, c, t, _ = blocks.assign(p, books[p], False)
                    count[p] += c
                    total[p] += t
        used = np.argwhere(count > 0)
        if len(used):
            p, e = used.T
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    tasks = chunks.mapInArrow(run, "part int, entry int, n long, total array<long>")
    # decimals: sums of very many vectors may leave 64 bits
    added = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(j)).cast("decimal(38,0)")).alias(f"t{j}") for j in range(width)])
    out = books.copy()
    for r in added.collect():
        out[r["part"], r["entry"]] = [int(r[f"t{j}"]) // r["n"] for j in range(width)]
    shared.unpersist()
    return out


def _coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts = len(books)
    shared = chunks.sparkSession.sparkContext.broadcast(books)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                blocks = _Blocks(batch, row, len(ids), parts)
                codes, errors = np.empty((blocks.n, parts), np.uint8), np.zeros(blocks.n, np.int64)
                for p in range(parts):
                    code, error, *_ = blocks.assign(p, books[p], True)
                    codes[blocks.at[p], p] = code
                    errors[blocks.at[p]] += error
                digits = codes.tobytes().hex()
                text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(run, "vec_id long, label string, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per vector that is whole: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(256 x). Vectors that are null or hold null or non-finite
    components are dropped, and so are those of another length than the commonest; a
    length that is no multiple of `parts` is an error. Integers beyond
    largest_component(length) either way count as that bound, which keeps all distances in
    64 bits. The codebooks start from the `entries` smallest vec_ids; rows of an equal id
    stand in the order of their vectors, rows without an id after all others. With fewer
    vectors the codebooks have as many entries. Repeated rows count each. A sum of errors
    that leaves 64 bits is null. Null labels are together. Other columns are not read; an
    empty table gives no rows. At most 256 entries, as codes are two digits a part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    read = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["label"].cast("string").alias("label"), vectors["embedding"].cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & whole)
    lengths = read.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = lengths[0]["n"] if lengths else 0
    if not dims:
        return read.limit(0).select(F.col("id").alias("vec_id"), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    if dims % parts:
        raise ValueError(f"vectors of {dims} components have no {parts} equal parts")
    read = read.filter(F.size("v") == dims)
    bound = largest_component(dims)
    first = [r["v"] for r in read.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()]
    books = np.clip(np.floor(np.array(first) * SCALE), -bound, bound).astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    chunks = scratch_table(_chunks(read, dims, parts), "vector-blocks")
    for _ in range(rounds):
        books = refine(chunks, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = scratch_table(_coded(chunks, books).withColumn("label_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))).drop("label"), "codes")
    by_label = scratch_table(coded.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors")
    out = salted_join(coded, by_label, "label_key", by_label.count(), broadcast_rows)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13(embeddings: DataFrame) -> DataFrame:
    return vector_codes(embeddings)


def _round(n: int) -> str:
    return f"""
a{n} AS (SELECT vec_id, part, entry, d FROM (SELECT d{n}.*, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS nth FROM
 (SELECT x.vec_id, x.part, b.entry, CAST(sum((x.c - b.c) * (x.c - b.c)) AS BIGINT) AS d FROM x JOIN b{n} b ON x.part = b.part AND x.j = b.j GROUP BY ALL) d{n}) WHERE nth = 1),"""


def _next(n: int) -> str:
    return f"""
m{n} AS (SELECT x.part, a.entry, x.j, sum(x.c) AS s, count(*) AS n FROM x JOIN a{n} a USING (vec_id, part) GROUP BY ALL),
b{n + 1} AS (SELECT part, entry, j, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM b{n} LEFT JOIN m{n} USING (part, entry, j)),"""


#: For distinct vec_ids and vectors of one length whose integers are within the bound.
ORACLE = f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
w AS (SELECT vec_id, unnest(e) AS y, unnest(range(len(e))) AS i, len(e) // {PARTS} AS width FROM v),
bad AS (SELECT DISTINCT vec_id FROM w WHERE y IS NULL OR NOT isfinite(y)),
x AS (SELECT vec_id, i // width AS part, i % width AS j, CAST(floor({SCALE} * y) AS BIGINT) AS c FROM w WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM x) ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS (SELECT part, entry, j, c FROM x JOIN first USING (vec_id)),{_round(0)}{_next(0)}{_round(1)}{_next(1)}{_round(2)}
book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM b2),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
labelled AS (SELECT coded.*, label FROM coded JOIN v USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM labelled, book
"""
