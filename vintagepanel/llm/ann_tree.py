"""Approximate nearest neighbours by cosine over a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is indexed. Leaves that stand for more
rows than they should, because the sample was too small to split them, are split again on
samples of their own, so the number of leaves follows that of the rows, up to MAX_LEAVES.
Equal vectors are collapsed first, each keeping its k+1 smallest ids, so a very common
vector is one entry. A query descends best-bin-first: a priority queue holds the nodes not
yet opened, nearest centre first, and the leaves are visited in the order in which they
come up. How many leaves are visited is calibrated before the search: a fixed number of
queries that the tree was not fitted on (where there are others) is compared with all
rows, and visits widen until the target share of their true neighbours is found. A query
whose leaves hold too few vectors goes on until they hold k others.

Neighbouring leaves are dealt out in groups of bounded size. A query is sent once to each
group in which it visits a leaf, with its leaves there, and meets the group's vectors a
chunk of queries at a time. Scores are computed on the original vectors in double
precision.
"""

import hashlib
import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vintagepanel.llm.common import scratch_table, small_or_shuffled

#: Vectors the tree, or a leaf that is split again, is fitted on, at most; rows of a group; distinct vectors gathered in a task before they are passed on.
SAMPLE, GROUP_ROWS, LOCAL_ROWS, BROADCAST_ROWS = 20_000, 2048, 50_000, 200_000
#: Children of a node, rows of a leaf, sampled vectors of a leaf, leaves (33 MB of centres in 64 dimensions), and queries compared with all rows to calibrate.
BRANCH, LEAF_ROWS, LEAF_SAMPLE, MAX_LEAVES, CALIBRATION = 8, 128, 24, 1 << 16, 256


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings them near 1: cosines stay what they are, and norms neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Node:
    centre: np.ndarray
    leaf: int = -1
    children: list["Node"] = field(default_factory=list)
    centres: np.ndarray | None = None


@dataclass
class Tree:
    root: Node
    leaves: int
    visits: int = 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of unit vectors, by the nearest centre at every level."""
        out = np.empty(len(x), np.int64)

        def down(node: Node, rows: np.ndarray) -> None:
            if node.leaf >= 0:
                out[rows] = node.leaf
                return
            nearest = np.argmax(x[rows] @ node.centres.T, 1)
            for i, child in enumerate(node.children):
                if len(part := rows[nearest == i]):
                    down(child, part)

        if len(x):
            down(self.root, np.arange(len(x)))
        return out

    def bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue, tick = [(0.0, 0, self.root)], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if node.leaf >= 0:
                yield node.leaf
                continue
            for child, near in zip(node.children, (node.centres @ q).tolist(), strict=True):
                tick += 1
                heapq.heappush(queue, (-near, tick, child))

    def visited(self, q: np.ndarray, sizes: dict[int, int], least: int) -> list[int]:
        """The leaves a query opens: as many as calibrated, and more until they hold this many vectors by the given sizes."""
        out, held = [], 0
        for leaf in self.bins(q):
            if len(out) >= self.visits and held >= least:
                break
            out.append(leaf)
            held += sizes.get(leaf, 0)
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Unit centres of a spherical k-means; as many as have members."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, 1)
        sums = np.zeros((len(centres), x.shape[1]))
        np.add.at(sums, nearest, x)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        centres = _unit(sums[some])
    return centres


def fit_tree(sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, seed: int = 3) -> Tree:
    """A tree over unit vectors, split until a leaf stands for leaf_rows of all rows or holds few of the sample."""
    rng = np.random.default_rng(seed)
    count = 0

    def grow(x: np.ndarray, centre: np.ndarray) -> Node:
        nonlocal count
        if len(x) > LEAF_SAMPLE and len(x) / len(sample) * rows > leaf_rows:
            centres = _kmeans(x, min(BRANCH, len(x)), rng)
            nearest = np.argmax(x @ centres.T, 1)
            used = np.unique(nearest)
            if len(used) > 1:
                return Node(centre, -1, [grow(x[nearest == i], centres[i]) for i in used], centres[used])
        count += 1
        return Node(centre, count - 1)

    root = grow(sample, np.zeros(sample.shape[1]))
    return Tree(root, count)


def graft(tree: Tree, splits: dict[int, Tree]) -> Tree:
    """The tree with some leaves replaced by trees, leaves numbered anew from left to right."""
    count = 0

    def copy(node: Node) -> Node:
        nonlocal count
        if node.leaf < 0:
            return Node(node.centre, -1, [copy(c) for c in node.children], node.centres)
        count += 1
        return Node(node.centre, count - 1)

    def walk(node: Node) -> Node:
        if node.leaf >= 0:
            if node.leaf in splits:
                return copy(Node(node.centre, -1, root.children, root.centres) if (root := splits[node.leaf].root).leaf < 0 else node)
            return copy(node)
        return Node(node.centre, -1, [walk(c) for c in node.children], node.centres)

    root = walk(tree.root)
    return Tree(root, count)


def calibrate(tree: Tree, queries: np.ndarray, leaves: list[list[int]], recall: float) -> int:
    """The fewest leaves to visit at which queries find this share of their true neighbours. leaves: those in which each query's neighbours are."""
    places = []
    for q, found in zip(queries, leaves, strict=True):
        order = np.empty(tree.leaves, np.int64)
        order[list(tree.bins(q))] = np.arange(tree.leaves)
        places += order[found].tolist()
    places.sort()
    return places[max(0, math.ceil(recall * len(places)) - 1)] + 1 if places else 1


def _prepared(vectors: DataFrame, every: int) -> DataFrame:
    """id, key (digest of the vector), v (float64), q (is a query) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1)
            dims = batch.column(2)[0].as_py() if batch.num_rows else 0
            keep, bodies = [], []
            for i, known in enumerate(rows.is_valid().to_pylist()):
                if not known or ids[i] is None or rows[i].values.null_count or len(rows[i].values) != dims:
                    continue
                v = rows[i].values.to_numpy().astype("<f8") + 0.0
                if np.isfinite(v).all() and v.any():
                    keep.append(ids[i])
                    bodies.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array([hashlib.blake2b(b, digest_size=16).digest() for b in bodies], pa.binary()), pa.array(bodies, pa.binary()), pa.array([k % every == 0 for k in keep], pa.bool_())], ["id", "key", "v", "q"])

    return vectors.mapInArrow(run, "id long, key binary, v binary, q boolean")


def _distinct(prepared: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: key, v, ids (the smallest), q (one of its rows is a query). Combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([h[0] for h in held.values()], pa.binary()), pa.array([h[1] for h in held.values()], pa.list_(pa.int64())), pa.array([h[2] for h in held.values()], pa.bool_())], ["key", "v", "ids", "q"])

        for batch in batches:
            for i, key, v, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = held.setdefault(key, [v, [], False])
                if i not in h[1]:
                    h[1] = sorted([*h[1], i])[:keep]
                h[2] = h[2] or q
            if len(held) >= LOCAL_ROWS:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = prepared.mapInArrow(run, "key binary, v binary, ids array<long>, q boolean")
    merged = parts.groupBy("key").agg(F.first("v").alias("v"), F.flatten(F.collect_list("ids")).alias("ids"), F.max("q").alias("q"))
    return merged.withColumn("ids", F.slice(F.array_sort(F.array_distinct("ids")), 1, keep))


def _matrix(column: pa.Array) -> np.ndarray:
    bodies = column.to_pylist()
    return np.frombuffer(b"".join(bodies), "<f8").reshape(len(bodies), -1) if bodies else np.zeros((0, 0))


def best_of_group(queries: np.ndarray, group: np.ndarray, ids: list[list[int]], keep: int, visited: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
    """The best keep (score, id) of a group for each query: largest cosine first, ties to the smaller id. visited: queries x rows, whether the query visits the row's leaf."""
    near = _unit(queries) @ _unit(group).T
    if visited is not None:
        near[~visited] = -2
    k = min(keep, near.shape[1])
    edge = np.maximum(-np.partition(-near, k - 1, axis=1)[:, k - 1] - 1e-9, -1.5)
    group, queries = _scaled(group), _scaled(queries)
    norms = np.sqrt((group * group).sum(1))
    out = []
    for q, row, least in zip(queries, near, edge, strict=True):
        some = np.flatnonzero(row >= least)
        exact = (group[some] * q).sum(1) / (norms[some] * np.sqrt((q * q).sum()))
        out.append(sorted(((float(s), i) for s, c in zip(exact, some, strict=True) for i in ids[c]), key=lambda x: (-x[0], x[1]))[:keep])
    return out


def _searched(units: DataFrame, keep: int) -> DataFrame:
    """Rows dealt by (grp, block), entries before queries, in; key, id, score out: each query's best of the groups of a task, combined there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, ids, leaves, group = None, [], [], [], None
        best: dict[bytes, list[tuple[float, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, i, s) for k, found in best.items() for s, i in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["key", "id", "score"])

        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            marks = list(zip(c["grp"].to_pylist(), c["block"].to_pylist(), c["side"].to_pylist(), strict=True))
            at = 0
            while at < len(marks):
                end = at
                while end < len(marks) and marks[end] == marks[at] and end - at < 512:
                    end += 1
                if marks[at][:2] != unit:
                    unit, held, ids, leaves, group = marks[at][:2], [], [], [], None
                v = _matrix(c["v"].slice(at, end - at))
                if marks[at][2] == 0:
                    held.append(v)
                    ids += c["ids"].slice(at, end - at).to_pylist()
                    leaves += [x[0] for x in c["leaves"].slice(at, end - at).to_pylist()]
                elif held:
                    if group is None:
                        group = np.concatenate(held)
                        numbered, row_leaf = np.unique(leaves, return_inverse=True)
                    asked = c["leaves"].slice(at, end - at).to_pylist()
                    opens = np.zeros((end - at, len(numbered)), bool)
                    for i, wanted in enumerate(asked):
                        opens[i, np.searchsorted(numbered, np.intersect1d(wanted, numbered))] = True
                    for key, found in zip(c["key"].slice(at, end - at).to_pylist(), best_of_group(v, group, ids, keep, opens[:, row_leaf]), strict=True):
                        before = best.get(key)
                        best[key] = sorted(before + found, key=lambda x: (-x[0], x[1]))[:keep] if before else found
                    if len(best) >= LOCAL_ROWS:
                        yield out()
                at = end
        if best:
            yield out()

    return units.repartition("grp", "block").sortWithinPartitions("grp", "block", "side").mapInArrow(run, "key binary, id long, score double")


def _assigned(distinct: DataFrame, tree: Tree) -> DataFrame:
    """key, v, ids and leaf of every distinct vector."""
    shared = distinct.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaf_of(_unit(_matrix(batch.column(1)))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return scratch_table(distinct.select("key", "v", "ids").mapInArrow(run, "key binary, v binary, ids array<long>, leaf long"), "index")


def _split_again(assigned: DataFrame, counted: dict[int, int], leaf_rows: int, sample: int) -> dict[int, Tree]:
    """Trees for the leaves that hold over twice leaf_rows rows, each fitted in one task on a sample of the leaf, at most `sample` vectors."""
    large = [(leaf, n, min(1.0, min(sample, math.ceil(n / leaf_rows) * LEAF_SAMPLE * 2) / n)) for leaf, n in counted.items() if n > 2 * leaf_rows]
    if not large:
        return {}
    wanted = assigned.sparkSession.createDataFrame(large, "leaf long, n long, share double")
    drawn = assigned.join(F.broadcast(wanted), "leaf").filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        points = _unit(np.frombuffer(b"".join(rows["v"]), "<f8").reshape(len(rows), -1))
        return pd.DataFrame({"leaf": rows["leaf"][:1], "tree": [pickle.dumps(fit_tree(points, int(rows["n"].iloc[0]), leaf_rows))]})

    grown = drawn.select("leaf", "n", "key", "v").groupBy("leaf").applyInPandas(grow, "leaf long, tree binary").collect()
    found = {r["leaf"]: pickle.loads(r["tree"]) for r in grown}
    return {leaf: t for leaf, t in found.items() if t.leaves > 1}


def _true_leaves(assigned: DataFrame, keys: list[bytes], queries: np.ndarray, k: int) -> list[list[int]]:
    """The leaves of the true k nearest other vectors of a fixed number of queries, by comparing them with all rows."""
    shared = assigned.sparkSession.sparkContext.broadcast((keys, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        best = np.full((len(q), k), -2.0)
        leaf = np.full((len(q), k), -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            near = q @ _unit(_matrix(batch.column(1))).T
            for j, key in enumerate(batch.column(0).to_pylist()):
                if key in index_of:
                    near[index_of[key], j] = -2
            near = np.concatenate([best, near], 1)
            leaves = np.concatenate([leaf, np.broadcast_to(batch.column(2).to_numpy(), (len(q), batch.num_rows))], 1)
            top = np.argpartition(-near, k - 1, 1)[:, :k]
            best, leaf = np.take_along_axis(near, top, 1), np.take_along_axis(leaves, top, 1)
        which, nth = np.nonzero(leaf >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(best[which, nth]), pa.array(leaf[which, nth].astype(np.int64))], ["q", "score", "leaf"])

    index_of = {key: i for i, key in enumerate(keys)}
    found = assigned.select("key", "v", "leaf").mapInArrow(run, "q long, score double, leaf long").filter("score > -2")
    nth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    out: list[list[int]] = [[] for _ in keys]
    for r in found.withColumn("nth", nth).filter(F.col("nth") <= k).collect():
        out[r["q"]].append(r["leaf"])
    return out


def index(distinct: DataFrame, k: int, recall: float, sample: int, leaf_rows: int) -> tuple[Tree, DataFrame, dict[int, int]] | None:
    """The tree with its calibrated visits, the table of vectors with their leaves, and the rows of each leaf; None without vectors."""
    n = distinct.count()
    by_hash = distinct.select("key", "v")
    drawn = by_hash.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    if not drawn:
        return None
    matrix = lambda rows: _unit(np.frombuffer(b"".join(r["v"] for r in rows), "<f8").reshape(len(rows), -1))
    leaf_rows = max(leaf_rows, math.ceil(n / MAX_LEAVES))
    tree = fit_tree(matrix(drawn), n, leaf_rows)
    while True:
        assigned = _assigned(distinct, tree)
        # a table of one row per leaf, of which there are MAX_LEAVES at most (about)
        counted = {r["leaf"]: r["count"] for r in assigned.groupBy("leaf").count().collect()}
        splits = _split_again(assigned, counted, leaf_rows, sample)
        if not splits:
            break
        tree = graft(tree, splits)
    # the far end of the order by hash: not in the sample, unless that is the whole table
    asked = by_hash.orderBy(F.desc(F.xxhash64("key")), "key").limit(CALIBRATION).collect()
    tree.visits = calibrate(tree, matrix(asked), _true_leaves(assigned, [bytes(r["key"]) for r in asked], matrix(asked), k), recall)
    return tree, assigned, counted


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, recall: float = 0.96, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found nearest each row whose id is divisible by `every`.

    Candidates are all rows with another id. Vectors that are null, zero, of another
    length than the commonest, or hold null or non-finite components, and rows without an
    id, take no part. Repeated rows of an id count once as candidates. Ties go to the
    smaller id. With fewer than k candidates, all are returned; an empty table gives no
    rows. Very large and very small components do no harm. Other columns are not read.
    """
    read = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("id"), vectors[f"`{vector_col}`"].cast("array<double>").alias("v"))
    lengths = read.filter("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = lengths[0]["n"] if lengths else 0
    prepared = scratch_table(_prepared(read.withColumn("dims", F.lit(dims)), every), "vectors")
    distinct = scratch_table(_distinct(prepared, k + 1), "distinct-vectors")
    made = index(distinct, k, recall, sample, leaf_rows)
    if made is None:
        return prepared.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    tree, assigned, counted = made
    # neighbouring leaves go into one group until it is full; a leaf too large for a group is dealt over blocks
    group_of, blocks_of, grp, held = {}, {}, 0, 0
    for leaf in sorted(counted):
        if held and held + counted[leaf] > GROUP_ROWS:
            grp, held = grp + 1, 0
        group_of[leaf] = grp
        held += counted[leaf]
        blocks_of[grp] = -(-held // GROUP_ROWS)
    shared = vectors.sparkSession.sparkContext.broadcast((tree, counted, group_of))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counted, group_of = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows: list[tuple] = []
                for i, q in enumerate(_unit(_matrix(part.column(1)))):
                    there: dict[int, list[int]] = {}
                    for leaf in tree.visited(q, counted, k + 1):
                        if leaf in group_of:
                            there.setdefault(group_of[leaf], []).append(leaf)
                    rows += [(i, g, leaves) for g, leaves in there.items()]
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["key", "v", "grp", "leaves"])

    spark = vectors.sparkSession
    blocks = spark.createDataFrame(list(blocks_of.items()), "grp long, blocks int")
    placed = spark.createDataFrame([(leaf, g, blocks_of[g]) for leaf, g in group_of.items()], "leaf long, grp long, blocks int")
    entries = assigned.join(F.broadcast(placed), "leaf").select("grp", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "key", "v", "ids", F.array("leaf").alias("leaves"))
    asked = distinct.filter("q").select("key", "v").mapInArrow(visit, "key binary, v binary, grp long, leaves array<long>").join(F.broadcast(blocks), "grp")
    asked = asked.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "key", "v", F.lit(None).cast("array<long>").alias("ids"), "leaves")
    found = _searched(entries.unionByName(asked), k + 1)
    best = found.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= k + 1)
    best = scratch_table(best.select("key", "id", "score"), "best")
    queries = prepared.filter("q").select(F.col("id").alias("query_id"), "key").distinct()
    paired = queries.join(small_or_shuffled(best, best.count(), broadcast_rows), "key").filter("id <> query_id")
    ranked = paired.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings)
