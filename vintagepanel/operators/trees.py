"""Walk-forward forests and boosting: the trees of all test quarters grown side by side over quantised features.

Features are quantised once, by quantiles of the rows that the first test quarter may
train on, so no later value shapes a bin; nulls have a bin of their own. A tree is grown a
level at a time: histograms of gradients and weights by node, feature and bin give the
best split of every node. Each test quarter is a model of its own (a vintage), trained on
the rows that were known by then.

Where every vintage's training rows are within `whole_rows`, each vintage is grown by one
task. Beyond it rows stay where they are, in chunks: a level of all vintages and trees is
one aggregation over the chunks, whose tasks add up their histograms and whose groups
(model, node) choose splits, so only splits come to the driver. Both ways grow the same
trees with the same functions; draws of rows and features are hashes of row, tree and node.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagepanel.functions.sizes import cut_lineage
from vintagepanel.operators.evaluation import qualifying_quarters

#: Quantile bins of a feature (bin 0 is null), training rows of a vintage that one task may hold, rows of a chunk, cells of histograms that a task holds at a time, and rounds of boosting between two cuts of the lineage.
BINS, WHOLE_ROWS, CHUNK_ROWS, CELLS, CUT_EVERY = 64, 500_000, 20_000, 1 << 22, 10


@dataclass(frozen=True)
class Trees:
    """rounds of `together` trees each; each round's trees fit what the rounds before left over."""

    rounds: int
    together: int
    depth: int
    leaf: int
    rate: float
    penalty: float = 0.0
    #: Share of the rows that a tree sees; None draws as many rows as there are, with repeats.
    share: float | None = 1.0
    #: Features that a node may split: all of them, or a draw of about the root of their number.
    some_features: bool = False
    seed: int = 0


def boosting(rounds: int = 400, depth: int = 4, rate: float = 0.03, leaf: int = 20, penalty: float = 1.0, share: float = 0.8, seed: int = 0) -> Trees:
    return Trees(rounds, 1, depth, leaf, rate, penalty, share, False, seed)


def forest(trees: int = 300, depth: int = 9, leaf: int = 10, seed: int = 0) -> Trees:
    return Trees(1, trees, depth, leaf, 1 / trees, 0.0, None, True, seed)


@dataclass
class Tree:
    """Node i has children 2i and 2i+1, the root is 1; a node without a feature (-1) is a leaf. Rows whose bin is above `cut` go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 << depth
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            at[inner] = 2 * at[inner] + (bins[inner, f[inner]] > self.cut[at[inner]])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each 64-bit key and the salt."""
    x = keys.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


#: The distribution function of how often a row is drawn when as many rows are drawn as there are.
_POISSON = np.cumsum(np.exp(-1) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040]))


def row_weights(keys: np.ndarray, tree: int, spec: Trees) -> np.ndarray:
    if spec.share is not None and spec.share >= 1:
        return np.ones(len(keys))
    u = _uniform(keys, spec.seed * 1_000_003 + tree + 1)
    return (u < spec.share).astype(float) if spec.share is not None else np.searchsorted(_POISSON, u, side="right").astype(float)


def allowed_features(n: int, tree: int, node: int, spec: Trees) -> np.ndarray:
    """Which of n features a node may split."""
    if not spec.some_features:
        return np.ones(n, bool)
    drawn = _uniform(np.arange(n, dtype=np.uint64), (spec.seed * 1_000_003 + tree + 1) * 4096 + node)
    return np.argsort(np.argsort(drawn)) < max(1, round(n**0.5))


def histograms(bins: np.ndarray, place: np.ndarray, gradient: np.ndarray, weight: np.ndarray, places: int) -> np.ndarray:
    """Sums of gradient and weight by place, feature and bin: (2, places, features, BINS + 1)."""
    n = bins.shape[1]
    cell = (place[:, None] * n + np.arange(n)) * (BINS + 1) + bins
    size = places * n * (BINS + 1)
    add = lambda v: np.bincount(cell.reshape(-1), np.repeat(v, n), size).reshape(places, n, BINS + 1)
    return np.stack([add(gradient), add(weight)])


def best_split(g: np.ndarray, w: np.ndarray, allowed: np.ndarray, spec: Trees) -> tuple[int, int, float, float, float] | None:
    """feature, cut, gain and the values of the children, from a node's histograms (features x bins); None where no split helps. Of equal gains the first feature and bin."""
    left_g, left_w = np.cumsum(g, 1)[:, :-1], np.cumsum(w, 1)[:, :-1]
    all_g, all_w = g.sum(1, keepdims=True), w.sum(1, keepdims=True)
    right_g, right_w = all_g - left_g, all_w - left_w
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / (left_w + spec.penalty) + right_g**2 / (right_w + spec.penalty) - all_g**2 / (all_w + spec.penalty)
    gain = np.where((left_w >= max(spec.leaf, 1)) & (right_w >= max(spec.leaf, 1)) & allowed[:, None], gain, -np.inf)
    # gains that differ by rounding alone are equal, in whatever order rows were added up
    top = gain.max(initial=-np.inf)
    if not top > 1e-9 * max(float((all_g**2 / np.maximum(all_w, 1)).max()), 1e-12):
        return None
    f, b = np.unravel_index(int(np.argmax(gain >= top - 1e-9 * abs(top))), gain.shape)
    value = lambda g, w: float(g[f, b] / (w[f, b] + spec.penalty))
    return int(f), int(b), float(gain[f, b]), value(left_g, left_w), value(right_g, right_w)


def _grow(bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray, number: int, spec: Trees, gains: np.ndarray) -> Tree:
    """The tree of these rows; adds its splits' gains to those of the features."""
    tree, at = Tree.empty(spec.depth), np.ones(len(bins), np.int64)
    seen = weight > 0
    bins, gradient, weight, at = bins[seen], gradient[seen] * weight[seen], weight[seen], at[seen]
    tree.value[1] = gradient.sum() / (weight.sum() + spec.penalty) if len(bins) else 0.0
    for level in range(spec.depth):
        open_nodes, place = np.unique(at, return_inverse=True)
        if not len(open_nodes):
            break
        g, w = histograms(bins, place, gradient, weight, len(open_nodes))
        for i, node in enumerate(open_nodes.tolist()):
            found = best_split(g[i], w[i], allowed_features(bins.shape[1], number, node, spec), spec)
            if found:
                tree.feature[node], tree.cut[node], gain, tree.value[2 * node], tree.value[2 * node + 1] = found
                gains[found[0]] += gain
        f = tree.feature[at]
        on = f >= 0  # rows in leaves are done
        bins, gradient, weight, at, f = bins[on], gradient[on], weight[on], at[on], f[on]
        at = 2 * at + (bins[np.arange(len(bins)), f] > tree.cut[at])
    return tree


def fit_rows(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, spec: Trees) -> tuple[float, list[Tree], np.ndarray]:
    """Start value, trees and the features' gains of one vintage, from rows held in memory."""
    base = float(y.mean()) if spec.rounds > 1 else 0.0
    left, trees, gains = y - base, [], np.zeros(bins.shape[1])
    for r in range(spec.rounds):
        fresh = [_grow(bins, left, row_weights(keys, r * spec.together + t, spec), r * spec.together + t, spec, gains) for t in range(spec.together)]
        trees += fresh
        if spec.rounds > 1:
            left = left - spec.rate * sum(t.predict(bins) for t in fresh)
    return base, trees, gains


def predict(base: float, trees: list[Tree], bins: np.ndarray, spec: Trees) -> np.ndarray:
    out = np.full(len(bins), base)
    for t in trees:
        out += spec.rate * t.predict(bins)
    return out


def bin_edges(rows: DataFrame, features: list[str], groups: list[str]) -> list[np.ndarray]:
    """The upper edges of the bins of each feature (quantiles of rows), and of the group columns."""
    levels = [i / BINS for i in range(1, BINS)]
    known = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), levels, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [np.array(sorted(set(known[i] or [])), float) for i in range(len(features))] + [np.array([0.5])] * len(groups)


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Rows of values (nan: null) as bins; 0 is null."""
    return np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, side="left")) for e, c in zip(edges, x.T, strict=True)], 1).astype(np.uint8)


def values_of(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of arrays of doubles as a matrix; null: nan."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def quantised(panel: DataFrame, y: str, features: list[str], groups: list[str], before: int) -> DataFrame:
    """Labelled rows of panel: entity, grp, qi, y, key, bins (a byte a feature and group column)."""
    rows = panel.filter(F.col(y).isNotNull())
    edges = bin_edges(rows.filter(F.col("qi") < before), features, groups)
    read = rows.select("entity", "grp", "qi", F.col(y).cast("double").alias("y"), F.xxhash64("entity", "qi").alias("key"), F.array(*[F.col(f).cast("double") for f in features], *[(F.col("grp") == v).cast("double") for v in groups]).alias("x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = to_bins(values_of(batch.column(5), len(edges)), edges)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([b.tobytes() for b in bins], pa.binary())], ["entity", "grp", "qi", "y", "key", "bins"])

    return read.mapInArrow(run, f"{kinds}, bins binary")


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


def _per_task(rows: DataFrame, vintages: list[int], width: int, spec: Trees, purge: int, gains: bool) -> DataFrame:
    """A task a vintage: its forecasts, or (gains) its features' gains."""
    of = F.explode(F.filter(F.array(*[F.lit(v).cast("long") for v in vintages]), lambda v: (F.col("qi") < v - purge) | (F.col("qi") == v)))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vintage = int(pdf["vintage"].iloc[0])
        pdf = pdf.sort_values(["qi", "key"])  # the order of rows is no task's accident
        bins, trained = _matrix(pdf["bins"], width), (pdf["qi"] < vintage - purge).to_numpy()
        base, trees, gain = fit_rows(bins[trained], pdf["y"].to_numpy()[trained], pdf["key"].to_numpy()[trained], spec)
        if gains:
            return pd.DataFrame({"vintage": vintage, "feature": np.arange(width), "gain": gain})
        asked = (pdf["qi"] == vintage).to_numpy()
        return pdf.loc[asked, ["entity", "grp", "qi", "y"]].assign(y_pred=predict(base, trees, bins[asked], spec))

    schema = "vintage long, feature int, gain double" if gains else f"entity {kind['entity']}, grp {kind['grp']}, qi {kind['qi']}, y double, y_pred double"
    # few bytes and long work: a number of partitions of its own keeps them from being put together
    return rows.withColumn("vintage", of).repartition(len(vintages), "vintage").groupBy("vintage").applyInPandas(run, schema)


def _chunks(rows: DataFrame, width: int, n_vintages: int) -> DataFrame:
    """Rows in chunks, in the order of their quarters, with what every vintage has still to explain (left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK_ROWS):
                qi, y, key, bins = (batch.column(i).slice(first, CHUNK_ROWS) for i in range(4))
                order = np.argsort(qi.to_numpy(), kind="stable")
                left = np.repeat(y.to_numpy()[order][None], n_vintages, 0)
                blobs = [qi.to_numpy()[order].astype(np.int64), key.to_numpy()[order].astype(np.int64), _matrix(bins.to_pylist(), width)[order], left]
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in blobs], ["qi", "key", "bins", "left"])

    return rows.select("qi", "y", "key", "bins").mapInArrow(run, "qi binary, key binary, bins binary, left binary")


def _opened(batch: pa.RecordBatch, row: int, width: int, n_vintages: int) -> tuple[np.ndarray, ...]:
    get = lambda i, kind: np.frombuffer(batch.column(i)[row].as_buffer(), kind)
    return get(0, np.int64), get(1, np.int64), get(2, np.uint8).reshape(-1, width), get(3, np.float64).reshape(n_vintages, -1)


def _level(chunks: DataFrame, models: list[tuple[int, int, Tree]], level: int, vintages: list[int], width: int, spec: Trees, purge: int) -> list:
    """The splits of a level of these models (vintage's place, tree's number, tree so far): rows (model, node, feature, cut, gain, left, right, mean)."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(models)
    at_once = max(1, CELLS // ((1 << level) * width * (BINS + 1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        models = shared.value

        def given() -> Iterator[pa.RecordBatch]:
            for m, h in held.items():
                node, cell = np.divmod(np.flatnonzero(h[1].reshape(-1)), width * (BINS + 1))
                flat = h.reshape(2, -1)[:, np.flatnonzero(h[1].reshape(-1))]
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), m, np.int32)), pa.array((node + (1 << level)).astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(flat[0]), pa.array(flat[1])], ["model", "node", "cell", "g", "w"])
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                qi, key, bins, left = _opened(batch, row, width, len(vintages))
                for m, (v, number, tree) in enumerate(models):
                    n = int(np.searchsorted(qi, vintages[v] - purge))  # rows known by the vintage come first
                    at, w = tree.nodes(bins[:n]), row_weights(key[:n], number, spec)
                    rows = np.flatnonzero((at >= 1 << level) & (w > 0))
                    if len(rows):
                        h = histograms(bins[rows], at[rows] - (1 << level), left[v, rows] * w[rows], w[rows], 1 << level)
                        held[m] = held[m] + h if m in held else h
                    if len(held) >= at_once:
                        yield from given()
        yield from given()

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for m, node, cells in zip(pdf["model"], pdf["node"], pdf["cells"], strict=True):
                h = np.zeros((2, width * (BINS + 1)))
                for c in cells:
                    h[:, c["cell"]] = c["g"], c["w"]
                g, w = h.reshape(2, width, BINS + 1)
                found = best_split(g, w, allowed_features(width, shared.value[m][1], node, spec), spec)
                out.append((m, node, *(found or (-1, 0, 0.0, 0.0, 0.0)), float(g[0].sum() / (w[0].sum() + spec.penalty))))
            yield pd.DataFrame(out, columns=["model", "node", "feature", "cut", "gain", "left", "right", "mean"])

    cells = chunks.mapInArrow(add, "model int, node int, cell int, g double, w double").groupBy("model", "node", "cell").agg(F.sum("g").alias("g"), F.sum("w").alias("w"))
    nodes = cells.groupBy("model", "node").agg(F.collect_list(F.struct("cell", "g", "w")).alias("cells"))
    found = nodes.mapInPandas(choose, "model int, node int, feature int, cut int, gain double, left double, right double, mean double").collect()
    shared.unpersist()
    return found


def _explained(chunks: DataFrame, trees: list[list[Tree]], start: list[float], width: int, spec: Trees) -> DataFrame:
    """chunks less what the trees of each vintage, and its start value, explain."""
    shared = chunks.sparkSession.sparkContext.broadcast((trees, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, start = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                _, _, bins, left = _opened(batch, row, width, len(start))
                less = np.stack([predict(b, t, bins, spec) for b, t in zip(start, trees, strict=True)])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(row, 1) for i in range(3)], pa.array([(left - less).tobytes()], pa.binary())], ["qi", "key", "bins", "left"])

    return chunks.mapInArrow(run, chunks.schema)


def fit_chunks(rows: DataFrame, quarters: list, width: int, spec: Trees, purge: int) -> tuple[list[float], list[list[Tree]], np.ndarray]:
    """Start values, trees and gains (vintage x feature) of all vintages, grown over chunks that stay where they are."""
    vintages = [q["qi"] for q in quarters]
    start = [q["train_mean"] if spec.rounds > 1 else 0.0 for q in quarters]
    out: list[list[Tree]] = [[] for _ in vintages]
    gains = np.zeros((len(vintages), width))
    settled = cut_lineage(_chunks(rows, width, len(vintages)))
    if spec.rounds > 1:
        settled = _explained(settled, [[] for _ in vintages], start, width, spec)
    cut = 0
    for r in range(spec.rounds):
        chunks = _explained(settled, [t[cut:] for t in out], [0.0] * len(vintages), width, spec) if len(out[0]) > cut else settled
        if len(out[0]) - cut >= CUT_EVERY * spec.together and spec.rounds > 1:
            kept = cut_lineage(chunks)
            if kept is not chunks:  # there is a folder to cut in
                settled = chunks = kept
                cut = len(out[0])
        models = [(v, r * spec.together + t, Tree.empty(spec.depth)) for v in range(len(vintages)) for t in range(spec.together)]
        for level in range(spec.depth):
            for s in _level(chunks, models, level, vintages, width, spec, purge):
                v, _, tree = models[s["model"]]
                node = s["node"]
                if level == 0:
                    tree.value[1] = s["mean"]
                if s["feature"] >= 0:
                    tree.feature[node], tree.cut[node], tree.value[2 * node], tree.value[2 * node + 1] = s["feature"], s["cut"], s["left"], s["right"]
                    gains[v, s["feature"]] += s["gain"]
        for v, _, tree in models:
            out[v].append(tree)
    return start, out, gains


def _prepared(panel: DataFrame, y: str, features: list[str], groups: list[str] | None, warmup: int, min_train: int, purge: int) -> tuple[list, DataFrame | None]:
    quarters = qualifying_quarters(panel, y, warmup, min_train, purge).orderBy("qi").collect()
    return quarters, cut_lineage(quantised(panel, y, features, groups or [], quarters[0]["qi"] - purge)) if quarters else None


def walk_forward(panel: DataFrame, y: str, features: list[str], spec: Trees, name: str, groups: list[str] | None = None, warmup: int = 8, min_train: int = 100, purge: int = 0, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Forecasts (model, entity, grp, qi, y_true, y_pred) of every qualifying test quarter, each from trees of its own.

    Null features are a bin below all others; rows without a label are left out. Equal
    rows count each. Without a qualifying quarter there are no rows. Other columns of the
    panel are not read. The quarters (a calendar) and the trees come to the driver.
    """
    quarters, rows = _prepared(panel, y, features, groups, warmup, min_train, purge)
    shape = [F.lit(name).alias("model"), "entity", "grp", "qi"]
    if rows is None:
        return panel.limit(0).select(*shape, F.col(y).cast("double").alias("y_true"), F.lit(0.0).alias("y_pred"))
    width, vintages = len(features) + len(groups or []), [q["qi"] for q in quarters]
    if max(q["n_train"] for q in quarters) <= whole_rows:
        out = _per_task(rows, vintages, width, spec, purge, False)
    else:
        start, trees, _ = fit_chunks(rows, quarters, width, spec, purge)
        shared = panel.sparkSession.sparkContext.broadcast({v: (b, t) for v, b, t in zip(vintages, start, trees, strict=True)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                qi, bins = batch.column(2).to_numpy(), _matrix(batch.column(4).to_pylist(), width)
                p = np.zeros(len(qi))
                for v in np.unique(qi):
                    p[qi == v] = predict(*shared.value[int(v)], bins[qi == v], spec)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p)], ["entity", "grp", "qi", "y", "y_pred"])

        kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        out = rows.filter(F.col("qi").isin(vintages)).select("entity", "grp", "qi", "y", "bins").mapInArrow(run, f"entity {kind['entity']}, grp {kind['grp']}, qi {kind['qi']}, y double, y_pred double")
    return out.select(*shape, F.col("y").alias("y_true"), "y_pred")


def gain_importance(panel: DataFrame, y: str, features: list[str], spec: Trees, groups: list[str] | None = None, warmup: int = 8, min_train: int = 100, purge: int = 0, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """qi, feature, gain, share: how much of the splits' gains each feature (group columns as is_<i>) has in the trees of each test quarter."""
    quarters, rows = _prepared(panel, y, features, groups, warmup, min_train, purge)
    names = [*features, *(f"is_{i}" for i in range(len(groups or [])))]
    if rows is None:
        return panel.sparkSession.createDataFrame([], "qi long, feature string, gain double, share double")
    if max(q["n_train"] for q in quarters) <= whole_rows:
        found = _per_task(rows, [q["qi"] for q in quarters], len(names), spec, purge, True)
    else:
        _, _, gains = fit_chunks(rows, quarters, len(names), spec, purge)
        found = panel.sparkSession.createDataFrame([(q["qi"], i, float(g)) for q, row in zip(quarters, gains, strict=True) for i, g in enumerate(row)], "vintage long, feature int, gain double")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1)
    whole = found.groupBy("vintage").agg(F.sum("gain").alias("all"))
    return found.join(F.broadcast(whole), "vintage").select(F.col("vintage").alias("qi"), named.alias("feature"), "gain", F.try_divide("gain", "all").alias("share"))


def fitted(panel: DataFrame, y: str, features: list[str], spec: Trees, before: int, whole_rows: int = WHOLE_ROWS):
    """A function from tables with an array x of the features to the same with y_pred, of trees grown on the labelled rows of the quarters before `before`."""
    rows = panel.filter(F.col(y).isNotNull() & (F.col("qi") < before))
    edges = bin_edges(rows, features, [])
    known = rows.agg(F.count("*").alias("n_train"), F.avg(y).alias("train_mean")).first()
    binned = cut_lineage(quantised(rows, y, features, [], before))
    if known["n_train"] <= whole_rows:
        r = binned.orderBy("qi", "key").select("y", "key", "bins").toPandas()  # at most whole_rows rows of some bytes
        base, trees, _ = fit_rows(_matrix(r["bins"], len(features)), r["y"].to_numpy(float), r["key"].to_numpy(np.int64), spec) if len(r) else (0.0, [], None)
    else:
        (base,), (trees,), _ = fit_chunks(binned, [{"qi": before, "train_mean": known["train_mean"]}], len(features), spec, 0)
    shared = panel.sparkSession.sparkContext.broadcast((base, trees, edges))

    def apply(df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != "x"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, trees, edges = shared.value
            for batch in batches:
                p = predict(base, trees, to_bins(values_of(batch.column(batch.num_columns - 1), len(edges)), edges), spec)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*kept, "y_pred"])

        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        return df.select(*kept, "x").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "y_pred double"]))

    return apply
