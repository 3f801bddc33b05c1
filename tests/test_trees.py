"""Trees of all vintages against plain recursive fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagepanel.operators import evaluation, trees

BOOST = trees.boosting(rounds=5, depth=3, rate=0.3, leaf=4, penalty=1.0, share=0.8)
FOREST = trees.forest(trees=6, depth=4, leaf=3)


def a_panel(spark, n_q=14, n_e=14):
    rng = np.random.default_rng(7)
    rows = []
    for e in range(n_e):
        for q in range(n_q):
            x, z = rng.normal(), rng.normal()
            y = 2.0 * (x > 0.3) - (z if e % 2 else 0.0) + 0.1 * rng.normal()
            rows.append((f"e{e}", "g" if e % 2 else "h", q, None if (e + q) % 11 == 0 else float(x), float(z), None if (e, q) == (1, 2) else float(y)))
    return spark.createDataFrame(rows, "entity string, grp string, qi long, x double, z double, y double").withColumn("bins", F.lit(0))


def forecasts(df):
    return {(r.entity, r.qi): r.y_pred for r in df.collect()}


def plain_tree(bins, g, w, number, spec, node=1, value=None):
    """(feature, cut, left, right) or a value, by recursion over every split."""
    total, weight = (g * w).sum(), w.sum()
    value = total / (weight + spec.penalty) if value is None else value
    best = None
    if node < 1 << spec.depth:
        for f in np.flatnonzero(trees.allowed_features(bins.shape[1], number, node, spec)):
            for cut in range(trees.BINS):
                left = bins[:, f] <= cut
                lw, rw = w[left].sum(), w[~left].sum()
                if lw >= spec.leaf and rw >= spec.leaf:
                    lg, rg = (g * w)[left].sum(), (g * w)[~left].sum()
                    gain = lg**2 / (lw + spec.penalty) + rg**2 / (rw + spec.penalty) - total**2 / (weight + spec.penalty)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, f, cut, left)
    if best is None:
        return value
    _, f, cut, left = best
    return (f, cut, plain_tree(bins[left], g[left], w[left], number, spec, 2 * node), plain_tree(bins[~left], g[~left], w[~left], number, spec, 2 * node + 1))


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_walk(panel, spec, warmup, least, purge):
    quarters = [r["qi"] for r in evaluation.qualifying_quarters(panel, "y", warmup, least, purge).orderBy("qi").collect()]
    rows = trees.quantised(panel, "y", ["x", "z"], ["g"], quarters[0] - purge).collect()
    bins = np.array([list(r["bins"]) for r in rows])
    y, qi, key = (np.array([r[c] for r in rows]) for c in ("y", "qi", "key"))
    out = {}
    for v in quarters:
        known, asked = qi < v - purge, np.flatnonzero(qi == v)
        base = y[known].mean() if spec.rounds > 1 else 0.0
        left, p = y[known] - base, np.full(len(asked), base)
        for r in range(spec.rounds):
            step = np.zeros(known.sum())
            for t in range(spec.together):
                number = r * spec.together + t
                w = trees.row_weights(key[known], number, spec)
                tree = plain_tree(bins[known][w > 0], left[w > 0], w[w > 0], number, spec)
                step += [plain_value(tree, b) for b in bins[known]]
                p += spec.rate * np.array([plain_value(tree, bins[i]) for i in asked])
            left = left - spec.rate * step
        out |= {(rows[i]["entity"], v): x for i, x in zip(asked, p, strict=True)}
    return out


@pytest.mark.parametrize(("spec", "purge"), [(BOOST, 1), (FOREST, 0)])
@pytest.mark.parametrize("whole_rows", [10**6, 0])
def test_walk_forward_equals_a_plain_fit(spark, monkeypatch, spec, purge, whole_rows):
    panel = a_panel(spark)
    if not whole_rows:  # rows in several chunks and partitions, histograms given out between models
        panel = panel.repartition(3, "entity")
        monkeypatch.setattr(trees, "CHUNK_ROWS", 40)
        monkeypatch.setattr(trees, "CELLS", 3000)
    got = forecasts(trees.walk_forward(panel, "y", ["x", "z"], spec, "t", groups=["g"], warmup=9, min_train=50, purge=purge, whole_rows=whole_rows))
    want = plain_walk(panel, spec, 9, 50, purge)
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_lineage_is_cut_between_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "CUT_EVERY", 2)
    panel = a_panel(spark, 11, 10)
    ask = lambda n: forecasts(trees.walk_forward(panel, "y", ["x"], BOOST, "t", warmup=8, min_train=30, whole_rows=n))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    a, b = ask(10**6), ask(0)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_no_quarter_and_constant_columns(spark):
    panel = a_panel(spark, 6, 5)
    assert trees.walk_forward(panel, "y", ["x"], FOREST, "t", warmup=8).collect() == []
    assert trees.gain_importance(panel, "y", ["x"], FOREST, warmup=8).collect() == []
    flat = panel.withColumns({"y": F.lit(3.0), "x": F.lit(None).cast("double")})
    got = forecasts(trees.walk_forward(flat, "y", ["x"], BOOST, "t", warmup=3, min_train=5))
    assert got and all(v == pytest.approx(3.0) for v in got.values())


@pytest.mark.parametrize("whole_rows", [10**6, 0])
def test_gains_show_the_planted_effect(spark, whole_rows):
    found = trees.gain_importance(a_panel(spark), "y", ["x", "z"], BOOST, ["g"], warmup=11, min_train=50, whole_rows=whole_rows)
    shares = {r.feature: r.s for r in found.groupBy("feature").agg(F.avg("share").alias("s")).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["x"] > 0.5 > shares["is_0"]


def test_defaults_are_whole():
    assert (trees.boosting().rounds, trees.boosting().rate, trees.boosting().depth) == (400, 0.03, 4)
    assert (trees.forest().together, trees.forest().depth, trees.forest().leaf) == (300, 9, 10)
