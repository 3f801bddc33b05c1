"""Linear models from moments against fits on the rows; trailing totals against all pairs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagepanel.operators import evaluation, ridge, temporal, text

COLUMNS = ["a", "b", "c", "flat"]


def a_panel(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{e}", "g", q, *(x := rng.normal(size=3)).tolist(), 2.0, float(1 + x[0] - 0.3 * x[1] + 0.5 * rng.normal())) for e in range(8) for q in range(12)]
    return spark.createDataFrame(rows, "entity string, grp string, qi long, a double, b double, c double, flat double, y double"), rows


def objective(x, y, intercept, slopes, sd, penalty, ratio):
    b = slopes * sd
    return ((y - intercept - x @ slopes) ** 2).mean() / 2 + penalty * (ratio * np.abs(b).sum() + (1 - ratio) / 2 * (b**2).sum())


def plain_net(x, y, penalty, ratio):
    """Proximal gradient steps on the standardised rows."""
    sd = x.std(0)
    live = sd > 1e-12
    z = (x[:, live] - x[:, live].mean(0)) / sd[live]
    b, step = np.zeros(live.sum()), 1 / (np.linalg.eigvalsh(z.T @ z / len(y)).max() + penalty)
    for _ in range(5000):
        g = z.T @ (z @ b - (y - y.mean())) / len(y) + penalty * (1 - ratio) * b
        b = b - step * g
        b = np.sign(b) * np.maximum(np.abs(b) - step * penalty * ratio, 0)
    slopes = np.zeros(len(sd))
    slopes[live] = b / sd[live]
    return np.concatenate([[y.mean() - slopes @ x.mean(0)], slopes])


def test_elastic_net_equals_a_fit_on_the_rows(spark):
    df, rows = a_panel(spark)
    got = ridge.coefficients(df, "y", COLUMNS, warmup=6, min_train=20, purge=1, folds=3, ratios=(0.2, 0.8), n_penalties=6).collect()
    assert len(got) == 6
    for r in got:
        known = np.array([row[2] < r.qi - 1 for row in rows])
        x, y, fold = (np.array([f(row) for row in rows])[known] for f in (lambda w: w[3:7], lambda w: w[7], lambda w: w[2] % 3))
        z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
        best = None
        for ratio in (0.8, 0.2):
            top = np.abs(z.T @ (y - y.mean())).max() / len(y) / ratio
            for penalty in np.geomspace(top, top * 1e-3, 6):
                loss = 0.0
                for k in range(3):
                    b = plain_net(x[fold != k], y[fold != k], penalty, ratio)
                    loss += ((y[fold == k] - b[0] - x[fold == k] @ b[1:]) ** 2).sum()
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, ratio, penalty)
        assert (r.ratio, r.n_train) == (best[1], known.sum()) and r.penalty == pytest.approx(best[2])
        assert r.beta == pytest.approx(plain_net(x, y, best[2], best[1]).tolist(), abs=1e-6)


def test_sets_equal_fits_of_their_own(spark):
    df, _ = a_panel(spark)
    sets = {"one": ["a"], "two": ["c", "a"], "all": COLUMNS}
    how = {"warmup": 6, "min_train": 20}
    key = lambda df: {(r.model, r.entity, r.qi): r.y_pred for r in df.collect()}
    got, want = key(ridge.walk_forward(df, "y", COLUMNS, sets=sets, **how)), {}
    for name, columns in sets.items():
        want |= key(ridge.walk_forward(df, "y", columns, name, **how))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = lambda s: ridge.coefficients(df, "y", COLUMNS, sets=s, **how)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert plan(sets) == plan({"one": ["a"]})  # the panel is read as often for many sets as for one


def test_shock_lasso(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    shocks = spark.createDataFrame([(q, float(2 * x[q, 0] + 0.1 * rng.normal())) for q in range(40)], "qi int, shock double")
    series = spark.createDataFrame([(q, *map(float, x[q]), None if q == 3 else 1.0) for q in range(40)], "qi int, a double, b double, c double, gap double")
    got = {r.feature: r for r in ridge.shock_lasso(shocks, series, ["a", "b", "c", "gap"]).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].coefficient == pytest.approx(2 * x[:, 0].std(), rel=0.05)
    assert abs(got["b"].coefficient) < 0.1 and got["a"].r2 > 0.95
    assert ridge.shock_lasso(shocks.limit(0), series, ["a"]).collect() == []


def test_verdicts(spark):
    rows = [(0.01, 0.3, 0.2), (0.01, 0.3, 0.9), (-0.01, 0.3, None), (0.01, 0.01, 0.2), (0.01, 0.01, 0.8), (-0.01, 0.01, None), (0.01, None, 0.2), (None, None, None)]
    got = [(r.verdict, r.note) for r in evaluation.verdict(spark.createDataFrame(rows, "mean_d double, p_value double, best_share double").coalesce(1)).collect()]
    note = "concentrated in one quarter"
    assert got == [("positive, insignificant", None), ("positive, insignificant", note), ("does not improve", None), ("helps", None), ("helps", note), ("does not improve", None), ("positive, insignificant", None), ("does not improve", None)]


def test_totals_equal_all_pairs(spark):
    rng = random.Random(1)
    day = dt.date(2024, 1, 1)
    events = [(rng.choice(["a", "b", None]), day + dt.timedelta(rng.randint(0, 400)) if rng.random() > 0.05 else None, rng.choice([None, 1, 2, 5])) for _ in range(300)]
    origins = [(rng.choice(["a", "b", "c", None]), day + dt.timedelta(rng.randint(0, 500))) for _ in range(60)]
    o = spark.createDataFrame(origins, "entity string, origin date")
    t = temporal.trailing_totals(o, spark.createDataFrame(events, "entity string, date date, v long"), "entity", "origin", "date", (30, 90), {"n": F.lit(1), "v": F.col("v")})
    got = {(r.entity, r.origin): tuple(r)[2:] for r in t.collect()}
    inside = lambda k, at, d: [v for e, on, v in events if k is not None and e == k and on and 0 < (at - on).days <= d]
    assert got == {(k, at): tuple(f(inside(k, at, d)) for d in (30, 90) for f in (len, lambda x: sum(v or 0 for v in x))) for k, at in set(origins)}
    assert temporal.with_totals(o, t, "entity", "origin").count() == len(origins)
    assert "age" not in t.columns and t._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_forward_words_rescue_within_words(spark):
    said = lambda word: f"Sales per share results {word} grew to 5 million about there"
    df = spark.createDataFrame([(1, said("unexpectedly")), (2, said("reforecasted")), (3, said("plainly")), (4, said("misguidance"))], "doc_id int, text string")
    assert sorted(r.doc_id for r in text.mentions(df, ["doc_id"]).collect()) == [1, 2]
