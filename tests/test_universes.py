"""The stacked panel of universes and targets against a run for each of them alone."""

import pytest
from pyspark.sql import functions as F

from tests.test_trees import a_panel
from vintagepanel.operators import evaluation, ridge, trees, universes

TARGETS = [universes.Target("one", "y", ("x", "z")), universes.Target("two", "w", ("z", "x"), 2)]
MEMBERS = [(f"e{e}", u) for e in range(14) for u in ("all", "even" if e % 2 == 0 else "odd")]


@pytest.fixture(scope="module")
def given(spark):
    p = a_panel(spark).withColumn("w", F.when(F.col("qi") % 5 > 0, F.col("z") * 2 + F.col("x"))).cache()
    m = spark.createDataFrame([*MEMBERS, MEMBERS[0], ("e1", None), (None, "all"), ("nobody", "all")], "entity string, universe string")
    return p, m, universes.stacked(p, TARGETS, ["a", "b"], m, ["x", "z"]).cache()


def rows(df):
    return sorted((r.model, r.entity, r.qi, round(r.y_true, 9), round(r.y_pred, 9)) for r in df.collect())


def test_forecasts_equal_those_of_each_universe_and_target_alone(given):
    p, _, stack = given
    naive = universes.naive_forecasts(stack, ["a", "b"], 2, 20).cache()
    fits = {t.name: ridge.walk_forward(stack.filter(F.col("target") == t.name), "y", ["x", "z"], by=universes.KEYS, warmup=2, min_train=20, purge=t.purge).cache() for t in TARGETS}
    assert {(r.universe, r.target) for r in naive.select(*universes.KEYS).distinct().collect()} == {(u, t) for u in ("all", "even", "odd") for t in ("one", "two")}
    for u in ("all", "even", "odd"):
        own = p.filter(F.col("entity").isin([e for e, v in MEMBERS if v == u]))
        for t in TARGETS:
            alone = evaluation.walk_forward_baselines(own.withColumns({"a": F.col(t.naive[0]), "b": F.col(t.naive[1])}), t.y, ["a", "b"], 2, 20, t.purge)
            here = (F.col("universe") == u) & (F.col("target") == t.name)
            assert rows(naive.filter(here)) == rows(alone) != []
            assert rows(fits[t.name].filter(here)) == rows(ridge.walk_forward(own, t.y, ["x", "z"], warmup=2, min_train=20, purge=t.purge)) != []


def test_scores_and_tests_equal_those_of_each_alone(given):
    _, _, stack = given
    naive = universes.naive_forecasts(stack, ["a", "b"], 2, 20).cache()
    six = {(r.universe, r.target, r.model): r for r in universes.six_metrics(naive, "a").collect()}
    dm = {(r.universe, r.target): r for r in universes.ablation_rows(naive, "a", "b").collect()}
    best = {(r.universe, r.target): r for r in universes.winners(evaluation.score(naive, universes.KEYS), F.col("model").isin("a", "expanding_mean")).collect()}
    for u, t in (("all", "one"), ("odd", "two")):
        own = naive.filter((F.col("universe") == u) & (F.col("target") == t))
        alone = {r.model: r for r in evaluation.six_metrics(own, own.filter("model = 'a'")).collect()}
        for m, r in alone.items():
            assert all(six[u, t, m][c] == pytest.approx(r[c]) for c in ("n", "mae", "rmse", "r2", "median_ae", "mape", "median_ape", "change_acc"))
        test = evaluation.dm_test(evaluation.per_quarter(evaluation.pair(own, "a", "b")).withColumn("whole", F.lit(0)), ["whole"], "d_se").first()
        assert (dm[u, t].n_q, dm[u, t].stat, dm[u, t].p_value) == pytest.approx((test.n_q, test.stat, test.p_value))
        assert best[u, t].best_model == "b" and best[u, t].rmse_model == pytest.approx(alone["b"].rmse) and best[u, t].r2_model == pytest.approx(alone["b"].r2)
        assert best[u, t].rmse_baseline == pytest.approx(min(alone["a"].rmse, alone["expanding_mean"].rmse))


def test_odd_members_and_empty_panels(given):
    p, m, stack = given
    assert stack.count() == 2 * 2 * p.count() and stack.filter("universe IS NULL").count() == 0
    nothing = universes.stacked(p.limit(0), TARGETS, ["a", "b"], m)
    assert universes.six_metrics(universes.naive_forecasts(nothing, ["a", "b"], 2, 20), "a").count() == 0
    assert universes.stacked(p, TARGETS, ["a", "b"], m.limit(0)).count() == 0


def test_importance_follows_what_each_target_is_made_of(given):
    p, _, _ = given
    made = p.withColumns({"by_x": 3 * F.col("x"), "by_z": F.when(F.col("z") > 0, 1.0).otherwise(0.0)})
    targets = [universes.Target("x", "by_x", ()), universes.Target("z", "by_z", (), 2)]
    got = {(r.target, r.feature): r.gain_pct for r in universes.target_importance(made, targets, ["x", "z"], trees.boosting(rounds=5, depth=2, rate=0.3, leaf=4), 2, 20).collect()}
    assert got["x", "x"] > 90 and got["z", "z"] > 90
    assert got["x", "x"] + got["x", "z"] == pytest.approx(100) and got["z", "x"] + got["z", "z"] == pytest.approx(100)
