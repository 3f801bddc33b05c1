"""Whole jobs, exact order statistics and cross-validated ridge, on small hand-made frames."""

import datetime
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vintagepanel.functions import order
from vintagepanel.operators import assembly, blending, conformal, evaluation, panel, ridge, series, temporal, text
from vintagepanel.plans import assembly_queries, views

DAY = datetime.date


def test_last_event_is_found_however_old(spark):
    events = spark.createDataFrame([(1, DAY(2020, 1, 1), 1, "raise"), (1, DAY(2023, 12, 31), 2, "lower"), (1, DAY(2024, 1, 1), 3, "raise"), (2, DAY(2010, 5, 5), 4, "raise"), (2, None, 5, "lower"), (None, DAY(2020, 1, 1), 6, "raise")], "entity int, date date, event_id int, action string")
    origins = spark.createDataFrame([(1, DAY(2024, 1, 1)), (1, DAY(2023, 6, 1)), (2, DAY(2024, 1, 1)), (3, DAY(2024, 1, 1))], "entity int, origin date")
    got = {(r.entity, r.origin): r for r in temporal.signed_event_features(origins, events).collect()}
    a, b, c, d = got[1, DAY(2024, 1, 1)], got[1, DAY(2023, 6, 1)], got[2, DAY(2024, 1, 1)], got[3, DAY(2024, 1, 1)]
    assert (a.days_since, a.last_is_lower, a.last_is_raise, a.n_180, a.net_365) == (1, 1, 0, 1, -1)  # the event on the origin itself is not seen
    assert (b.days_since, b.last_is_raise, b.n_180) == (1247, 1, 0)
    assert (c.days_since, c.last_is_raise, c.n_180) == (4989, 1, 0) and (d.days_since, d.last_is_raise, d.n_180) == (None, 0, 0)


def test_latest_document_is_found_however_old(spark):
    docs = spark.createDataFrame([("a", DAY(2015, 1, 1), 1, "10-K", 10, 0.5), ("a", DAY(2015, 1, 1), 2, "8-K", 0, None)], "entity string, date date, doc_id int, form string, n_words int, net_tone double")
    origins = spark.createDataFrame([("a", DAY(2020, 1, 1)), ("a", DAY(2015, 1, 2)), ("b", DAY(2020, 1, 1))], "entity string, origin date")
    got = {(r.entity, r.origin): r for r in text.trailing_text_features(origins, docs, forms={"8k": ["8-K"]}).collect()}
    old, fresh, none = got["a", DAY(2020, 1, 1)], got["a", DAY(2015, 1, 2)], got["b", DAY(2020, 1, 1)]
    assert (old.latest_form, old.latest_date, old.docs_365, old.net_tone_365) == ("8-K", DAY(2015, 1, 1), 0, None)
    assert (fresh.docs_90, fresh.docs_8k_90, fresh.words_90) == (2, 1, 10) and fresh.net_tone_90 == pytest.approx(5 / 11)
    assert (none.latest_form, none.docs_90, none.words_365) == (None, 0, 0)


def test_estimates_of_several_origins_of_a_quarter(spark):
    targets = spark.createDataFrame([(1, 8096, DAY(2024, 1, d), 10.0, 0.0) for d in (2, 9)], "entity int, qi int, origin date, revenue double, ttm double")
    estimates = spark.createDataFrame([(1, 8096, DAY(2024, 1, 1), 5.0, 4.0, 6.0, 3), (1, 8096, DAY(2024, 1, 5), 8.0, 4.0, 6.0, 3)], "entity int, qi int, asof date, avg double, low double, high double, n int")
    got = {r.origin.day: r for r in text.estimate_features(targets, estimates).collect()}
    assert (got[2].est_avg, got[2].est_age, got[9].est_avg, got[9].est_age) == (5.0, 1, 8.0, 4) and got[9].est_to_ttm is None


def tiny_accounts(spark, n=14, bump=None):
    """Two entities of steady growth; bump changes what is after a quarter."""
    rows = [(e, "g", 8000 + i, (100.0 + 3 * i * (1 + k)) * (5.0 if bump is not None and 8000 + i > bump else 1.0)) for k, e in enumerate(("a", "b")) for i in range(n)]
    df = spark.createDataFrame(rows, "entity string, grp string, qi long, revenue double")
    return df.withColumns({"cost": F.col("revenue") * 0.5, "operating_income": F.col("revenue") * 0.3, "depreciation": F.col("revenue") * 0.1, "assets": F.col("revenue") * 2, "goodwill": F.col("revenue") * 0.2})


def test_panel_of_accounts_alone(spark):
    clean = series.clean_growth(tiny_accounts(spark))
    groups = spark.createDataFrame([("a", "x"), ("b", None)], "entity string, grp string")
    rows = assembly.build_panel(clean, groups, winsor=(0.0, 1.0), coverage=0.5).collect()
    assert {r.entity for r in rows} == {"a"} and len(rows) == 14 and {r.grp for r in rows} == {"x"}
    by_quarter = {r.qi: r for r in rows}
    x = [100.0 + 3 * i for i in range(14)]
    assert by_quarter[8009].y_annual == pytest.approx(sum(x[9:13]) / sum(x[5:9]) - 1) and by_quarter[8009].y_gm == pytest.approx(0.5) and by_quarter[8009].y_em == pytest.approx(0.4)
    assert by_quarter[8012].y_annual is None and "f_gross_margin" not in rows[0].asDict()  # no gross profit column: no such feature
    assert "n_180" not in rows[0].asDict() and "mkt_px" not in rows[0].asDict()


def test_features_see_nothing_after_their_quarter(spark):
    lists = []
    for bump in (None, 8008):
        x = assembly.build_features(series.clean_growth(tiny_accounts(spark, bump=bump)))
        lists.append({(r.entity, r.qi): tuple(v for k, v in sorted(r.asDict().items()) if k.startswith(("f_", "asof_"))) for r in x.filter("qi <= 8009").collect()})
    assert lists[0] == lists[1]


def test_financials_of_odd_facts(spark):
    kind = "entity int, concept string, tag string, prio int, form string, start date, end date, filed date, val double, fy int, fp string"
    q = lambda m: (DAY(2020, m, 1), DAY(2020, m + 2, 28))
    rows = [(1, "rev", "A", 0, "10-Q", *q(m), DAY(2020, m + 2, 28), float(m), 2020, f"Q{m // 3 + 1}") for m in (1, 4, 7)]
    rows += [(1, "rev", "A", 0, "10-K", DAY(2020, 1, 1), DAY(2020, 12, 31), DAY(2021, 2, 1), 100.0, 2020, "FY"), (1, "rev", "B", 1, "10-Q", *q(1), DAY(2021, 1, 1), 9.0, 2020, "Q1"), (2, "rev", "A", 0, "8-K", *q(1), DAY(2020, 5, 1), 5.0, 2020, "Q1"), (3, "rev", None, None, "10-Q", None, None, None, None, None, None)]
    got = {(r.entity, r.end): (r.rev, r.rev_source, r.fp) for r in assembly.collect_financials(spark.createDataFrame(rows, kind), ["rev"]).collect() if r.end}
    assert got == {(1, DAY(2020, 3, 28)): (1.0, "direct:A", "Q1"), (1, DAY(2020, 6, 28)): (4.0, "direct:A", "Q2"), (1, DAY(2020, 9, 28)): (7.0, "direct:A", "Q3"), (1, DAY(2020, 12, 31)): (88.0, "direct:A less three quarters", "FY")}
    assert assembly.collect_financials(spark.createDataFrame([], kind), ["rev"]).count() == 0


def test_financials_read_the_facts_once(spark, monkeypatch):
    kind = "entity int, concept string, tag string, prio int, form string, start date, end date, filed date, val double, fy int, fp string"
    q = lambda m: (DAY(2020, m, 1), DAY(2020, m + 2, 28))
    rows = [(1, "rev", "A", 0, "10-Q", *q(1), DAY(2020, 5, 1), 7.0, 2020, "FY"), (1, "rev", "B", 1, "10-Q", *q(1), DAY(2020, 6, 1), 9.0, 2019, "Q1")]
    cuts = []
    monkeypatch.setattr(assembly, "cut_lineage", lambda df: cuts.append(df) or df.localCheckpoint())
    x = assembly.collect_financials(spark.createDataFrame(rows, kind), ["rev"])
    assert len(cuts) == 1 and "form#" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.rev, r.fy, r.fp) for r in x.collect()] == [(7.0, 2019, "Q1")]  # the label is that of a fact which was not kept


@pytest.mark.parametrize("name", ["purged_scores", "year_ahead_targets"])
def test_accounts_read_the_lines_once(spark, sf_dir, monkeypatch, name):
    cuts = []
    monkeypatch.setattr(views, "cut_lineage", lambda df: cuts.append(df) or df.localCheckpoint(), raising=False)
    files = assembly_queries.QUERIES[name](spark, sf_dir).inputFiles()
    assert len(cuts) == 1 and not any("lineitem" in f for f in files)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.sampled_from([0.0, 1.0, 2.5, -3.0]), st.floats(-5, 5))), min_size=1, max_size=60))
def test_group_quantiles_are_exact(spark, rows):
    levels = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r.g: r.q for r in order.group_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", levels).collect()}
    for g in "ab":
        x = [v for k, v in rows if k == g and v is not None]
        assert (g not in got and not x) or got[g] == pytest.approx(np.quantile(x, levels), abs=1e-12)


def test_group_quantiles_in_narrow_ranges(spark, monkeypatch):
    """The exact pass over ranges, with a third of the rows tied."""
    monkeypatch.setattr(order, "_WHOLE", 100)
    rng = random.Random(5)
    x = [0.25 if rng.random() < 0.33 else rng.gauss(0, 1) for _ in range(20_000)]
    levels = [0.0, 0.01, 0.5, 0.6, 0.99, 1.0]
    got = order.group_quantiles(spark.createDataFrame([(v,) for v in x], "v double"), [], "v", levels).first()
    assert got.n == 20_000 and got.q == pytest.approx(np.quantile(x, levels), abs=1e-12)


@pytest.mark.parametrize("window", [None, 2])
def test_past_order_statistics_against_sorting(spark, window):
    rng = random.Random(window or 7)
    rows = [(rng.choice("ab"), 10 * rng.randint(1, 6), rng.choice([None, 1.0, 2.0, rng.random()])) for _ in range(400)]
    ranks = lambda n: [F.floor((n - 1) * 0.3), n - 1, n + 5]
    df = spark.createDataFrame(rows, "grp string, qi long, v double")
    for by in ([], ["grp"]):
        got = {(r["grp"] if by else None, r.qi): (r.n, r.v) for r in order.past_order_statistics(df, "v", ranks, by, window, bins=16).collect()}
        quarters = sorted({q for _, q, _ in rows})
        for i, q in enumerate(quarters):
            seen = quarters[:i] if window is None else quarters[max(0, i - window) : i]
            for g in "ab" if by else [None]:
                x = sorted(v for k, p, v in rows if p in seen and v is not None and g in (None, k))
                n, v = got[g, q]
                assert n == len(x) and v == ([x[math.floor((n - 1) * 0.3)], x[-1], None] if n else [None] * 3)


def test_conformal_quantile_at_its_edges(spark):
    df = spark.createDataFrame([(q, "g", float(s)) for q, s in ((1, 5), (2, 1), (2, 2), (3, 9), (4, 0))], "qi long, grp string, score double")
    got = {r.qi: (r.n_cal, r.q) for r in conformal.conformal_quantile(df, None, 0.5).collect()}
    assert got == {2: (1, 5.0), 3: (3, 2.0), 4: (4, 5.0)}
    assert {r.qi: r.q for r in conformal.conformal_quantile(df, None, 0.1).collect()} == dict.fromkeys((2, 3, 4), math.inf)


def test_ridge_penalty_is_that_of_cross_validation(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{e}", "g", 100 + q, *x.tolist(), float(x @ [1.0, 0.0, -0.5] + rng.standard_normal() * 2)) for q in range(14) for e in range(6) for x in [rng.standard_normal(3)]]
    df = spark.createDataFrame(rows, "entity string, grp string, qi long, a double, b double, c double, y double")
    penalties = (0.01, 1.0, 30.0, 1000.0)
    got = {r.qi: (r.penalty, r.beta) for r in ridge.coefficients(df, "y", ["a", "b", "c"], warmup=4, min_train=20, penalties=penalties).collect()}
    x, y, t = np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows]), np.array([r[2] for r in rows])

    def fit(rows, p):
        m, s = x[rows].mean(0), x[rows].std(0)
        z = (x[rows] - m) / s
        w = np.linalg.solve(z.T @ z + p * np.eye(3), z.T @ (y[rows] - y[rows].mean())) / s
        return np.concatenate([[y[rows].mean() - w @ m], w])

    assert set(got) == set(range(104, 114))
    for q, (penalty, beta) in got.items():
        past = t < q
        loss = {p: sum(((y[f] - np.column_stack([np.ones(f.sum()), x[f]]) @ fit(past & ~f, p)) ** 2).sum() for k in range(5) if (f := past & (t % 5 == k)).any()) for p in penalties}
        assert penalty == min(penalties, key=lambda p: loss[p]) and beta == pytest.approx(fit(past, penalty))


def test_prior_row_and_experts(spark):
    scores = spark.createDataFrame([("m", 5, 0.1, 0.2, 0.3, 0.4)], "model string, n long, mae double, rmse double, r2 double, dir_acc double")
    kind = "model_family string, feature_set string, scope string, n long, mae double, rmse double, r2 double, directional_accuracy double"
    prior = spark.createDataFrame([("tree", "all", "ALL", 9, 1.0, 2.0, 0.1, 0.5), (None, "few", "ALL", 9, 1.0, 1.5, 0.1, 0.5), ("x", "y", "SECTOR", 9, 0.0, 0.0, 1.0, 1.0)], kind)
    assert [r.model for r in evaluation.with_prior_best(scores, prior).orderBy("rmse").collect()] == ["m", "earlier best (?/few)"]
    assert evaluation.with_prior_best(scores, prior.limit(0)).count() == 1
    df = spark.createDataFrame([], "f_lag_yoy_1 double, f_gross_margin double, mac_x double, own_yoy double, b_group double, yoy double")
    assert panel.expert_columns(df, {"company": {"own history", "fundamentals"}, "macro": {"macro"}}) == {"company": ["f_lag_yoy_1", "f_gross_margin"], "macro": ["mac_x", "own_yoy"], "full": ["f_lag_yoy_1", "f_gross_margin", "mac_x", "own_yoy"]}


def test_forecasts_of_a_year_ahead_as_growth(spark):
    history = spark.createDataFrame([("a", q, 10.0) for q in range(100, 104)], "entity string, qi long, x double")
    ahead = spark.createDataFrame([("a", 104, h, 11.0) for h in range(4)] + [("a", 105, 0, 11.0), ("b", 104, 0, None)], "entity string, qi long, h int, f double")
    got = {(r.entity, r.qi): r.implied_year for r in blending.trailing_growth(ahead, history, "x", "f").collect()}
    assert got["a", 104] == pytest.approx(0.1) and got["a", 105] is None and got["b", 104] is None
