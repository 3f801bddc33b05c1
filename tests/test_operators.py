"""Edge cases of the panel operators on small frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagepanel.functions import quarters, significance
from vintagepanel.operators import blending, conformal, correlation, evaluation, fundamentals, market, panel, ridge, series, temporal, text, universe
from vintagepanel.sources import feeds
from vintagepanel.streaming import events as stream_events


def day(s):
    return dt.date.fromisoformat(s)


def test_quarter_labels(spark):
    df = spark.createDataFrame([(day("2014-08-05"),)], "d date").withColumn("qi", quarters.quarter_index(F.col("d")))
    r = df.select("qi", quarters.quarter_label(F.col("qi")).alias("l"), quarters.quarter_start(F.col("qi")).alias("s"), quarters.quarter_end(F.col("qi")).alias("e")).first()
    assert (r.qi, r.l, r.s, r.e) == (2014 * 4 + 2, "2014Q3", day("2014-07-01"), day("2014-09-30"))
    back = spark.createDataFrame([("2014Q3",), ("2014Q5",)], "l string").select(quarters.quarter_from_label(F.col("l")).alias("q")).collect()
    assert [x.q for x in back] == [8058, None]


def test_grid_and_growth(spark):
    df = spark.createDataFrame([("a", 1, None, 10.0), ("a", 2, 7, 11.0), ("a", 5, None, 20.0)], "entity string, qi long, cik int, revenue double")
    g = series.gap_free(df, static=["cik"])
    assert [(r.qi, r.revenue, r.cik) for r in g.orderBy("qi").collect()] == [(1, 10.0, 7), (2, 11.0, 7), (3, None, 7), (4, None, 7), (5, 20.0, 7)]
    out = {r.qi: r for r in series.clean_growth(g).collect()}
    assert out[5].yoy == pytest.approx(1.0) and out[2].qoq == pytest.approx(0.1) and out[3].qoq is None and out[5].ttm is None


@pytest.mark.parametrize(("value", "kept"), [(-0.95, False), (3.0, False), (-0.9499, True), (2.999, True)])
def test_blanking_is_open(spark, value, kept):
    from vintagepanel.functions.guarded import between_open

    r = spark.range(1).select(between_open(F.lit(value), -0.95, 3.0).alias("x")).first()
    assert (r.x is not None) == kept


def test_windows_need_enough_values(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([0.1, None, 0.3, 0.4, 0.5])], "entity string, qi long, yoy double").withColumn("qoq", F.col("yoy"))
    out = {r.qi: r for r in series.growth_features(df).collect()}
    assert out[2].f_mean_4 is None and out[3].f_mean_4 == pytest.approx(0.2)
    assert out[4].f_exp_mean is None and out[4].f_exp_n == 3 and out[0].f_exp_n == 0


def test_future_does_not_reach_features(spark):
    rows = [("a", i, 100.0 + i * i) for i in range(16)]
    changed = [(e, q, x if q < 10 else x * 9) for e, q, x in rows]
    f = lambda r: {x.qi: x for x in series.growth_features(series.clean_growth(spark.createDataFrame(r, "entity string, qi long, revenue double"))).select("qi", "f_lag_yoy_1", "f_mean_4", "f_exp_mean", "f_zscore").collect()}
    a, b = f(rows), f(changed)
    assert all(a[q] == b[q] for q in range(11))


def test_leave_one_out(spark):
    df = spark.createDataFrame([("a", "g", 1, 1.0), ("b", "g", 1, 3.0), ("c", "g", 1, None), ("d", "h", 1, 5.0)], "entity string, grp string, qi long, x double")
    out = {r.entity: r.x_peer_mean for r in panel.peers(df, "x").collect()}
    assert out == {"a": 3.0, "b": 1.0, "c": 2.0, "d": None}


def test_group_medians_hold_no_group(spark):
    """Medians of two columns against percentile() on a group with most of the rows, ties, nulls, and rows without a key; the plan has no percentile of a group."""
    x = spark.range(60_000).select(F.col("id").alias("entity"), F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "cold").alias("grp"), F.when(F.col("id") % 77 > 0, F.col("id") % 2).alias("qi"), F.when(F.col("id") % 3 > 0, F.round(F.rand(5), 3)).alias("a"), (F.col("id") % 7).alias("b"))
    x = x.unionByName(x.limit(1).select("entity", F.lit("bare").alias("grp"), F.lit(1).cast("long").alias("qi"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("long").alias("b")))
    found = panel.group_median(x, {"a": "m_a", "b": "m_b"})
    assert found.count() == x.count() and "percentile(" not in found._jdf.queryExecution().toString()
    got = {(r.grp, r.qi): (r.m_a, r.m_b) for r in found.select("grp", "qi", "m_a", "m_b").distinct().collect()}
    want = {(r.grp, r.qi): (r.a, r.b) for r in x.dropna(subset=["grp", "qi"]).groupBy("grp", "qi").agg(F.median("a").alias("a"), F.median("b").alias("b")).collect()}
    assert {k: v for k, v in got.items() if None not in k} == want and all(v == (None, None) for k, v in got.items() if None in k)


def test_trim_keeps_all_if_nothing_is_dense(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "entity string, qi long")
    assert panel.trim(df, 1, 0.9, 10).count() == 2 and panel.trim(df, 2, 0.1, 2).count() == 1


def test_asof(spark):
    left = spark.createDataFrame([("a", day("2024-01-10"), 1), ("a", day("2024-03-12"), 2), ("z", day("2024-01-01"), 3), (None, day("2024-05-01"), 4)], "k string, d date, id int")
    right = spark.createDataFrame([("a", day("2024-01-10"), 5.0), ("a", day("2024-01-10"), 7.0), ("a", day("2024-01-11"), 9.0), (None, day("2024-01-01"), 1.0)], "k string, t date, v double")
    exact = {r.id: r.v for r in temporal.asof_join(left, right, "k", "d", "t", ["v"]).collect()}
    assert exact == {1: 7.0, 2: 9.0, 3: None, 4: None}
    strict = {r.id: r.v for r in temporal.asof_join(left, right, "k", "d", "t", ["v"], strict=True).collect()}
    assert strict[1] is None
    aged = lambda n: {r.id: r.v for r in temporal.asof_join(left, right, "k", "d", "t", ["v"], max_age_days=n).collect()}[2]
    assert aged(61) == 9.0 and aged(60) is None


def test_trailing_window_bounds(spark):
    origins = spark.createDataFrame([("a", day("2024-06-30"))], "entity string, origin date")
    ev = [("a", day("2024-06-30"), 1, "raise"), ("a", day("2024-04-01"), 2, "raise"), ("a", day("2024-03-31"), 3, "lower"), ("a", day("2023-06-30"), 4, "raise")]
    r = temporal.signed_event_features(origins, spark.createDataFrame(ev, "entity string, date date, event_id long, action string")).first()
    assert (r.raise_90, r.lower_90, r.n_180, r.net_180, r.net_365, r.days_since, r.last_is_raise) == (1, 0, 2, 0, 0, 90, 1)
    import datetime as dt

    said = [("e", dt.date(2024, 5, 1), 1, "raise"), ("e", dt.date(2024, 5, 20), 2, "mention"), ("e", dt.date(2024, 5, 25), 3, None)]
    june = spark.createDataFrame([("e", dt.date(2024, 6, 1))], "entity string, origin date")
    m = temporal.signed_event_features(june, spark.createDataFrame(said, "entity string, date date, event_id long, action string")).first()
    assert (m.n_180, m.days_since, m.last_is_raise) == (1, 31, 1)  # a mention is no event
    none = temporal.signed_event_features(origins, spark.createDataFrame([], "entity string, date date, event_id long, action string")).first()
    assert (none.n_180, none.days_since, none.last_is_lower) == (0, None, 0)


def test_restatements(spark):
    rows = [("a", "rev", "t1", 1, day("2024-03-31"), day("2024-05-01"), 1.0), ("a", "rev", "t0", 0, day("2024-03-31"), day("2024-04-01"), 2.0), ("a", "rev", "t0", 0, day("2024-03-31"), day("2024-06-01"), 3.0)]
    df = spark.createDataFrame(rows, "entity string, concept string, tag string, prio int, end date, filed date, val double")
    assert fundamentals.one_per_period(df).first().val == 3.0 and fundamentals.one_per_period(df, first_reported=True).first().val == 2.0


def test_facts_are_dealt_out_before_they_are_sorted(spark):
    df = spark.createDataFrame([("a", "rev", "t1", 1, day("2024-03-31"), day("2024-05-01"), 1.0)], "entity string, concept string, tag string, prio int, end date, filed date, val double")
    plan = fundamentals.one_per_period(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Sort [") < plan.index("Exchange")


@pytest.mark.parametrize(("n", "reported", "rows"), [(3, False, 1), (2, False, 0), (3, True, 0)])
def test_residual_quarter(spark, n, reported, rows):
    q = [("a", "r", day("2024-01-06"), day("2024-03-31"), 10.0), ("a", "r", day("2024-04-01"), day("2024-06-30"), 20.0), ("a", "r", day("2024-07-01"), day("2024-09-30"), 30.0)][:n]
    q += [("a", "r", day("2024-10-01"), day("2024-12-31"), 99.0)] * reported
    schema = "entity string, concept string, start date, end date, val double"
    out = fundamentals.derive_last_quarter(spark.createDataFrame(q, schema), spark.createDataFrame([("a", "r", day("2024-01-01"), day("2024-12-31"), 100.0)], schema)).collect()
    assert len(out) == rows and (not rows or (out[0].val, out[0].start) == (40.0, day("2024-10-01")))


def test_t_distribution():
    # fixed values: two-sided p of Student's t
    for t, n, p in ((2.0, 10, 0.07338803), (1.0, 1, 0.5), (0.0, 5, 1.0), (2.570582, 5, 0.05), (1.959964, 1e7, 0.05)):
        assert significance.two_sided_p(t, n) == pytest.approx(p, abs=2e-7)


def test_dm_against_numpy(spark):
    rng = np.random.default_rng(0)
    for n, lags in ((49, 3), (64, 3), (7, None)):
        d = rng.standard_normal(n) * 0.1 + 0.05
        got = evaluation.dm_test(spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(d)], "metric string, qi long, d double"), ["metric"]).first()
        if lags is None:
            assert got.stat is None and got.p_value is None
            continue
        e = d - d.mean()
        lrv = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
        want = d.mean() / math.sqrt(lrv / n) * math.sqrt((n - 1) / n)
        assert got.hac_lags == lags and got.stat == pytest.approx(want, rel=1e-12) and got.p_value == pytest.approx(significance.two_sided_p(want, n - 1))


def test_dm_constant_difference(spark):
    got = evaluation.dm_test(spark.createDataFrame([("m", i, 0.5) for i in range(9)], "metric string, qi long, d double"), ["metric"]).first()
    assert got.stat == pytest.approx(0.5 / math.sqrt(1e-12 / 9) * math.sqrt(8 / 9))


def test_conformal_quantile(spark):
    def q(scores, alpha=0.2):
        df = spark.createDataFrame([(1, float(s)) for s in scores] + [(2, 0.0)], "qi long, score double")
        return conformal.conformal_quantile(df, None, alpha).filter("qi = 2").first().q

    assert q(range(1, 10)) == 8.0 and q([1, 2, 3]) == math.inf and q(range(1, 5)) == 4.0


def _panel(spark, n_q=14, n_e=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"e{e}", "gh"[e % 2], q, float(x := rng.standard_normal()), float(z) if (z := rng.standard_normal()) > -1.5 else None, float(0.5 * x + rng.standard_normal() * 0.1)) for e in range(n_e) for q in range(n_q)]
    return spark.createDataFrame(rows, "entity string, grp string, qi long, x double, z double, y double"), rows


def test_ridge_against_direct_fit(spark):
    df, rows = _panel(spark)
    got = {(r.entity, r.qi): r.y_pred for r in ridge.walk_forward(df, "y", ["x", "z"], warmup=3, min_train=20, purge=1).collect()}
    want = {}
    for q in range(3, 14):
        train = [r for r in rows if r[2] < q - 1]
        if len(train) < 20:
            continue
        X, y = np.array([[r[3], r[4] or 0.0] for r in train]), np.array([r[5] for r in train])
        m, s = X.mean(0), X.std(0)
        b = np.linalg.solve(((X - m) / s).T @ ((X - m) / s) + np.eye(2), ((X - m) / s).T @ (y - y.mean()))
        want |= {(r[0], q): float(y.mean() + ((np.array([r[3], r[4] or 0.0]) - m) / s) @ b) for r in rows if r[2] == q}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_global_stack_against_search(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{e}", "g", q, float(y := rng.standard_normal()), float(y + rng.standard_normal()), float(0.3 * y + rng.standard_normal()), float(-y)) for e in range(10) for q in range(12)]
    df = spark.createDataFrame(rows, "entity string, grp string, qi long, y_true double, a double, b double, c double")
    got = {r.qi: np.array([r.w_a, r.w_b, r.w_c]) for r in blending.global_stack(df, "a", "b", "c").collect()}
    grid = np.array([(i, j, k) for i in np.arange(0, 1.01, 0.02) for j in np.arange(0, 1.01, 0.02) for k in (0.0, 0.02)])
    X, y = np.array([r[4:] for r in rows if r[2] < 11]), np.array([r[3] for r in rows if r[2] < 11])
    best = grid[np.argmin(((X @ grid.T - y[:, None]) ** 2).sum(0))]
    assert got[11] == pytest.approx(best / best.sum(), abs=0.03)


def test_aci_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{e}", "g", q, float(rng.standard_normal()), -0.5, 0.0, 0.5) for q in range(8) for e in range(30)]
    got = conformal.aci_schedule(spark.createDataFrame(rows, "entity string, grp string, qi long, y_true double, q10 double, q50 double, q90 double"), 0.2, 0.05, 60).orderBy("qi").collect()
    level, want = 0.2, []
    for q in range(8):
        past = sorted(max(-0.5 - r[3], r[3] - 0.5) for r in rows if r[2] < q)
        if len(past) < 60:
            want.append((q, len(past), 0.0, level))
            continue
        k = math.ceil((len(past) + 1) * (1 - level))
        width = past[k - 1]
        want.append((q, len(past), width, level))
        missed = np.mean([max(-0.5 - r[3], r[3] - 0.5) > width for r in rows if r[2] == q])
        level = min(0.6, max(0.01, level + 0.05 * (0.2 - missed)))
    assert [(r.qi, r.n_cal) for r in got] == [w[:2] for w in want]
    assert all(r.q == pytest.approx(w[2]) and r.alpha_used == pytest.approx(w[3]) for r, w in zip(got, want, strict=True))


def test_guard(spark):
    df = spark.createDataFrame([(5.0, 1.0, 0.1), (5.0, 1.0, None), (0.1, 0.01, 0.2), (5.0, None, 0.1)], "p double, ceiling double, f double")
    value, flag = blending.guard(F.col("p"), F.col("ceiling"), F.col("f"), 2.0, 0.5)
    assert [(r.v, r.g) for r in df.select(value.alias("v"), flag.alias("g")).collect()] == [(0.1, True), (5.0, False), (0.1, False), (0.1, True)]


def test_money_period_action(spark):
    said = ["$1,234.5 million", "2 bn", "none", "7"]
    assert [r.x for r in spark.createDataFrame([(s,) for s in said], "s string").select(text.amount(F.col("s")).alias("x")).collect()] == [1234.5e6, 2e9, None, 7.0]
    where = ["in Q3 2025 we", "2024 Q1, not Q2 2023", "the fourth quarter of 2026", "soon"]
    assert [r.x for r in spark.createDataFrame([(s,) for s in where], "s string").select(text.period(F.col("s")).alias("x")).collect()] == ["2025Q3", "2024Q1", "2026Q4", None]
    what = ["we lowered and raised", "Raised today", "we withdrew it and cut", "reduction", None]
    assert [r.x for r in spark.createDataFrame([(s,) for s in what], "s string").select(text.action(F.col("s")).alias("x")).collect()] == ["lower", "raise", "withdraw", "mention", "mention"]


def test_guidance_units_and_order(spark):
    docs = [(1, "Outlook: revenue of 6 to 5 billion"), (2, "tax and margin"), (3, "We expect sales of $3 million"), (4, None), (5, "")]
    got = {r.id: (r.low, r.high) for r in text.guidance(spark.createDataFrame(docs, "id int, text string"), ["id"]).collect()}
    assert got == {1: (5e9, 6e9), 3: (3e6, 3e6)}


def test_spaced_positions(spark):
    df = spark.createDataFrame([("a", day("2024-01-01") + dt.timedelta(i), i) for i in range(10)], "entity string, date date, doc_id int")
    assert sorted(r.doc_id for r in feeds.spaced_documents(df, 5).collect()) == [0, 2, 4, 7, 9]


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 9)], "k int, v string, w int")
    once = feeds.incremental_merge(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, feeds.incremental_merge(once, new, ["k"]).collect())) == [(1, "a", None), (2, "c", 9)]


def test_company_facts(spark):
    body = '{"cik":"7","facts":{"us-gaap":{"Revenues":{"units":{"USD":[{"start":"2024-01-01","end":"2024-03-31","val":5,"fy":2024,"fp":"Q1","form":"10-Q","filed":"2024-05-01"}]}},"Sales":{"units":{"EUR":[{"end":"2024-03-31","val":6,"form":"10-K","filed":"2024-05-02"}]}},"Other":{"units":{"USD":[]}}}}}'
    concepts = spark.createDataFrame([("revenue", "Revenues", 0, "USD"), ("revenue", "Sales", 1, "USD")], "concept string, tag string, prio int, unit string")
    got = feeds.facts_to_long(spark.createDataFrame([("x", body), ("bad", "{")], "entity string, json string"), concepts).orderBy("prio").collect()
    assert [(r.tag, r.unit, r.val, r.start) for r in got] == [("Revenues", "USD", 5.0, day("2024-01-01")), ("Sales", "EUR", 6.0, None)]


def test_company_facts_are_parsed_once(spark):
    raw = spark.createDataFrame([("x", "{")], "entity string, json string")
    concepts = spark.createDataFrame([("revenue", "Sales", 0, "USD")], "concept string, tag string, prio int, unit string")
    for x in (feeds.facts_to_long(raw, concepts), feeds.damaged_facts(raw)):
        assert x._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_nested_feeds(spark):
    est = spark.createDataFrame([("x", [{"date": "2024-03-31", "revenueAvg": "5"}], [{"fiscalDateEnding": "2024-12-31", "estimatedRevenueAvg": "20", "asof": "2024-01-01"}])], "entity string, quarterly array<map<string,string>>, annual array<map<string,string>>")
    assert [(r.period_type, r.fiscal_date, r.asof, r["avg"]) for r in feeds.flatten_estimates(est, "2024-02-02").collect()] == [("quarterly", "2024-03-31", "2024-02-02", 5.0), ("annual", "2024-12-31", "2024-01-01", 20.0)]
    news = spark.createDataFrame([("x", [("t", "now", 0.5, [("y", "0.1"), ("x", "0.9")])])], "entity string, feed array<struct<title:string,time:string,score:double,sentiments:array<struct<ticker:string,score:string>>>>")
    assert feeds.flatten_news(news).first().own_score == 0.9
    subs = spark.createDataFrame([("x", 7, ["1-2", "3-4"], ["8-K", "10-K"], ["2024-01-01", "2024-02-02"], ["a.htm", "b.htm"])], "entity string, id long, accession array<string>, form array<string>, filed array<string>, document array<string>")
    assert [r.url for r in feeds.filings_index(subs, ["10-K"], "2024-01-15", "https://host/data").collect()] == ["https://host/data/7/34/b.htm"]
    short = spark.createDataFrame([("BRK.B", "2024-01-15", "12", "x")], "ticker string, settlementDate string, currentShortPositionQuantity string, daysToCoverQuantity string")
    assert tuple(feeds.short_interest_rows(short).first()) == ("BRKB", day("2024-01-15"), 12.0, None)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,sector,role\n a ,Tech,selected\nb,Tech,backup\nc,Oil,\n")
    assert sorted(r.ticker for r in feeds.read_universe(spark, str(tmp_path / "u.csv")).collect()) == ["a", "c"]
    assert feeds.load(spark, str(tmp_path / "none")) is None
    assert not feeds.save(spark.createDataFrame([], "a int"), str(tmp_path / "e")) and feeds.save(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "t"))
    assert feeds.load(spark, str(tmp_path / "t")).count() == 1


def test_swap_keeps_the_number_selected(spark):
    drawn = spark.createDataFrame([("a", "g", 1, "selected"), ("b", "g", 2, "selected"), ("c", "g", 3, "backup"), ("d", "g", 4, "backup")], "entity string, grp string, draw int, role string")
    labelled = spark.createDataFrame([("a", 3), ("b", 50), ("c", 2), ("d", 40)], "entity string, n long")
    assert {r.entity: r.role for r in universe.coverage_swap(drawn, labelled, 20).collect()} == {"a": "dropped", "b": "selected", "c": "backup", "d": "selected"}


def test_calendar_returns(spark):
    rows = [("a", day("2024-01-01"), 10.0), ("a", day("2024-01-03"), 12.0), ("b", day("2024-01-02"), 5.0), ("a", day("2024-01-04"), 18.0)]
    got = {(r.entity, r.date.day): r.ret for r in market.calendar_returns(spark.createDataFrame(rows, "entity string, date date, px double")).collect()}
    assert got == {("a", 1): None, ("a", 3): None, ("b", 2): None, ("a", 4): pytest.approx(0.5)}


def test_stream_counts(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d, 12), "raise" if d % 2 else "lower") for d in range(1, 15)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, action string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_events.windowed_action_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.entity, r.window_start): tuple(r) for r in stream_events.windowed_action_counts(df).collect()}
    got = {(r.entity, r.window_start): tuple(r) for r in spark.table("counts").collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_damaged_documents_lose_themselves_alone(spark):
    good = '{"cik": "1", "facts": {"us-gaap": {"Sales": {"units": {"USD": [{"end": "2024-03-31", "val": 5, "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01"}]}}}}}'
    rows = [(1, good), (2, good[:-9]), (3, None), (4, "{}"), (5, '{"facts": {"us-gaap": {}}}'), (6, "[1"), (7, good), (8, "")]
    raw = spark.createDataFrame(rows, "entity int, json string")
    concepts = spark.createDataFrame([("revenue", "Sales", 0, "USD")], "concept string, tag string, prio int, unit string")
    kept = sorted(r.entity for r in feeds.facts_to_long(raw, concepts).collect())
    lost = {r.entity: r.reason for r in feeds.damaged_facts(raw).collect()}
    assert kept == [1, 7] and lost == {2: "not JSON", 3: "not JSON", 4: "no facts", 5: "no facts", 6: "not JSON", 8: "not JSON"}


def test_contexts_are_unbroken_runs(spark):
    values = [1.0, None, *map(float, range(2, 14))]
    df = spark.createDataFrame([("e", q, v) for q, v in enumerate(values)], "entity string, qi int, x double")
    got = {r.qi: r.ctx for r in blending.contexts(df, "x", most=10, least=8).collect()}
    for q in range(len(values)):
        run = []
        for v in reversed(values[:q]):
            if v is None:
                break
            run.insert(0, v)
        assert got[q] == (run[-10:] if len(run) >= 8 else None)
    ahead = blending.seasonal_forecast(blending.contexts(df, "x", most=10, least=8), 6).filter("qi = 10").orderBy("h").collect()
    rate = (6 + 7 + 8 + 9) / (2 + 3 + 4 + 5)
    assert [r.forecast for r in ahead] == pytest.approx([6 * rate, 7 * rate, 8 * rate, 9 * rate, 6 * rate**2, 7 * rate**2])


def test_universe_without_members(spark, tmp_path):
    (tmp_path / "u").mkdir()
    file = tmp_path / "u" / "a.csv"
    file.write_text("ticker,sector,role\n a , s, selected\n , s, \n b, s, backup\n")
    assert [r.ticker for r in feeds.read_universe(spark, str(tmp_path / "u")).collect()] == ["a"]
    file.write_text("ticker,sector,role\n , s, \n b, s, backup\n")
    with pytest.raises(ValueError, match="no members"):
        feeds.read_universe(spark, str(tmp_path / "u"))
    assert feeds.load(spark, str(tmp_path / "none")) is None


def test_stream_merge(spark, tmp_path):
    import os

    path = str(tmp_path / "out")
    batch = lambda a, b, v: spark.range(a, b).selectExpr("id AS k", f"{v} AS v")
    assert stream_events.read_merged(spark, path) is None
    stream_events.merge_batch(batch(0, 100, 1), 0, path, ["k"], 8)
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path + "/rows") for f in fs}
    first = files()
    stream_events.merge_batch(batch(7, 8, 2).withColumn("w", F.lit("x")), 1, path, ["k"], 8)
    assert first.items() <= files().items() and len({f.split("bucket=")[1].split("/")[0] for f in set(files()) - set(first) if f.endswith(".parquet")}) == 1
    once = sorted(map(tuple, stream_events.read_merged(spark, path).select("k", "v", "w").collect()))
    assert once == sorted((i, 2 if i == 7 else 1, "x" if i == 7 else None) for i in range(100))
    stream_events.merge_batch(batch(7, 8, 2).withColumn("w", F.lit("x")), 1, path, ["k"], 8)  # run again
    assert sorted(map(tuple, stream_events.read_merged(spark, path).select("k", "v", "w").collect())) == once
    stream_events.merge_batch(batch(0, 0, 3), 2, path, ["k"], 8)
    assert stream_events.read_merged(spark, path).count() == 100


def test_stream_merge_of_micro_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i) for i in range(9)], "k int, v int")
    rows.dropDuplicates(["k"]).write.parquet(str(tmp_path / "in"))
    write = lambda: stream_events.merge_writer(spark.readStream.schema("k int, v int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).start()
    for _ in range(2):
        q = write()
        q.processAllAvailable()
        q.stop()
        rows.limit(1).withColumn("v", F.lit(50)).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.k: r.v for r in stream_events.read_merged(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 3 and sum(v == 50 for v in got.values()) == 1


def test_rolling_sums_and_risk_are_stable(spark):
    rng = np.random.default_rng(4)
    n, days = 400, 30
    x = rng.normal(0, 0.01, n)
    x[40] = 1e6  # gone from every frame after row 69
    rows = [("a", i, float(v)) for i, v in enumerate(x) if i != 200] + [("b", i, float(v) if i % 50 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "entity string, cal long, ret double").repartition(3)
    got = {(r.entity, r.cal): r.s for r in market.rolling_sums(df, "entity", "cal", days, {"s": F.col("ret")}).collect()}
    for e in "ab":
        own = [(c, v or 0.0) for k, c, v in rows if k == e]
        for i, (c, _) in enumerate(own):
            want = None if i < days - 1 else sum(v for _, v in own[i - days + 1 : i + 1])
            assert got[e, c] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-12))
    bench = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(0, 0.01, n))], "cal long, rb double")
    rb = {r.cal: r.rb for r in bench.collect()}
    risk = {(r.entity, r.cal): (r.vol, r.beta) for r in market.rolling_risk(df, bench, days).collect()}
    for e in "ab":
        known = {c: v for k, c, v in rows if k == e}
        for c in known:
            frame = [known.get(i) for i in range(c - days + 1, c + 1)]
            if None in frame:
                assert risk[e, c] == (None, None)
            else:
                ys = [rb[i] for i in range(c - days + 1, c + 1)]
                assert risk[e, c][0] == pytest.approx(np.std(frame, ddof=1) * days**0.5, rel=1e-6)
                if 1e6 not in frame:
                    assert risk[e, c][1] == pytest.approx(np.cov(frame, ys)[0, 1] / np.var(ys, ddof=1), rel=1e-3, abs=1e-4)


def test_permutation_damage_of_any_model(spark):
    from vintagepanel.operators import learners, trees

    df, rows = _panel(spark, n_q=16, n_e=12)
    df = df.cache()
    models = [learners.linear_fitted(df, "y", ["x", "z"], 12), learners.linear_fitted(df, "y", ["x", "z"], 12, ratios=(0.5,)), trees.fitted(df, "y", ["x", "z"], trees.forest(20, 5, 3), 12), trees.fitted(df, "y", ["x", "z"], trees.forest(20, 5, 3), 12, whole_rows=0)]
    found = []
    for m in models:
        damage = {r.feature: r.damage for r in learners.permutation_importance(df, "y", ["x", "z"], m, 12, repeats=3, cell_rows=20).collect()}
        assert damage["x"] > 5 * abs(damage["z"]) and damage["x"] > 0
        found.append(damage)
    assert found[2] == pytest.approx(found[3])
    plan = lambda n: learners.permutation_importance(df.withColumns({f"f{i}": F.lit(0.0) for i in range(n)}), "y", ["x", *(f"f{i}" for i in range(n))], models[0], 12)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert plan(1) == plan(6)


def test_permutation_by_hand(spark):
    from vintagepanel.operators import learners

    df = spark.createDataFrame([(f"e{i}", 5, float(i), float(i)) for i in range(6)], "entity string, qi int, y double, x double")
    same = lambda t: t.withColumn("y_pred", F.coalesce(F.get("x", F.lit(0)), F.lit(0.0))).drop("x")
    (r,) = learners.permutation_importance(df, "y", ["x"], same, 5, repeats=4).collect()
    assert r.damage > 0  # the model is exact, so all error comes from the shuffle
    flat = learners.permutation_importance(df.withColumn("x", F.lit(1.0)), "y", ["x"], same, 5, repeats=2).collect()
    assert flat[0].damage == pytest.approx(0.0) and flat[0].damage_std == pytest.approx(0.0)


def test_association_importance_and_medians(spark):
    rows = [("a", q, float(q), 2.0 * q + 1, 5.0, None) for q in range(12)] + [("a", 12, None, 3.0, 5.0, None)]
    df = spark.createDataFrame(rows, "grp string, qi int, yoy double, exact double, flat double, hollow double")
    found = {r.feature: (r.r2, r.gain_pct) for r in evaluation.association_importance(df, ["yoy"], ["exact", "flat", "hollow"]).collect()}
    assert found["exact"] == (pytest.approx(1.0), pytest.approx(100.0)) and found["flat"] == found["hollow"] == (0.0, 0.0)
    nothing = evaluation.association_importance(df.limit(0), ["yoy"], ["exact"]).collect()
    assert [(r.r2, r.gain_pct) for r in nothing] == [(0.0, None)]
    # three entities a quarter, one of them far off: the median does not follow it
    wild = df.select("grp", "qi", (F.col("yoy") * -1000).alias("yoy"), "exact")
    typical = df.select("grp", "qi", "yoy", "exact")
    got = correlation.median_correlation(typical.unionByName(typical).unionByName(wild), "yoy", ["exact"]).collect()
    assert [(r.n, round(r.corr, 9)) for r in got] == [(12, 1.0)]
    filled = {r.column_name: (r.family, r.n_filled) for r in panel.column_dictionary(df).collect()}
    assert filled["yoy"][1] == 12 and filled["hollow"][1] == 0 and filled["qi"][1] == 13
