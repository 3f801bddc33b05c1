"""Queries of the whole jobs: wide accounts, features and the panel, each with the same in SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintagepanel.functions.sizes import cut_lineage
from vintagepanel.operators import assembly, evaluation, market, panel, series, temporal
from vintagepanel.plans import views as v
from vintagepanel.plans.panel_queries import _FEATURE_SQL, _FEATURES, _MATCH, _QUARTERS, quarterly_series, sql_round
from vintagepanel.plans.views import ACCOUNTS, BENCH, DAILY, SERIES, growth_sql, rolled, rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of suppliers from the lines: instants, quarters, years and forms that are not accepted."""
    li, line = v.table(spark, d, "lineitem"), F.col("l_linenumber")
    day = F.to_date("l_shipdate")
    end = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    year_end = F.make_date(F.year(day), F.lit(12), F.lit(31))
    end = F.when(line == 4, year_end).otherwise(end)
    start = F.when(line == 3, F.lit(None).cast("date")).when(line == 4, F.make_date(F.year(day), F.lit(1), F.lit(1))).otherwise(F.trunc(day, "quarter"))
    flag = F.col("l_returnflag")
    cells = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(f"l_{c}").alias("val")) for c in ("quantity", "extendedprice", "tax")])
    fp = F.when(line == 4, "FY").otherwise(F.concat(F.lit("Q"), F.quarter(end).cast("string")))
    rows = li.filter(~((line < 3) & (F.quarter(end) == 4) & (F.col("l_suppkey") % 5 > 0))).select(
        F.col("l_suppkey").alias("entity"), flag.alias("tag"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("prio"), F.when(line == 5, "8-K").when(line == 4, "10-K").otherwise("10-Q").alias("form"),
        start.alias("start"), end.alias("end"), day.alias("filed"), F.year(end).alias("fy"), fp.alias("fp"), "l_orderkey", "l_linenumber", F.explode(cells).alias("c"),
    )
    return rows.select("*", "c.*").drop("c").filter("NOT (concept = 'quantity' AND val < 10)")


_CONCEPTS = ["quantity", "extendedprice", "tax"]
_FACTS = """r0 AS (SELECT *, CAST(l_shipdate AS DATE) AS day, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS qe FROM lineitem),
r1 AS (SELECT l_suppkey AS entity, l_returnflag AS tag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS prio, CASE l_linenumber WHEN 5 THEN '8-K' WHEN 4 THEN '10-K' ELSE '10-Q' END AS form,
  CASE l_linenumber WHEN 3 THEN NULL WHEN 4 THEN make_date(year(day), 1, 1) ELSE CAST(date_trunc('quarter', day) AS DATE) END AS start, CASE WHEN l_linenumber = 4 THEN make_date(year(day), 12, 31) ELSE CAST(qe AS DATE) END AS "end",
  day AS filed, l_orderkey, l_linenumber, unnest(['quantity', 'extendedprice', 'tax']) AS concept, unnest([l_quantity, l_extendedprice, l_tax]) AS val FROM r0 WHERE NOT (l_linenumber < 3 AND quarter(qe) = 4 AND l_suppkey % 5 > 0)),
r2 AS (SELECT *, CAST(year("end") AS INTEGER) AS fy, CASE WHEN l_linenumber = 4 THEN 'FY' ELSE 'Q' || CAST(quarter("end") AS VARCHAR) END AS fp,
  CASE WHEN start IS NULL THEN 'instant' WHEN "end" - start BETWEEN 60 AND 100 THEN 'quarterly' WHEN "end" - start BETWEEN 330 AND 380 THEN 'annual' END AS kind FROM r1 WHERE NOT (concept = 'quantity' AND val < 10) AND form IN ('10-Q', '10-K')),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, concept, "end", kind = 'annual' ORDER BY prio, filed DESC, tag, l_orderkey, l_linenumber) AS n FROM r2 WHERE kind IS NOT NULL) WHERE n = 1),
dq AS (SELECT y.entity, y.concept, y."end", y.val - sum(q.val) AS val, y.filed, y.tag || ' less three quarters' AS tag FROM one y JOIN one q ON y.entity = q.entity AND y.concept = q.concept AND y.kind = 'annual' AND q.kind = 'quarterly'
  AND q.start >= y.start - 8 AND q."end" <= y."end" + 8 AND q."end" < y."end" - 20 WHERE NOT EXISTS (SELECT 1 FROM one k WHERE k.kind = 'quarterly' AND k.entity = y.entity AND k.concept = y.concept AND k."end" = y."end")
  GROUP BY y.entity, y.concept, y."end", y.val, y.filed, y.tag HAVING count(*) = 3 AND count(DISTINCT q."end") = 3),
al AS (SELECT entity, concept, "end", filed, tag, val FROM one WHERE kind <> 'annual' UNION ALL SELECT entity, concept, "end", filed, tag, val FROM dq),
wd AS (SELECT entity, "end", arg_max(val, (filed, tag)) FILTER (WHERE concept = 'quantity') AS quantity, arg_max(val, (filed, tag)) FILTER (WHERE concept = 'extendedprice') AS extendedprice, arg_max(val, (filed, tag)) FILTER (WHERE concept = 'tax') AS tax,
  max(filed) AS filed, arg_max(tag, (filed, tag)) FILTER (WHERE concept = 'quantity') AS qt FROM al GROUP BY 1, 2),
lb AS (SELECT entity, "end", arg_min({'fy': fy, 'fp': fp}, (CASE WHEN fp = 'FY' THEN 5 ELSE CAST(substr(fp, 2, 1) AS INTEGER) END, fy, fp)) AS l FROM r2 WHERE kind IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {_FACTS} SELECT wd.entity, wd."end", l.fy, l.fp, filed, round(coalesce(quantity, extendedprice + tax), 4) AS quantity, round(extendedprice, 4) AS extendedprice, round(tax, 4) + 0.0e0 AS tax,
  CASE WHEN quantity IS NULL AND extendedprice + tax IS NOT NULL THEN 'proxy:extendedprice+tax' WHEN quantity IS NULL THEN 'missing' ELSE 'direct:' || qt END AS quantity_source FROM wd LEFT JOIN lb ON wd.entity = lb.entity AND wd."end" = lb."end" """)
def collect_financials(spark: SparkSession, d: str) -> DataFrame:
    x = assembly.collect_financials(facts(spark, d), _CONCEPTS, ("extendedprice", "tax"), ties=("tag", "l_orderkey", "l_linenumber"))
    return rounded(x, _CONCEPTS, 4).select("entity", "end", "fy", "fp", "filed", *_CONCEPTS, "quantity_source")


_LEVELS = {
    "gross_margin": "gross_profit / nullif(revenue, 0)", "operating_margin": "operating_income / nullif(revenue, 0)", "net_margin": "net_income / nullif(revenue, 0)", "ebitda_margin": "(operating_income + depreciation) / nullif(revenue, 0)",
    "research_share": "research / nullif(revenue, 0)", "overhead_share": "overhead / nullif(revenue, 0)", "capex_share": "capex / nullif(revenue, 0)", "cash_share": "operating_cash / nullif(revenue, 0)", "turnover": "revenue / nullif(assets, 0)",
    "log_revenue": "CASE WHEN revenue > 0 THEN ln(revenue) END",
}
_BUILT = f"""{ACCOUNTS}, {growth_sql('accounts')}, {_FEATURE_SQL},
lv AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _LEVELS.items())}, goodwill / nullif(lag(goodwill, 1) OVER w, 0) - 1 AS gup, goodwill - lag(goodwill, 1) OVER w AS grise FROM g WINDOW w AS (PARTITION BY entity ORDER BY qi)),
lw AS (SELECT *, grise / nullif(assets, 0) AS jump, CASE WHEN coalesce(gup > 0.05e0 AND grise > 0, false) THEN 1e0 ELSE 0e0 END AS flag FROM lv),
bf AS (SELECT lw.*, {', '.join(f'lag({n}, 1) OVER w AS f_{n}' for n in _LEVELS)}, {', '.join(f'lag({n}, 1) OVER w - lag({n}, 5) OVER w AS f_{n}_chg4' for n in assembly.CHANGES)},
  (lag(deferred, 1) OVER w - lag(deferred, 5) OVER w) / nullif(lag(revenue, 5) OVER w, 0) AS f_deferred_chg, lag(deferred, 1) OVER w / nullif(lag(ttm, 1) OVER w, 0) AS f_deferred_share,
  lag(receivables, 1) OVER w / nullif(lag(receivables, 5) OVER w, 0) - 1 - lag(yoy, 1) OVER w AS f_receivables_gap, lag(jump, 1) OVER w AS f_jump, max(flag) OVER (PARTITION BY entity ORDER BY qi ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS f_recent,
  {', '.join(f'lag({c}, 1) OVER w AS asof_{c}' for c in assembly.AS_OF)} FROM lw WINDOW w AS (PARTITION BY entity ORDER BY qi))"""
_BUILT_COLUMNS = [*(f"f_{n}" for n in _LEVELS), *(f"f_{n}_chg4" for n in assembly.CHANGES), "f_deferred_chg", "f_deferred_share", "f_receivables_gap", "f_jump", "f_recent", *(f"asof_{c}" for c in assembly.AS_OF)]


@query(f"""WITH {_BUILT} SELECT bf.entity, bf.qi, f.f_exp_n, {', '.join(f'round(f.{c}, 6) + 0.0e0 AS {c}' for c in _FEATURES)}, {', '.join(f'round(bf.{c}, 4) + 0.0e0 AS {c}' for c in _BUILT_COLUMNS)} FROM bf JOIN f ON bf.entity = f.entity AND bf.qi = f.qi""")
def build_features(spark: SparkSession, d: str) -> DataFrame:
    x = assembly.build_features(series.clean_growth(v.accounts(spark, d)))
    return rounded(rounded(x, _FEATURES), _BUILT_COLUMNS, 4).select("entity", "qi", "f_exp_n", *_FEATURES, *_BUILT_COLUMNS)


_T = [f"{k}_{n}" for n in ("annual", "gm", "em") for k in ("y",)] + [f"b_{n}_{k}" for n in ("annual", "gm", "em") for k in ("persistence", "mean", "group")] + ["b_group"]


def _margin_sql(name: str, part: str, low: str, high: str) -> str:
    return f"""{name}0 AS (SELECT entity, qi, CASE WHEN count({part}) OVER w4 = 4 THEN sum({part}) OVER w4 END / nullif(CASE WHEN count(revenue) OVER w4 = 4 THEN sum(revenue) OVER w4 END, 0) AS m FROM g WINDOW w4 AS (PARTITION BY entity ORDER BY qi ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
{name}1 AS (SELECT entity, qi, lead(m, 3) OVER w AS y, lag(m, 1) OVER w AS p FROM {name}0 WINDOW w AS (PARTITION BY entity ORDER BY qi)),
{name} AS (SELECT entity, qi, CASE WHEN y > {low} AND y < {high} THEN y END AS y_{name}, CASE WHEN p > {low} AND p < {high} THEN p END AS b_{name}_persistence, {rolled('avg', 'p', 'UNBOUNDED PRECEDING', 'CURRENT ROW', 2)} AS b_{name}_mean FROM {name}1)"""


_TARGETS = f"""{_BUILT},
an0 AS (SELECT entity, qi, lead(ttm, 3) OVER w / nullif(lag(ttm, 1) OVER w, 0) - 1 AS y, lag(ttm, 1) OVER w / nullif(lag(ttm, 5) OVER w, 0) - 1 AS p FROM g WINDOW w AS (PARTITION BY entity ORDER BY qi)),
an AS (SELECT entity, qi, CASE WHEN y > -0.95e0 AND y < 3e0 THEN y END AS y_annual, CASE WHEN p > -0.95e0 AND p < 3e0 THEN p END AS b_annual_persistence, {rolled('avg', 'p', 'UNBOUNDED PRECEDING', 'CURRENT ROW', 2)} AS b_annual_mean FROM an0),
{_margin_sql('gm', 'coalesce(gross_profit, revenue - cost)', '-0.5e0', '1e0')},
{_margin_sql('em', '(operating_income + depreciation)', '-1e0', '1e0')},
bs AS (SELECT bf.*, f.* EXCLUDE (entity, grp, qi, yoy), lag(bf.yoy, 1) OVER w AS b_persistence, an.* EXCLUDE (entity, qi), gm.* EXCLUDE (entity, qi), em.* EXCLUDE (entity, qi)
  FROM bf JOIN f ON bf.entity = f.entity AND bf.qi = f.qi JOIN an ON bf.entity = an.entity AND bf.qi = an.qi JOIN gm ON bf.entity = gm.entity AND bf.qi = gm.qi JOIN em ON bf.entity = em.entity AND bf.qi = em.qi WINDOW w AS (PARTITION BY bf.entity ORDER BY bf.qi)),
tt AS (SELECT *, median(b_persistence) OVER w AS b_group, median(b_annual_persistence) OVER w AS b_annual_group, median(b_gm_persistence) OVER w AS b_gm_group, median(b_em_persistence) OVER w AS b_em_group FROM bs WINDOW w AS (PARTITION BY grp, qi))"""


@query(f"WITH {_TARGETS} SELECT entity, grp, qi, {sql_round(_T)} FROM tt")
def year_ahead_targets(spark: SparkSession, d: str) -> DataFrame:
    x = assembly.targets(series.clean_growth(v.accounts(spark, d)))
    return rounded(x, _T).select("entity", "grp", "qi", *_T)


_P = ["mae", "rmse", "r2", "dir_acc"]


def _purged_sql(name: str) -> str:
    names = ["persistence", "mean", "group"]
    return f"""p_{name} AS (SELECT qi, count(*) AS n, sum(y_{name}) AS s FROM tt WHERE y_{name} IS NOT NULL GROUP BY qi),
q_{name} AS (SELECT qi, row_number() OVER (ORDER BY qi) AS i, coalesce(sum(n) OVER w, 0) AS n, sum(s) OVER w AS s FROM p_{name} WINDOW w AS (ORDER BY qi RANGE BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)),
k_{name} AS (SELECT '{name}' AS target, unnest([{', '.join(f"'b_{name}_{k}'" for k in names)}, 'expanding_mean']) AS model, y_{name} AS y_true, unnest([{', '.join(f'coalesce(b_{name}_{k}, q.s / q.n)' for k in names)}, q.s / q.n]) AS y_pred
  FROM tt JOIN q_{name} q ON tt.qi = q.qi WHERE q.i > 2 AND q.n >= 100 AND y_{name} IS NOT NULL)"""


@query(f"""WITH {_TARGETS}, {', '.join(_purged_sql(n) for n in ('annual', 'gm', 'em'))}, al AS (SELECT * FROM k_annual UNION ALL SELECT * FROM k_gm UNION ALL SELECT * FROM k_em),
s AS (SELECT target, model, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, 1 - sum((y_pred - y_true) * (y_pred - y_true)) / nullif(var_pop(y_true) * count(*), 0) AS r2,
  avg(CASE WHEN sign(y_true) = sign(y_pred) THEN 1e0 ELSE 0e0 END) AS dir_acc FROM al GROUP BY 1, 2) SELECT target, model, n, {sql_round(_P)} FROM s""")
def purged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Naive forecasts of the three targets of the year ahead, trained on labels that end before the test quarter begins."""
    x = assembly.targets(series.clean_growth(v.accounts(spark, d)))
    out = None
    for name in ("annual", "gm", "em"):
        s = evaluation.score(assembly.purged_baselines(x, name, 2, 100)).withColumn("target", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return rounded(out, _P)


_CROSS = [("AFRICA", "1-URGENT"), ("AFRICA", "2-HIGH"), ("AMERICA", "2-HIGH"), ("ASIA", "3-MEDIUM"), ("ASIA", "5-LOW"), ("EUROPE", "4-NOT SPECIFIED")]


def _filings(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (v.table(spark, d, t) for t in ("orders", "customer", "nation"))
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    e = e.select(F.col("n_name").alias("entity"), v.quarter_index(F.col("o_orderdate")).alias("qi"), F.col("o_totalprice").alias("car"), "o_orderdate", "o_orderkey")
    return temporal.latest_event(e, "entity", "qi", "o_orderdate", ["o_orderkey"])


def _guidance(spark: SparkSession, d: str) -> DataFrame:
    """The events given to nations and moved to 1998 and 1999."""
    e, n = v.signed_events(spark, d), v.table(spark, d, "nation")
    on = F.pmod(F.col("entity"), F.lit(25)) == F.col("n_nationkey")
    return e.join(F.broadcast(n), on).select(F.col("n_name").alias("entity"), F.date_sub("date", (9200 + F.col("event_id") % 300).cast("int")).alias("date"), "event_id", "action")


def full_panel(spark: SparkSession, d: str) -> DataFrame:
    days = cut_lineage(v.daily(spark, d))
    returns = market.calendar_returns(days)
    bench = v.bench(spark, d).withColumn("rb", F.try_divide(F.col("px"), F.lag("px").over(Window.orderBy("date"))) - 1).join(returns.select("date", "cal").distinct(), "date").select("cal", "rb")
    macro = cut_lineage(quarterly_series(spark, d))
    long = macro.select("qi", F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("value")) for s in SERIES])).alias("x")).select("qi", "x.*")
    i = v.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("industry"), v.quarter_index(F.col("o_orderdate")).alias("qi")).agg(v.cents(F.col("o_totalprice")).alias("value"))
    acc = v.accounts(spark, d)
    short = days.select("entity", "date", F.col("px").alias("short"), F.col("volume").alias("days_to_cover"))
    return assembly.build_panel(
        series.clean_growth(acc), acc.select("entity", "grp").distinct().filter("entity <> 'PERU'"), (macro, ["p1", "p2"], ["p1"]), panel.matched_series(long, spark.createDataFrame(_MATCH, "grp string, series string")), _filings(spark, d), days,
        market.rolling_risk(returns, bench, 5), panel.crosswalk(i, spark.createDataFrame(_CROSS, "grp string, industry string")), _guidance(spark, d), short, ladder=(2,), winsor=(0.05, 0.95), start=1996 * 4, market_rows=(5, 10, 3),
    )


_CLIPPED = [*(f"f_{n}" for n in ("gross_margin", "operating_margin", "net_margin", "ebitda_margin")), *(f"f_{n}_chg4" for n in assembly.CHANGES), "f_turnover", "f_zscore", "f_jump", "mac_p1", "mac_p2", "mac_p1_yoy", "mac_p1_qoq", "mac_p1_l2", "mac_p2_l2", "mkt_ps", "mkt_ev_sales", "mkt_ret_short", "mkt_ret_long"]
_PLAIN = ["yoy", "y_annual", "y_gm", "y_em", "b_persistence", "b_group", "b_gm_mean", "f_lag_yoy_1", "f_lag_yoy_1_peer_mean", "f_lag_yoy_1_vs_peers", "f_recent", "own_yoy", "own_qoq", "ev_car", "ev_car_sum4", "mkt_px", "mkt_drawdown", "mkt_vol", "mkt_beta", "va_yoy", "short", "short_chg2", "days_to_cover", "short_to_shares"]
_COUNTS = ["n_180", "net_180", "net_365", "raise_90", "lower_90", "days_since", "last_is_raise", "last_is_lower"]
_PANEL = f"""{_TARGETS}, {_QUARTERS}, {DAILY}, {BENCH},
ta AS (SELECT *, make_date(qi // 4, (qi % 4) * 3 + 1, 1) AS origin, f_lag_yoy_1 - median(f_lag_yoy_1) OVER w AS f_lag_yoy_1_vs_peers,
  CASE WHEN count(f_lag_yoy_1) OVER w - (f_lag_yoy_1 IS NOT NULL)::INT > 0 THEN (sum(f_lag_yoy_1) OVER w - coalesce(f_lag_yoy_1, 0)) / (count(f_lag_yoy_1) OVER w - (f_lag_yoy_1 IS NOT NULL)::INT) END AS f_lag_yoy_1_peer_mean
  FROM (SELECT * EXCLUDE (b_group), median(b_persistence) OVER (PARTITION BY grp, qi) AS b_group FROM tt WHERE entity <> 'PERU') WINDOW w AS (PARTITION BY grp, qi)),
ma AS (SELECT qi + 1 AS qi, p1 AS mac_p1, p2 AS mac_p2, p1 / nullif(lag(p1, 4) OVER w, 0) - 1 AS mac_p1_yoy, p1 / nullif(lag(p1, 1) OVER w, 0) - 1 AS mac_p1_qoq, lag(p1, 1) OVER w AS mac_p1_l2, lag(p2, 1) OVER w AS mac_p2_l2 FROM mq WINDOW w AS (ORDER BY qi)),
ml AS (SELECT qi, unnest(['p1', 'p2', 'p3', 'p4', 'p5']) AS series, unnest([p1, p2, p3, p4, p5]) AS value FROM mq),
ms AS (SELECT series, qi + 1 AS qi, value / nullif(lag(value, 4) OVER w, 0) - 1 AS own_yoy, value / nullif(lag(value, 1) OVER w, 0) - 1 AS own_qoq FROM ml WINDOW w AS (PARTITION BY series ORDER BY qi)),
mt AS (SELECT t.grp, ms.* EXCLUDE (series) FROM ms JOIN (VALUES {', '.join(str(x) for x in _MATCH)}) t(grp, m) ON series = m),
fe0 AS (SELECT n_name AS entity, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi, o_totalprice AS car, row_number() OVER (PARTITION BY n_name, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
fe AS (SELECT entity, qi + 1 AS qi, car AS ev_car, CASE WHEN count(car) OVER w >= 2 THEN sum(car) OVER w END AS ev_car_sum4 FROM fe0 WHERE n = 1 WINDOW w AS (PARTITION BY entity ORDER BY qi RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS cal FROM (SELECT DISTINCT date FROM daily)),
rr0 AS (SELECT entity, daily.date, cal, px, lag(px) OVER w AS pp, lag(cal) OVER w AS pc FROM daily JOIN cal ON daily.date = cal.date WINDOW w AS (PARTITION BY entity ORDER BY cal)),
rr AS (SELECT entity, date, cal, CASE WHEN cal - pc = 1 THEN px / nullif(pp, 0) - 1 END AS ret FROM rr0),
rb AS (SELECT cal.cal, px / nullif(lag(px) OVER (ORDER BY bench.date), 0) - 1 AS rb FROM bench JOIN cal ON bench.date = cal.date),
rv AS (SELECT cal, rb, CASE WHEN count(rb) OVER w >= 5 THEN var_samp(rb) OVER w END AS var_b FROM rb WINDOW w AS (ORDER BY cal RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
rj AS (SELECT rr.*, rv.rb, rv.var_b FROM rr LEFT JOIN rv ON rr.cal = rv.cal),
rk AS (SELECT entity, date, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END * sqrt(5e0) AS mkt_vol, CASE WHEN count(CASE WHEN ret IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER w >= 5 THEN covar_samp(ret, rb) OVER w END / nullif(var_b, 0) AS mkt_beta
  FROM rj WINDOW w AS (PARTITION BY entity ORDER BY cal RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
mo AS (SELECT daily.entity, daily.date, px AS mkt_px, px / nullif(lag(px, 5) OVER w, 0) - 1 AS mkt_ret_short, px / nullif(lag(px, 10) OVER w, 0) - 1 AS mkt_ret_long, mkt_vol, mkt_beta,
  px / nullif(CASE WHEN count(px) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN max(px) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 0) - 1 AS mkt_drawdown
  FROM daily JOIN rk ON daily.entity = rk.entity AND daily.date = rk.date WINDOW w AS (PARTITION BY daily.entity ORDER BY daily.date)),
iv AS (SELECT o_orderpriority AS industry, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
iw AS (SELECT grp, qi, sum(value) AS va FROM iv JOIN (VALUES {', '.join(str(x) for x in _CROSS)}) t(grp, m) ON industry = m GROUP BY 1, 2),
ix AS (SELECT grp, qi + 2 AS qi, va / nullif(lag(va, 4) OVER w, 0) - 1 AS va_yoy FROM iw WINDOW w AS (PARTITION BY grp ORDER BY qi)),
gv AS (SELECT n_name AS entity, CAST(CAST(ts AS DATE) - CAST(9200 + event_id % 300 AS INTEGER) AS DATE) AS date, event_id, CASE event_type WHEN 'purchase' THEN 'raise' WHEN 'error' THEN 'lower' ELSE 'reaffirm' END AS action FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_id % 7 <> 3 AND event_type IN ('purchase', 'error', 'view', 'signup', 'click')),
gq AS (SELECT ta.entity, ta.qi, count(action) FILTER (WHERE age <= 180) AS n_180, CAST(coalesce(sum((action = 'raise')::INT - (action = 'lower')::INT) FILTER (WHERE age <= 180), 0) AS BIGINT) AS net_180, CAST(coalesce(sum((action = 'raise')::INT - (action = 'lower')::INT) FILTER (WHERE age <= 365), 0) AS BIGINT) AS net_365,
  count(*) FILTER (WHERE age <= 90 AND action = 'raise') AS raise_90, count(*) FILTER (WHERE age <= 90 AND action = 'lower') AS lower_90, CAST(min(age) AS INTEGER) AS days_since,
  CAST(coalesce(arg_max(action, (date, event_id)) = 'raise', false) AS INTEGER) AS last_is_raise, CAST(coalesce(arg_max(action, (date, event_id)) = 'lower', false) AS INTEGER) AS last_is_lower
  FROM ta LEFT JOIN (SELECT entity AS e, date, event_id, action FROM gv) ON ta.entity = e AND date < ta.origin, LATERAL (SELECT date_diff('day', date, ta.origin) AS age) GROUP BY 1, 2),
sh AS (SELECT entity, date, px AS short, px / nullif(lag(px, 2) OVER w, 0) - 1 AS short_chg2, volume AS days_to_cover FROM daily WINDOW w AS (PARTITION BY entity ORDER BY date)),
sa AS (SELECT t.entity, t.qi, sh.* EXCLUDE (entity, date), date_diff('day', sh.date, t.cut) <= 60 AS fresh FROM (SELECT entity, qi, CAST(origin - 14 AS DATE) AS cut FROM ta) t ASOF LEFT JOIN sh ON t.entity = sh.entity AND t.cut >= sh.date),
mk AS (SELECT t.entity, t.qi, mo.* EXCLUDE (entity, date) FROM (SELECT entity, qi, origin FROM ta) t ASOF LEFT JOIN mo ON t.entity = mo.entity AND t.origin > mo.date),
pj AS (SELECT ta.*, ma.* EXCLUDE (qi), mt.* EXCLUDE (grp, qi), fe.* EXCLUDE (entity, qi), mk.* EXCLUDE (entity, qi), ix.va_yoy, gq.* EXCLUDE (entity, qi), CASE WHEN fresh THEN short END AS short, CASE WHEN fresh THEN short_chg2 END AS short_chg2, CASE WHEN fresh THEN sa.days_to_cover END AS days_to_cover,
  CASE WHEN fresh THEN short END / nullif(asof_shares, 0) AS short_to_shares, mkt_px * asof_shares / nullif(asof_ttm, 0) AS mkt_ps, (mkt_px * asof_shares + coalesce(asof_debt, 0) - coalesce(asof_cash, 0)) / nullif(asof_ttm, 0) AS mkt_ev_sales
  FROM ta LEFT JOIN ma ON ta.qi = ma.qi LEFT JOIN mt ON ta.grp = mt.grp AND ta.qi = mt.qi LEFT JOIN fe ON ta.entity = fe.entity AND ta.qi = fe.qi LEFT JOIN mk ON ta.entity = mk.entity AND ta.qi = mk.qi
  LEFT JOIN ix ON ta.grp = ix.grp AND ta.qi = ix.qi LEFT JOIN gq ON ta.entity = gq.entity AND ta.qi = gq.qi LEFT JOIN sa ON ta.entity = sa.entity AND ta.qi = sa.qi),
ql AS (SELECT {', '.join(f'quantile_cont({c}, [0.05, 0.95]) AS {c}' for c in _CLIPPED)} FROM pj),
pc AS (SELECT pj.* REPLACE ({', '.join(f'CASE WHEN pj.{c} IS NOT NULL THEN greatest(least(pj.{c}, ql.{c}[2]), ql.{c}[1]) END AS {c}' for c in _CLIPPED)}) FROM pj, ql WHERE qi >= 1996 * 4),
kq AS (SELECT qi FROM pc GROUP BY qi HAVING count(DISTINCT entity) >= 0.6 * (SELECT count(DISTINCT entity) FROM accounts))"""


@query(f"""WITH {_PANEL} SELECT entity, grp, qi, CAST(qi // 4 AS VARCHAR) || 'Q' || CAST(qi % 4 + 1 AS VARCHAR) AS target_quarter, origin, {', '.join(_COUNTS)}, {', '.join(f'round({c}, 4) + 0.0e0 AS {c}' for c in [*_CLIPPED, *_PLAIN])} FROM pc WHERE qi IN (SELECT qi FROM kq)""")
def build_panel(spark: SparkSession, d: str) -> DataFrame:
    """All blocks from accounts to short positions, clipped and trimmed."""
    return rounded(full_panel(spark, d), [*_CLIPPED, *_PLAIN], 4).select("entity", "grp", "qi", "target_quarter", "origin", *_COUNTS, *_CLIPPED, *_PLAIN)
