"""Queries of the panel operators, each with the same in SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintagepanel.operators import market, panel, series, temporal
from vintagepanel.plans import views as v
from vintagepanel.plans.views import BENCH, DAILY, DENSE, EVENTS, GROWN, ORIGINS, RATIOS, SERIES, SERIES_WIDE, SPARSE, growth_sql, rolled, rounded
from vintagepanel.sources import feeds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def sql_round(columns: list[str], n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) + 0.0e0 AS {c}" for c in columns)


GRID = f"""{SPARSE},
span AS (SELECT entity, min(qi) AS a, max(qi) AS b, FROM sparse GROUP BY entity),
grid AS (SELECT entity, unnest(generate_series(a, b)) AS qi FROM span),
filled AS (
  SELECT grid.entity, grid.qi, sparse.revenue,
         coalesce(last_value(grp IGNORE NULLS) OVER (PARTITION BY grid.entity ORDER BY grid.qi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  first_value(grp IGNORE NULLS) OVER (PARTITION BY grid.entity ORDER BY grid.qi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS grp
  FROM grid LEFT JOIN sparse ON grid.entity = sparse.entity AND grid.qi = sparse.qi)"""


@query(f"WITH {GRID} SELECT entity, qi, grp, revenue FROM filled")
def gap_free_grid(spark: SparkSession, d: str) -> DataFrame:
    return series.gap_free(v.sparse(spark, d), static=["grp"]).select("entity", "qi", "grp", "revenue")


@query(f"WITH {GRID}, {growth_sql('filled')} SELECT entity, qi, revenue, round(ttm, 2) AS ttm, {sql_round(['yoy', 'qoq'])} FROM g")
def clean_growth_sparse(spark: SparkSession, d: str) -> DataFrame:
    x = series.clean_growth(series.gap_free(v.sparse(spark, d), static=["grp"]))
    return rounded(x, ["yoy", "qoq"]).select("entity", "qi", "revenue", F.round("ttm", 2).alias("ttm"), "yoy", "qoq")


@query(
    """WITH last AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders)
SELECT entity, qi, o_orderkey, o_totalprice FROM last WHERE n = 1"""
)
def last_per_quarter(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").withColumnRenamed("o_custkey", "entity")
    return series.last_per_quarter(o, date="o_orderdate", ties=["o_orderkey"]).select("entity", "qi", "o_orderkey", "o_totalprice")


_SIZE = ["gross_margin", "operating_margin", "cash_share", "log_revenue"]


@query(f"""WITH {RATIOS} SELECT entity, qi, round((revenue - cost) / nullif(revenue, 0), 6) + 0.0e0 AS gross_margin, round((revenue - cost - tax) / nullif(revenue, 0), 6) + 0.0e0 AS operating_margin,
       round(qty / nullif(revenue, 0), 6) + 0.0e0 AS cash_share, round(CASE WHEN revenue > 0 THEN ln(revenue) END, 6) + 0.0e0 AS log_revenue FROM ratios""")
def common_size(spark: SparkSession, d: str) -> DataFrame:
    x = v.ratios(spark, d).withColumns({"gross_profit": F.col("revenue") - F.col("cost"), "operating_income": F.col("revenue") - F.col("cost") - F.col("tax"), "operating_cash": F.col("qty")})
    return rounded(series.common_size(x), _SIZE).select("entity", "qi", *_SIZE)


_FEATURES = ["f_lag_yoy_1", "f_lag_yoy_2", "f_lag_yoy_3", "f_lag_yoy_4", "f_lag_yoy_5", "f_accel_1", "f_accel_4", "f_mean_4", "f_mean_8", "f_std_4", "f_std_8", "f_exp_mean", "f_exp_std", "f_zscore", "f_lag_qoq", "f_qoq_mean_4"]
_FEATURE_SQL = f"""f0 AS (
  SELECT entity, grp, qi, yoy, {', '.join(f'lag(yoy, {i}) OVER w AS f_lag_yoy_{i}' for i in range(1, 6))},
         {rolled('avg', 'yoy', '4 PRECEDING', '1 PRECEDING', 2)} AS f_mean_4, {rolled('avg', 'yoy', '8 PRECEDING', '1 PRECEDING', 4)} AS f_mean_8,
         {rolled('stddev_samp', 'yoy', '4 PRECEDING', '1 PRECEDING', 2)} AS f_std_4, {rolled('stddev_samp', 'yoy', '8 PRECEDING', '1 PRECEDING', 4)} AS f_std_8,
         {rolled('avg', 'yoy', 'UNBOUNDED PRECEDING', '1 PRECEDING', 4)} AS f_exp_mean, {rolled('stddev_samp', 'yoy', 'UNBOUNDED PRECEDING', '1 PRECEDING', 4)} AS f_exp_std,
         count(yoy) OVER (PARTITION BY entity ORDER BY qi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f_exp_n,
         lag(qoq, 1) OVER w AS f_lag_qoq, {rolled('avg', 'qoq', '4 PRECEDING', '1 PRECEDING', 2)} AS f_qoq_mean_4
  FROM g WINDOW w AS (PARTITION BY entity ORDER BY qi)),
f AS (SELECT *, f_lag_yoy_1 - f_lag_yoy_2 AS f_accel_1, f_lag_yoy_1 - f_lag_yoy_5 AS f_accel_4, (f_lag_yoy_1 - f_mean_8) / nullif(f_std_8, 0) AS f_zscore FROM f0)"""


@query(f"WITH {DENSE}, {growth_sql('dense')}, {_FEATURE_SQL} SELECT entity, qi, f_exp_n, {sql_round(_FEATURES)} FROM f")
def growth_features(spark: SparkSession, d: str) -> DataFrame:
    x = series.growth_features(series.clean_growth(v.dense(spark, d)))
    return rounded(x, _FEATURES).select("entity", "qi", "f_exp_n", *_FEATURES)


@query(f"""WITH {RATIOS} SELECT entity, qi, lag(cost, 1) OVER w AS f_cost, lag(tax, 1) OVER w AS f_tax, round(lag(cost, 1) OVER w - lag(cost, 5) OVER w, 4) + 0.0e0 AS f_cost_chg4
FROM ratios WINDOW w AS (PARTITION BY entity ORDER BY qi)""")
def lagged_levels(spark: SparkSession, d: str) -> DataFrame:
    x = series.lagged_levels(v.ratios(spark, d), ["cost", "tax"], ["cost"])
    return rounded(x, ["f_cost_chg4"], 4).select("entity", "qi", "f_cost", "f_tax", "f_cost_chg4")


_BALANCE = ["f_deferred_chg", "f_deferred_share", "f_receivables_gap", "f_jump"]


@query(f"""WITH {RATIOS}, {growth_sql('ratios')},
b AS (SELECT *, cost / nullif(lag(cost, 1) OVER w, 0) - 1 AS up, cost - lag(cost, 1) OVER w AS rise FROM g WINDOW w AS (PARTITION BY entity ORDER BY qi)),
c AS (SELECT *, rise / nullif(revenue, 0) AS jump, CASE WHEN coalesce(up > 0.05e0 AND rise > 0, false) THEN 1.0e0 ELSE 0.0e0 END AS flag FROM b),
x AS (SELECT entity, qi, (lag(cost, 1) OVER w - lag(cost, 5) OVER w) / nullif(lag(revenue, 5) OVER w, 0) AS f_deferred_chg,
       lag(cost, 1) OVER w / nullif(lag(ttm, 1) OVER w, 0) AS f_deferred_share,
       lag(tax, 1) OVER w / nullif(lag(tax, 5) OVER w, 0) - 1 - lag(yoy, 1) OVER w AS f_receivables_gap, lag(jump, 1) OVER w AS f_jump,
       max(flag) OVER (PARTITION BY entity ORDER BY qi ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS f_recent
FROM c WINDOW w AS (PARTITION BY entity ORDER BY qi))
SELECT entity, qi, f_recent, {sql_round(_BALANCE)} FROM x""")
def balance_signals(spark: SparkSession, d: str) -> DataFrame:
    x = series.clean_growth(v.ratios(spark, d))
    x = series.deferred_signals(x, "cost")
    x = series.receivables_gap(x, "tax")
    x = series.goodwill_jump(x, "cost", "revenue")
    return rounded(x, _BALANCE).select("entity", "qi", "f_recent", *_BALANCE)


_BASE = ["b_persistence", "b_seasonal", "b_mean_4", "b_mean_8", "b_history"]


@query(f"""WITH {GROWN} SELECT entity, grp, qi, CAST(qi // 4 AS VARCHAR) || 'Q' || CAST(qi % 4 + 1 AS VARCHAR) AS target_quarter,
       make_date(qi // 4, (qi % 4) * 3 + 1, 1) AS origin, last_day(make_date(qi // 4, (qi % 4) * 3 + 3, 1)) AS period_end, CAST(qi % 4 + 1 AS BIGINT) AS quarter_number,
       CASE WHEN qi % 4 = 3 THEN 1.0e0 ELSE 0.0e0 END AS is_q4, {sql_round(_BASE)} FROM grown""")
def timing_and_baselines(spark: SparkSession, d: str) -> DataFrame:
    x = panel.timing(v.grown(spark, d))
    return rounded(x, _BASE).select("entity", "grp", "qi", "target_quarter", "origin", "period_end", "quarter_number", "is_q4", *_BASE)


_ANNUAL = ["y_annual", "b_annual_persistence", "b_annual_mean"]


@query(f"""WITH {DENSE}, {growth_sql('dense')},
a AS (SELECT entity, qi, lead(ttm, 3) OVER w / nullif(lag(ttm, 1) OVER w, 0) - 1 AS y, lag(ttm, 1) OVER w / nullif(lag(ttm, 5) OVER w, 0) - 1 AS p FROM g WINDOW w AS (PARTITION BY entity ORDER BY qi)),
x AS (SELECT entity, qi, CASE WHEN y > -0.95e0 AND y < 3e0 THEN y END AS y_annual, CASE WHEN p > -0.95e0 AND p < 3e0 THEN p END AS b_annual_persistence,
       {rolled('avg', 'p', 'UNBOUNDED PRECEDING', 'CURRENT ROW', 2)} AS b_annual_mean FROM a)
SELECT entity, qi, {sql_round(_ANNUAL)} FROM x""")
def annual_target(spark: SparkSession, d: str) -> DataFrame:
    x = panel.annual_target(series.clean_growth(v.dense(spark, d)))
    return rounded(x, _ANNUAL).select("entity", "qi", *_ANNUAL)


_MARGIN = ["y_gm", "b_gm_persistence", "b_gm_mean"]


@query(f"""WITH {RATIOS},
s AS (SELECT entity, qi, CASE WHEN count(*) OVER f = 4 THEN sum(revenue - cost) OVER f / nullif(sum(revenue) OVER f, 0) END AS m FROM ratios WINDOW f AS (PARTITION BY entity ORDER BY qi ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
a AS (SELECT entity, qi, lead(m, 3) OVER w AS y, lag(m, 1) OVER w AS p FROM s WINDOW w AS (PARTITION BY entity ORDER BY qi)),
x AS (SELECT entity, qi, CASE WHEN y > -0.5e0 AND y < 1e0 THEN y END AS y_gm, CASE WHEN p > -0.5e0 AND p < 1e0 THEN p END AS b_gm_persistence, {rolled('avg', 'p', 'UNBOUNDED PRECEDING', 'CURRENT ROW', 2)} AS b_gm_mean FROM a)
SELECT entity, qi, {sql_round(_MARGIN)} FROM x""")
def annual_margin(spark: SparkSession, d: str) -> DataFrame:
    x = panel.annual_margin(v.ratios(spark, d), F.col("revenue") - F.col("cost"), "revenue", "gm", series.BANDS["gross_margin"])
    return rounded(x, _MARGIN).select("entity", "qi", *_MARGIN)


_PEERS = ["b_group", "yoy_peer_mean", "yoy_peer_median", "yoy_peer_std", "yoy_vs_peers"]


@query(f"""WITH {GROWN},
p AS (SELECT entity, grp, qi, yoy, median(b_persistence) OVER w AS b_group,
       CASE WHEN count(yoy) OVER w - CASE WHEN yoy IS NOT NULL THEN 1 ELSE 0 END > 0 THEN (sum(yoy) OVER w - coalesce(yoy, 0)) / (count(yoy) OVER w - CASE WHEN yoy IS NOT NULL THEN 1 ELSE 0 END) END AS yoy_peer_mean,
       median(yoy) OVER w AS yoy_peer_median, stddev_samp(yoy) OVER w AS yoy_peer_std FROM grown WINDOW w AS (PARTITION BY grp, qi)),
x AS (SELECT *, yoy - yoy_peer_median AS yoy_vs_peers FROM p)
SELECT entity, grp, qi, {sql_round(_PEERS)} FROM x""")
def peer_features(spark: SparkSession, d: str) -> DataFrame:
    x = panel.peers(panel.group_median(v.grown(spark, d), {"b_persistence": "b_group"}), "yoy")
    return rounded(x, _PEERS).select("entity", "grp", "qi", *_PEERS)


def quarterly_series(spark: SparkSession, d: str) -> DataFrame:
    return market.to_quarters(feeds.align_series(v.series_long(spark, d), SERIES), SERIES)


_QUARTERS = f"""{SERIES_WIDE},
wq AS (SELECT *, CAST(year(date) * 4 + quarter(date) - 1 AS BIGINT) AS qi FROM wide),
mq0 AS (SELECT qi, {', '.join(f'arg_max({c}, date) AS {c}, avg({c}) AS {c}_qavg, stddev_samp({c}) AS {c}_qstd' for c in SERIES)} FROM wq GROUP BY qi),
mq AS (SELECT t.qi, mq0.* EXCLUDE (qi) FROM (SELECT unnest(generate_series((SELECT min(qi) FROM wq), (SELECT max(qi) FROM wq))) AS qi) t LEFT JOIN mq0 ON t.qi = mq0.qi)"""


@query(f"""WITH {_QUARTERS} SELECT qi, last_day(make_date(qi // 4, (qi % 4) * 3 + 3, 1)) AS date, p1, round(p1_qavg, 4) AS p1_qavg, round(p1_qstd, 4) AS p1_qstd, p2, round(p2_qavg, 4) AS p2_qavg,
       round(p1 - p2, 4) + 0.0e0 AS gap, round(p1_qavg - p2_qavg, 4) + 0.0e0 AS gap_qavg FROM mq""")
def quarterly_macro(spark: SparkSession, d: str) -> DataFrame:
    x = market.spread(quarterly_series(spark, d), "p1", "p2", "gap")
    return rounded(x, ["p1_qavg", "p1_qstd", "p2_qavg", "gap", "gap_qavg"], 4).select("qi", "date", "p1", "p1_qavg", "p1_qstd", "p2", "p2_qavg", "gap", "gap_qavg")


@query(f"""WITH {DENSE}, {_QUARTERS},
m AS (SELECT qi + 1 AS qi, p1 AS mac_p1, p2 AS mac_p2, p1 / nullif(lag(p1, 4) OVER w, 0) - 1 AS mac_p1_yoy, p1 / nullif(lag(p1, 1) OVER w, 0) - 1 AS mac_p1_qoq, lag(p1, 1) OVER w AS mac_p1_l2, lag(p2, 2) OVER w AS mac_p2_l3 FROM mq WINDOW w AS (ORDER BY qi))
SELECT entity, dense.qi, mac_p1, mac_p2, {sql_round(['mac_p1_yoy', 'mac_p1_qoq'])}, mac_p1_l2, mac_p2_l3 FROM dense LEFT JOIN m ON dense.qi = m.qi""")
def macro_features(spark: SparkSession, d: str) -> DataFrame:
    m = panel.macro_features(quarterly_series(spark, d), ["p1", "p2"], ["p1"], lag=1, ladder=(2, 3))
    x = panel.macro_join(v.dense(spark, d), m)
    return rounded(x, ["mac_p1_yoy", "mac_p1_qoq"]).select("entity", "qi", "mac_p1", "mac_p2", "mac_p1_yoy", "mac_p1_qoq", "mac_p1_l2", "mac_p2_l3")


_MATCH = [("AFRICA", "p1"), ("AMERICA", "p2"), ("ASIA", "p3"), ("EUROPE", "p4"), ("MIDDLE EAST", "p5")]


@query(f"""WITH {_QUARTERS},
l AS (SELECT qi, unnest(['p1', 'p2', 'p3', 'p4', 'p5']) AS series, unnest([p1, p2, p3, p4, p5]) AS value FROM mq),
s AS (SELECT series, qi, value / nullif(lag(value, 4) OVER w, 0) - 1 AS own_yoy, value / nullif(lag(value, 1) OVER w, 0) - 1 AS own_qoq FROM l WINDOW w AS (PARTITION BY series ORDER BY qi))
SELECT grp, qi + 1 AS qi, {sql_round(['own_yoy', 'own_qoq'])} FROM s JOIN (VALUES {', '.join(str(x) for x in _MATCH)}) t(grp, m) ON series = m""")
def group_matched_series(spark: SparkSession, d: str) -> DataFrame:
    long = quarterly_series(spark, d).select("qi", F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("value")) for s in SERIES])).alias("x")).select("qi", "x.*")
    matching = spark.createDataFrame(_MATCH, "grp string, series string")
    return rounded(panel.matched_series(long, matching), ["own_yoy", "own_qoq"])


_CROSS = [("AFRICA", "1-URGENT"), ("AFRICA", "2-HIGH"), ("AMERICA", "2-HIGH"), ("ASIA", "3-MEDIUM"), ("ASIA", "5-LOW"), ("EUROPE", "4-NOT SPECIFIED")]


@query(f"""WITH i AS (SELECT o_orderpriority AS industry, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
s AS (SELECT grp, qi, sum(value) AS va FROM i JOIN (VALUES {', '.join(str(x) for x in _CROSS)}) t(grp, m) ON industry = m GROUP BY 1, 2),
x AS (SELECT grp, qi + 2 AS qi, va, va / nullif(lag(va, 4) OVER w, 0) - 1 AS va_yoy, va / nullif(lag(va, 1) OVER w, 0) - 1 AS va_qoq FROM s WINDOW w AS (PARTITION BY grp ORDER BY qi))
SELECT grp, qi, round(va, 2) AS va, {sql_round(['va_yoy', 'va_qoq'])} FROM x""")
def industry_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    i = o.groupBy(F.col("o_orderpriority").alias("industry"), v.quarter_index(F.col("o_orderdate")).alias("qi")).agg(v.cents(F.col("o_totalprice")).alias("value"))
    x = panel.crosswalk(i, spark.createDataFrame(_CROSS, "grp string, industry string"))
    return rounded(rounded(x, ["va_yoy", "va_qoq"]), ["va"], 2)


@query("""SELECT p.event_id, p.entity, v.asof_date, v.value AS value FROM (SELECT event_id, user_id AS entity, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id AS entity, ts AS asof_date, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.entity = v.entity AND p.ts >= v.asof_date""")
def asof_last_view(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").withColumnRenamed("user_id", "entity")
    left = e.filter("event_type = 'purchase'").select("event_id", "entity", "ts")
    right = e.filter("event_type = 'view'").select("entity", F.col("ts").alias("seen"), "value", F.col("event_id").alias("view_id"))
    return temporal.asof_join(left, right, "entity", "ts", "seen", ["value"], ties=["view_id"]).select("event_id", "entity", "asof_date", "value")


_MARKET = ["ret_short", "ret_long", "drawdown"]


@query(f"""WITH {DAILY}, m AS (
  SELECT entity, date, px, px / nullif(lag(px, 5) OVER w, 0) - 1 AS ret_short, px / nullif(lag(px, 10) OVER w, 0) - 1 AS ret_long,
         px / nullif(CASE WHEN count(px) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN max(px) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 0) - 1 AS drawdown
  FROM daily WINDOW w AS (PARTITION BY entity ORDER BY date)),
o AS (SELECT entity, CAST(t AS DATE) AS origin FROM (SELECT DISTINCT entity FROM daily), (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2000-10-01', INTERVAL 3 MONTH)) AS t))
SELECT o.entity, o.origin, m.date AS asof_date, m.px, {sql_round(_MARKET)} FROM o ASOF LEFT JOIN m ON o.entity = m.entity AND o.origin > m.date""")
def market_features(spark: SparkSession, d: str) -> DataFrame:
    days = v.daily(spark, d)
    quarters = F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2000-10-01").cast("date"), F.expr("interval 3 months"))
    origins = days.select("entity").distinct().select("entity", F.explode(quarters).alias("origin"))
    x = market.market_at_origin(origins, market.momentum(days, 5, 10, 3), ["px", *_MARKET])
    return rounded(x, _MARKET).select("entity", "origin", F.to_date("asof_date").alias("asof_date"), "px", *_MARKET)


@query(f"""WITH {RATIOS}, {growth_sql('ratios')} SELECT entity, qi, round(tax * qty, 0) AS mkt_cap, round(tax * qty / nullif(ttm, 0), 6) + 0.0e0 AS mkt_ps,
       round((tax * qty + coalesce(cost, 0) - coalesce(ttm, 0)) / nullif(ttm, 0), 6) + 0.0e0 AS mkt_ev_sales FROM g""")
def valuation(spark: SparkSession, d: str) -> DataFrame:
    x = panel.valuation(series.clean_growth(v.ratios(spark, d)), "tax", "qty", "ttm", "cost", "ttm")
    return rounded(rounded(x, ["mkt_ps", "mkt_ev_sales"]), ["mkt_cap"], 0).select("entity", "qi", "mkt_cap", "mkt_ps", "mkt_ev_sales")


@query(f"""WITH {EVENTS}, {ORIGINS},
j AS (SELECT o.entity, o.origin, date_diff('day', e.date, o.origin) AS age, e.action, e.date, e.event_id FROM orig o LEFT JOIN ev e ON o.entity = e.entity AND e.date < o.origin AND e.action IN ('raise', 'lower', 'reaffirm', 'initiate', 'withdraw'))
SELECT entity, origin, count(action) FILTER (WHERE age <= 180) AS n_180,
       CAST(coalesce(sum(CASE action WHEN 'raise' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END) FILTER (WHERE age <= 180), 0) AS BIGINT) AS net_180,
       CAST(coalesce(sum(CASE action WHEN 'raise' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END) FILTER (WHERE age <= 365), 0) AS BIGINT) AS net_365,
       count(*) FILTER (WHERE age <= 90 AND action = 'raise') AS raise_90, count(*) FILTER (WHERE age <= 90 AND action = 'lower') AS lower_90,
       CAST(min(age) AS INTEGER) AS days_since,
       CAST(coalesce(arg_max(action, (date, event_id)) = 'raise', false) AS INTEGER) AS last_is_raise, CAST(coalesce(arg_max(action, (date, event_id)) = 'lower', false) AS INTEGER) AS last_is_lower
FROM j GROUP BY 1, 2""")
def signed_event_features(spark: SparkSession, d: str) -> DataFrame:
    return temporal.signed_event_features(v.origins(spark, d), v.signed_events(spark, d))


@query(f"""WITH {GROWN}, e0 AS (
  SELECT n_name AS entity, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi, o_totalprice AS car,
         row_number() OVER (PARTITION BY n_name, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT entity, qi, car, CASE WHEN count(car) OVER w >= 2 THEN sum(car) OVER w END AS s FROM e0 WHERE n = 1 WINDOW w AS (PARTITION BY entity ORDER BY qi RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT grown.entity, grown.qi, e.car AS ev_car, round(e.s, 2) AS ev_car_sum4 FROM grown LEFT JOIN e ON grown.entity = e.entity AND grown.qi = e.qi + 1""")
def event_feature_join(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (v.table(spark, d, t) for t in ("orders", "customer", "nation"))
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    e = e.select(F.col("n_name").alias("entity"), v.quarter_index(F.col("o_orderdate")).alias("qi"), F.col("o_totalprice").alias("car"), "o_orderdate", "o_orderkey")
    last = temporal.latest_event(e, "entity", "qi", "o_orderdate", ["o_orderkey"])
    x = temporal.event_join(v.grown(spark, d), last, "entity", ["car"], 1)
    return rounded(x, ["ev_car_sum4"], 2).select("entity", "qi", "ev_car", "ev_car_sum4")


_CAR = ["car_m1_p1", "car_p1_p5", "car_m5_m1", "advol0"]


@query(f"""WITH {DAILY}, {BENCH}, b AS (SELECT date, px / nullif(lag(px) OVER (ORDER BY date), 0) - 1 AS rb FROM bench),
d0 AS (SELECT daily.*, row_number() OVER w AS day, px / nullif(lag(px) OVER w, 0) - 1 AS ret, avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base, lag(date) OVER w AS prev FROM daily WINDOW w AS (PARTITION BY entity ORDER BY date)),
dd AS (SELECT d0.entity, d0.date, day, ret - rb AS ar, volume / nullif(base, 0) AS av, prev FROM d0 LEFT JOIN b ON d0.date = b.date),
ev AS (SELECT n_name AS entity, CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'),
f AS (SELECT ev.entity, o_orderkey, day AS day0 FROM ev JOIN dd ON ev.entity = dd.entity AND ev.date <= dd.date AND (prev IS NULL OR ev.date > prev)),
o AS (SELECT f.entity, f.o_orderkey, k, ar, av FROM f CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS k) LEFT JOIN dd ON f.entity = dd.entity AND dd.day = f.day0 + k),
x AS (SELECT entity, o_orderkey, CASE WHEN count(ar) FILTER (WHERE k BETWEEN -1 AND 1) = 3 THEN sum(ar) FILTER (WHERE k BETWEEN -1 AND 1) END AS car_m1_p1,
       CASE WHEN count(ar) FILTER (WHERE k BETWEEN 1 AND 5) = 5 THEN sum(ar) FILTER (WHERE k BETWEEN 1 AND 5) END AS car_p1_p5,
       CASE WHEN count(ar) FILTER (WHERE k BETWEEN -5 AND -1) = 5 THEN sum(ar) FILTER (WHERE k BETWEEN -5 AND -1) END AS car_m5_m1, max(av) FILTER (WHERE k = 0) AS advol0 FROM o GROUP BY 1, 2)
SELECT entity, o_orderkey, {sql_round(_CAR)} FROM x""")
def event_study(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (v.table(spark, d, t) for t in ("orders", "customer", "nation"))
    e = o.filter("o_orderpriority = '1-URGENT'").join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    e = e.select(F.col("n_name").alias("entity"), F.to_date("o_orderdate").alias("date"), "o_orderkey")
    return rounded(temporal.event_study(v.daily(spark, d), v.bench(spark, d), e, "o_orderkey"), _CAR)


_SHORT = ["px_chg2", "px_chg6"]


@query(f"""WITH {DAILY}, m AS (SELECT entity, date, px, px / nullif(lag(px, 2) OVER w, 0) - 1 AS px_chg2, px / nullif(lag(px, 6) OVER w, 0) - 1 AS px_chg6 FROM daily WINDOW w AS (PARTITION BY entity ORDER BY date)),
o AS (SELECT entity, CAST(t AS DATE) AS origin, CAST(t AS DATE) - 14 AS cut FROM (SELECT DISTINCT entity FROM daily), (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2002-10-01', INTERVAL 3 MONTH)) AS t)),
x AS (SELECT o.entity, o.origin, m.* EXCLUDE (entity), date_diff('day', m.date, o.cut) <= 60 AS fresh FROM o ASOF LEFT JOIN m ON o.entity = m.entity AND o.cut >= m.date)
SELECT entity, origin, CASE WHEN fresh THEN date END AS asof_date, CASE WHEN fresh THEN px END AS px, round(CASE WHEN fresh THEN px_chg2 END, 6) + 0.0e0 AS px_chg2, round(CASE WHEN fresh THEN px_chg6 END, 6) + 0.0e0 AS px_chg6 FROM x""")
def publication_lagged(spark: SparkSession, d: str) -> DataFrame:
    days = v.daily(spark, d)
    quarters = F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2002-10-01").cast("date"), F.expr("interval 3 months"))
    origins = days.select("entity").distinct().select("entity", F.explode(quarters).alias("origin"))
    x = market.publication_lagged(origins, days, "px")
    return rounded(x, _SHORT).select("entity", "origin", F.to_date("asof_date").alias("asof_date"), "px", *_SHORT)


@query(f"""WITH {GROWN}, q AS (SELECT quantile_cont(b_persistence, 0.05) AS a, quantile_cont(b_persistence, 0.95) AS b FROM grown),
c AS (SELECT entity, qi, CASE WHEN b_persistence IS NOT NULL THEN greatest(least(b_persistence, b), a) END AS b_persistence FROM grown, q WHERE qi >= 1997 * 4),
k AS (SELECT qi FROM c GROUP BY qi HAVING count(DISTINCT entity) >= 0.6 * (SELECT count(DISTINCT entity) FROM dense))
SELECT entity, qi, {sql_round(['b_persistence'])} FROM c WHERE qi IN (SELECT qi FROM k)""")
def winsorize_and_trim(spark: SparkSession, d: str) -> DataFrame:
    x = panel.trim(panel.winsorize(v.grown(spark, d), ["b_persistence"], 0.05, 0.95), 1997 * 4)
    return rounded(x, ["b_persistence"]).select("entity", "qi", "b_persistence")


@query(f"WITH {GRID}, {growth_sql('filled')} SELECT c_custkey AS entity, count(g.qi) AS n_rows, count(g.yoy) AS n_labelled, min(g.qi) AS first_qi, max(g.qi) AS last_qi FROM customer LEFT JOIN g ON c_custkey = g.entity GROUP BY 1")
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    x = series.clean_growth(series.gap_free(v.sparse(spark, d), static=["grp"]))
    return panel.coverage_audit(x, v.table(spark, d, "customer").select(F.col("c_custkey").alias("entity")))


_RISK = ["ret", "vol", "beta"]


@query(f"""WITH {DAILY}, {BENCH}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS cal FROM (SELECT DISTINCT date FROM daily)),
r0 AS (SELECT entity, daily.date, cal, px, lag(px) OVER w AS pp, lag(cal) OVER w AS pc FROM daily JOIN cal ON daily.date = cal.date WINDOW w AS (PARTITION BY entity ORDER BY cal)),
r AS (SELECT entity, date, cal, CASE WHEN cal - pc = 1 THEN px / nullif(pp, 0) - 1 END AS ret FROM r0),
b AS (SELECT cal.cal, px / nullif(lag(px) OVER (ORDER BY bench.date), 0) - 1 AS rb FROM bench JOIN cal ON bench.date = cal.date),
bv AS (SELECT cal, rb, CASE WHEN count(rb) OVER w >= 5 THEN var_samp(rb) OVER w END AS var_b FROM b WINDOW w AS (ORDER BY cal RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
j AS (SELECT r.*, bv.rb, bv.var_b FROM r LEFT JOIN bv ON r.cal = bv.cal),
x AS (SELECT entity, date, ret, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END * sqrt(5e0) AS vol,
       CASE WHEN count(CASE WHEN ret IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER w >= 5 THEN covar_samp(ret, rb) OVER w END / nullif(var_b, 0) AS beta
FROM j WINDOW w AS (PARTITION BY entity ORDER BY cal RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT entity, date, {sql_round(_RISK)} FROM x""")
def rolling_risk(spark: SparkSession, d: str) -> DataFrame:
    r = market.calendar_returns(v.daily(spark, d))
    calendar = r.select("date", "cal").distinct()
    change = F.try_divide(F.col("px"), F.lag("px").over(Window.orderBy("date"))) - 1
    b = v.bench(spark, d).withColumn("rb", change).join(calendar, "date").select("cal", "rb")
    return rounded(market.rolling_risk(r, b, 5), _RISK).select("entity", "date", *_RISK)


_YEAR = ["vol", "beta", "ret_short", "ret_long", "drawdown"]


def carried(spark: SparkSession, d: str) -> DataFrame:
    """daily with the last known price on every day of the calendar."""
    x = v.daily(spark, d)
    grid = x.select("entity").distinct().crossJoin(F.broadcast(x.select("date").distinct()))  # nations x days
    last = F.last("px", True).over(Window.partitionBy("entity").orderBy("date"))
    return grid.join(x.select("entity", "date", "px"), ["entity", "date"], "left").withColumn("px", last)


@query(f"""WITH {DAILY}, {BENCH}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS cal FROM (SELECT DISTINCT date FROM daily)),
g AS (SELECT e.entity, cal.date, cal, last_value(px IGNORE NULLS) OVER (PARTITION BY e.entity ORDER BY cal.date) AS px FROM (SELECT DISTINCT entity FROM daily) e CROSS JOIN cal LEFT JOIN daily ON daily.entity = e.entity AND daily.date = cal.date),
r AS (SELECT *, px / nullif(lag(px) OVER w, 0) - 1 AS ret, px / nullif(lag(px, 63) OVER w, 0) - 1 AS ret_short, px / nullif(lag(px, 126) OVER w, 0) - 1 AS ret_long,
  px / nullif(CASE WHEN count(px) OVER (w ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) >= 21 THEN max(px) OVER (w ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) END, 0) - 1 AS drawdown FROM g WINDOW w AS (PARTITION BY entity ORDER BY cal)),
b AS (SELECT cal.cal, px / nullif(lag(px) OVER (ORDER BY bench.date), 0) - 1 AS rb FROM bench JOIN cal ON bench.date = cal.date),
bv AS (SELECT cal, rb, CASE WHEN count(rb) OVER w >= 252 THEN var_samp(rb) OVER w END AS var_b FROM b WINDOW w AS (ORDER BY cal RANGE BETWEEN 251 PRECEDING AND CURRENT ROW)),
x AS (SELECT entity, date, ret_short, ret_long, drawdown, CASE WHEN count(ret) OVER w >= 252 THEN stddev_samp(ret) OVER w END * sqrt(252e0) AS vol,
       CASE WHEN count(CASE WHEN ret IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER w >= 252 THEN covar_samp(ret, rb) OVER w END / nullif(var_b, 0) AS beta
FROM r LEFT JOIN bv ON r.cal = bv.cal WINDOW w AS (PARTITION BY entity ORDER BY r.cal RANGE BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT entity, date, {sql_round(_YEAR)} FROM x""")
def yearly_risk(spark: SparkSession, d: str) -> DataFrame:
    """Volatility and beta over 252 days, returns over 63 and 126, and the fall from the highest price of 63 (21 at least)."""
    px = carried(spark, d)
    r = market.calendar_returns(px)
    change = F.try_divide(F.col("px"), F.lag("px").over(Window.orderBy("date"))) - 1
    b = v.bench(spark, d).withColumn("rb", change).join(r.select("date", "cal").distinct(), "date").select("cal", "rb")
    risk = market.rolling_risk(r, b).select("entity", "date", "vol", "beta")
    return rounded(risk.join(market.momentum(px), ["entity", "date"]), _YEAR).select("entity", "date", *_YEAR)


_GROWN_COLUMNS = ["entity", "grp", "qi", "revenue", "n_orders", "yoy", "qoq", "ttm", "b_persistence", "b_seasonal", "b_mean_4", "b_mean_8", "b_history"]


@query(f"""WITH {GROWN} SELECT c AS column_name, CASE WHEN c LIKE 'b\\_%' ESCAPE '\\' THEN 'baseline' WHEN c LIKE 'y%' THEN 'target' ELSE 'other' END AS family, n AS n_filled
FROM (SELECT unnest([{', '.join(f"'{c}'" for c in _GROWN_COLUMNS)}]) AS c, unnest([{', '.join(f'count({c})' for c in _GROWN_COLUMNS)}]) AS n FROM grown)""")
def column_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return panel.column_dictionary(v.grown(spark, d))
