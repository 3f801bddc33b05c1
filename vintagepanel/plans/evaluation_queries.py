"""Queries of the evaluation, calibration, blending and correlation operators, each with the same in SQL where SQL has it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.functions import guarded as g
from vintagepanel.functions.sizes import cut_lineage
from vintagepanel.operators import blending, conformal, correlation, evaluation, panel, ridge, series
from vintagepanel.plans import views as v
from vintagepanel.plans.feed_queries import _folder
from vintagepanel.plans.panel_queries import _FEATURE_SQL, _QUARTERS, quarterly_series, sql_round
from vintagepanel.plans.views import DENSE, GROWN, SERIES, SPARSE, growth_sql, rounded
from vintagepanel.sources import feeds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Naive models, and the settings that fit a panel of 27 quarters.
MODELS = ["b_persistence", "b_seasonal", "b_mean_4", "b_mean_8", "b_history"]
WARMUP, MIN_TRAIN, MIN_CAL, ALPHA = 2, 100, 50, 0.2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.walk_forward_baselines(v.grown(spark, d), "yoy", MODELS, WARMUP, MIN_TRAIN)


_LISTED = ", ".join(f"'{m}'" for m in MODELS)
FORECASTS = f"""{GROWN},
per AS (SELECT qi, count(*) AS n, sum(yoy) AS s FROM grown WHERE yoy IS NOT NULL GROUP BY qi),
past AS (SELECT qi, row_number() OVER (ORDER BY qi) AS i, coalesce(sum(n) OVER w, 0) AS n_train, sum(s) OVER w AS s_train FROM per WINDOW w AS (ORDER BY qi RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
okq AS (SELECT qi, CAST(n_train AS BIGINT) AS n_train, s_train / n_train AS train_mean FROM past WHERE i > {WARMUP} AND n_train >= {MIN_TRAIN}),
fc AS (SELECT unnest([{_LISTED}, 'expanding_mean']) AS model, entity, grp, grown.qi, yoy AS y_true,
       unnest([{', '.join(f'coalesce({m}, train_mean)' for m in MODELS)}, train_mean]) AS y_pred FROM grown JOIN okq ON grown.qi = okq.qi WHERE yoy IS NOT NULL)"""

METRICS = """count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse,
       1 - sum((y_pred - y_true) * (y_pred - y_true)) / nullif(var_pop(y_true) * count(*), 0) AS r2, avg(CASE WHEN sign(y_true) = sign(y_pred) THEN 1e0 ELSE 0e0 END) AS dir_acc"""
_M = ["mae", "rmse", "r2", "dir_acc"]


@query(f"WITH {FORECASTS}, s AS (SELECT model, {METRICS} FROM fc GROUP BY model) SELECT model, n, {sql_round(_M)} FROM s")
def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    """Which naive growth rule forecasts the next quarter's yearly growth best."""
    return rounded(evaluation.score(forecasts(spark, d)), _M)


@query(f"WITH {FORECASTS} SELECT qi, n_train, {sql_round(['train_mean'])} FROM okq")
def walk_forward_quarters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.qualifying_quarters(v.grown(spark, d), "yoy", WARMUP, MIN_TRAIN), ["train_mean"])


@query(f"""WITH {FORECASTS}, c AS (
  SELECT 'all' AS cut, 'all' AS value, * FROM fc UNION ALL SELECT 'grp', grp, * FROM fc UNION ALL SELECT 'entity', entity, * FROM fc),
s AS (SELECT cut, value, model, {METRICS} FROM c GROUP BY ALL HAVING count(*) >= 5) SELECT cut, value, model, n, {sql_round(_M)} FROM s""")
def score_cuts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.score_cuts(forecasts(spark, d), ["grp", "entity"]), _M)


_SIX = ["mae", "rmse", "r2", "median_ae", "mape", "median_ape", "change_acc"]


@query(f"""WITH {FORECASTS}, b AS (SELECT entity, qi, y_pred AS p FROM fc WHERE model = 'b_persistence'),
s AS (SELECT model, {METRICS}, median(abs(y_pred - y_true)) AS median_ae, avg(abs(y_pred - y_true) / abs(y_true)) FILTER (WHERE abs(y_true) >= 0.01e0) AS mape,
       median(abs(y_pred - y_true) / abs(y_true)) FILTER (WHERE abs(y_true) >= 0.01e0) AS median_ape, avg(CASE WHEN sign(y_true - p) = sign(y_pred - p) THEN 1e0 ELSE 0e0 END) AS change_acc
FROM fc JOIN b USING (entity, qi) GROUP BY model) SELECT model, n, {sql_round(_SIX)} FROM s""")
def six_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    return rounded(evaluation.six_metrics(f, f.filter("model = 'b_persistence'")), _SIX)


@query(f"WITH {FORECASTS} SELECT 'ensemble' AS model, entity, grp, qi, round(any_value(y_true), 6) + 0.0e0 AS y_true, round(avg(y_pred), 6) + 0.0e0 AS y_pred FROM fc GROUP BY entity, grp, qi HAVING count(*) >= 2")
def ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.ensemble(forecasts(spark, d)), ["y_true", "y_pred"])


BANDS = f"""{FORECASTS}, h AS (SELECT entity, grp, qi, y_true, y_pred FROM fc WHERE model = 'b_history'),
qs AS (SELECT h1.qi, count(*) AS n, quantile_cont(h2.y_true - h2.y_pred, 0.1) AS a, quantile_cont(h2.y_true - h2.y_pred, 0.5) AS m, quantile_cont(h2.y_true - h2.y_pred, 0.9) AS b
  FROM (SELECT DISTINCT qi FROM h) h1 JOIN h h2 ON h2.qi < h1.qi GROUP BY h1.qi HAVING count(*) >= {MIN_CAL}),
bands AS (SELECT entity, grp, h.qi, y_true, y_pred + a AS q10, y_pred + m AS q50, y_pred + b AS q90 FROM h JOIN qs ON h.qi = qs.qi)"""


def bands(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(evaluation.quantile_walk_forward(cut_lineage(forecasts(spark, d).filter("model = 'b_history'")), least=MIN_CAL))


@query(f"WITH {BANDS} SELECT entity, grp, qi, {sql_round(['y_true', 'q10', 'q50', 'q90'])} FROM bands")
def quantile_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bands(spark, d), ["y_true", "q10", "q50", "q90"])


_QR = ["coverage", "mean_width", "median_width", "pinball_low", "pinball_mid", "pinball_high", "mid_mae", "mid_rmse", "mid_dir_acc"]


def _pin(p: str, a: float) -> str:
    return f"avg(greatest((y_true - {p}) * {a}e0, (y_true - {p}) * ({a}e0 - 1)))"


@query(f"""WITH {BANDS}, s AS (SELECT count(*) AS n, avg(CASE WHEN y_true BETWEEN q10 AND q90 THEN 1e0 ELSE 0e0 END) AS coverage, avg(q90 - q10) AS mean_width, median(q90 - q10) AS median_width,
 {_pin('q10', 0.1)} AS pinball_low, {_pin('q50', 0.5)} AS pinball_mid, {_pin('q90', 0.9)} AS pinball_high, avg(abs(y_true - q50)) AS mid_mae, sqrt(avg((y_true - q50) * (y_true - q50))) AS mid_rmse,
 avg(CASE WHEN sign(y_true) = sign(q50) THEN 1e0 ELSE 0e0 END) AS mid_dir_acc FROM bands) SELECT n, {sql_round(_QR)} FROM s""")
def quantile_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.quantile_report(bands(spark, d)), _QR)


PAIRED = f"""{FORECASTS}, pa AS (
  SELECT a.entity, a.grp, a.qi, a.y_true, a.y_pred AS p_a, b.y_pred AS p_b FROM fc a JOIN fc b ON a.entity = b.entity AND a.qi = b.qi WHERE a.model = 'b_persistence' AND b.model = 'b_history'),
paired AS (SELECT *, (p_a - y_true) * (p_a - y_true) - (p_b - y_true) * (p_b - y_true) AS d_se, abs(p_a - y_true) - abs(p_b - y_true) AS d_ae,
  CASE WHEN sign(y_true) = sign(p_b) THEN 1e0 ELSE 0e0 END - CASE WHEN sign(y_true) = sign(p_a) THEN 1e0 ELSE 0e0 END AS d_hit FROM pa)"""
PER_Q = f"{PAIRED}, pq AS (SELECT qi, avg(d_se) AS d_se, avg(d_ae) AS d_ae, avg(d_hit) AS d_hit FROM paired GROUP BY qi)"
_D = ["d_se", "d_ae", "d_hit"]


def paired(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pair(forecasts(spark, d), "b_persistence", "b_history")


@query(f"WITH {PER_Q} SELECT qi, {sql_round(_D)} FROM pq")
def paired_per_quarter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.per_quarter(paired(spark, d)), _D)


_T = ["mean_d", "stat", "best_share"]


def dm_sql(source: str, by: str, metrics: tuple[str, ...] = ("d_se", "d_ae", "d_hit"), lags: int | None = None) -> str:
    """CTE dm of the paired test per group of by (a column of source, which has a row a quarter and group) and metric, without the p-value, for which SQL has no function."""
    most = "CAST(floor(pow(CAST(count(*) AS DOUBLE), 1.0e0 / 3.0e0)) AS INTEGER)" if lags is None else str(lags)
    return f"""lg AS (SELECT {by} AS g, qi, unnest([{', '.join(f"'{m}'" for m in metrics)}]) AS metric, unnest([{', '.join(metrics)}]) AS d FROM {source}),
t AS (SELECT g, metric, count(*) AS n_q, avg(d) AS mean_d, {most} AS hac_lags, count(*) FILTER (WHERE d > 0) AS better, CASE WHEN sum(d) > 0 THEN max(d) / sum(d) END AS best_share FROM lg GROUP BY g, metric),
e AS (SELECT lg.g, lg.metric, d - mean_d AS e, row_number() OVER (PARTITION BY lg.g, lg.metric ORDER BY qi) AS i FROM lg JOIN t ON lg.metric = t.metric AND lg.g = t.g),
dg AS (SELECT g, metric, avg(e * e) AS g0 FROM e GROUP BY g, metric),
k AS (SELECT a.g, a.metric, 2 * sum((1 - (a.i - b.i) / (hac_lags + 1e0)) * a.e * b.e / n_q) AS gk FROM e a JOIN e b ON a.g = b.g AND a.metric = b.metric AND a.i > b.i JOIN t ON a.metric = t.metric AND a.g = t.g WHERE a.i - b.i <= hac_lags GROUP BY a.g, a.metric),
dm AS (SELECT t.*, CASE WHEN n_q >= 8 THEN mean_d / sqrt(greatest(g0 + coalesce(gk, 0), 1e-12) / n_q) * sqrt((n_q - 1e0) / n_q) END AS stat FROM t JOIN dg ON t.metric = dg.metric AND t.g = dg.g LEFT JOIN k ON t.metric = k.metric AND t.g = k.g)"""


_TESTS = ["n_q", "hac_lags", "better"]


@query(f"WITH {PER_Q}, {dm_sql('pq', '0')} SELECT metric, n_q, hac_lags, better, {sql_round(_T)} FROM dm")
def ablation_tests(spark: SparkSession, d: str) -> DataFrame:
    """The test without its p-value, which SQL has no function for (a golden pair tests it)."""
    t = evaluation.ablation_tests(evaluation.per_quarter(paired(spark, d)))
    return rounded(t, _T).select("metric", *_TESTS, *_T)


_PER_GROUP = f"{PAIRED}, pg AS (SELECT grp, qi, avg(d_se) AS d_se, avg(d_ae) AS d_ae, avg(d_hit) AS d_hit FROM paired GROUP BY grp, qi)"


@query(f"WITH {_PER_GROUP}, {dm_sql('pg', 'grp')} SELECT g AS grp, metric, n_q, hac_lags, better, {sql_round(_T)} FROM dm")
def delta_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Tests per group, without p-values."""
    t = evaluation.ablation_tests(evaluation.per_quarter(paired(spark, d), ["grp"]), by=["grp"])
    return rounded(t, _T).select("grp", "metric", *_TESTS, *_T)


@query(f"WITH {_PER_GROUP}, late AS (SELECT * FROM pg WHERE qi >= 1998 * 4), {dm_sql('late', 'grp')} SELECT g AS grp, metric, n_q, hac_lags, better, {sql_round(_T)} FROM dm")
def covered_window_retest(spark: SparkSession, d: str) -> DataFrame:
    """Tests per group on the quarters from 1998 on alone, without p-values."""
    late = paired(spark, d).filter(F.col("qi") >= 1998 * 4)
    t = evaluation.ablation_tests(evaluation.per_quarter(late, ["grp"]), by=["grp"])
    return rounded(t, _T).select("grp", "metric", *_TESTS, *_T)


_BEST = ["rmse_best", "rmse_reference", "mean_d", "stat"]


@query(f"""WITH {FORECASTS}, en AS (SELECT entity, qi, avg(y_pred) AS p_b FROM fc GROUP BY 1, 2 HAVING count(*) >= 2),
bo AS (SELECT fc.*, p_b FROM fc JOIN en ON fc.entity = en.entity AND fc.qi = en.qi),
sc0 AS (SELECT model, count(*) AS n, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse_best, sqrt(avg((p_b - y_true) * (p_b - y_true))) AS rmse_reference FROM bo GROUP BY 1 ORDER BY rmse_best, model LIMIT 1),
pb AS (SELECT bo.model, qi, avg((y_pred - y_true) * (y_pred - y_true) - (p_b - y_true) * (p_b - y_true)) AS d FROM bo JOIN sc0 ON bo.model = sc0.model GROUP BY 1, 2), {dm_sql('pb', 'model', ('d',), 4)},
o AS (SELECT sc0.*, n_q, hac_lags, mean_d, stat FROM sc0 JOIN dm ON sc0.model = dm.g) SELECT model AS best_model, n, n_q, hac_lags, {sql_round(_BEST)} FROM o""")
def best_model_on_common_rows(spark: SparkSession, d: str) -> DataFrame:
    """The best of the models against the blend of all on the rows they share, with four lags; without the p-value."""
    f = cut_lineage(forecasts(spark, d))
    x = evaluation.best_on_common_rows(f.unionByName(evaluation.ensemble(f)), "ensemble")
    return rounded(x, _BEST).select("best_model", "n", "n_q", "hac_lags", *_BEST)


@query(f"""WITH {FORECASTS}, s AS (SELECT model, {METRICS} FROM fc GROUP BY model),
pr AS (SELECT 'earlier best (' || model || '/lags)' AS model, n, mae * 1.5e0 AS mae, rmse * 2e0 AS rmse, r2 - 1 AS r2, dir_acc / 2e0 AS dir_acc, 'another target: errors do not compare' AS note FROM s WHERE model <> 'b_history' ORDER BY rmse, model LIMIT 1),
u AS (SELECT *, NULL AS note FROM s UNION ALL SELECT * FROM pr) SELECT model, n, {sql_round(_M)}, note FROM u""")
def prior_suite_row(spark: SparkSession, d: str) -> DataFrame:
    """The scores, and the best row of an earlier suite that landed as CSV."""
    s = cut_lineage(evaluation.score(forecasts(spark, d)))
    e = s.select(F.col("model").alias("model_family"), F.lit("lags").alias("feature_set"), F.when(F.col("model") == "b_history", "GROUP").otherwise("ALL").alias("scope"), "n", (F.col("mae") * 1.5).alias("mae"), (F.col("rmse") * 2.0).alias("rmse"), (F.col("r2") - 1).alias("r2"), (F.col("dir_acc") / 2.0).alias("directional_accuracy"))
    path = _folder(spark, "suite")
    feeds.save(e, path, "csv")
    return rounded(evaluation.with_prior_best(s, spark.read.csv(path, header=True, inferSchema=True)), _M)


@query()
def ablation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Tests with p-values and labels, per group."""
    quarterly = evaluation.per_quarter(paired(spark, d), ["grp"])
    return evaluation.verdict(evaluation.ablation_tests(quarterly, by=["grp"]))


_Y = ["rmse_a", "rmse_b", "d_rmse", "d_dir_acc"]


@query(f"""WITH {PAIRED}, s AS (SELECT qi // 4 AS year, count(*) AS n, sqrt(avg((p_a - y_true) * (p_a - y_true))) AS rmse_a, sqrt(avg((p_b - y_true) * (p_b - y_true))) AS rmse_b, avg(d_hit) AS d_dir_acc FROM paired GROUP BY 1),
x AS (SELECT *, rmse_a - rmse_b AS d_rmse FROM s) SELECT CAST(year AS BIGINT) AS year, n, {sql_round(_Y)} FROM x""")
def delta_by_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.delta_by_year(paired(spark, d)), _Y).select("year", "n", *_Y)


@query(f"""WITH {FORECASTS}, s AS (SELECT model, entity, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse FROM fc GROUP BY 1, 2)
SELECT b.model AS baseline, count(*) AS n_entities, count(*) FILTER (WHERE a.rmse < b.rmse) AS n_better FROM s a JOIN s b ON a.entity = b.entity WHERE a.model = 'b_history' AND b.model <> 'b_history' GROUP BY 1""")
def skill_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.skill_counts(evaluation.score(forecasts(spark, d), ["entity"]), "b_history")


@query(f"""WITH {FORECASTS}, s AS (SELECT grp, model, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, model IN ('b_persistence', 'b_seasonal', 'expanding_mean') AS b FROM fc GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, b ORDER BY rmse, model) AS n FROM s)
SELECT m.grp, m.model AS best_model, round(m.rmse, 6) AS rmse_model, k.model AS best_baseline, round(k.rmse, 6) AS rmse_baseline, round((1 - m.rmse / nullif(k.rmse, 0)) * 100, 6) + 0.0e0 AS gain_pct
FROM r m JOIN r k ON m.grp = k.grp WHERE m.n = 1 AND k.n = 1 AND NOT m.b AND k.b""")
def compare_groups(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.score(forecasts(spark, d), ["grp"])
    x = evaluation.compare_best(s, F.col("model").isin("b_persistence", "b_seasonal", "expanding_mean"), ["grp"])
    return rounded(x, ["rmse_model", "rmse_baseline", "gain_pct"]).select("grp", "best_model", "rmse_model", "best_baseline", "rmse_baseline", "gain_pct")


_MR = ["rmse_a", "rmse_b", "rmse_delta", "pct_change"]


@query(f"""WITH {PAIRED}, s AS (SELECT grp, count(*) AS n, sqrt(avg((p_a - y_true) * (p_a - y_true))) AS rmse_a, sqrt(avg((p_b - y_true) * (p_b - y_true))) AS rmse_b FROM paired GROUP BY 1),
x AS (SELECT *, rmse_b - rmse_a AS rmse_delta, (rmse_b / nullif(rmse_a, 0) - 1) * 100 AS pct_change FROM s) SELECT grp, n, {sql_round(_MR)} FROM x""")
def matched_rows(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    return rounded(evaluation.matched_rows(f.filter("model = 'b_persistence'"), f.filter("model = 'b_history'"), ["grp"]), _MR)


_TAIL = ["p50", "p75", "p90", "p95", "p99", "top_share"]


@query(f"""WITH {FORECASTS}, b AS (SELECT entity, qi, y_pred AS p_b FROM fc WHERE model = 'b_history'),
x AS (SELECT model, fc.entity, fc.qi, abs(y_pred - y_true) AS e, (y_pred - y_true) * (y_pred - y_true) - (p_b - y_true) * (p_b - y_true) AS x FROM fc JOIN b ON fc.entity = b.entity AND fc.qi = b.qi WHERE model <> 'b_history'),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY x DESC, entity, qi) AS n FROM x),
s AS (SELECT model, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.75) AS p75, quantile_cont(e, 0.9) AS p90, quantile_cont(e, 0.95) AS p95, quantile_cont(e, 0.99) AS p99, CASE WHEN sum(x) > 0 THEN sum(x) FILTER (WHERE n <= 10) / sum(x) END AS top_share FROM r GROUP BY 1)
SELECT model, {sql_round(_TAIL)} FROM s""")
def error_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.error_tail(forecasts(spark, d), "b_history"), _TAIL)


@query(f"WITH {FORECASTS}, s AS (SELECT model, qi, avg(y_true - y_pred) AS shock, count(*) AS n FROM fc GROUP BY 1, 2) SELECT model, qi, n, {sql_round(['shock'])} FROM s")
def residual_shocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.residual_shocks(forecasts(spark, d)), ["shock"])


_LAGS, _AIMS = [f"yoy_l{k}" for k in (1, 2, 3, 4)], ["yoy", "qoq"]
_EXPLAIN = MODELS + _LAGS
_IMPORTANCE = f"""{GROWN}, lagged AS (SELECT *, {', '.join(f'lag(yoy, {k}) OVER w AS yoy_l{k}' for k in (1, 2, 3, 4))} FROM grown WINDOW w AS (PARTITION BY entity ORDER BY qi)),
pairs AS ({' UNION ALL '.join(f"SELECT '{t}' AS target, '{f}' AS feature, {t} AS y, {f} AS x FROM lagged WHERE {t} IS NOT NULL AND {f} IS NOT NULL" for t in _AIMS for f in _EXPLAIN)}),
explained AS (SELECT target, feature, coalesce(corr(y, x) * corr(y, x), 0) AS r2 FROM pairs GROUP BY 1, 2),
imp AS (SELECT *, 100 * r2 / nullif(sum(r2) OVER (PARTITION BY target), 0) AS gain_pct FROM explained)"""


def _lagged(spark: SparkSession, d: str) -> DataFrame:
    w = g.series()
    return v.grown(spark, d).withColumns({f"yoy_l{k}": F.lag("yoy", k).over(w) for k in (1, 2, 3, 4)})


@query(f"WITH {_IMPORTANCE} SELECT target, feature, {sql_round(['r2', 'gain_pct'])} FROM imp")
def association_importance(spark: SparkSession, d: str) -> DataFrame:
    """How much of the variance of growth each known column explains by itself."""
    return rounded(evaluation.association_importance(_lagged(spark, d), _AIMS, _EXPLAIN), ["r2", "gain_pct"])


@query(f"""WITH {_IMPORTANCE}, w AS (SELECT feature, {', '.join(f"coalesce(sum(gain_pct) FILTER (WHERE target = '{t}'), 0) AS {t}" for t in _AIMS)}, regexp_extract(feature, '_l(\\d)$', 1) AS lag FROM imp GROUP BY feature)
SELECT feature, {sql_round(_AIMS)}, 'lag ' || CASE WHEN lag = '' THEN '1' ELSE lag END AS lag_bucket FROM w""")
def importance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.importance_matrix(evaluation.association_importance(_lagged(spark, d), _AIMS, _EXPLAIN), _AIMS), _AIMS)


@query(f"""WITH {_IMPORTANCE}, gi AS (SELECT CASE WHEN feature LIKE 'b\\_mean%' ESCAPE '\\' THEN 'means' WHEN feature LIKE 'b\\_%' ESCAPE '\\' THEN 'single' ELSE 'other' END AS family, sum(gain_pct) AS gain_pct, count(*) AS n_features FROM imp WHERE target = 'yoy' GROUP BY 1)
SELECT family, n_features, {sql_round(['gain_pct'])} FROM gi""")
def grouped_importance(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.association_importance(_lagged(spark, d), ["yoy"], _EXPLAIN)
    return rounded(evaluation.grouped_importance(found, [("b_mean", "means"), ("b_", "single")]), ["gain_pct"])


@query(f"""WITH {_IMPORTANCE}, s AS (SELECT feature, unnest(['r2', 'same_sign', 'closeness']) AS method,
  unnest([round(corr(y, x) * corr(y, x), 9), avg(CASE WHEN sign(y) = sign(x) THEN 1e0 ELSE 0e0 END), round(-avg((y - x) * (y - x)), 9)]) AS x FROM pairs WHERE target = 'yoy' GROUP BY feature),
r AS (SELECT feature, method, rank() OVER (PARTITION BY method ORDER BY x) + (count(*) OVER (PARTITION BY method, x) - 1) / 2e0 AS r FROM s)
SELECT a.method AS method_a, b.method AS method_b, round(CASE WHEN stddev_pop(a.r) > 0 AND stddev_pop(b.r) > 0 THEN corr(a.r, b.r) END, 6) + 0.0e0 AS spearman FROM r a JOIN r b ON a.feature = b.feature AND a.method < b.method GROUP BY 1, 2""")
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether three measures of a column's worth for forecasting growth put the columns in the same order."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in _EXPLAIN]))
    pairs = _lagged(spark, d).filter("yoy IS NOT NULL").select("yoy", each.alias("p")).select("yoy", "p.*").filter("x IS NOT NULL")
    r, off = g.correlation(F.col("yoy"), F.col("x")), F.col("yoy") - F.col("x")
    same = F.avg(F.when(F.signum("yoy") == F.signum("x"), 1.0).otherwise(0.0))
    worth = pairs.groupBy("feature").agg(F.round(r * r, 9).alias("r2"), same.alias("same_sign"), F.round(-F.avg(off * off), 9).alias("closeness"))
    return rounded(evaluation.rank_agreement(worth, ["r2", "same_sign", "closeness"]), ["spearman"])


_RIDGE = ["f_lag_yoy_1", "f_lag_yoy_2", "f_mean_4", "f_lag_qoq"]


def _features(spark: SparkSession, d: str) -> DataFrame:
    return panel.baselines(series.growth_features(series.clean_growth(v.dense(spark, d))))


def _moments_sql(source: str, sets: dict[str, list[str]]) -> str:
    """CTEs rz (rows with z = 1, features, y) and ro (their moments a model and quarter, upper triangle)."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS model, entity, grp, qi, [1e0, {', '.join(f'coalesce({c}, 0e0)' for c in columns)}, yoy] AS z FROM {source} WHERE yoy IS NOT NULL" for name, columns in sets.items())
    return f"""rz AS (SELECT *, len(z) - 2 AS k FROM ({rows})),
ri AS (SELECT *, unnest(range(1, k + 3)) AS i FROM rz), rj AS (SELECT *, unnest(range(i, k + 3)) AS j FROM ri),
ro AS (SELECT model, k, qi, i, j, sum(z[i] * z[j]) AS v FROM rj GROUP BY ALL)"""


def _solve_sql(source: str, keys: list[str], penalty: str) -> str:
    """CTE rt (keys, base, slope) of ridge fits on the moments in source (keys, k, i, j, v): features standardised, then elimination, a column a step. For WITH RECURSIVE."""
    key, same = ", ".join(keys), lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in keys)
    of = lambda t: ", ".join(f"{t}.{c}" for c in keys)
    pivot = "m[s + 1][s + 1]"
    return f"""rm AS (SELECT {of('f')}, f.j AS i, n.v AS n, f.v / n.v AS mean, sqrt(greatest(d.v / n.v - (f.v / n.v) * (f.v / n.v), 0)) AS sd, y.v AS sum_y
  FROM {source} f JOIN {source} d ON {same('d', 'f')} AND d.i = f.j AND d.j = f.j JOIN {source} n ON {same('n', 'f')} AND n.i = 1 AND n.j = 1
  JOIN {source} y ON {same('y', 'f')} AND y.i = 1 AND y.j = f.k + 2 WHERE f.i = 1 AND f.j BETWEEN 2 AND f.k + 1),
rs AS (SELECT * REPLACE (CASE WHEN sd < 1e-12 THEN 'inf'::DOUBLE ELSE sd END AS sd) FROM rm),
re AS (SELECT {of('a')}, a.i, a.j, (a.v - p.n * p.mean * q.mean) / p.sd / q.sd + CASE WHEN a.i = a.j THEN {penalty} ELSE 0e0 END AS v FROM {source} a JOIN rs p ON {same('p', 'a')} AND p.i = a.i JOIN rs q ON {same('q', 'a')} AND q.i = a.j
  UNION ALL SELECT {of('a')}, a.i, a.j, (a.v - p.mean * p.sum_y) / p.sd FROM {source} a JOIN rs p ON {same('p', 'a')} AND p.i = a.i WHERE a.j = a.k + 2),
rb AS (SELECT * FROM re UNION ALL SELECT {of('re')}, re.j AS i, re.i AS j, re.v FROM re JOIN rs ON {same('rs', 're')} AND rs.i = re.j WHERE re.i < re.j),
rr AS (SELECT {key}, i, list(v ORDER BY j) AS r FROM rb GROUP BY ALL),
el AS (SELECT {key}, CAST(0 AS BIGINT) AS s, list(r ORDER BY i) AS m FROM rr GROUP BY {key}
  UNION ALL SELECT {key}, s + 1, list_transform(m, lambda r, i: CASE WHEN i = s + 1 THEN list_transform(r, lambda x: x / {pivot}) ELSE list_transform(r, lambda x, j: x - r[s + 1] / {pivot} * m[s + 1][j]) END) FROM el WHERE s < len(m)),
rl AS (SELECT {key}, unnest(range(2, len(m) + 2)) AS i, unnest(list_transform(m, lambda r: r[-1])) AS b FROM el WHERE s = len(m)),
rt AS (SELECT {key}, list(b / sd ORDER BY i) AS slope, any_value(sum_y / n) - sum(b / sd * mean) AS base FROM rl JOIN rs USING ({key}, i) GROUP BY {key})"""


_PAST = "OVER (PARTITION BY model, i, j ORDER BY qi RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def ridge_sql(source: str, sets: dict[str, list[str]], penalty: float = 1.0) -> str:
    """CTE rg (model, entity, grp, qi, y_true, y_pred) of walk-forward ridge fits of yoy in source. Stands after FORECASTS, whose okq lists the test quarters."""
    return f"""{_moments_sql(source, sets)},
rc AS (SELECT * REPLACE (sum(v) {_PAST} AS v) FROM ro), ra AS (SELECT rc.* FROM rc JOIN okq ON rc.qi = okq.qi),
{_solve_sql('ra', ['model', 'qi'], repr(penalty))},
rg AS (SELECT model, entity, grp, qi, z[-1] AS y_true, base + list_sum(list_transform(slope, lambda b, i: b * z[i + 1])) AS y_pred FROM rz JOIN rt USING (model, qi))"""


_RIDGE_FEATURES = f"{FORECASTS}, {_FEATURE_SQL}"


@query(f"WITH RECURSIVE {_RIDGE_FEATURES}, {ridge_sql('f', {'ridge': _RIDGE})} SELECT model, entity, grp, qi, {sql_round(['y_true', 'y_pred'])} FROM rg")
def ridge_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Ridge forecasts from running cross-products; tests also compare them with a fit per quarter."""
    return rounded(ridge.walk_forward(_features(spark, d), "yoy", _RIDGE, warmup=WARMUP, min_train=MIN_TRAIN), ["y_true", "y_pred"])


_PENALTIES = (0.1, 1.0, 10.0, 100.0)


@query(f"""WITH RECURSIVE {_RIDGE_FEATURES}, {_moments_sql('f', {'ridge': _RIDGE})},
tq AS (SELECT okq.qi, n_train, i, j, k, ro.qi % 5 AS fold, sum(v) AS v FROM okq JOIN ro ON ro.qi < okq.qi GROUP BY ALL),
wh AS (SELECT qi, i, j, sum(v) AS v FROM tq GROUP BY ALL),
fo AS (SELECT tq.*, wh.v - tq.v AS rest FROM tq JOIN wh USING (qi, i, j)),
able AS (SELECT qi, fold FROM fo WHERE i = 1 AND j = 1 AND v >= 1 AND rest >= 2),
ra AS (SELECT qi, fold, p, i, j, k, rest AS v FROM fo JOIN able USING (qi, fold), (SELECT unnest({list(_PENALTIES)}::DOUBLE[]) AS p)),
{_solve_sql('ra', ['qi', 'fold', 'p'], 'a.p')},
co AS (SELECT qi, fold, p, list_concat([base], slope, [-1e0]) AS c FROM rt),
ls AS (SELECT qi, p, sum(c[i] * c[j] * v * CASE WHEN i = j THEN 1 ELSE 2 END) AS loss FROM co JOIN fo USING (qi, fold) GROUP BY ALL)
SELECT qi, okq.n_train, arg_min(p, loss) AS penalty FROM ls JOIN okq USING (qi) GROUP BY ALL""")
def ridge_cross_validated(spark: SparkSession, d: str) -> DataFrame:
    """qi, n_train and the penalty that cross-validation chose; tests also compare it with refits on the rows."""
    f = _features(spark, d)
    return ridge.coefficients(f, "yoy", _RIDGE, warmup=WARMUP, min_train=MIN_TRAIN, penalties=_PENALTIES).select("qi", "n_train", "penalty")


@query()
def specialist_vs_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Ridge per group against one for all, on the rows both forecast, with tests, per group and for ALL; groups with fewer labels than twice the training minimum are skipped."""
    f, least = cut_lineage(_features(spark, d)), 20
    enough = f.groupBy("grp").agg(F.count("yoy").alias("n_labelled")).filter(F.col("n_labelled") >= 2 * least)
    pooled = ridge.walk_forward(f, "yoy", _RIDGE, "pooled", warmup=WARMUP, min_train=least)
    own = ridge.walk_forward(f.join(enough.select("grp"), "grp", "left_semi"), "yoy", _RIDGE, "own", by=["grp"], warmup=WARMUP, min_train=least)
    both = cut_lineage(evaluation.pair(pooled.unionByName(own), "pooled", "own"))
    return evaluation.delta_rows(both, ["grp"]).unionByName(evaluation.delta_rows(both).withColumn("grp", F.lit("ALL")))


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """A panel, its base features, and blocks of further ones."""
    f = panel.macro_join(_features(spark, d), panel.macro_features(quarterly_series(spark, d), list(SERIES), list(SERIES)))
    f = panel.peers(f, "f_lag_yoy_1")
    f = f.withColumns({f"sec_{i}": (F.col("grp") == g).cast("double") for i, g in enumerate(_GROUPS)})
    return cut_lineage(f), _BASE, _BLOCKS


_GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_BASE = _RIDGE[:3]
_BLOCKS = {"momentum": ["f_lag_qoq", "f_qoq_mean_4"], "peers": ["f_lag_yoy_1_peer_mean", "f_lag_yoy_1_vs_peers"]} | {s: [f"mac_{s}_yoy"] for s in SERIES}
_SECTORS = [f"sec_{i}" for i in range(len(_GROUPS))]
_OTHERS = "(count(f_lag_yoy_1) OVER w - CASE WHEN f_lag_yoy_1 IS NOT NULL THEN 1 ELSE 0 END)"
_BLOCK_SQL = f"""{_RIDGE_FEATURES}, {_QUARTERS},
bm AS (SELECT qi + 1 AS qi, {', '.join(f'{s} / nullif(lag({s}, 4) OVER w, 0) - 1 AS mac_{s}_yoy, {s} / nullif(lag({s}, 1) OVER w, 0) - 1 AS mac_{s}_qoq' for s in SERIES)} FROM mq WINDOW w AS (ORDER BY qi)),
bp AS (SELECT *, CASE WHEN {_OTHERS} > 0 THEN (sum(f_lag_yoy_1) OVER w - coalesce(f_lag_yoy_1, 0)) / {_OTHERS} END AS f_lag_yoy_1_peer_mean, median(f_lag_yoy_1) OVER w AS f_lag_yoy_1_peer_median,
  stddev_samp(f_lag_yoy_1) OVER w AS f_lag_yoy_1_peer_std, f_lag_yoy_1 - median(f_lag_yoy_1) OVER w AS f_lag_yoy_1_vs_peers, {', '.join(f"CASE WHEN grp = '{g}' THEN 1e0 ELSE 0e0 END AS sec_{i}" for i, g in enumerate(_GROUPS))} FROM f WINDOW w AS (PARTITION BY grp, qi)),
bf AS (SELECT bp.*, bm.* EXCLUDE (qi) FROM bp LEFT JOIN bm ON bp.qi = bm.qi)"""

#: Macro columns in groups that are decided on together.
THEMES = {
    "levels": [f"mac_{s}" for s in SERIES], "yearly_change": [f"mac_{s}_yoy" for s in SERIES], "quarterly_change": [f"mac_{s}_qoq" for s in SERIES],
    "urgent": [f"mac_{s}{x}" for s in SERIES[:2] for x in ("", "_yoy", "_qoq")], "slack": [f"mac_{s}{x}" for s in SERIES[2:] for x in ("", "_yoy", "_qoq")],
}


def _fits(f: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Ridge forecasts with each set of features, from one table of moments."""
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    return cut_lineage(ridge.walk_forward(f, "yoy", columns, sets=sets, warmup=WARMUP, min_train=MIN_TRAIN))


_SWEEP = {"base": _BASE} | {n: _BASE + c for n, c in _BLOCKS.items()} | {"ALL_BLOCKS": _BASE + [c for b in _BLOCKS.values() for c in b]}


def _sweep(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    f, base, _ = _blocks(spark, d)
    return evaluation.pair_with(_fits(f, _SWEEP), "base").withColumnRenamed("model", "block"), {n: len(c) - len(base) for n, c in _SWEEP.items()}


@query()
def block_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The base model with each block added, and with all: differences and tests, overall and per group."""
    pairs, sizes = _sweep(spark, d)
    rows = evaluation.delta_rows(pairs, ["block"]).withColumn("grp", F.lit("all")).unionByName(evaluation.delta_rows(pairs, ["block", "grp"]))
    return rows.withColumn("n_columns", F.create_map(*[F.lit(x) for n, c in sizes.items() for x in (n, c)])[F.col("block")])


@query(f"""WITH RECURSIVE {_BLOCK_SQL}, {ridge_sql('bf', _SWEEP)},
x AS (SELECT b.model AS block, b.qi, b.y_true AS t, a.y_pred AS p, b.y_pred AS q FROM rg b JOIN rg a USING (entity, qi) WHERE a.model = 'base' AND b.model <> 'base'),
s AS (SELECT block, qi, avg((p - t) * (p - t) - (q - t) * (q - t)) AS d_se, avg(CASE WHEN sign(t) = sign(q) THEN 1e0 ELSE 0e0 END - CASE WHEN sign(t) = sign(p) THEN 1e0 ELSE 0e0 END) AS d_hit FROM x GROUP BY 1, 2)
SELECT block, qi, {sql_round(['d_se', 'd_hit'])} FROM s""")
def block_sweep_quarters(spark: SparkSession, d: str) -> DataFrame:
    """The differences of block_sweep by quarter, so that a block with a part of the history can be tested on what it covers."""
    return rounded(evaluation.per_quarter(_sweep(spark, d)[0], ["block"], ("d_se", "d_hit")), ["d_se", "d_hit"])


@query()
def theme_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The base model with each theme of macro columns added, and with all of them: tests with p-values and labels."""
    f, base, _ = _blocks(spark, d)
    every = list(dict.fromkeys(c for own in THEMES.values() for c in own))
    fits = _fits(f, {"base": base} | {t: base + c for t, c in THEMES.items()} | {"all_themes": base + every})
    quarterly = evaluation.per_quarter(evaluation.pair_with(fits, "base").withColumnRenamed("model", "theme"), ["theme"])
    return evaluation.verdict(evaluation.ablation_tests(quarterly, by=["theme"]))


@query()
def macro_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Without macro columns, with them, and with them alone, beside the naive forecasts: number of features, metrics, and for with_macro the paired tests against no_macro with what they say."""
    f, base, blocks = _blocks(spark, d)
    macro = [c for s in SERIES for c in blocks[s]]
    sets = {"no_macro": base, "with_macro": base + macro, "macro_only": macro + [f"sec_{i}" for i in range(len(_GROUPS))]}
    fits = _fits(f, sets)
    both = evaluation.score(fits).unionByName(evaluation.score(forecasts(spark, d)))
    size = F.coalesce(F.create_map(*[F.lit(x) for n, c in sets.items() for x in (n, len(c))])[F.col("model")], F.lit(0))
    tests = evaluation.verdict(evaluation.ablation_tests(evaluation.per_quarter(evaluation.pair(fits, "no_macro", "with_macro"))))
    told = ["n_q", "mean_d", "hac_lags", "stat", "p_value", "better", "best_share", "verdict", "note"]
    listed = tests.agg(F.sort_array(F.collect_list(F.struct("metric", *told))).alias("tests")).withColumn("model", F.lit("with_macro"))  # three rows
    return both.withColumn("n_features", size).join(F.broadcast(listed), "model", "left")


def _experts(spark: SparkSession, d: str) -> DataFrame:
    f, _, _ = _blocks(spark, d)
    views = panel.expert_columns(f.drop(*THEMES["levels"]), {"company": {"own history", "fundamentals"}, "macro": {"macro"}})
    peers = [c for c in views["full"] if "peer" in c]
    views = {"company": [c for c in views["company"] if c not in peers], "macro": views["macro"], "sector": peers + _SECTORS, "full": views["full"] + _SECTORS}
    wide = blending.widen(_fits(f, views), list(views))
    return blending.softmax_blend(wide, ["company", "macro", "sector"])


# what the experts see, listed for the SQL; the query finds it by the families of the columns
_COMPANY = [*(f"f_lag_yoy_{i}" for i in range(1, 6)), "f_mean_4", "f_mean_8", "f_std_4", "f_std_8", "f_exp_mean", "f_exp_std", "f_exp_n", "f_lag_qoq", "f_qoq_mean_4", "f_accel_1", "f_accel_4", "f_zscore"]
_CHANGES = [f"mac_{s}_{x}" for x in ("yoy", "qoq") for s in SERIES]
_PEER = [f"f_lag_yoy_1_{x}" for x in ("peer_mean", "peer_median", "peer_std", "vs_peers")]
_VIEWS = {"company": _COMPANY, "macro": _CHANGES, "sector": _PEER + _SECTORS, "full": _COMPANY + _CHANGES + _PEER + _SECTORS}
_GATED = ["company", "macro", "sector"]
_EXPERT_SQL = f"""{_BLOCK_SQL}, {ridge_sql('bf', _VIEWS)},
xw AS (SELECT entity, grp, qi, any_value(y_true) AS y_true, {', '.join(f"max(y_pred) FILTER (WHERE model = '{m}') AS \"{m}\"" for m in _VIEWS)} FROM rg GROUP BY entity, grp, qi),
xe AS (SELECT *, {', '.join(f'avg(abs({m} - y_true)) OVER w AS err_{m}' for m in _GATED)} FROM xw WINDOW w AS (PARTITION BY entity ORDER BY qi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
xx AS (SELECT *, {', '.join(f'exp(-coalesce(err_{m}, 0) / 0.05e0) AS x_{m}' for m in _GATED)} FROM xe),
xs AS (SELECT * EXCLUDE ({', '.join(f'x_{m}' for m in _GATED)}), {', '.join(f"x_{m} / ({' + '.join(f'x_{k}' for k in _GATED)}) AS w_{m}" for m in _GATED)} FROM xx),
xg AS (SELECT *, {' + '.join(f'w_{m} * {m}' for m in _GATED)} AS gate FROM xs)"""
_EXPERT = ["y_true", *_VIEWS, *(f"{x}_{m}" for x in ("err", "w") for m in _GATED), "gate"]


@query(f"WITH RECURSIVE {_EXPERT_SQL} SELECT entity, grp, qi, {sql_round([f'"{c}"' for c in _EXPERT])} FROM xg")
def expert_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample forecasts of experts that see a family of columns each (the sector's: its peers and which it is), side by side with their trailing errors."""
    return rounded(_experts(spark, d), _EXPERT)


_AGAINST = ["rmse_a", "rmse_b", "rmse_delta", "dir_a", "dir_b"]


@query(f"""WITH RECURSIVE {_EXPERT_SQL}, s0 AS (SELECT grp, count(*) AS n, {', '.join(f'sqrt(avg(({m} - y_true) * ({m} - y_true))) AS rmse_{x}, avg(CASE WHEN sign(y_true) = sign({m}) THEN 1e0 ELSE 0e0 END) AS dir_{x}' for x, m in (('a', 'gate'), ('b', '"full"')))} FROM xg GROUP BY grp),
s AS (SELECT *, rmse_a - rmse_b AS rmse_delta FROM s0) SELECT grp, n, {sql_round(_AGAINST)} FROM s""")
def gate_by_group(spark: SparkSession, d: str) -> DataFrame:
    """The gate over three experts against the full model, by group: errors, their difference and hits (below 0: the gate is better)."""
    return rounded(evaluation.gate_against(_experts(spark, d), "gate", "full", "grp"), _AGAINST)


@query()
def block_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Ridge with and without the block of short-term momentum: tests of the difference."""
    both = _fits(_features(spark, d), {"without": _RIDGE[:3], "with": _RIDGE})
    return evaluation.verdict(evaluation.ablation_tests(evaluation.per_quarter(evaluation.pair(both, "without", "with"))))


def _calibrated_sql(window: int | None, by_group: bool) -> str:
    low = "0" if window is None else f"t.r - {window}"
    own = f"""
ow AS (SELECT qi, grp, n AS n_own, CASE WHEN ceil((n + 1) * 0.8e0) > n THEN 'inf'::DOUBLE ELSE max(score) FILTER (WHERE rn = ceil((n + 1) * 0.8e0)) END AS q_own
  FROM (SELECT qi, grp, score, count(*) OVER (PARTITION BY qi, grp) AS n, row_number() OVER (PARTITION BY qi, grp ORDER BY score) AS rn FROM pst) GROUP BY qi, grp, n),""" if by_group else ""
    q = f"CASE WHEN coalesce(n_cal, 0) >= {MIN_CAL} THEN q0 ELSE 0e0 END"
    if by_group:
        q = f"CASE WHEN coalesce(n_cal, 0) >= {MIN_CAL} AND coalesce(n_own, 0) >= {MIN_CAL // 4} THEN q_own ELSE {q} END"
    return f"""{BANDS},
sc AS (SELECT *, greatest(q10 - y_true, y_true - q90) AS score FROM bands),
rk AS (SELECT qi, row_number() OVER (ORDER BY qi) AS r FROM (SELECT DISTINCT qi FROM sc)),
pst AS (SELECT t.qi, sc.grp, sc.score FROM rk t JOIN rk p ON p.r < t.r AND p.r >= {low} JOIN sc ON sc.qi = p.qi),
al AS (SELECT qi, n AS n_cal, CASE WHEN ceil((n + 1) * 0.8e0) > n THEN 'inf'::DOUBLE ELSE max(score) FILTER (WHERE rn = ceil((n + 1) * 0.8e0)) END AS q0
  FROM (SELECT qi, score, count(*) OVER (PARTITION BY qi) AS n, row_number() OVER (PARTITION BY qi ORDER BY score) AS rn FROM pst) GROUP BY qi, n),{own}
cq AS (SELECT sc.*, coalesce(n_cal, 0) AS n_cal, {q} AS q FROM sc LEFT JOIN al ON sc.qi = al.qi {'LEFT JOIN ow ON sc.qi = ow.qi AND sc.grp = ow.grp' if by_group else ''}),
cb AS (SELECT entity, grp, qi, y_true, n_cal, q, q10 - q AS lo, q90 + q AS hi FROM cq)"""


_C = ["lo", "hi", "q"]


def _calibrate(spark: SparkSession, d: str, **how) -> DataFrame:
    return conformal.calibrate(bands(spark, d), ALPHA, MIN_CAL, **how)


@query(f"WITH {_calibrated_sql(None, False)} SELECT entity, grp, qi, n_cal, {sql_round(_C)} FROM cb")
def conformal_expanding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_calibrate(spark, d), _C).select("entity", "grp", "qi", "n_cal", *_C)


@query(f"WITH {_calibrated_sql(4, False)} SELECT entity, grp, qi, n_cal, {sql_round(_C)} FROM cb")
def conformal_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_calibrate(spark, d, window=4), _C).select("entity", "grp", "qi", "n_cal", *_C)


@query(f"WITH {_calibrated_sql(None, True)} SELECT entity, grp, qi, n_cal, {sql_round(_C)} FROM cb")
def conformal_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_calibrate(spark, d, by_group=True), _C).select("entity", "grp", "qi", "n_cal", *_C)


_IR = ["coverage", "mean_width", "median_width", "winkler", "worst_quarter", "coverage_std"]


@query(f"""WITH {_calibrated_sql(None, False)}, x AS (SELECT *, CASE WHEN y_true BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END AS hit, hi - lo + 10e0 * (greatest(lo - y_true, 0) + greatest(y_true - hi, 0)) AS s FROM cb),
e AS (SELECT min(c) AS worst_quarter, stddev_samp(c) AS coverage_std FROM (SELECT qi, avg(hit) AS c FROM x GROUP BY qi)),
r AS (SELECT count(*) AS n, avg(hit) AS coverage, avg(hi - lo) AS mean_width, median(hi - lo) AS median_width, avg(s) AS winkler, any_value(worst_quarter) AS worst_quarter, any_value(coverage_std) AS coverage_std FROM x, e)
SELECT n, 0.8e0 AS target, {sql_round(_IR)} FROM r""")
def interval_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conformal.interval_report(_calibrate(spark, d), ALPHA), _IR)


@query(f"""WITH {_calibrated_sql(None, False)}, x AS (SELECT grp, CASE WHEN b.y_true BETWEEN q10 AND q90 THEN 1e0 ELSE 0e0 END AS raw, CASE WHEN b.y_true BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END AS expanding FROM cb b JOIN bands USING (entity, grp, qi))
SELECT grp, round(avg(raw), 6) AS raw, round(avg(expanding), 6) AS expanding FROM x GROUP BY grp""")
def group_coverage(spark: SparkSession, d: str) -> DataFrame:
    raw = bands(spark, d).select("grp", "y_true", F.col("q10").alias("lo"), F.col("q90").alias("hi"), F.lit("raw").alias("method"))
    x = raw.unionByName(_calibrate(spark, d).select("grp", "y_true", "lo", "hi", F.lit("expanding").alias("method")))
    return rounded(conformal.group_coverage(x, ["raw", "expanding"]), ["raw", "expanding"])


_ACI = f"""{BANDS}, sq AS (SELECT qi, row_number() OVER (ORDER BY qi) AS i, list(greatest(q10 - y_true, y_true - q90)) AS own FROM bands GROUP BY qi),
sp AS (SELECT qi, i, own, list_sort(coalesce((SELECT flatten(list(p.own)) FROM sq p WHERE p.i < sq.i), [])) AS past FROM sq),
lv AS (SELECT 0 AS i, CAST(NULL AS BIGINT) AS qi, CAST(0 AS BIGINT) AS n_cal, 0e0 AS q, 0.2e0 AS used, 0.2e0 AS level
  UNION ALL SELECT n.i, n.qi, n.n_cal, n.q, n.used, CASE WHEN n.n_cal >= {MIN_CAL} THEN least(0.6e0, greatest(0.01e0, n.used + 0.02e0 * (0.2e0 - list_avg(list_transform(n.own, lambda s: CASE WHEN s > n.q THEN 1e0 ELSE 0e0 END))))) ELSE n.used END
  FROM (SELECT sp.i, sp.qi, sp.own, CAST(len(past) AS BIGINT) AS n_cal, lv.level AS used, CASE WHEN len(past) < {MIN_CAL} THEN 0e0 WHEN ceil((len(past) + 1) * (1 - lv.level)) > len(past) THEN 'inf'::DOUBLE ELSE past[CAST(ceil((len(past) + 1) * (1 - lv.level)) AS BIGINT)] END AS q FROM lv JOIN sp ON sp.i = lv.i + 1) n)"""


@query(f"WITH RECURSIVE {_ACI} SELECT qi, n_cal, round(q, 6) + 0.0e0 AS q, round(used, 6) + 0.0e0 AS alpha_used FROM lv WHERE i > 0")
def aci_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive levels, quarter after quarter."""
    return rounded(conformal.aci_schedule(bands(spark, d), ALPHA, min_cal=MIN_CAL), ["q", "alpha_used"])


@query(f"WITH RECURSIVE {_ACI} SELECT entity, grp, bands.qi, n_cal, round(q10 - q, 6) + 0.0e0 AS lo, round(q90 + q, 6) + 0.0e0 AS hi, round(q, 6) + 0.0e0 AS q FROM bands JOIN lv ON bands.qi = lv.qi")
def conformal_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Bands widened by the adaptive schedule."""
    return rounded(conformal.calibrate_adaptive(bands(spark, d), ALPHA, min_cal=MIN_CAL), _C).select("entity", "grp", "qi", "n_cal", *_C)


@query(f"WITH {_calibrated_sql(None, False)} SELECT qi, max(n_cal) AS n_cal, round(avg(q), 6) + 0.0e0 AS mean_q FROM cb GROUP BY qi")
def calibration_schedule(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conformal.schedule(_calibrate(spark, d)), ["mean_q"])


@query(f"""WITH {_calibrated_sql(None, False)}, wk AS (SELECT c.qi, avg((q90 - q10) + 10e0 * (greatest(q10 - b.y_true, 0) + greatest(b.y_true - q90, 0)) - (hi - lo) - 10e0 * (greatest(lo - b.y_true, 0) + greatest(b.y_true - hi, 0))) AS d FROM cb c JOIN bands b USING (entity, grp, qi) GROUP BY c.qi),
{dm_sql('wk', "'winkler'", ('d',))} SELECT g AS metric, n_q, hac_lags, {sql_round(['mean_d', 'stat'])} FROM dm""")
def interval_dm(spark: SparkSession, d: str) -> DataFrame:
    """Test of the quarterly Winkler difference between raw and calibrated bands, without the p-value."""
    a, b = (conformal.winkler(F.col("y_true"), F.col(x), F.col(y), ALPHA) for x, y in (("q10", "q90"), ("lo", "hi")))
    q = _calibrate(spark, d).groupBy("qi").agg(F.avg(a - b).alias("d"))
    t = evaluation.dm_test(q.withColumn("metric", F.lit("winkler")), ["metric"])
    return rounded(t, ["mean_d", "stat"]).select("metric", "n_q", "hac_lags", "mean_d", "stat")


_EXPERTS = ["b_persistence", "b_mean_8", "b_history"]
_WIDE = f"""{FORECASTS}, wd AS (SELECT entity, grp, qi, any_value(y_true) AS y_true, {', '.join(f"max(y_pred) FILTER (WHERE model = '{e}') AS {e}" for e in _EXPERTS)} FROM fc GROUP BY 1, 2, 3)"""
_SOFT = f"""{_WIDE}, te AS (SELECT *, {', '.join(f'avg(abs({e} - y_true)) OVER w AS err_{e}' for e in _EXPERTS)} FROM wd WINDOW w AS (PARTITION BY entity ORDER BY qi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ex AS (SELECT *, {', '.join(f'exp(-coalesce(err_{e}, 0) / 0.05e0) AS x_{e}' for e in _EXPERTS)} FROM te),
sw AS (SELECT *, {', '.join(f'x_{e} / ({" + ".join(f"x_{k}" for k in _EXPERTS)}) AS w_{e}' for e in _EXPERTS)} FROM ex),
gt AS (SELECT *, {' + '.join(f'w_{e} * {e}' for e in _EXPERTS)} AS gate FROM sw)"""
_G = ["gate", *[f"err_{e}" for e in _EXPERTS], *[f"w_{e}" for e in _EXPERTS]]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return blending.widen(forecasts(spark, d), _EXPERTS)


@query(f"WITH {_SOFT} SELECT entity, grp, qi, {sql_round(_G)} FROM gt")
def softmax_blend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(blending.softmax_blend(_wide(spark, d), _EXPERTS), _G).select("entity", "grp", "qi", *_G)


@query(f"""WITH {_SOFT}, l AS (SELECT grp, y_true, unnest(['gate', 'equal', 'b_history']) AS model, unnest([gate, ({' + '.join(_EXPERTS)}) / 3, b_history]) AS y_pred FROM gt),
s AS (SELECT model, grp, {METRICS} FROM l GROUP BY 1, 2) SELECT model, grp, n, {sql_round(_M)} FROM s""")
def blend_scores(spark: SparkSession, d: str) -> DataFrame:
    x = blending.softmax_blend(_wide(spark, d), _EXPERTS).withColumn("equal", blending.equal_blend(_EXPERTS))
    return rounded(blending.score_methods(x, ["gate", "equal", "b_history"], ["grp"]), _M)


_WS = [*(f"{k}_w_{e}" for k in ("mean", "std") for e in _EXPERTS), "weight_volatility"]


def _weights_sql(by: str) -> str:
    return f"""WITH {_SOFT}, s0 AS (SELECT {by}, count(*) AS n, {', '.join(f'avg(w_{e}) AS mean_w_{e}, stddev_samp(w_{e}) AS std_w_{e}' for e in _EXPERTS)} FROM gt GROUP BY 1),
s AS (SELECT *, list_avg([{', '.join(f'std_w_{e}' for e in _EXPERTS)}]) AS weight_volatility FROM s0) SELECT {by}, n, {sql_round(_WS)} FROM s"""


@query(_weights_sql("grp"))
def weight_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(blending.weight_summary(blending.softmax_blend(_wide(spark, d), _EXPERTS), _EXPERTS, "grp"), _WS)


@query(_weights_sql("entity"))
def entity_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(blending.weight_summary(blending.softmax_blend(_wide(spark, d), _EXPERTS), _EXPERTS, "entity"), _WS)


@query()
def global_stack(spark: SparkSession, d: str) -> DataFrame:
    """Non-negative weights per quarter from running cross-products; tests compare them with a search."""
    return blending.global_stack(_wide(spark, d), *_EXPERTS)


_GUARD = f"""{GROWN}, ce AS (SELECT *, max(abs(yoy)) OVER (PARTITION BY entity ORDER BY qi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ceiling FROM grown)"""


@query(f"""WITH {_GUARD}, x AS (SELECT k, fl AS floor, yoy AS y_true, coalesce(abs(b_seasonal) > greatest(k * ceiling, fl) AND b_persistence IS NOT NULL, false) AS flag, b_seasonal, b_persistence, b_mean_4
  FROM ce, (SELECT unnest([0.5e0, 1.0e0]) AS k), (SELECT unnest([0.1e0, 0.2e0]) AS fl) WHERE yoy IS NOT NULL AND b_seasonal IS NOT NULL AND b_mean_4 IS NOT NULL),
p0 AS (SELECT *, CASE WHEN flag THEN b_persistence ELSE b_seasonal END AS v FROM x), p AS (SELECT k, floor, flag, y_true, unnest(['guarded', 'blend']) AS kind, unnest([v, 0.5e0 * v + 0.5e0 * b_mean_4]) AS y_pred FROM p0),
s AS (SELECT kind, k, floor, {METRICS}, count(*) FILTER (WHERE flag) AS n_guarded FROM p GROUP BY 1, 2, 3) SELECT kind, k, floor, n, n_guarded, {sql_round(_M)} FROM s""")
def guard_sweep(spark: SparkSession, d: str) -> DataFrame:
    x = blending.history_ceiling(v.grown(spark, d), "yoy").filter("yoy IS NOT NULL AND b_seasonal IS NOT NULL AND b_mean_4 IS NOT NULL").withColumn("y_true", F.col("yoy"))
    return rounded(blending.guard_sweep(x, "b_seasonal", "b_persistence", [0.5, 1.0], [0.1, 0.2], "b_mean_4"), _M)


@query(f"""WITH {_WIDE}, x AS (SELECT w, y_true, w * greatest(least(b_persistence, 3e0), -0.95e0) + (1 - w) * b_history AS y_pred FROM wd, (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS w)),
s AS (SELECT w, {METRICS} FROM x GROUP BY 1) SELECT w, n, {sql_round(_M)} FROM s""")
def blend_sweep(spark: SparkSession, d: str) -> DataFrame:
    x = _wide(spark, d).withColumn("clipped", blending.clip(F.col("b_persistence"), *series.BANDS["yoy"]))
    return rounded(blending.blend_sweep(x, "clipped", "b_history", [0.3, 0.5, 0.7]), _M)


_ERA = ["rmse_a", "rmse_b", "mean_d", "stat"]


@query(f"""WITH {PAIRED}, er AS (SELECT *, CASE WHEN qi // 4 < 1999 THEN 'before 1999' ELSE 'from 1999' END AS era FROM paired),
z AS (SELECT era, count(*) AS n, sqrt(avg((p_a - y_true) * (p_a - y_true))) AS rmse_a, sqrt(avg((p_b - y_true) * (p_b - y_true))) AS rmse_b FROM er GROUP BY 1 HAVING count(*) >= 50),
pe AS (SELECT era, qi, avg(d_se) AS d_se FROM er GROUP BY 1, 2), {dm_sql('pe', 'era', ('d_se',))}, o AS (SELECT z.*, n_q, hac_lags, mean_d, stat FROM z JOIN dm ON z.era = dm.g) SELECT era, n, n_q, hac_lags, {sql_round(_ERA)} FROM o""")
def era_split(spark: SparkSession, d: str) -> DataFrame:
    """Both eras of at least 50 rows, with the test of each, without p-values."""
    return rounded(evaluation.era_tests(paired(spark, d), 1999), _ERA).select("era", "n", "n_q", "hac_lags", *_ERA)


@query(f"""WITH {SPARSE}, span AS (SELECT entity, min(qi) AS a, max(qi) AS b FROM sparse GROUP BY entity), grid AS (SELECT entity, unnest(generate_series(a, b)) AS qi FROM span),
f AS (SELECT grid.entity, grid.qi, revenue FROM grid LEFT JOIN sparse ON grid.entity = sparse.entity AND grid.qi = sparse.qi),
x AS (SELECT entity, qi, qi - coalesce(max(CASE WHEN revenue IS NULL THEN qi END) OVER (PARTITION BY entity ORDER BY qi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, min(qi) OVER (PARTITION BY entity)) AS run FROM f)
SELECT entity, qi, CASE WHEN least(run, 6) >= 2 THEN least(run, 6) END AS context FROM x""")
def contiguous_suffix(spark: SparkSession, d: str) -> DataFrame:
    return blending.contiguous_suffix(series.gap_free(v.sparse(spark, d)), "revenue", 6, 2).select("entity", "qi", "context")


@query(f"""WITH {DENSE}, f AS (SELECT entity, qi, lag(revenue, 4) OVER w * lag(revenue, 1) OVER w / nullif(lag(revenue, 5) OVER w, 0) AS forecast FROM dense WINDOW w AS (PARTITION BY entity ORDER BY qi))
SELECT f.entity, f.qi, round(f.forecast, 2) AS forecast, round(f.forecast / nullif(b.revenue, 0) - 1, 6) + 0.0e0 AS implied FROM f LEFT JOIN dense b ON f.entity = b.entity AND f.qi = b.qi + 4""")
def univariate_forecast(spark: SparkSession, d: str) -> DataFrame:
    p = v.dense(spark, d)
    x = blending.implied_growth(blending.univariate_forecast(p, "revenue").select("entity", "qi", "forecast"), p, "revenue", "forecast")
    return rounded(rounded(x, ["implied"]), ["forecast"], 2)


_LAGS = [f"lag(revenue, {i}) OVER w" for i in range(1, 9)]


@query(f"""WITH {SPARSE}, span AS (SELECT entity, min(qi) AS a, max(qi) AS b FROM sparse GROUP BY entity), grid AS (SELECT entity, unnest(generate_series(a, b)) AS qi FROM span),
f AS (SELECT grid.entity, grid.qi, revenue FROM grid LEFT JOIN sparse ON grid.entity = sparse.entity AND grid.qi = sparse.qi),
l AS (SELECT entity, qi, {' + '.join(_LAGS[:4])} AS y1, {' + '.join(_LAGS[4:])} AS y2, lag(revenue, 4) OVER w AS s FROM f WINDOW w AS (PARTITION BY entity ORDER BY qi))
SELECT entity, qi, round(s * y1 / nullif(y2, 0), 2) AS forecast, round(y1 / nullif(y2, 0) / s * s - 1, 6) + 0.0e0 AS implied, round(y1 * (y1 / nullif(y2, 0)) / nullif(y1, 0) - 1, 6) + 0.0e0 AS implied_year FROM l WHERE y1 + y2 IS NOT NULL""")
def context_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of a quarter and of a year ahead from unbroken contexts of 8 to 64 quarters, as growth; none where the context is shorter."""
    p = series.gap_free(v.sparse(spark, d))
    ahead = blending.seasonal_forecast(blending.contexts(p, "revenue"))
    x = blending.implied_growth(ahead.filter("h = 0").drop("h"), p, "revenue", "forecast").join(blending.trailing_growth(ahead, p, "revenue", "forecast"), ["entity", "qi"])
    return rounded(rounded(x, ["implied", "implied_year"]), ["forecast"], 2).select("entity", "qi", "forecast", "implied", "implied_year")


_MACRO = ["mac_p1_yoy", "mac_p2_yoy", "mac_p3_yoy"]
_JOINED = f"""{_QUARTERS}, {DENSE}, {growth_sql('dense')},
mm AS (SELECT qi + 1 AS qi, {', '.join(f'p{i} / nullif(lag(p{i}, 4) OVER w, 0) - 1 AS mac_p{i}_yoy' for i in (1, 2, 3))} FROM mq WINDOW w AS (ORDER BY qi)),
jn AS (SELECT g.*, mm.* EXCLUDE (qi) FROM g LEFT JOIN mm ON g.qi = mm.qi)"""


def _with_macro(spark: SparkSession, d: str, changes: tuple[str, ...] = ("p1", "p2", "p3")) -> DataFrame:
    m = panel.macro_features(quarterly_series(spark, d), [], list(changes))
    return panel.macro_join(series.clean_growth(v.dense(spark, d)), m)


@query(f"""WITH {_JOINED}, l AS (SELECT grp, yoy AS y, unnest([{', '.join(f"'{m}'" for m in _MACRO)}]) AS series, unnest([{', '.join(_MACRO)}]) AS x FROM jn)
SELECT grp, series, count(*) AS n, round(corr(y, x), 6) + 0.0e0 AS corr FROM l WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 50""")
def group_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.group_correlation(_with_macro(spark, d), "yoy", _MACRO), ["corr"])


@query(f"""WITH {_JOINED}, t AS (SELECT grp, qi, median(yoy) AS y, {', '.join(f'max({m}) AS {m}' for m in _MACRO)} FROM jn GROUP BY 1, 2),
l AS (SELECT grp, y, unnest([{', '.join(f"'{m}'" for m in _MACRO)}]) AS series, unnest([{', '.join(_MACRO)}]) AS x FROM t)
SELECT grp, series, count(*) AS n, round(corr(y, x), 6) + 0.0e0 AS corr FROM l WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 8""")
def median_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.median_correlation(_with_macro(spark, d), "yoy", _MACRO), ["corr"])


_PAIRS = [(a, b) for i, a in enumerate(SERIES) for b in SERIES[i:]]


@query(f"WITH {_QUARTERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0e0 AS corr FROM mq" for a, b in _PAIRS))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.correlation_matrix(quarterly_series(spark, d), SERIES), ["corr"])


@query(f"""WITH {_JOINED}, l AS (SELECT grp, yoy AS y, unnest([{', '.join(f"'{m}'" for m in _MACRO)}]) AS series, unnest([{', '.join(_MACRO)}]) AS x FROM jn),
c AS (SELECT grp, series, corr(y, x) AS corr FROM l WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 50)
SELECT grp, series, round(corr, 6) + 0.0e0 AS corr FROM c ORDER BY round(abs(corr), 9) DESC, grp, series LIMIT 5""")
def strongest_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = correlation.group_correlation(_with_macro(spark, d), "yoy", _MACRO)
    return rounded(correlation.strongest(c, 5), ["corr"]).select("grp", "series", "corr")


@query(f"""WITH {_JOINED}, l AS (SELECT grp, yoy AS y, unnest([{', '.join(f"'{m}'" for m in _MACRO)}]) AS series, unnest([{', '.join(_MACRO)}]) AS x FROM jn),
c AS (SELECT grp, series, corr(y, x) AS corr FROM l WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 50), m AS (SELECT grp, avg(abs(corr)) AS mean_abs FROM c GROUP BY 1)
SELECT grp, round(mean_abs, 6) AS mean_abs, CAST(row_number() OVER (ORDER BY round(mean_abs, 9) DESC, grp) AS INTEGER) AS place FROM m""")
def strength_order(spark: SparkSession, d: str) -> DataFrame:
    c = correlation.group_correlation(_with_macro(spark, d), "yoy", _MACRO)
    return rounded(correlation.strength_order(c, "grp"), ["mean_abs"])


@query(f"""WITH {_JOINED} SELECT entity, qi, round(mac_p1_yoy * CASE WHEN grp = 'ASIA' THEN 1e0 ELSE 0e0 END, 6) + 0.0e0 AS mac_p1_yoy_x_asia, round(mac_p1_yoy * CASE WHEN grp = 'MIDDLE EAST' THEN 1e0 ELSE 0e0 END, 6) + 0.0e0 AS mac_p1_yoy_x_middle_east FROM jn""")
def interaction_features(spark: SparkSession, d: str) -> DataFrame:
    x = evaluation.interactions(_with_macro(spark, d), ["mac_p1_yoy"], ["ASIA", "MIDDLE EAST"])
    return rounded(x, ["mac_p1_yoy_x_asia", "mac_p1_yoy_x_middle_east"]).select("entity", "qi", "mac_p1_yoy_x_asia", "mac_p1_yoy_x_middle_east")
