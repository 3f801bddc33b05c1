"""Queries over universes and targets in one run."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.functions.sizes import cut_lineage
from vintagepanel.operators import assembly, evaluation, panel, ridge, series, trees, universes
from vintagepanel.plans import views as v
from vintagepanel.plans.assembly_queries import _TARGETS
from vintagepanel.plans.panel_queries import quarterly_series, sql_round
from vintagepanel.plans.views import SERIES, rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
WARMUP, MIN_TRAIN = 2, 40
NAIVE = ["persistence", "mean", "group"]
TARGETS = [
    universes.Target("quarterly", "yoy", ("b_persistence", "b_history", "b_group")),
    *(universes.Target(n, f"y_{n}", (f"b_{n}_persistence", f"b_{n}_mean", f"b_{n}_group"), 3) for n in ("annual", "gm", "em")),
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def members(spark: SparkSession, d: str) -> DataFrame:
    """(entity, universe): every nation is in `pool`, and by the mean balance of its customers in `upper` or `lower`."""
    c, n = v.table(spark, d, "customer"), v.table(spark, d, "nation")
    own = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("b")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    middle = own.agg(F.avg("b").alias("m"))  # one row
    part = F.when(F.col("b") >= F.col("m"), "upper").otherwise("lower")
    return own.crossJoin(F.broadcast(middle)).select(F.col("n_name").alias("entity"), F.explode(F.array(F.lit("pool"), part)).alias("universe"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    return assembly.targets(series.growth_features(series.clean_growth(v.accounts(spark, d))))


_LISTED = ", ".join(f"'{n}'" for n in [*NAIVE, "expanding_mean"])
_COLUMNS = {t.name: (t.y, "f_exp_mean" if t.name == "quarterly" else f"b_{t.name}_mean", t.naive) for t in TARGETS}
_STACK = f"""{_TARGETS},
nb AS (SELECT n_name AS entity, avg(c_acctbal) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
un AS (SELECT entity, unnest(['pool', CASE WHEN b >= (SELECT avg(b) FROM nb) THEN 'upper' ELSE 'lower' END]) AS universe FROM nb),
sl AS ({' UNION ALL '.join(f"SELECT '{t.name}' AS target, {t.purge} AS purge, entity, qi, {t.y} AS y, {t.naive[0]} AS p1, {_COLUMNS[t.name][1]} AS p2, {t.naive[2]} AS p3 FROM tt WHERE {t.y} IS NOT NULL" for t in TARGETS)}),
sk AS (SELECT universe, sl.* FROM sl JOIN un USING (entity)),
sp AS (SELECT universe, target, purge, qi, count(*) AS n, sum(y) AS s, row_number() OVER (PARTITION BY universe, target ORDER BY qi) AS i FROM sk GROUP BY 1, 2, 3, 4),
sm AS (SELECT a.universe, a.target, a.qi, sum(b.n) AS n, sum(b.s) / sum(b.n) AS m FROM sp a JOIN sp b ON a.universe = b.universe AND a.target = b.target AND b.qi + b.purge < a.qi WHERE a.i > {WARMUP} GROUP BY 1, 2, 3 HAVING sum(b.n) >= {MIN_TRAIN}),
sf AS (SELECT universe, target, entity, qi, y AS y_true, unnest([{_LISTED}]) AS model, unnest([coalesce(p1, m), coalesce(p2, m), coalesce(p3, m), m]) AS y_pred, coalesce(p1, m) AS last FROM sk JOIN sm USING (universe, target, qi)),
sx AS (SELECT universe, target, model, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, 1 - sum((y_pred - y_true) * (y_pred - y_true)) / nullif(var_pop(y_true) * count(*), 0) AS r2,
  avg(CASE WHEN sign(y_true) = sign(y_pred) THEN 1e0 ELSE 0e0 END) AS dir_acc, avg(abs(y_pred - y_true) / abs(y_true)) FILTER (WHERE abs(y_true) >= 0.01e0) AS mape, avg(CASE WHEN sign(y_true - last) = sign(y_pred - last) THEN 1e0 ELSE 0e0 END) AS change_acc,
  median(abs(y_pred - y_true)) AS median_ae, median(abs(y_pred - y_true) / abs(y_true)) FILTER (WHERE abs(y_true) >= 0.01e0) AS median_ape FROM sf GROUP BY 1, 2, 3)"""
_SIX = ["mae", "rmse", "r2", "dir_acc", "mape", "change_acc", "median_ae", "median_ape"]


def naive(spark: SparkSession, d: str) -> DataFrame:
    s = cut_lineage(universes.stacked(targets(spark, d), TARGETS, NAIVE, members(spark, d)))
    return cut_lineage(universes.naive_forecasts(s, NAIVE, WARMUP, MIN_TRAIN))


@query(f"WITH {_STACK} SELECT universe, target, model, n, {sql_round(_SIX)} FROM sx")
def universe_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Naive forecasts of growth, year-ahead growth and two margins in three universes."""
    return rounded(universes.six_metrics(naive(spark, d)), _SIX)


_W = ["rmse_model", "r2_model", "dir_acc_model", "rmse_baseline", "gain_pct"]


@query(f"""WITH {_STACK}, rk AS (SELECT *, model IN ('persistence', 'expanding_mean') AS b, row_number() OVER (PARTITION BY universe, target, model IN ('persistence', 'expanding_mean') ORDER BY rmse, model) AS k FROM sx),
wn AS (SELECT m.universe, m.target, m.model AS best_model, m.n AS n_model, m.rmse AS rmse_model, m.r2 AS r2_model, m.dir_acc AS dir_acc_model, k.model AS best_baseline, k.rmse AS rmse_baseline, (1 - m.rmse / nullif(k.rmse, 0)) * 100 AS gain_pct
  FROM rk m JOIN rk k ON m.universe = k.universe AND m.target = k.target WHERE m.k = 1 AND k.k = 1 AND NOT m.b AND k.b) SELECT universe, target, best_model, n_model, best_baseline, {sql_round(_W)} FROM wn""")
def universe_winners(spark: SparkSession, d: str) -> DataFrame:
    """The better of the averaging rules against the better of last value and training mean, per universe and target."""
    scores = evaluation.score(naive(spark, d), universes.KEYS)
    out = universes.winners(scores, F.col("model").isin("persistence", "expanding_mean"))
    return rounded(out, _W).select(*universes.KEYS, "best_model", "n_model", "best_baseline", *_W)


_OWN = ["f_lag_yoy_1", "f_lag_yoy_2", "f_mean_4", "f_std_4", *NAIVE]
_MACRO = [f"mac_{s}_yoy" for s in SERIES]


@query()
def universe_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Ridge forecasts with and without the macro series, a fit per universe and target from one table of moments a purge, and the test of one against the other."""
    m = panel.macro_features(quarterly_series(spark, d), [], SERIES)
    s = cut_lineage(universes.stacked(panel.macro_join(targets(spark, d), m), TARGETS, NAIVE, members(spark, d), [*_OWN[:4], *_MACRO]))
    sets = {"without": _OWN, "with": [*_OWN, *_MACRO]}
    parts = [ridge.walk_forward(s.filter(F.col("purge") == k), "y", [*_OWN, *_MACRO], by=universes.KEYS, sets=sets, warmup=WARMUP, min_train=MIN_TRAIN, purge=k) for k in sorted({t.purge for t in TARGETS})]
    return universes.ablation_rows(cut_lineage(parts[0].unionByName(parts[1])), "without", "with")


_LAGGED = [f"yoy_l{k}" for k in (1, 2, 3, 4)]
#: The first prefix that fits names a feature's family.
FAMILIES = [("mac_", "macro"), ("yoy_", "own growth"), ("f_", "own shape")]


@query()
def target_importance(spark: SparkSession, d: str) -> DataFrame:
    """What the boosting finds important for each of the four targets, in per cent of its gain: features, families and lag buckets side by side."""
    m = panel.macro_features(quarterly_series(spark, d), [], SERIES)
    x = panel.macro_join(targets(spark, d), m).withColumns({n: F.col(f"f_lag_yoy_{k}") for k, n in enumerate(_LAGGED, 1)})
    found = cut_lineage(universes.target_importance(cut_lineage(x), TARGETS, [*_LAGGED, "f_mean_4", "f_std_4", *_MACRO], trees.boosting(), WARMUP, 100))
    names = [t.name for t in TARGETS]
    features = evaluation.importance_matrix(found, names)
    parts = [features.select(F.lit("feature").alias("level"), F.col("feature").alias("name"), *names)]
    parts.append(features.groupBy(F.col("lag_bucket").alias("name")).agg(*[F.sum(n).alias(n) for n in names]).select(F.lit("lag").alias("level"), "name", *names))
    each = None
    for n in names:
        part = evaluation.grouped_importance(found.filter(F.col("target") == n), FAMILIES).select(F.col("family").alias("name"), F.col("gain_pct").alias(n))
        each = part if each is None else each.join(part, "name", "full")
    return parts[0].unionByName(parts[1]).unionByName(each.select(F.lit("family").alias("level"), "name", *names).fillna(0.0, names))
