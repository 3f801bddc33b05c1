"""Queries of the fitted models. SQL has no learners; tests check them by their errors and by planted effects."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.functions.sizes import cut_lineage
from vintagepanel.operators import evaluation, learners, panel, ridge, series, trees
from vintagepanel.plans.evaluation_queries import MIN_TRAIN, WARMUP, _with_macro, forecasts
from vintagepanel.plans.panel_queries import quarterly_series
from vintagepanel.plans.views import SERIES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FEATURES = ["f_lag_yoy_1", "f_lag_yoy_2", "f_mean_4", "f_lag_qoq", "f_std_4"]
GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return series.growth_features(panel.baselines(_with_macro(spark, d, tuple(SERIES))))


def _trees(p: DataFrame, spec: trees.Trees, name: str) -> DataFrame:
    return trees.walk_forward(p, "yoy", FEATURES, spec, name, GROUPS, WARMUP, MIN_TRAIN)


@query
def forest_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return _trees(_panel(spark, d), trees.forest(), "forest")


@query
def boosting_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return _trees(_panel(spark, d), trees.boosting(), "boosting")


@query
def elastic_net_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Ratio and penalty chosen by cross-validation at every quarter, all from one table of moments."""
    p = _panel(spark, d).withColumns({f"is_{i}": (F.col("grp") == g).cast("double") for i, g in enumerate(GROUPS)})
    return ridge.walk_forward(p, "yoy", [*FEATURES, *(f"is_{i}" for i in range(len(GROUPS)))], "elastic_net", warmup=WARMUP, min_train=MIN_TRAIN, folds=3, ratios=(0.2, 0.5, 0.8))


@query
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """Of the boosting's gain each feature's share, on average over the test quarters."""
    found = trees.gain_importance(_panel(spark, d), "yoy", FEATURES, trees.boosting(), GROUPS, WARMUP, MIN_TRAIN)
    return found.groupBy("feature").agg(F.avg("gain").alias("gain"), (100 * F.avg("share")).alias("gain_pct"))


def _damage(spark: SparkSession, d: str) -> DataFrame:
    """Damage of a cross-validated elastic net and of a forest, each fitted once before the split."""
    p, split = cut_lineage(_panel(spark, d)), 1999 * 4
    models = {"elastic_net": learners.linear_fitted(p, "yoy", FEATURES, split, ratios=(0.2, 0.5, 0.8)), "forest": trees.fitted(p, "yoy", FEATURES, trees.forest(), split)}
    parts = [learners.permutation_importance(p, "yoy", FEATURES, m, split, repeats=10).withColumn("model", F.lit(n)) for n, m in models.items()]
    return parts[0].unionByName(parts[1])


@query
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    return _damage(spark, d)


@query
def importance_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether the boosting's gain and the damage of permutation put the features in the same order."""
    gain = trees.gain_importance(_panel(spark, d), "yoy", FEATURES, trees.boosting(), [], WARMUP, MIN_TRAIN).groupBy("feature").agg(F.avg("share").alias("gain"))
    damage = _damage(spark, d).groupBy("feature").pivot("model", ["elastic_net", "forest"]).agg(F.first("damage"))
    return evaluation.rank_agreement(gain.join(damage, "feature"), ["gain", "elastic_net", "forest"])


@query
def residual_lasso(spark: SparkSession, d: str) -> DataFrame:
    shocks = evaluation.residual_shocks(forecasts(spark, d)).filter("model = 'b_history'").select("qi", "shock")
    m = panel.macro_features(quarterly_series(spark, d), [], SERIES)
    return ridge.shock_lasso(shocks, m, [f"mac_{s}_yoy" for s in SERIES])
