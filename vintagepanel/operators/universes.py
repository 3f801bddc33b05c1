"""Universes and targets in one run: a stacked panel, whose two keys every later step groups by.

An entity may belong to several universes (one of all, and parts of it). Labels, training
sums, forecasts, scores and winners are made for all (universe, target) at once; no part
of the panel is read for one of them alone.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions.order import group_quantiles
from vintagepanel.operators import evaluation, trees

KEYS = ["universe", "target"]


@dataclass(frozen=True)
class Target:
    """A label, the columns with its naive forecasts in the order of the caller's names, and the quarters that its label reaches past the target quarter."""

    name: str
    y: str
    naive: tuple[str, ...]
    purge: int = 0


def stacked(panel: DataFrame, targets: list[Target], names: list[str], members: DataFrame, features: list[str] | None = None) -> DataFrame:
    """universe, target, purge, entity, grp, qi, y, the naive forecasts under their common names, and the features.

    members: (entity, universe); equal rows count once, entities in no universe are left
    out, a null universe or entity takes no part. Rows without a label stay, as origins.
    """
    each = [F.struct(F.lit(t.name).alias("target"), F.lit(t.purge).alias("purge"), F.col(t.y).cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for n, c in zip(names, t.naive, strict=True)]) for t in targets]
    kept = members.filter("entity IS NOT NULL AND universe IS NOT NULL").select("entity", "universe").distinct()
    rows = panel.select("entity", "grp", "qi", *(features or []), F.explode(F.array(*each)).alias("_t"))
    return rows.join(kept, "entity").select("universe", "_t.target", "_t.purge", "entity", "grp", "qi", "_t.y", *[F.col(f"_t.{n}") for n in names], *(features or []))


def training_means(stack: DataFrame, warmup: int, min_train: int) -> DataFrame:
    """universe, target, qi, n_train, train_mean of each test quarter: after warmup labelled ones, with min_train labels that were known by then.

    A label is known when the quarters that it reaches are over. Sums per quarter are the
    rows of one window a (universe, target), labels at the quarter in which they are known.
    """
    per = stack.filter("y IS NOT NULL").groupBy(*KEYS, "purge", "qi").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    asked = per.select(*KEYS, "qi", F.row_number().over(Window.partitionBy(*KEYS).orderBy("qi")).alias("i"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    known = per.select(*KEYS, (F.col("qi") + F.col("purge") + 1).alias("qi"), F.lit(None).cast("int").alias("i"), "n", "s")
    past = Window.partitionBy(*KEYS).orderBy("qi").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = asked.unionByName(known).withColumns({"n_train": F.sum("n").over(past), "_s": F.sum("s").over(past)})
    return run.filter((F.col("i") > warmup) & (F.col("n_train") >= min_train)).select(*KEYS, "qi", "n_train", (F.col("_s") / F.col("n_train")).alias("train_mean"))


def naive_forecasts(stack: DataFrame, names: list[str], warmup: int, min_train: int) -> DataFrame:
    """universe, target, model, entity, grp, qi, y_true, y_pred of every test quarter; a null forecast is the training mean, which is also a model (expanding_mean)."""
    means = training_means(stack, warmup, min_train)
    tested = stack.filter("y IS NOT NULL").join(F.broadcast(means), [*KEYS, "qi"])  # a row a universe, target and quarter
    pairs = [F.struct(F.lit(n).alias("model"), F.coalesce(n, "train_mean").alias("y_pred")) for n in names] + [F.struct(F.lit("expanding_mean").alias("model"), F.col("train_mean").alias("y_pred"))]
    return tested.select(*KEYS, "entity", "grp", "qi", F.col("y").alias("y_true"), F.explode(F.array(*pairs)).alias("m")).select(*KEYS, "m.model", "entity", "grp", "qi", "y_true", "m.y_pred")


def six_metrics(predictions: DataFrame, base: str = "persistence") -> DataFrame:
    """universe, target, model, n, the metrics of evaluation.six_metrics; change_acc is the direction of change against the model `base` of the same universe, target, entity and quarter (margins are levels: their own sign says nothing)."""
    own = [*KEYS, "entity", "qi"]
    level = predictions.filter(F.col("model") == base).select(*own, F.col("y_pred").alias("_b"))
    t, p = F.col("y_true"), F.col("y_pred")
    share = F.when(F.abs(t) >= 0.01, F.abs(p - t) / F.abs(t))
    x = predictions.join(level, own, "left").withColumns({"_ae": F.abs(p - t), "_ape": share})
    moved = (F.signum(t - F.col("_b")) == F.signum(p - F.col("_b"))).cast("double")
    by = [*KEYS, "model"]
    middle = lambda c, name: group_quantiles(x, by, c, [0.5]).select(*by, F.get("q", F.lit(0)).alias(name))
    whole = x.groupBy(*by).agg(*evaluation.metric_columns(), F.avg("_ape").alias("mape"), F.avg(moved).alias("change_acc"))
    return whole.join(middle("_ae", "median_ae"), by, "left").join(middle("_ape", "median_ape"), by, "left")


def winners(scores: DataFrame, is_baseline: Column) -> DataFrame:
    """Per universe and target the best model with its r2 and dir_acc, the best baseline, and the model's gain in per cent; those without one of both are left out."""
    best = evaluation.compare_best(scores, is_baseline, KEYS)
    more = scores.select(*KEYS, F.col("model").alias("best_model"), F.col("n").alias("n_model"), F.col("r2").alias("r2_model"), F.col("dir_acc").alias("dir_acc_model"))
    return best.join(more, [*KEYS, "best_model"])


def ablation_rows(predictions: DataFrame, a: str, b: str, lags: int | None = None) -> DataFrame:
    """universe, target and the test of the squared errors of model a less those of b by quarter (positive where b is better): n_q, mean_d, hac_lags, stat, p_value, and n_better, the quarters in which b is better."""
    e2 = (F.col("y_pred") - F.col("y_true")) * (F.col("y_pred") - F.col("y_true"))
    own = [*KEYS, "entity", "qi"]
    side = lambda m, n: predictions.filter(F.col("model") == m).select(*own, e2.alias(n))
    quarterly = side(a, "_a").join(side(b, "_b"), own).groupBy(*KEYS, "qi").agg(F.avg(F.col("_a") - F.col("_b")).alias("d"))
    better = quarterly.groupBy(*KEYS).agg(F.count_if(F.col("d") > 0).alias("n_better"))
    return evaluation.dm_test(quarterly, KEYS, lags=lags).join(better, KEYS)


def target_importance(panel: DataFrame, targets: list[Target], features: list[str], spec: trees.Trees, warmup: int = 8, min_train: int = 100) -> DataFrame:
    """target, feature, gain_pct: each feature's share of the gain of the trees of a target, on average over its test quarters, in per cent."""
    parts = [trees.gain_importance(panel, t.y, features, spec, [], warmup, min_train, t.purge).groupBy("feature").agg((100 * F.avg("share")).alias("gain_pct")).withColumn("target", F.lit(t.name)) for t in targets]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("target", "feature", "gain_pct")
