"""Walk-forward evaluation: splits, baselines, metrics and paired significance tests."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions import guarded as g
from vintagepanel.functions.order import group_quantiles, past_order_statistics
from vintagepanel.functions.significance import t_p_value


def qualifying_quarters(panel: DataFrame, y: str, warmup: int, min_train: int, purge: int = 0) -> DataFrame:
    """Test quarters after `warmup` of them, with at least min_train labelled rows more than `purge` quarters before; and the mean label of these.

    One row a quarter: counts and sums per quarter and their running totals, no copy of
    the training rows per test quarter.
    """
    per = panel.filter(F.col(y).isNotNull()).groupBy("qi").agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    past = Window.orderBy("qi").rangeBetween(Window.unboundedPreceding, -1 - purge)
    out = per.select("qi", F.row_number().over(Window.orderBy("qi")).alias("i"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n_train"), F.sum("s").over(past).alias("s_train"))
    return out.filter((F.col("i") > warmup) & (F.col("n_train") >= min_train)).select("qi", "n_train", (F.col("s_train") / F.col("n_train")).alias("train_mean"))


def walk_forward_baselines(panel: DataFrame, y: str, models: list[str], warmup: int, min_train: int, purge: int = 0) -> DataFrame:
    """Long forecasts (model, entity, grp, qi, y_true, y_pred) of precomputed columns; a null forecast is the training mean, which is also a model."""
    quarters = qualifying_quarters(panel, y, warmup, min_train, purge)
    tested = panel.filter(F.col(y).isNotNull()).join(F.broadcast(quarters), "qi")
    pairs = [F.struct(F.lit(m).alias("model"), F.coalesce(m, "train_mean").alias("y_pred")) for m in models] + [F.struct(F.lit("expanding_mean").alias("model"), F.col("train_mean").alias("y_pred"))]
    return tested.select("entity", "grp", "qi", F.col(y).alias("y_true"), F.explode(F.array(*pairs)).alias("m")).select("m.model", "entity", "grp", "qi", "y_true", "m.y_pred")


def _same_sign(a: Column, b: Column) -> Column:
    return (F.signum(a) == F.signum(b)).cast("double")


def metric_columns(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    """n, mae, rmse, r2 (null if the truth does not vary) and dir_acc, as aggregates."""
    t, e = F.col(y), F.col(p) - F.col(y)
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(t) * F.count("*"))).alias("r2"), F.avg(_same_sign(t, F.col(p))).alias("dir_acc")]


def score(predictions: DataFrame, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """Metrics per model, or per model and the columns of `by`, of groups of at least `least` rows."""
    return predictions.groupBy("model", *(by or [])).agg(*metric_columns()).filter(F.col("n") >= least)


def score_cuts(predictions: DataFrame, cuts: list[str], least: int = 5) -> DataFrame:
    """Metrics per model, overall and along each cut, from one scan: cut, value, model, metrics."""
    kinds = [F.struct(F.lit("all").alias("cut"), F.lit("all").alias("value"))] + [F.struct(F.lit(c).alias("cut"), F.col(c).cast("string").alias("value")) for c in cuts]
    return predictions.withColumn("_c", F.explode(F.array(*kinds))).groupBy("_c.cut", "_c.value", "model").agg(*metric_columns()).filter(F.col("n") >= least)


def six_metrics(predictions: DataFrame, persistence: DataFrame) -> DataFrame:
    """Per model: mae, rmse, r2, median error, mean and median percentage error where |y| is at least 1 %, and how often the direction of change against persistence is right."""
    base = persistence.select("entity", "qi", F.col("y_pred").alias("_b"))
    x = predictions.join(base, ["entity", "qi"], "left")
    t, p = F.col("y_true"), F.col("y_pred")
    share = F.when(F.abs(t) >= 0.01, F.abs(p - t) / F.abs(t))
    x = x.withColumns({"_ae": F.abs(p - t), "_ape": share})
    middle = lambda c, name: group_quantiles(x, ["model"], c, [0.5]).select("model", F.get("q", F.lit(0)).alias(name))
    whole = x.groupBy("model").agg(*metric_columns()[:4], F.avg("_ape").alias("mape"), F.avg(_same_sign(t - F.col("_b"), p - F.col("_b"))).alias("change_acc"))
    return whole.join(middle("_ae", "median_ae"), "model", "left").join(middle("_ape", "median_ape"), "model", "left")


def ensemble(predictions: DataFrame, name: str = "ensemble", least: int = 2) -> DataFrame:
    """Mean forecast of each row over the models, where there are at least two."""
    return predictions.groupBy("entity", "grp", "qi").agg(F.first("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"), F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n").withColumn("model", F.lit(name))


def pinball(y: Column, p: Column, alpha: float) -> Column:
    e = y - p
    return F.greatest(e * alpha, e * (alpha - 1))


def quantile_walk_forward(predictions: DataFrame, levels: tuple[float, float, float] = (0.1, 0.5, 0.9), least: int = 50) -> DataFrame:
    """Bands (entity, grp, qi, y_true, q10, q50, q90): the forecast plus quantiles of the residuals of all earlier quarters, of which there must be `least`."""
    r = predictions.select("qi", (F.col("y_true") - F.col("y_pred")).alias("r"))
    ends = lambda n: [f(p * (n - 1)) for p in levels for f in (F.floor, F.ceil)]
    past = past_order_statistics(r, "r", ends).filter(F.col("n") >= least)
    place = [F.lit(p) * (F.col("n") - 1) for p in levels]
    b = [F.col("v")[2 * i] + (F.col("v")[2 * i + 1] - F.col("v")[2 * i]) * (at - F.floor(at)) for i, at in enumerate(place)]
    bands = predictions.join(F.broadcast(past.select("qi", F.array(*b).alias("b"))), "qi").select("entity", "grp", "qi", "y_true", F.sort_array(F.array(*[F.col("y_pred") + F.col("b")[i] for i in range(3)])).alias("s"))
    return bands.select("entity", "grp", "qi", "y_true", *[F.col("s")[i].alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


def quantile_report(bands: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Coverage, mean and median width, three pinball losses, and error and direction of the middle forecast: one row."""
    y, a, m, b = (F.col(c) for c in ("y_true", "q10", "q50", "q90"))
    whole = bands.agg(F.count("*").alias("n"), F.avg(((y >= a) & (y <= b)).cast("double")).alias("coverage"), F.avg(b - a).alias("mean_width"), F.avg(pinball(y, a, low)).alias("pinball_low"), F.avg(pinball(y, m, 0.5)).alias("pinball_mid"), F.avg(pinball(y, b, high)).alias("pinball_high"), F.avg(F.abs(y - m)).alias("mid_mae"), F.sqrt(F.avg((y - m) * (y - m))).alias("mid_rmse"), F.avg(_same_sign(y, m)).alias("mid_dir_acc"))
    middle = group_quantiles(bands.withColumn("_w", b - a), [], "_w", [0.5]).select(F.get("q", F.lit(0)).alias("median_width"))
    return whole.crossJoin(F.broadcast(middle))  # a row each


def pair(predictions: DataFrame, a: str, b: str) -> DataFrame:
    """Rows both models forecast, with differences in squared error, absolute error and hits; positive where b is better."""
    one = lambda m, s: predictions.filter(F.col("model") == m).select("entity", "qi", *(["grp", "y_true"] if s == "a" else []), F.col("y_pred").alias(f"p_{s}"))
    return differences(one(a, "a").join(one(b, "b"), ["entity", "qi"]))


def differences(x: DataFrame) -> DataFrame:
    """Adds d_se, d_ae and d_hit to rows with y_true, p_a and p_b."""
    ea, eb, t = F.col("p_a") - F.col("y_true"), F.col("p_b") - F.col("y_true"), F.col("y_true")
    return x.withColumns({"d_se": ea * ea - eb * eb, "d_ae": F.abs(ea) - F.abs(eb), "d_hit": _same_sign(t, F.col("p_b")) - _same_sign(t, F.col("p_a"))})


def per_quarter(paired: DataFrame, by: list[str] | None = None, columns: tuple[str, ...] = ("d_se", "d_ae", "d_hit")) -> DataFrame:
    return paired.groupBy(*(by or []), "qi").agg(*[F.avg(c).alias(c) for c in columns])


def dm_test(quarterly: DataFrame, by: list[str], d: str = "d", lags: int | None = None) -> DataFrame:
    """Diebold-Mariano test of a mean difference per quarter, one row per group of `by`: n_q, mean_d, hac_lags, stat, p_value.

    The long-run variance is Newey and West's with Bartlett weights and floor(n^(1/3))
    lags (or `lags`), at least 1e-12; the statistic carries the small-sample factor
    sqrt((n-1)/n) and is read against t(n-1). With fewer than eight quarters it is null.
    """
    base = quarterly.filter(F.col(d).isNotNull())
    w = Window.partitionBy(*by)
    t = F.count("*").over(w)
    most = F.floor(F.pow(t.cast("double"), F.lit(1.0 / 3.0))).cast("int") if lags is None else F.lit(lags)
    x = base.select(*by, "qi", F.col(d).alias("d"), t.alias("n_q"), most.alias("hac_lags"), F.avg(d).over(w).alias("mean_d"), F.row_number().over(w.orderBy("qi")).alias("i")).withColumn("e", F.col("d") - F.col("mean_d"))
    own = x.groupBy(*by).agg(F.first("n_q").alias("n_q"), F.first("mean_d").alias("mean_d"), F.first("hac_lags").alias("hac_lags"), F.avg(F.col("e") * F.col("e")).alias("g0"))
    ahead = x.select(*by, "i", "e", "n_q", "hac_lags", F.explode(F.sequence(F.lit(1), F.greatest(F.col("hac_lags"), F.lit(1)))).alias("k")).filter(F.col("k") <= F.col("hac_lags"))
    back = x.select(*by, (F.col("i")).alias("j"), F.col("e").alias("e_k"))
    on = (F.col("a.i") - F.col("a.k")) == F.col("b.j")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    weighted = (1 - F.col("a.k") / (F.col("a.hac_lags") + 1)) * F.col("a.e") * F.col("b.e_k") / F.col("a.n_q")
    cov = ahead.alias("a").join(back.alias("b"), on).groupBy(*[F.col(f"a.{c}").alias(f"_{c}") for c in by]).agg((2 * F.sum(weighted)).alias("gk"))
    joined_on = F.lit(True)
    for c in by:
        joined_on = joined_on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = own.join(cov, joined_on, "left")
    n = F.col("n_q")
    lrv = F.greatest(F.col("g0") + F.coalesce("gk", F.lit(0.0)), F.lit(1e-12))
    stat = F.when(n >= 8, F.col("mean_d") / F.sqrt(lrv / n) * F.sqrt((n - 1) / n))
    out = both.select(*by, "n_q", "mean_d", "hac_lags", stat.alias("stat"))
    return out.withColumn("p_value", t_p_value("stat", (F.col("n_q") - 1).cast("double")))


def ablation_tests(quarterly: DataFrame, columns: tuple[str, ...] = ("d_se", "d_ae", "d_hit"), by: list[str] | None = None, lags: int | None = None) -> DataFrame:
    """Per difference (and group): mean, test, quarters that are better, and the share of the gain that the best quarter has (null if there is no gain)."""
    by = by or []
    long = quarterly.select(*by, "qi", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("d")) for c in columns])).alias("m")).select(*by, "qi", "m.metric", "m.d")
    keys = [*by, "metric"]
    counts = long.groupBy(*keys).agg(F.count_if(F.col("d") > 0).alias("better"), F.when(F.sum("d") > 0, F.max("d") / F.sum("d")).alias("best_share"))
    return dm_test(long, keys, lags=lags).join(counts, keys)


def verdict(tests: DataFrame, level: float = 0.10, share: float = 0.5) -> DataFrame:
    """What each test says (verdict), and a note where an improvement is concentrated: one quarter holds more than `share` of it, significant or not.

    An improvement is a mean difference above 0; it is significant below `level`. A test
    without a p-value is not significant.
    """
    better, sure = F.coalesce(F.col("mean_d") > 0, F.lit(False)), F.coalesce(F.col("p_value") < level, F.lit(False))
    label = F.when(better & sure, "helps").when(better, "positive, insignificant").otherwise("does not improve")
    return tests.withColumns({"verdict": label, "note": F.when(better & (F.col("best_share") > share), "concentrated in one quarter")})


def pair_with(predictions: DataFrame, base: str) -> DataFrame:
    """Every other model against `base` on the rows that both forecast: model and the columns of pair()."""
    b = predictions.filter(F.col("model") == base).select("entity", "qi", F.col("y_pred").alias("p_a"))
    x = predictions.filter(F.col("model") != base).withColumnRenamed("y_pred", "p_b").join(b, ["entity", "qi"])
    return differences(x)


def gate_against(wide: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """by, n, rmse_a, rmse_b, rmse_delta (a less b), dir_a, dir_b of two columns of forecasts over the rows that have both."""
    t, e = F.col("y_true"), lambda p: F.sqrt(F.avg((F.col(p) - F.col("y_true")) * (F.col(p) - F.col("y_true"))))
    x = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & t.isNotNull())
    scored = x.groupBy(by).agg(F.count("*").alias("n"), e(a).alias("rmse_a"), e(b).alias("rmse_b"), F.avg(_same_sign(t, F.col(a))).alias("dir_a"), F.avg(_same_sign(t, F.col(b))).alias("dir_b"))
    return scored.withColumn("rmse_delta", F.col("rmse_a") - F.col("rmse_b"))


def delta_by_year(paired: DataFrame) -> DataFrame:
    """Per calendar year: both errors, their difference, and the difference in hits."""
    t = F.col("y_true")
    rm = lambda p: F.sqrt(F.avg((F.col(p) - t) * (F.col(p) - t)))
    return paired.groupBy(F.floor(F.col("qi") / 4).alias("year")).agg(F.count("*").alias("n"), rm("p_a").alias("rmse_a"), rm("p_b").alias("rmse_b"), F.avg("d_hit").alias("d_dir_acc")).withColumn("d_rmse", F.col("rmse_a") - F.col("rmse_b"))


def skill_counts(by_entity: DataFrame, model: str) -> DataFrame:
    """For each other model, the number of entities where `model` has the smaller error."""
    own = by_entity.filter(F.col("model") == model).select("entity", F.col("rmse").alias("_own"))
    others = by_entity.filter(F.col("model") != model).join(own, "entity")
    return others.groupBy(F.col("model").alias("baseline")).agg(F.count("*").alias("n_entities"), F.count_if(F.col("_own") < F.col("rmse")).alias("n_better"))


def compare_best(scores: DataFrame, is_baseline: Column, by: list[str]) -> DataFrame:
    """Best model and best baseline by error in each group of `by`, and the model's gain in per cent."""
    w = Window.partitionBy(*by, "_b").orderBy("rmse", "model")
    best = scores.withColumn("_b", is_baseline).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    side = lambda flag, s: best.filter(F.col("_b") == flag).select(*by, F.col("model").alias(f"best_{s}"), F.col("rmse").alias(f"rmse_{s}"))
    return side(False, "model").join(side(True, "baseline"), by).withColumn("gain_pct", (1 - F.try_divide(F.col("rmse_model"), F.col("rmse_baseline"))) * 100)


def matched_rows(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Errors of two sets of forecasts on the rows both have: rmse_a, rmse_b, rmse_delta, pct_change."""
    x = a.select("entity", "qi", *by, "y_true", F.col("y_pred").alias("p_a")).join(b.select("entity", "qi", F.col("y_pred").alias("p_b")), ["entity", "qi"])
    t = F.col("y_true")
    rm = lambda p: F.sqrt(F.avg((F.col(p) - t) * (F.col(p) - t)))
    out = x.groupBy(*by).agg(F.count("*").alias("n"), rm("p_a").alias("rmse_a"), rm("p_b").alias("rmse_b"))
    return out.withColumns({"rmse_delta": F.col("rmse_b") - F.col("rmse_a"), "pct_change": (F.try_divide(F.col("rmse_b"), F.col("rmse_a")) - 1) * 100})


def association_importance(df: DataFrame, targets: list[str], features: list[str]) -> DataFrame:
    """target, feature, r2 (squared correlation on the rows that have both, 0 where there is none) and gain_pct, its share of the target's sum: one aggregation for all pairs."""
    pairs = [(t, f) for t in targets for f in features]
    one = df.agg(*[F.coalesce(g.correlation(F.col(t), F.col(f)), F.lit(0.0)).alias(f"c{i}") for i, (t, f) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), (F.col(f"c{i}") * F.col(f"c{i}")).alias("r2")) for i, (t, f) in enumerate(pairs)]))
    return one.select(each.alias("p")).select("p.*").withColumn("gain_pct", 100 * F.try_divide(F.col("r2"), F.sum("r2").over(Window.partitionBy("target"))))


def grouped_importance(importance: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Sum of gain_pct by group; the first prefix rule that fits a feature names its group."""
    group = F.lit("other")
    for prefix, name in reversed(rules):
        group = F.when(F.col("feature").startswith(prefix), name).otherwise(group)
    return importance.groupBy(group.alias("family")).agg(F.sum("gain_pct").alias("gain_pct"), F.count("*").alias("n_features"))


def rank_agreement(scores: DataFrame, methods: list[str]) -> DataFrame:
    """Spearman correlation of each pair of methods (columns) over the rows; ties share their mean rank."""
    long = scores.select("feature", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("x")) for m in methods])).alias("s")).select("feature", "s.method", "s.x")
    same, w = Window.partitionBy("method", "x"), Window.partitionBy("method").orderBy("x")
    ranked = long.withColumn("r", F.rank().over(w) + (F.count("*").over(same) - 1) / 2)
    a, b = ranked.alias("a"), ranked.alias("b")
    both = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.method") < F.col("b.method")))
    return both.groupBy(F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b")).agg(g.correlation(F.col("a.r"), F.col("b.r")).alias("spearman"))


def importance_matrix(importances: DataFrame, targets: list[str]) -> DataFrame:
    """importances (target, feature, gain_pct) side by side: one column a target, missing as 0, and the lag bucket of the feature."""
    lag = F.regexp_extract("feature", r"_l(\d)$", 1)
    wide = importances.groupBy("feature").pivot("target", targets).agg(F.sum("gain_pct")).fillna(0.0, targets)
    return wide.withColumn("lag_bucket", F.when(lag == "", "lag 1").otherwise(F.concat(F.lit("lag "), lag)))


def error_tail(predictions: DataFrame, base: str, top: int = 10) -> DataFrame:
    """Per model other than base: percentiles of its absolute error, and of all squared error that it has in excess of the base model on common rows, the share of the `top` rows with the most (null if there is no excess)."""
    e = lambda p: F.col(p) - F.col("y_true")
    own = predictions.filter(F.col("model") != base)
    levels = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    quantiles = group_quantiles(own.withColumn("e", F.abs(e("y_pred"))), ["model"], "e", list(levels.values()))
    other = predictions.filter(F.col("model") == base).select("entity", "qi", F.col("y_pred").alias("_b"))
    excess = own.join(other, ["entity", "qi"]).select("model", "entity", "qi", (e("y_pred") * e("y_pred") - e("_b") * e("_b")).alias("x"))
    whole = excess.groupBy("model").agg(F.sum("x").alias("_whole"))
    nth = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("x"), "entity", "qi"))
    most = excess.withColumn("_n", nth).filter(F.col("_n") <= top).groupBy("model").agg(F.sum("x").alias("_most"))
    out = quantiles.join(whole, "model").join(most, "model")
    return out.select("model", *[F.col("q")[i].alias(k) for i, k in enumerate(levels)], F.when(F.col("_whole") > 0, F.col("_most") / F.col("_whole")).alias("top_share"))


def residual_shocks(predictions: DataFrame) -> DataFrame:
    """Mean residual of each model and quarter."""
    return predictions.groupBy("model", "qi").agg(F.avg(F.col("y_true") - F.col("y_pred")).alias("shock"), F.count("*").alias("n"))


def interactions(df: DataFrame, series: list[str], groups: list[str]) -> DataFrame:
    """A column per series and group: the series where the row is of the group, else 0 (null stays null)."""
    slug = lambda s: "".join(c if c.isalnum() else "_" for c in s.lower())
    return df.withColumns({f"{s}_x_{slug(v)}": F.col(s) * (F.col("grp") == v).cast("double") for s in series for v in groups})


def era_tests(paired: DataFrame, year: int, least: int = 50) -> DataFrame:
    """Per era (before `year`, and from it on) of at least `least` rows: rows, both errors, and the test of the difference in squared error."""
    x = paired.withColumn("era", F.when(F.floor(F.col("qi") / 4) < year, f"before {year}").otherwise(f"from {year}"))
    t = F.col("y_true")
    rm = lambda p: F.sqrt(F.avg((F.col(p) - t) * (F.col(p) - t)))
    sizes = x.groupBy("era").agg(F.count("*").alias("n"), rm("p_a").alias("rmse_a"), rm("p_b").alias("rmse_b")).filter(F.col("n") >= least)
    return sizes.join(dm_test(per_quarter(x, ["era"]), ["era"], "d_se"), "era")


def best_on_common_rows(predictions: DataFrame, reference: str, lags: int = 4) -> DataFrame:
    """The model with the smallest error on the rows that it shares with the reference, and the test of one against the other: best_model, n, rmse_best, rmse_reference and the test."""
    other = predictions.filter(F.col("model") == reference).select("entity", "qi", F.col("y_pred").alias("p_b"))
    both = predictions.filter(F.col("model") != reference).join(other, ["entity", "qi"])
    ea, eb = F.col("y_pred") - F.col("y_true"), F.col("p_b") - F.col("y_true")
    scores = both.groupBy("model").agg(F.count("*").alias("n"), F.sqrt(F.avg(ea * ea)).alias("rmse_best"), F.sqrt(F.avg(eb * eb)).alias("rmse_reference"))
    best = scores.agg(F.min(F.struct("rmse_best", "model", "n", "rmse_reference")).alias("s")).select("s.*")
    quarterly = both.join(F.broadcast(best.select("model")), "model").groupBy("model", "qi").agg(F.avg(ea * ea - eb * eb).alias("d"))
    return best.join(dm_test(quarterly, ["model"], lags=lags), "model").withColumnRenamed("model", "best_model")


def delta_rows(paired: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, both errors, their difference (positive where b is better), difference in hits, and the test, overall or per group."""
    keys = by or ["_all"]
    x = paired if by else paired.withColumn("_all", F.lit(0))
    t = F.col("y_true")
    rm = lambda p: F.sqrt(F.avg((F.col(p) - t) * (F.col(p) - t)))
    sizes = x.groupBy(*keys).agg(F.count("*").alias("n"), rm("p_a").alias("rmse_base"), rm("p_b").alias("rmse_alt"), F.avg("d_hit").alias("d_dir_acc")).withColumn("rmse_delta", F.col("rmse_base") - F.col("rmse_alt"))
    out = sizes.join(dm_test(per_quarter(x, keys), keys, "d_se"), keys)
    return out if by else out.drop("_all")


def with_prior_best(scores: DataFrame, prior: DataFrame) -> DataFrame:
    """scores (model, n and metrics) and, appended, the best row of an earlier suite (model_family, feature_set, scope, n, mae, rmse, r2, directional_accuracy), with a note; scores alone where that has no row of scope ALL."""
    best = prior.filter("scope = 'ALL'").orderBy("rmse", "model_family", "feature_set").limit(1)
    name = F.concat(F.lit("earlier best ("), F.coalesce("model_family", F.lit("?")), F.lit("/"), F.coalesce("feature_set", F.lit("?")), F.lit(")"))
    row = best.select(name.alias("model"), F.col("n").cast("long").alias("n"), *[F.col(c).cast("double").alias(c) for c in ("mae", "rmse", "r2")], F.col("directional_accuracy").cast("double").alias("dir_acc"), F.lit("another target: errors do not compare").alias("note"))
    return scores.withColumn("note", F.lit(None).cast("string")).unionByName(row)
