"""Blending experts, guarding tails, and comparing the results. Wide tables: a column per expert."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions import guarded as g
from vintagepanel.operators.evaluation import metric_columns


def widen(predictions: DataFrame, models: list[str]) -> DataFrame:
    """entity, grp, qi, y_true and a column a model; rows that all models forecast."""
    wide = predictions.groupBy("entity", "grp", "qi").pivot("model", models).agg(F.first("y_pred"))
    truth = predictions.groupBy("entity", "grp", "qi").agg(F.first("y_true").alias("y_true"))
    return truth.join(wide, ["entity", "grp", "qi"]).dropna(subset=models)


def trailing_error(wide: DataFrame, experts: list[str]) -> DataFrame:
    """Adds err_<expert>: the mean absolute error of the entity's earlier forecasts."""
    past = g.expanding(g.series(), 1)
    return wide.withColumns({f"err_{e}": F.avg(F.abs(F.col(e) - F.col("y_true"))).over(past) for e in experts})


def equal_blend(experts: list[str]) -> Column:
    total = F.lit(0.0)
    for e in experts:
        total = total + F.col(e)
    return total / len(experts)


def softmax_blend(wide: DataFrame, experts: list[str], temperature: float = 0.05) -> DataFrame:
    """Adds w_<expert> and gate: weights fall with the trailing error; without history all weigh the same."""
    x = trailing_error(wide, experts)
    raw = {e: F.exp(-F.coalesce(F.col(f"err_{e}"), F.lit(0.0)) / temperature) for e in experts}
    total = F.lit(0.0)
    for e in experts:
        total = total + raw[e]
    weighted = x.withColumns({f"w_{e}": raw[e] / total for e in experts})
    gate = F.lit(0.0)
    for e in experts:
        gate = gate + F.col(f"w_{e}") * F.col(e)
    return weighted.withColumn("gate", gate)


def global_stack(wide: DataFrame, a: str, b: str, c: str, min_train: int = 50) -> DataFrame:
    """Non-negative least-squares weights of three experts over all earlier quarters, normalised to 1: qi, w_a, w_b, w_c.

    From running sums of the cross-products per quarter; with three experts the solution
    is the best of the seven sets of active ones, each in closed form.
    """
    names = [a, b, c]
    cross = {f"g{i}{j}": F.sum(F.col(names[i]) * F.col(names[j])) for i in range(3) for j in range(i, 3)}
    right = {f"r{i}": F.sum(F.col(names[i]) * F.col("y_true")) for i in range(3)}
    per = wide.groupBy("qi").agg(F.count("*").alias("n"), *[e.alias(k) for k, e in (cross | right).items()])
    past = Window.orderBy("qi").rowsBetween(Window.unboundedPreceding, -1)
    s = per.select("qi", *[F.sum(k).over(past).alias(k) for k in ("n", *cross, *right)]).filter(F.col("n") >= min_train)
    G = lambda i, j: F.col(f"g{min(i, j)}{max(i, j)}")  # noqa: E731, N806
    r = lambda i: F.col(f"r{i}")
    zero = F.lit(0.0)
    options = []
    for i in range(3):
        w = [zero] * 3
        w[i] = F.try_divide(r(i), G(i, i))
        options.append(w)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        d = G(i, i) * G(j, j) - G(i, j) * G(i, j)
        w = [zero] * 3
        w[i], w[j] = F.try_divide(r(i) * G(j, j) - r(j) * G(i, j), d), F.try_divide(r(j) * G(i, i) - r(i) * G(i, j), d)
        options.append(w)
    minor = lambda i, j, k, m: G(i, k) * G(j, m) - G(i, m) * G(j, k)
    d = G(0, 0) * minor(1, 2, 1, 2) - G(0, 1) * minor(1, 2, 0, 2) + G(0, 2) * minor(1, 2, 0, 1)
    col = lambda m: [[(r(i) if j == m else G(i, j)) for j in range(3)] for i in range(3)]
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    options.append([F.try_divide(det(col(m)), d) for m in range(3)])

    def loss(w: list[Column]) -> Column:
        out = zero
        for i in range(3):
            out = out - 2 * w[i] * r(i)
            for j in range(3):
                out = out + w[i] * w[j] * G(i, j)
        return out

    feasible = [F.when((w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0), F.struct(loss(w).alias("loss"), *[w[i].alias(f"w{i}") for i in range(3)])) for w in options]
    best = s.withColumn("best", F.array_min(F.array_compact(F.array(*feasible))))
    total = F.col("best.w0") + F.col("best.w1") + F.col("best.w2")
    return best.select("qi", *[F.try_divide(F.col(f"best.w{i}"), total).alias(f"w_{n}") for i, n in enumerate(names)])


def score_methods(wide: DataFrame, methods: list[str], by: list[str] | None = None) -> DataFrame:
    """Metrics of each method column."""
    long = wide.select(*(by or []), "y_true", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in methods])).alias("m")).select(*(by or []), "y_true", "m.model", "m.y_pred")
    return long.filter(F.col("y_pred").isNotNull()).groupBy("model", *(by or [])).agg(*metric_columns())


def weight_summary(weighted: DataFrame, experts: list[str], by: str) -> DataFrame:
    """Per group (or entity): rows, mean and deviation of each expert's weight, and weight_volatility, the mean of the deviations that are known."""
    out = weighted.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(f"w_{e}").alias(f"mean_w_{e}") for e in experts], *[F.stddev_samp(f"w_{e}").alias(f"std_w_{e}") for e in experts])
    known = F.filter(F.array(*[F.col(f"std_w_{e}") for e in experts]), lambda x: x.isNotNull())
    return out.withColumn("weight_volatility", F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known)))


def contiguous_suffix(df: DataFrame, x: str, most: int = 64, least: int = 8) -> DataFrame:
    """For each row the length of the run of non-null values that ends just before it (at most `most`); null if shorter than `least`. df is gap-free."""
    w = g.series()
    last_gap = F.max(F.when(F.col(x).isNull(), F.col("qi"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("qi").over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = F.least(F.col("qi") - F.coalesce(last_gap + 1, first), F.lit(most))
    return df.withColumn("context", F.when(run >= least, run))


def contexts(df: DataFrame, x: str, most: int = 64, least: int = 8) -> DataFrame:
    """df with ctx: the values of x, oldest first, of the run that ends just before the row (contiguous_suffix); null where that is too short. An array holds at most `most` values."""
    past = F.collect_list(x).over(g.series().rowsBetween(-most, -1))  # nulls are left out, and lie before the run
    run = contiguous_suffix(df, x, most, least).withColumn("_past", past)
    return run.withColumn("ctx", F.when(F.col("context").isNotNull(), F.slice("_past", F.greatest(F.size("_past") - F.col("context").cast("int") + 1, F.lit(1)), F.col("context").cast("int")))).drop("_past", "context")


def seasonal_forecast(ctx: DataFrame, horizon: int = 4) -> DataFrame:
    """entity, qi, h (0 to horizon - 1), forecast of a table with contexts (ctx): the value of the same season in the last known year, times that year's growth over the one before. Rows without a context have no forecast."""
    c = F.col("ctx")
    year = lambda end: F.aggregate(F.slice(c, -end, F.lit(4)), F.lit(0.0), lambda s, v: s + v)
    rows = ctx.filter(c.isNotNull() & (F.size(c) >= 8)).withColumn("_rate", F.try_divide(year(F.lit(4)), year(F.lit(8))))
    rows = rows.select("entity", "qi", "ctx", "_rate", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"))
    return rows.select("entity", "qi", "h", (F.get(c, F.size(c) - 4 + F.col("h") % 4) * F.pow("_rate", F.floor(F.col("h") / 4) + 1)).alias("forecast"))


def implied_growth(forecasts: DataFrame, history: DataFrame, value: str, forecast: str) -> DataFrame:
    """Level forecasts (entity, qi, forecast) as growth over the value four quarters before."""
    base = history.select("entity", (F.col("qi") + 4).alias("qi"), F.col(value).alias("_base"))
    return forecasts.join(base, ["entity", "qi"], "left").withColumn("implied", F.try_divide(F.col(forecast), F.col("_base")) - 1).drop("_base")


def trailing_growth(forecasts: DataFrame, history: DataFrame, value: str, forecast: str) -> DataFrame:
    """Level forecasts of four quarters ahead (entity, qi the first of them, h 0 to 3, forecast) as growth of their sum over the last four known values: entity, qi, implied_year. All eight values must be there."""
    w = g.series()
    known = history.withColumn("_ttm", g.rolling_sum(F.col(value), w, 4)).select("entity", (F.col("qi") + 1).alias("qi"), "_ttm")
    x = F.col(forecast)
    ahead = forecasts.groupBy("entity", "qi").agg(F.when(F.count(x) == 4, F.sum(x)).alias("_ahead"))
    return ahead.join(known, ["entity", "qi"], "left").select("entity", "qi", (F.try_divide(F.col("_ahead"), F.col("_ttm")) - 1).alias("implied_year"))


def univariate_forecast(df: DataFrame, value: str) -> DataFrame:
    """A stand-in for an outside forecaster from single lags: the quarter a year before, times the growth of the last known quarter over its own."""
    w = g.series()
    x = F.col(value)
    return df.withColumn("forecast", F.lag(x, 4).over(w) * F.try_divide(F.lag(x, 1).over(w), F.lag(x, 5).over(w)))


def history_ceiling(df: DataFrame, x: str) -> DataFrame:
    """Adds ceiling: the largest absolute value strictly before this quarter."""
    return df.withColumn("ceiling", F.max(F.abs(F.col(x))).over(g.expanding(g.series(), 1)))


def guard(pred: Column, ceiling: Column, fallback: Column, k: float | Column, floor: float | Column) -> tuple[Column, Column]:
    """(forecast, flag): a forecast beyond k times the ceiling (and beyond the floor) gives way to the fallback, if there is one."""
    k, floor = (F.lit(v) if isinstance(v, (int, float)) else v for v in (k, floor))
    beyond = F.coalesce((F.abs(pred) > F.greatest(k * ceiling, floor)) & fallback.isNotNull(), F.lit(False))
    return F.when(beyond, fallback).otherwise(pred), beyond


def guard_sweep(df: DataFrame, pred: str, fallback: str, ks: list[float], floors: list[float], other: str | None = None) -> DataFrame:
    """Metrics and guarded rows for each k and floor: of the guarded forecast and, with other, of its even blend with that. df: y_true, pred, ceiling, fallback."""
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("floor")) for k in ks for f in floors]))
    x = df.withColumn("_g", grid).withColumns({"k": F.col("_g.k"), "floor": F.col("_g.floor")})
    value, flag = guard(F.col(pred), F.col("ceiling"), F.col(fallback), F.col("k"), F.col("floor"))
    kinds = [F.struct(F.lit("guarded").alias("kind"), F.col("_v").alias("y_pred"))] + ([F.struct(F.lit("blend").alias("kind"), (0.5 * F.col("_v") + 0.5 * F.col(other)).alias("y_pred"))] if other else [])
    x = x.withColumns({"_v": value, "_flag": flag}).withColumn("_p", F.explode(F.array(*kinds))).withColumns({"kind": F.col("_p.kind"), "y_pred": F.col("_p.y_pred")})
    return x.groupBy("kind", "k", "floor").agg(*metric_columns(), F.count_if("_flag").alias("n_guarded"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def blend_sweep(wide: DataFrame, a: str, b: str, weights: list[float]) -> DataFrame:
    """Metrics of w*a + (1-w)*b for each weight."""
    x = wide.withColumn("w", F.explode(F.array(*[F.lit(w) for w in weights])))
    return x.withColumn("y_pred", F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b)).groupBy("w").agg(*metric_columns())
