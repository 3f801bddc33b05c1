"""From raw observations to clean quarterly series, and causal features of them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions import guarded as g
from vintagepanel.functions.quarters import quarter_index

#: Open bands outside which a value is blanked, by what it measures (fixed values).
BANDS = {"yoy": (-0.95, 3.0), "qoq": (-0.95, 5.0), "annual": (-0.95, 3.0), "gross_margin": (-0.5, 1.0), "ebitda_margin": (-1.0, 1.0)}


def last_per_quarter(df: DataFrame, entity: str = "entity", date: str = "date", ties: list[str] | None = None) -> DataFrame:
    """The last row of each entity and quarter, with its qi. Rows of one date are ordered by the columns of ties."""
    w = Window.partitionBy(entity, "qi").orderBy(F.desc(date), *[F.desc(t) for t in ties or []])
    return df.withColumn("qi", quarter_index(F.col(date))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def gap_free(df: DataFrame, entity: str = "entity", static: list[str] | None = None) -> DataFrame:
    """Every quarter of each entity between its first and last; static columns are filled forward, then backward."""
    span = df.groupBy(entity).agg(F.min("qi").alias("a"), F.max("qi").alias("b"))
    grid = span.select(entity, F.explode(F.sequence("a", "b")).alias("qi"))
    out = grid.join(df, [entity, "qi"], "left")
    w = Window.partitionBy(entity).orderBy("qi")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return out.withColumns({c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)) for c in static or []})


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def clean_growth(df: DataFrame, value: str = "revenue", entity: str = "entity") -> DataFrame:
    """Adds yoy, qoq (blanked outside their bands) and ttm to a gap-free table; values that are not positive count as missing."""
    w = g.series(entity)
    out = df.withColumn(value, positive(F.col(value)))
    x = F.col(value)
    return out.withColumns({"yoy": g.between_open(g.growth(x, w, 4), *BANDS["yoy"]), "qoq": g.between_open(g.growth(x, w, 1), *BANDS["qoq"]), "ttm": g.rolling_sum(x, w, 4)})


def common_size(df: DataFrame) -> DataFrame:
    """Ratios to revenue of whichever of the known columns df has, assets turnover and the log of revenue."""
    have, revenue = set(df.columns), F.col("revenue")
    over = {"gross_profit": "gross_margin", "operating_income": "operating_margin", "net_income": "net_margin", "research": "research_share", "overhead": "overhead_share", "capex": "capex_share", "operating_cash": "cash_share"}
    new = {name: g.ratio(F.col(c), revenue) for c, name in over.items() if c in have}
    if {"operating_income", "depreciation"} <= have:
        new["ebitda_margin"] = g.ratio(F.col("operating_income") + F.col("depreciation"), revenue)
    if "assets" in have:
        new["turnover"] = g.ratio(revenue, F.col("assets"))
    return df.withColumns(new | {"log_revenue": F.when(revenue > 0, F.ln(revenue))})


def growth_features(df: DataFrame, lag: int = 1, entity: str = "entity", x: str = "yoy", q: str = "qoq") -> DataFrame:
    """Lag ladder, acceleration, rolling and expanding statistics and momentum of a gap-free table, none of which sees the last `lag` - 1 quarters or this one."""
    w, y, m = g.series(entity), F.col(x), F.col(q)
    lags = {f"f_lag_{x}_{i}": F.lag(y, lag + i - 1).over(w) for i in range(1, 6)}
    past = g.expanding(w, lag)
    out = df.withColumns(
        lags
        | {"f_mean_4": g.rolling_mean(y, w, 4, 2, lag), "f_mean_8": g.rolling_mean(y, w, 8, 4, lag), "f_std_4": g.rolling_std(y, w, 4, 2, lag), "f_std_8": g.rolling_std(y, w, 8, 4, lag)}
        | {"f_exp_mean": g.guarded(F.avg(y), y, past, 4), "f_exp_std": g.guarded(F.stddev_samp(y), y, past, 4), "f_exp_n": F.count(y).over(past)}
        | {f"f_lag_{q}": F.lag(m, lag).over(w), f"f_{q}_mean_4": g.rolling_mean(m, w, 4, 2, lag)}
    )
    first = F.col(f"f_lag_{x}_1")
    return out.withColumns({"f_accel_1": first - F.col(f"f_lag_{x}_2"), "f_accel_4": first - F.col(f"f_lag_{x}_5"), "f_zscore": F.try_divide(first - F.col("f_mean_8"), F.col("f_std_8"))})


def lagged_levels(df: DataFrame, levels: list[str], changes: list[str], lag: int = 1, entity: str = "entity") -> DataFrame:
    """f_<c>: the level of c, lag quarters before; f_<c>_chg4: its change over the four quarters to then."""
    w = g.series(entity)
    new = {f"f_{c}": F.lag(c, lag).over(w) for c in levels}
    return df.withColumns(new | {f"f_{c}_chg4": F.lag(c, lag).over(w) - F.lag(c, lag + 4).over(w) for c in changes})


def deferred_signals(df: DataFrame, deferred: str, revenue: str = "revenue", ttm: str = "ttm", lag: int = 1, entity: str = "entity") -> DataFrame:
    """Change of deferred revenue over four quarters against revenue then, and its level against a year's revenue."""
    w = g.series(entity)
    back = lambda c, k: F.lag(c, k).over(w)
    return df.withColumns({"f_deferred_chg": g.ratio(back(deferred, lag) - back(deferred, lag + 4), back(revenue, lag + 4)), "f_deferred_share": g.ratio(back(deferred, lag), back(ttm, lag))})


def receivables_gap(df: DataFrame, receivables: str, yoy: str = "yoy", lag: int = 1, entity: str = "entity") -> DataFrame:
    """Growth of receivables over the year less that of revenue."""
    w = g.series(entity)
    grown = g.ratio(F.lag(receivables, lag).over(w), F.lag(receivables, lag + 4).over(w)) - 1
    return df.withColumn("f_receivables_gap", grown - F.lag(yoy, lag).over(w))


def goodwill_jump(df: DataFrame, goodwill: str, assets: str, lag: int = 1, entity: str = "entity", share: float = 0.05) -> DataFrame:
    """f_jump: change of goodwill against assets; f_recent: 1.0 if one of the last four changes was a rise of more than share."""
    w = g.series(entity)
    rise = F.col(goodwill) - F.lag(goodwill, 1).over(w)
    grown = g.ratio(F.col(goodwill), F.lag(goodwill, 1).over(w)) - 1
    flagged = df.withColumns({"_jump": g.ratio(rise, F.col(assets)), "_flag": F.coalesce((grown > share) & (rise > 0), F.lit(False)).cast("double")})
    return flagged.withColumns({"f_jump": F.lag("_jump", lag).over(w), "f_recent": F.max("_flag").over(g.trailing(w, 4, lag))}).drop("_jump", "_flag")
