"""Daily prices to risk measures, and daily series to quarters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions import guarded as g
from vintagepanel.functions.quarters import quarter_end, quarter_index
from vintagepanel.operators.temporal import asof_join


def calendar_returns(daily: DataFrame) -> DataFrame:
    """daily (entity, date, px) with cal, the index of the date in the calendar of all entities, and ret, null unless the day before is there."""
    dates = daily.select("date").distinct()
    calendar = dates.withColumn("cal", F.row_number().over(Window.orderBy("date")).cast("long"))  # one row a day
    w = Window.partitionBy("entity").orderBy("cal")
    out = daily.join(F.broadcast(calendar), "date")
    follows = F.col("cal") - F.lag("cal").over(w) == 1
    return out.withColumn("ret", F.when(follows, F.try_divide(F.col("px"), F.lag("px").over(w)) - 1))


def rolling_sums(rows: DataFrame, by: str, order: str, n: int, values: dict[str, Column]) -> DataFrame:
    """rows with, for each value, the sum over the last n rows of the key (null where there are fewer); nulls count as 0.

    Rows are cut into blocks of n. The last n rows are the end of one block and the
    beginning of the next, so a running sum from the front of each block and one from its
    back give every sum by one addition: no frame is added up again, and nothing is
    subtracted, so a large value leaves no trace once it has left the frame.
    """
    along = Window.partitionBy(by).orderBy(order)
    block = rows.withColumn("_at", F.row_number().over(along) - 1).withColumn("_block", F.floor(F.col("_at") / n))
    front = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(by, "_block").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    filled = block.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in values.items()})
    halves = filled.withColumns({f"_f_{k}": F.sum(f"_v_{k}").over(front) for k in values}).withColumns({f"_b_{k}": F.coalesce(F.sum(f"_v_{k}").over(back), F.lit(0)) for k in values})
    whole = F.col("_at") >= n - 1
    before = {k: F.coalesce(F.lag(f"_b_{k}", n).over(along), F.lit(0)) for k in values}
    summed = halves.withColumns({k: F.when(whole, F.col(f"_f_{k}") + before[k]) for k in values})
    return summed.drop("_at", "_block", *[f"_{h}_{k}" for h in "vfb" for k in values])


def rolling_risk(returns: DataFrame, bench: DataFrame, days: int = 252) -> DataFrame:
    """Volatility over `days` calendar rows, a year's worth, and beta to a benchmark (cal, rb); null unless all rows are there.

    From sums over blocks (rolling_sums): daily returns are small against their spread, so
    squares less the square of the mean lose nothing.
    """
    b = bench.withColumn("var_b", g.guarded(F.var_samp("rb"), F.col("rb"), Window.orderBy("cal").rangeBetween(-days + 1, 0), days))  # one row a day
    both = returns.join(F.broadcast(b), "cal", "left")
    x, y = F.col("ret"), F.when(F.col("ret").isNotNull(), F.col("rb"))
    values = {"_n": x.isNotNull().cast("int"), "_sx": x, "_sxx": x * x, "_m": y.isNotNull().cast("int"), "_sy": y, "_sxy": x * y}
    s = rolling_sums(both, "entity", "cal", days, values)
    # days rows without a gap
    gapless = F.col("cal") - F.lag("cal", days - 1).over(Window.partitionBy("entity").orderBy("cal")) == days - 1
    full, paired = gapless & (F.col("_n") == days), gapless & (F.col("_m") == days)
    var = F.greatest(F.col("_sxx") - F.col("_sx") * F.col("_sx") / days, F.lit(0.0)) / (days - 1)
    cov = (F.col("_sxy") - F.col("_sx") * F.col("_sy") / days) / (days - 1)
    out = s.withColumns({"vol": F.when(full, F.sqrt(var)) * (days**0.5), "beta": F.when(paired, F.try_divide(cov, F.col("var_b")))})
    return out.drop("var_b", *values)


def momentum(daily: DataFrame, short: int = 63, long: int = 126, least: int = 21) -> DataFrame:
    """Returns over `short` and `long` rows of the entity, and the fall from the highest price of the last `short` rows."""
    w = Window.partitionBy("entity").orderBy("date")
    x = F.col("px")
    high = g.guarded(F.max(x), x, w.rowsBetween(-short + 1, 0), least)
    return daily.withColumns({"ret_short": g.growth(x, w, short), "ret_long": g.growth(x, w, long), "drawdown": F.try_divide(x, high) - 1})


def market_at_origin(origins: DataFrame, measures: DataFrame, values: list[str]) -> DataFrame:
    """origins (entity, origin) with the measures of the last day before the origin."""
    return asof_join(origins, measures, "entity", "origin", "date", values, strict=True)


def publication_lagged(origins: DataFrame, rows: DataFrame, value: str, publication_days: int = 14, max_age: int = 60, steps: tuple[int, ...] = (2, 6), also: tuple[str, ...] = ()) -> DataFrame:
    """The value, its change over some settlements, and the columns of also, as known at each origin: published some days late, and not older than max_age."""
    w = Window.partitionBy("entity").orderBy("date")
    changed = rows.withColumns({f"{value}_chg{k}": g.growth(F.col(value), w, k) for k in steps})
    cut = origins.withColumn("_cut", F.date_sub("origin", publication_days))
    return asof_join(cut, changed, "entity", "_cut", "date", [value, *[f"{value}_chg{k}" for k in steps], *also], max_age_days=max_age).drop("_cut")


def to_quarters(series: DataFrame, columns: list[str]) -> DataFrame:
    """Last non-null value, mean and sample deviation of each column in each quarter, empty quarters between included."""
    x = series.withColumn("qi", quarter_index(F.col("date")))
    stats: list[Column] = []
    for c in columns:
        stats += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c), F.avg(c).alias(f"{c}_qavg"), F.stddev_samp(c).alias(f"{c}_qstd")]
    found = x.groupBy("qi").agg(*stats)
    span = x.agg(F.min("qi").alias("a"), F.max("qi").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b")).alias("qi"))
    return grid.join(found, "qi", "left").withColumn("date", quarter_end(F.col("qi")))


def spread(df: DataFrame, long: str, short: str, name: str) -> DataFrame:
    """Differences of the last values and of the averages, where both columns are there."""
    new = {name + s: F.col(long + s) - F.col(short + s) for s in ("", "_qavg") if {long + s, short + s} <= set(df.columns)}
    return df.withColumns(new)
