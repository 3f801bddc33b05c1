"""Joins in time that never look ahead: as-of, and totals over trailing windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, values: list[str], max_age_days: int | None = None, strict: bool = False, ties: list[str] | None = None) -> DataFrame:
    """left with the values (and asof_date) of the latest row of right at or before left_on (strict: before it), per key.

    Both sides are united and carried forward by one window per key, so every row is
    read once and no key is compared with all dates of another. A key with no earlier row
    gets nulls, as does a row found to be older than max_age_days. Several right rows of
    one date: the last in the order of ties (or of the values).
    """
    order = [F.col(t) for t in ties or values]
    here = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l")
    no_left, no_right = F.lit(None).cast(left.schema), F.struct(F.col(f"`{right_on}`").alias("asof_date"), *[F.col(f"`{v}`") for v in values])
    a = left.select(F.col(by).alias("k"), F.col(left_on).cast("timestamp").alias("t"), F.lit(0 if strict else 1).alias("side"), here, F.lit(True).alias("is_left"))
    b = right.filter(F.col(right_on).isNotNull()).select(F.col(by).alias("k"), F.col(right_on).cast("timestamp").alias("t"), F.lit(1 if strict else 0).alias("side"), no_left.alias("l"), F.lit(False).alias("is_left"), no_right.alias("r"), F.struct(*order).alias("o"))
    a = a.withColumns({"r": F.lit(None).cast(b.schema["r"].dataType), "o": F.lit(None).cast(b.schema["o"].dataType)})
    w = Window.partitionBy("k").orderBy("t", "side", "o").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("r", F.last("r", True).over(w)).filter("is_left")
    fresh = F.lit(True) if max_age_days is None else F.datediff(F.col("t"), F.col("r.asof_date")) <= max_age_days
    # a null key meets nothing
    usable = fresh & F.col("k").isNotNull()
    return found.select("l.*", *[F.when(usable, F.col(f"r.{c}")).alias(c) for c in ["asof_date", *values]])


def trailing_totals(left: DataFrame, right: DataFrame, by: str, origin: str, date: str, windows: list[int] | tuple[int, ...], values: dict[str, Column]) -> DataFrame:
    """Distinct keys and origins of left (by, origin as a date) with <name>_<days>: the total of each value over right's rows in [origin - days, origin).

    No origin meets an event: right is added up by day, running totals are looked up as of
    the origin and of the start of each window, and subtracted. A key has a row a day
    however many events it has. Null values count as 0, rows without a date are not seen,
    origins without events have zeros, and a null key meets nothing.
    """
    days = right.filter(F.col(date).isNotNull()).select(F.col(by).alias("_k"), F.col(date).cast("date").alias("_d"), *[F.coalesce(v, F.lit(0)).alias(n) for n, v in values.items()])
    daily = days.groupBy("_k", "_d").agg(*[F.sum(n).alias(n) for n in values])
    so_far = daily.withColumns({n: F.sum(n).over(Window.partitionBy("_k").orderBy("_d")) for n in values})
    ends = left.select(F.col(by).alias("_k"), F.col(origin).cast("date").alias("_o")).distinct().select("*", F.explode(F.array(F.lit(0), *[F.lit(d) for d in windows])).alias("_w"))
    found = asof_join(ends.withColumn("_at", F.date_sub("_o", F.col("_w"))), so_far, "_k", "_at", "_d", list(values), strict=True)
    at = lambda n, d: F.coalesce(F.max(F.when(F.col("_w") == d, F.col(n))), F.lit(0))
    return found.groupBy("_k", "_o").agg(*[(at(n, 0) - at(n, d)).alias(f"{n}_{d}") for d in windows for n in values]).withColumnsRenamed({"_k": by, "_o": origin})


def with_totals(left: DataFrame, totals: DataFrame, by: str, origin: str) -> DataFrame:
    """left with the columns of trailing_totals."""
    t = totals.withColumnsRenamed({by: "_k", origin: "_o"})
    return left.join(t, left[by].eqNullSafe(t["_k"]) & left[origin].cast("date").eqNullSafe(t["_o"]), "left").drop("_k", "_o")


#: fixed values: what an event does to guidance; others, mere mentions among them, are not events.
SIGNED_ACTIONS = ("raise", "lower", "reaffirm", "initiate", "withdraw")


def signed_event_features(origins: DataFrame, events: DataFrame, by: str = "entity", origin: str = "origin", date: str = "date", action: str = "action", ties: str = "event_id") -> DataFrame:
    """Counts of events before each origin, net raises less lowers over 180 and 365 days, and what the last event was; zeros where there was none.

    Events are those of SIGNED_ACTIONS; others are not seen. The counts see their windows;
    days_since, last_is_raise and last_is_lower see the last of all earlier events, however
    old. Events without a date are not seen.
    """
    real = events.filter(F.col(action).isin(*SIGNED_ACTIONS))
    is_ = lambda k: (F.col(action) == k).cast("long")
    totals = trailing_totals(origins, real, by, origin, date, (90, 180, 365), {"n": F.lit(1).cast("long"), "raise": is_("raise"), "lower": is_("lower")})
    x = with_totals(origins, totals, by, origin)
    counts = {"n_180": F.col("n_180"), "net_180": F.col("raise_180") - F.col("lower_180"), "net_365": F.col("raise_365") - F.col("lower_365"), "raise_90": F.col("raise_90"), "lower_90": F.col("lower_90")}
    out = asof_join(x.select(*[F.col(c) for c in origins.columns], *[c.alias(n) for n, c in counts.items()]), real, by, origin, date, [action], strict=True, ties=[ties])
    flags = {f"last_is_{k}": F.coalesce((F.col(action) == k).cast("int"), F.lit(0)) for k in ("raise", "lower")}
    return out.withColumns({"days_since": F.datediff(origin, "asof_date")} | flags).drop("asof_date", action)


def latest_event(events: DataFrame, by: str, qi: str, date: str, ties: list[str]) -> DataFrame:
    """The last event of each key and quarter."""
    w = Window.partitionBy(by, qi).orderBy(F.desc(date), *[F.desc(t) for t in ties])
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def event_join(panel: DataFrame, events: DataFrame, by: str, values: list[str], lag: int, prefix: str = "ev_") -> DataFrame:
    """panel with the values of the event of quarter qi - lag, and a rolling sum of the first over four quarters (two at least)."""
    w = Window.partitionBy(by).orderBy("qi").rangeBetween(-3, 0)
    x = F.col(values[0])
    summed = events.withColumn("_sum4", F.when(F.count(x).over(w) >= 2, F.sum(x).over(w)))
    side = summed.select(F.col(by), (F.col("qi") + lag).alias("qi"), *[F.col(v).alias(prefix + v) for v in values], F.col("_sum4").alias(f"{prefix}{values[0]}_sum4"))
    return panel.join(side, [by, "qi"], "left")


def event_study(prices: DataFrame, bench: DataFrame, events: DataFrame, ties: str) -> DataFrame:
    """Abnormal returns around events. prices (entity, date, px, volume), bench (date, px), events (entity, date, ties).

    An event falls on its entity's first trading day at or after its date. Abnormal
    return is the return less the benchmark's; car_m1_p1, car_p1_p5 and car_m5_m1 sum it
    over trading-day offsets, and are null unless all days are there; advol0 is the
    day's volume over the mean of the 20 days before.
    """
    w = Window.partitionBy("entity").orderBy("date")
    change = lambda c, win: F.try_divide(F.col(c), F.lag(c).over(win)) - 1
    b = bench.withColumn("rb", change("px", Window.partitionBy(F.lit(0)).orderBy("date"))).select("date", "rb")
    days = prices.withColumns({"day": F.row_number().over(w), "ret": change("px", w), "base": F.avg("volume").over(w.rowsBetween(-20, -1))}).join(b, "date", "left")
    days = days.select("entity", "date", "day", (F.col("ret") - F.col("rb")).alias("ar"), F.try_divide(F.col("volume"), F.col("base")).alias("av"))
    # days are numbered without gaps, so the first day at or after a date follows the last day before it
    known = events.filter(F.col("date").isNotNull()).withColumn("date", F.col("date").cast("date"))
    before = asof_join(known, days, "entity", "date", "date", ["day"], strict=True).withColumn("day0", F.coalesce("day", F.lit(0)) + 1)
    first = before.select(*events.columns, "day0").join(days.select("entity", F.col("day").alias("day0")), ["entity", "day0"], "left_semi")
    offsets = first.select("*", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("o")).withColumn("day", F.col("day0") + F.col("o"))
    around = offsets.join(days.select("entity", "day", "ar", "av"), ["entity", "day"], "left")

    def car(low: int, high: int) -> Column:
        x = F.when(F.col("o").between(low, high), F.col("ar"))
        return F.when(F.count(x) == high - low + 1, F.sum(x))

    return around.groupBy("entity", ties).agg(car(-1, 1).alias("car_m1_p1"), car(1, 5).alias("car_p1_p5"), car(-5, -1).alias("car_m5_m1"), F.max(F.when(F.col("o") == 0, F.col("av"))).alias("advol0"))
