"""Assembly of the panel: targets, peers, macro and sector series, valuation, clipping and trimming."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions import guarded as g
from vintagepanel.functions import quarters as q
from vintagepanel.functions.order import group_quantiles
from vintagepanel.functions.sizes import small
from vintagepanel.operators.series import BANDS


def attach_group(df: DataFrame, groups: DataFrame, entity: str = "entity") -> DataFrame:
    """df with the group of each entity (groups: entity, grp); entities without one are dropped."""
    return df.join(groups.filter(F.col("grp").isNotNull()), entity)


def timing(df: DataFrame) -> DataFrame:
    """Label, end date, origin (first day) and seasonal flags of the target quarter qi."""
    n = F.col("qi") % 4 + 1
    flags = {f"is_q{k}": (n == k).cast("double") for k in (1, 2, 3, 4)}
    return df.withColumns({"target_quarter": q.quarter_label(F.col("qi")), "period_end": q.quarter_end(F.col("qi")), "origin": q.quarter_start(F.col("qi")), "quarter_number": n.cast("long")} | flags)


def baselines(df: DataFrame, y: str = "yoy", entity: str = "entity") -> DataFrame:
    """Naive forecasts of y from what is known a quarter before: last value, the same quarter a year before, trailing and expanding means."""
    w, x = g.series(entity), F.col(y)
    return df.withColumns({"b_persistence": F.lag(x, 1).over(w), "b_seasonal": F.lag(x, 4).over(w), "b_mean_4": g.rolling_mean(x, w, 4, 2, 1), "b_mean_8": g.rolling_mean(x, w, 8, 4, 1), "b_history": g.guarded(F.avg(x), x, g.expanding(w, 1), 4)})


def annual_target(df: DataFrame, ttm: str = "ttm", entity: str = "entity") -> DataFrame:
    """Growth of the year that begins with the target quarter over the year before it, its persistence, and the expanding mean of past ones.

    Target and persistence are blanked outside their band; the mean is taken before that.
    """
    w, t = g.series(entity), F.col(ttm)
    raw = df.withColumns({"_target": F.try_divide(F.lead(t, 3).over(w), F.lag(t, 1).over(w)) - 1, "_persist": F.try_divide(F.lag(t, 1).over(w), F.lag(t, 5).over(w)) - 1})
    known = F.col("_persist")
    return raw.withColumns({"y_annual": g.between_open(F.col("_target"), *BANDS["annual"]), "b_annual_persistence": g.between_open(known, *BANDS["annual"]), "b_annual_mean": g.guarded(F.avg(known), known, g.expanding(w, 0), 2)}).drop("_target", "_persist")


def annual_margin(df: DataFrame, part: Column, revenue: str, name: str, band: tuple[float, float], entity: str = "entity") -> DataFrame:
    """Share of `part` in the revenue of the four quarters from the target on; persistence and expanding mean of the known ones."""
    w = g.series(entity)
    sums = df.withColumns({"_p": g.rolling_sum(part, w, 4), "_r": g.rolling_sum(F.col(revenue), w, 4)}).withColumn("_m", g.ratio(F.col("_p"), F.col("_r")))
    last = F.lag("_m", 1).over(w)
    kept = sums.withColumns({f"y_{name}": g.between_open(F.lead("_m", 3).over(w), *band), "_last": last})
    return kept.withColumns({f"b_{name}_persistence": g.between_open(F.col("_last"), *band), f"b_{name}_mean": g.guarded(F.avg("_last"), F.col("_last"), g.expanding(w, 0), 2)}).drop("_p", "_r", "_m", "_last")


def group_median(df: DataFrame, columns: dict[str, str], by: tuple[str, ...] = ("grp", "qi")) -> DataFrame:
    """Adds, for each column, the median of its group and quarter under the new name; null where the row has no group or quarter, or the group no value.

    All columns are one stacked pass, and no task holds a group; a row per group and
    quarter comes back, so that is broadcast.
    """
    pairs = [F.struct(F.lit(new).alias("c"), F.col(c).cast("double").alias("x")) for c, new in columns.items()]
    long = df.select(*by, F.explode(F.array(*pairs)).alias("_s")).select(*by, F.col("_s.c").alias("_c"), F.col("_s.x").alias("_x")).dropna(subset=list(by))
    middle = group_quantiles(long, [*by, "_c"], "_x", [0.5]).withColumn("_m", F.get("q", F.lit(0)))
    return df.join(F.broadcast(middle.groupBy(*by).pivot("_c", list(columns.values())).agg(F.first("_m"))), list(by), "left").select(*df.columns, *columns.values())


def peers(df: DataFrame, x: str, by: tuple[str, ...] = ("grp", "qi")) -> DataFrame:
    """Mean of x over the other members of the group and quarter, and the group's median, deviation and own distance from the median; all null where the row has no group or quarter."""
    v, median = F.col(x), f"{x}_peer_median"
    group = df.groupBy(*by).agg(F.count(v).alias("_n"), F.sum(v).alias("_sum"), F.stddev_samp(v).alias(f"{x}_peer_std"))
    others = F.col("_n") - v.isNotNull().cast("long")
    out = group_median(df, {x: median}, by).join(F.broadcast(group), list(by), "left")
    new = {f"{x}_peer_mean": F.when(others > 0, (F.col("_sum") - F.coalesce(v, F.lit(0.0))) / others), f"{x}_vs_peers": v - F.col(median)}
    return out.withColumns(new).select(*df.columns, f"{x}_peer_mean", median, f"{x}_peer_std", f"{x}_vs_peers")


def macro_features(macro: DataFrame, levels: list[str], changes: list[str], lag: int = 1, ladder: tuple[int, ...] = ()) -> DataFrame:
    """A calendar table (qi and series) turned into features of the quarter that may use them: levels, changes, and levels at further lags."""
    w = Window.orderBy("qi")  # one row a quarter
    new = {f"mac_{c}": F.col(c) for c in levels}
    new |= {f"mac_{c}_yoy": g.growth(F.col(c), w, 4) for c in changes} | {f"mac_{c}_qoq": g.growth(F.col(c), w, 1) for c in changes}
    new |= {f"mac_{c}_l{k}": F.lag(c, k - lag).over(w) for k in ladder for c in levels}
    return macro.select((F.col("qi") + lag).alias("qi"), *[e.alias(n) for n, e in new.items()])


def macro_join(panel: DataFrame, features: DataFrame) -> DataFrame:
    """The features of a quarter to all its rows; one row a quarter, so broadcast."""
    return panel.join(F.broadcast(features), "qi", "left")


def matched_series(series: DataFrame, matching: DataFrame, lag: int = 1) -> DataFrame:
    """series (series, qi, value) matched to groups (matching: grp, series): grp, qi, own_yoy, own_qoq for the quarter that may use them."""
    w = Window.partitionBy("series").orderBy("qi")
    grown = series.withColumns({"own_yoy": g.growth(F.col("value"), w, 4), "own_qoq": g.growth(F.col("value"), w, 1)})
    return grown.join(small(matching), "series").select("grp", (F.col("qi") + lag).alias("qi"), "own_yoy", "own_qoq")


def crosswalk(industry: DataFrame, mapping: DataFrame, lag: int = 2) -> DataFrame:
    """industry (industry, qi, value) summed to groups over a many-to-many mapping (grp, industry), with yearly and quarterly growth, lagged."""
    w = Window.partitionBy("grp").orderBy("qi")
    summed = industry.join(small(mapping), "industry").groupBy("grp", "qi").agg(F.sum("value").alias("value"))
    grown = summed.withColumns({"va_yoy": g.growth(F.col("value"), w, 4), "va_qoq": g.growth(F.col("value"), w, 1)})
    return grown.select("grp", (F.col("qi") + lag).alias("qi"), F.col("value").alias("va"), "va_yoy", "va_qoq")


def valuation(df: DataFrame, price: str, shares: str, ttm: str, debt: str, cash: str) -> DataFrame:
    """Market value, price to sales, and enterprise value to sales with missing debt and cash as 0."""
    cap = F.col(price) * F.col(shares)
    worth = cap + F.coalesce(debt, F.lit(0.0)) - F.coalesce(cash, F.lit(0.0))
    return df.withColumns({"mkt_cap": cap, "mkt_ps": g.ratio(cap, F.col(ttm)), "mkt_ev_sales": g.ratio(worth, F.col(ttm))})


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, as_of: int | None = None) -> DataFrame:
    """Clip columns to exact quantiles of the whole table. as_of: quantiles of the quarters before this qi alone, so that nothing looks ahead."""
    seen = df if as_of is None else df.filter(F.col("qi") < as_of)
    long = seen.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")).select("s.*") if columns else None
    limits = {c: None for c in columns} | ({r["column_name"]: r["q"] for r in group_quantiles(long, ["column_name"], "value", [low, high]).collect()} if columns else {})
    clip = lambda c, ends: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(ends[1])), F.lit(ends[0])))
    return df.withColumns({c: clip(c, limits[c]) for c in columns if limits[c] is not None})


def trim(df: DataFrame, start: int, coverage: float = 0.6, n_entities: int | None = None) -> DataFrame:
    """Rows from quarter `start` on, of quarters that hold at least this share of the entities; if no quarter does, of all."""
    late = df.filter(F.col("qi") >= start)
    if n_entities is None:
        n_entities = df.select("entity").distinct().count()
    dense = late.groupBy("qi").agg(F.countDistinct("entity").alias("n")).filter(F.col("n") >= coverage * n_entities).select("qi")
    return late.join(F.broadcast(dense), "qi", "left_semi") if dense.limit(1).count() else late


def coverage_audit(panel: DataFrame, universe: DataFrame, y: str = "yoy") -> DataFrame:
    """Rows, rows with a target and first and last quarter of every entity of the universe; zero rows where it is absent."""
    found = panel.groupBy("entity").agg(F.count("*").alias("n_rows"), F.count(y).alias("n_labelled"), F.min("qi").alias("first_qi"), F.max("qi").alias("last_qi"))
    return universe.select("entity").distinct().join(found, "entity", "left").fillna(0, ["n_rows", "n_labelled"])


#: Families of columns by prefix; the first that fits.
FAMILIES = [("f_lag_", "own history"), ("f_exp_", "own history"), ("f_mean_", "own history"), ("f_std_", "own history"), ("f_", "fundamentals"), ("mac_", "macro"), ("mkt_", "market"), ("bl_", "peers"), ("ev_", "events"), ("own_", "macro"), ("va", "industry"), ("is_q", "calendar"), ("b_", "baseline"), ("y", "target")]


def feature_columns(df: DataFrame, prefixes: tuple[str, ...] = ("f_", "mac_", "mkt_", "bl_", "ev_"), without: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes) and not (without and c.startswith(without))]


def column_dictionary(df: DataFrame) -> DataFrame:
    """column_name, family, n_filled (rows with a value) of every column, counted in one pass: one row a column."""
    family = F.lit("other")
    for prefix, label in reversed(FAMILIES):
        family = F.when(F.col("c.column_name").startswith(prefix), label).otherwise(family)
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_filled")) for i, c in enumerate(df.columns)]))
    return filled.select(each.alias("c")).select("c.column_name", family.alias("family"), "c.n_filled")


def family_of(column: str) -> str:
    """The family of a column: that of the first prefix that fits."""
    return next((label for prefix, label in FAMILIES if column.startswith(prefix)), "other")


def expert_columns(df: DataFrame, views: dict[str, set[str]], prefixes: tuple[str, ...] = ("f_", "mac_", "mkt_", "ev_", "va", "own_")) -> dict[str, list[str]]:
    """The feature columns of each view (a set of families), and of all: the columns an expert sees."""
    known = feature_columns(df, prefixes)
    return {name: [c for c in known if family_of(c) in families] for name, families in views.items()} | {"full": known}
