"""Whole jobs: facts to wide accounts, accounts to features, features and feeds to the panel."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagepanel.functions import guarded as g
from vintagepanel.functions.sizes import cut_lineage
from vintagepanel.operators import fundamentals, market, panel, series, temporal
from vintagepanel.operators.evaluation import walk_forward_baselines

#: Level ratios that become features, and those of which the change over four quarters does too.
LEVELS = ["gross_margin", "operating_margin", "net_margin", "ebitda_margin", "research_share", "overhead_share", "capex_share", "cash_share", "turnover", "log_revenue"]
CHANGES = ["gross_margin", "operating_margin", "net_margin", "ebitda_margin"]
AS_OF = ["ttm", "shares", "debt", "cash"]


def collect_financials(facts: DataFrame, concepts: list[str], proxy: tuple[str, str] | None = None, first_reported: bool = False, ties: tuple[str, ...] = ("tag",)) -> DataFrame:
    """Facts of all entities (entity, concept, tag, prio, form, start, end, filed, val, fy, fp) to wide quarterly accounts.

    Facts are classified, one is kept per period, fourth quarters are derived from years,
    and the concepts of a fixed list become columns, with the source of the first, the
    latest filing and the fiscal labels. Rows that cannot be classified, and entities
    without facts, are simply not there.
    """
    fiscal = fundamentals.fiscal_order()
    kinds = fundamentals.classify(facts).withColumns({"whole": F.col("kind") == "annual", "label": fiscal})
    read = dict.fromkeys(["entity", "concept", "tag", "prio", "start", "end", "filed", "val", *ties, "whole", "label"])
    kept = fundamentals.one_per_period(kinds.select(*read), ("entity", "concept", "end", "whole"), first_reported, ties, {"label": F.min("label")})
    kept = cut_lineage(kept.select("entity", "concept", "tag", "start", "end", "filed", "val", "whole", "label"))
    quarters, years = kept.filter("NOT whole AND start IS NOT NULL"), kept.filter("whole")
    narrow = ["entity", "concept", "start", "end", "val"]
    derived = fundamentals.derive_last_quarter(quarters.select(narrow), years.select(narrow))
    filed = years.select("entity", "concept", "end", "filed", F.concat("tag", F.lit(" less three quarters")).alias("tag"))
    rows = kept.filter("NOT whole").select("entity", "concept", "end", "filed", "tag", "val")
    rows = rows.unionByName(derived.drop("start").join(filed, ["entity", "concept", "end"]))
    wide = fundamentals.with_source(fundamentals.pivot_wide(rows, concepts), concepts[0], proxy)
    return wide.join(fundamentals.fiscal_label(kept, F.col("label")), ["entity", "end"], "left")


def build_features(clean: DataFrame, lag: int = 1) -> DataFrame:
    """Every causal feature of a gap-free table of accounts with growth (clean_growth), of the columns that it has.

    All windows are those of an entity in the order of its quarters, so one shuffle serves
    them all.
    """
    x = series.common_size(series.growth_features(clean, lag))
    have = set(x.columns)
    x = series.lagged_levels(x, [c for c in LEVELS if c in have], [c for c in CHANGES if c in have], lag)
    if "deferred" in have:
        x = series.deferred_signals(x, "deferred", lag=lag)
    if "receivables" in have:
        x = series.receivables_gap(x, "receivables", lag=lag)
    if {"goodwill", "assets"} <= have:
        x = series.goodwill_jump(x, "goodwill", "assets", lag=lag)
    w = g.series()
    return x.withColumns({f"asof_{c}": F.lag(c, lag).over(w) for c in AS_OF if c in have})


def gross_profit(df: DataFrame) -> Column:
    """Gross profit as reported, else revenue less cost, of whichever columns are there."""
    parts = [F.col("gross_profit")] if "gross_profit" in df.columns else []
    return F.coalesce(*parts, *([F.col("revenue") - F.col("cost")] if "cost" in df.columns else [F.lit(None).cast("double")]))


def targets(df: DataFrame) -> DataFrame:
    """Adds naive forecasts, and the targets of the year ahead with theirs: growth, gross margin, EBITDA margin."""
    x = panel.annual_target(panel.baselines(df))
    x = panel.annual_margin(x, gross_profit(x), "revenue", "gm", series.BANDS["gross_margin"])
    if {"operating_income", "depreciation"} <= set(df.columns):
        x = panel.annual_margin(x, F.col("operating_income") + F.col("depreciation"), "revenue", "em", series.BANDS["ebitda_margin"])
    medians = {f"b_{n}_persistence": f"b_{n}_group" for n in ("annual", "gm", "em") if f"b_{n}_persistence" in x.columns}
    return panel.group_median(x, {"b_persistence": "b_group"} | medians)


def market_block(x: DataFrame, daily: DataFrame, risk: DataFrame | None, short: int = 63, long: int = 126, least: int = 21) -> DataFrame:
    """x (entity, origin) with what the market showed the day before the origin, volatility and beta too, and valuations by the accounts as known then."""
    moves = market.momentum(daily, short, long, least)
    values = ["px", "ret_short", "ret_long", "drawdown"]
    if risk is not None:
        moves = moves.join(risk.select("entity", "date", "vol", "beta"), ["entity", "date"], "left")
        values += ["vol", "beta"]
    named = moves.select("entity", "date", *[F.col(v).alias(f"mkt_{v}") for v in values])
    x = market.market_at_origin(x, named, [f"mkt_{v}" for v in values]).drop("asof_date")
    return panel.valuation(x, "mkt_px", "asof_shares", "asof_ttm", "asof_debt", "asof_cash") if {f"asof_{c}" for c in AS_OF} <= set(x.columns) else x


def short_interest_block(x: DataFrame, short: DataFrame, **how) -> DataFrame:
    """x (entity, origin, asof_shares) with short positions (entity, date, short, days_to_cover) as known at the origin, their changes, and their share of the shares."""
    found = market.publication_lagged(x, short, "short", also=("days_to_cover",), **how).drop("asof_date")
    return found.withColumn("short_to_shares", g.ratio(F.col("short"), F.col("asof_shares"))) if "asof_shares" in x.columns else found


def build_panel(
    clean: DataFrame, groups: DataFrame, macro: tuple[DataFrame, list[str], list[str]] | None = None, matched: DataFrame | None = None, filings: DataFrame | None = None, daily: DataFrame | None = None,
    risk: DataFrame | None = None, industry: DataFrame | None = None, guidance: DataFrame | None = None, short: DataFrame | None = None, lag: int = 1, macro_lag: int = 1, ladder: tuple[int, ...] = (),
    winsor: tuple[float, float] = (0.01, 0.99), clipped: tuple[str, ...] = ("f_gross_margin", "f_operating_margin", "f_net_margin", "f_ebitda_margin", "f_turnover", "f_zscore", "f_jump", "mac_", "mkt_ps", "mkt_ev_sales", "mkt_ret_"),
    start: int | None = None, coverage: float = 0.6, market_rows: tuple[int, int, int] = (63, 126, 21),
) -> DataFrame:
    """One row per entity and target quarter: features known a quarter before (`lag`), targets and naive forecasts.

    clean: accounts on a gap-free grid with growth; groups: entity, grp (entities without
    one are dropped). Each further table is a block that is left out where it is None:
    macro (a calendar table, level and change columns), matched (grp, qi, own_yoy,
    own_qoq), filings (entity, qi, car, ...), daily prices and risk, industry (grp, qi, va,
    va_yoy, va_qoq), guidance (entity, date, event_id, action), short positions. Clipping
    to the sample's quantiles comes before rows are dropped, and never touches a target.
    Blocks that are found by date see the keys alone, and are joined to the rest.
    """
    x = targets(panel.attach_group(build_features(clean, lag).drop("grp"), groups))
    x = cut_lineage(panel.timing(panel.peers(x, "f_lag_yoy_1")))
    keys = x.select("entity", "qi", "origin", *[c for c in x.columns if c.startswith("asof_")])

    def joined(block: DataFrame) -> DataFrame:
        return x.join(block.drop("origin", *[c for c in keys.columns if c.startswith("asof_")]), ["entity", "qi"], "left")

    if macro is not None:
        x = panel.macro_join(x, panel.macro_features(macro[0], macro[1], macro[2], macro_lag, ladder))
    if matched is not None:
        x = x.join(matched, ["grp", "qi"], "left")
    if filings is not None:
        x = temporal.event_join(x, filings, "entity", ["car"], lag)
    if daily is not None:
        x = joined(market_block(keys, daily, risk, *market_rows))
    if industry is not None:
        x = x.join(industry, ["grp", "qi"], "left")
    if guidance is not None:
        x = joined(temporal.signed_event_features(keys.select("entity", "qi", "origin"), guidance))
    if short is not None:
        x = joined(short_interest_block(keys, short))
    x = panel.winsorize(cut_lineage(x), [c for c in x.columns if c.startswith(clipped)], *winsor)
    return panel.trim(x, start if start is not None else 0, coverage, clean.select("entity").distinct().count())


def purged_baselines(df: DataFrame, target: str, warmup: int, min_train: int, purge: int = 3) -> DataFrame:
    """Forecasts of a target of the year ahead (annual, gm, em) by its naive columns: training ends `purge` quarters earlier, as labels overlap."""
    names = [f"b_{target}_{k}" for k in ("persistence", "mean", "group") if f"b_{target}_{k}" in df.columns]
    return walk_forward_baselines(df, f"y_{target}", names, warmup, min_train, purge)
