"""Reconciliation of restated facts: one value per concept and period, missing quarters derived, wide rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMS = ["10-Q", "10-K", "10-Q/A", "10-K/A"]


def classify(facts: DataFrame) -> DataFrame:
    """Facts of the accepted forms with kind: instant (no start), quarterly (60-100 days), annual (330-380 days); others are dropped."""
    days = F.datediff("end", "start")
    kind = F.when(F.col("start").isNull(), "instant").when(days.between(60, 100), "quarterly").when(days.between(330, 380), "annual")
    return facts.filter(F.col("form").isin(FORMS)).withColumn("kind", kind).filter("kind IS NOT NULL")


def one_per_period(facts: DataFrame, keys: tuple[str, ...] = ("entity", "concept", "end"), first_reported: bool = False, ties: tuple[str, ...] = ("tag",), over_all: dict[str, Column] | None = None, by: tuple[str, ...] = ("entity", "end")) -> DataFrame:
    """The row of the best tag (lowest prio) of each period; of these the latest filed, or the earliest. over_all: aggregates of all rows of the period, as further columns.

    Rows are dealt out by those keys that `by` names before anything is sorted: a task sorts
    a share of the rows, not all that it read, and the concepts of a filing stay side by side.
    """
    filed = F.col("filed").asc() if first_reported else F.col("filed").desc()
    w, whole = Window.partitionBy(*keys).orderBy("prio", filed, *ties), Window.partitionBy(*keys)
    dealt = facts.repartition(*[k for k in keys if k in by] or keys)
    ranked = dealt.withColumn("_n", F.row_number().over(w)).withColumns({n: a.over(whole) for n, a in (over_all or {}).items()})
    return ranked.filter("_n = 1").drop("_n")


def derive_last_quarter(quarters: DataFrame, years: DataFrame, slack: int = 8, margin: int = 20) -> DataFrame:
    """Fourth quarters: a year less the three quarters it contains by date, where none is reported with the year's end.

    quarters, years: entity, concept, start, end, val. A quarter belongs to a year if it
    starts no more than `slack` days before it, ends no more than that after it, and ends
    more than `margin` days before its end; there must be exactly three ends.
    """
    a, b = years.alias("y"), quarters.alias("q")
    inside = (F.col("q.start") >= F.date_sub("y.start", slack)) & (F.col("q.end") <= F.date_add("y.end", slack)) & (F.col("q.end") < F.date_sub("y.end", margin))
    same = (F.col("q.entity") == F.col("y.entity")) & (F.col("q.concept") == F.col("y.concept"))
    found = a.join(b, same & inside).groupBy("y.entity", "y.concept", F.col("y.end").alias("end"), F.col("y.val").alias("whole")).agg(F.countDistinct("q.end").alias("n"), F.count("*").alias("m"), F.sum("q.val").alias("three"), F.max("q.end").alias("last"))
    rest = found.filter("n = 3 AND m = 3").select("entity", "concept", F.date_add("last", 1).alias("start"), "end", (F.col("whole") - F.col("three")).alias("val"))
    return rest.join(quarters.select("entity", "concept", "end"), ["entity", "concept", "end"], "left_anti")


def pivot_wide(facts: DataFrame, concepts: list[str], ties: tuple[str, ...] = ("tag",)) -> DataFrame:
    """One row per entity and end: the last filed value of each concept of a fixed list, the latest filing, and the tag of the first concept."""
    order = F.struct("filed", *ties)
    one = [F.max_by(F.when(F.col("concept") == c, F.col("val")), F.when((F.col("concept") == c) & F.col("val").isNotNull(), order)).alias(c) for c in concepts]
    tag = F.max_by("tag", F.when(F.col("concept") == concepts[0], order)).alias(f"{concepts[0]}_tag")
    return facts.groupBy("entity", "end").agg(*one, F.max("filed").alias("filed"), tag)


def with_source(wide: DataFrame, concept: str, parts: tuple[str, str] | None = None) -> DataFrame:
    """Adds <concept>_source: direct:<tag>, proxy where both parts stand in for a missing value, or missing."""
    tag = F.col(f"{concept}_tag")
    out = wide.withColumn(f"{concept}_source", F.when(F.col(concept).isNull(), "missing").otherwise(F.concat(F.lit("direct:"), tag)))
    if parts:
        total = F.col(parts[0]) + F.col(parts[1])
        use = F.col(concept).isNull() & total.isNotNull()
        out = out.withColumns({f"{concept}_source": F.when(use, f"proxy:{parts[0]}+{parts[1]}").otherwise(F.col(f"{concept}_source")), concept: F.when(use, total).otherwise(F.col(concept))})
    return out


def fiscal_order() -> Column:
    """fy and fp of a fact behind their rank: Q1 to Q4 before FY before others."""
    rank = F.when(F.col("fp") == "FY", 5).when(F.col("fp").rlike("^Q[1-4]$"), F.substring("fp", 2, 1).cast("int")).otherwise(6)
    return F.struct(rank.alias("o"), "fy", "fp")


def fiscal_label(facts: DataFrame, order: Column | None = None) -> DataFrame:
    """One fiscal year and period per entity and end: the first in fiscal_order, or in `order`, which then holds what was found of several facts."""
    best = F.min(fiscal_order() if order is None else order)
    return facts.groupBy("entity", "end").agg(best.alias("b")).select("entity", "end", "b.fy", "b.fp")
