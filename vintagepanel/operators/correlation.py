"""Correlations of growth with calendar series."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions import guarded as g
from vintagepanel.functions.order import group_quantiles


def group_correlation(df: DataFrame, y: str, series: list[str], by: str = "grp", least: int = 50) -> DataFrame:
    """Per group and series: correlation with y over the rows that have both, where there are more than `least`."""
    long = df.select(by, F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("x")) for s in series])).alias("s")).filter("y IS NOT NULL AND s.x IS NOT NULL")
    return long.groupBy(by, "s.series").agg(F.count("*").alias("n"), g.correlation(F.col("y"), F.col("s.x")).alias("corr")).filter(F.col("n") > least)


def median_correlation(df: DataFrame, y: str, series: list[str], by: str = "grp", least: int = 8) -> DataFrame:
    """The same of the group's median y a quarter, one row a quarter, so that a quarter counts once however many entities it has."""
    middle = group_quantiles(df.dropna(subset=[by, "qi"]), [by, "qi"], y, [0.5]).select(by, "qi", F.get("q", F.lit(0)).alias("_typical"))
    typical = df.groupBy(by, "qi").agg(*[F.max(s).alias(s) for s in series]).join(F.broadcast(middle), [by, "qi"])
    return group_correlation(typical, "_typical", series, by, least)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete correlations in one aggregation: a, b, corr."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[g.correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("m")).select("m.*")


def strongest(correlations: DataFrame, n: int = 15, keys: tuple[str, ...] = ("grp", "series")) -> DataFrame:
    """The n largest by absolute value."""
    return correlations.filter(F.col("corr").isNotNull()).orderBy(F.desc(F.round(F.abs("corr"), 9)), *keys).limit(n)


def strength_order(correlations: DataFrame, key: str) -> DataFrame:
    """Mean absolute correlation of each value of key, and its rank."""
    mean = correlations.groupBy(key).agg(F.avg(F.abs("corr")).alias("mean_abs"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("mean_abs", 9)), key)))
