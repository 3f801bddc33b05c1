"""Building universes: mapping labels, eligibility, stratified draws and swaps for coverage."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions.sizes import small


def map_labels(df: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """df with grp, the canonical name of its label (mapping: label, grp); unmapped rows are dropped."""
    return df.join(small(mapping.select(F.col("label").alias(label), "grp")), label)


def eligible(candidates: DataFrame, excluded: DataFrame, known: DataFrame, key: str = "entity") -> DataFrame:
    """Distinct candidates that are known and not excluded."""
    return candidates.join(excluded.select(key), key, "left_anti").join(known.select(key), key, "left_semi").dropDuplicates([key])


def stratified(df: DataFrame, n: int, backups: int, order: str, group: str = "grp", key: str = "entity") -> DataFrame:
    """In each group the first n by the hash column `order` are selected, the next are backups; role says which."""
    w = Window.partitionBy(group).orderBy(order, key)
    ranked = df.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n + backups)
    return ranked.withColumn("role", F.when(F.col("draw") <= n, "selected").otherwise("backup"))


def coverage_swap(drawn: DataFrame, labelled: DataFrame, least: int, group: str = "grp", key: str = "entity") -> DataFrame:
    """The i-th selected entity with too few labelled rows (labelled: key, n) gives way to the i-th backup of its group."""
    rows = drawn.join(labelled, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    weak = (F.col("role") == "selected") & (F.col("n") < least)
    kind = F.when(weak, "weak").when((F.col("role") == "backup") & (F.col("n") >= least), "spare").otherwise("rest")
    w = Window.partitionBy(group, "_kind").orderBy("draw")
    ranked = rows.withColumn("_kind", kind).withColumn("_i", F.row_number().over(w))
    totals = Window.partitionBy(group)
    swaps = F.least(F.sum((F.col("_kind") == "weak").cast("int")).over(totals), F.sum((F.col("_kind") == "spare").cast("int")).over(totals))
    swapped = ranked.withColumn("_swaps", swaps)
    moved = F.col("_i") <= F.col("_swaps")
    role = F.when((F.col("_kind") == "weak") & moved, "dropped").when((F.col("_kind") == "spare") & moved, "selected").otherwise(F.col("role"))
    return swapped.withColumn("role", role).drop("_kind", "_i", "_swaps")


def members(holdings: DataFrame, screener: DataFrame, key: str = "entity") -> DataFrame:
    """Holdings that the screener has, with its columns, once each."""
    return holdings.select(key).join(screener, key).dropDuplicates([key])
