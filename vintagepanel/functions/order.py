"""Exact quantiles and order statistics without one task that holds a whole group.

A first pass finds, from approximate quantiles or a histogram, in which narrow range the
wanted rank lies; a second counts the values of that range alone.
"""

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions.sizes import cut_lineage

#: Accuracy of the approximate quantiles, and how far to either side of them (a share of the rows) the exact pass looks.
_ACCURACY, _SLACK = 10_000, 3e-4
#: Groups of up to this many rows are counted whole.
_WHOLE = 20_000


def group_quantiles(df: DataFrame, by: list[str], x: str, levels: list[float]) -> DataFrame:
    """by, n, q: for each group of by the interpolated quantiles of x at the levels, nulls left out; like percentile(), but exact at any size with bounded buffers.

    by may be empty: one group. The table of groups is small (models, quarters) and broadcast.
    """
    keys = by or ["_all"]
    rows = cut_lineage(df.filter(F.col(x).isNotNull()).select(*[F.col(c) for c in by], *([] if by else [F.lit(0).alias("_all")]), F.col(x).cast("double").alias("x")))
    ends = [min(max(p + s, 0.0), 1.0) for p in levels for s in (-_SLACK, _SLACK)]
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("x", ends, _ACCURACY).alias("e"))
    far = F.col("n") <= _WHOLE
    bounds = [F.struct(F.lit(i).alias("i"), F.when(far | F.lit(p <= _SLACK), F.lit(float("-inf"))).otherwise(F.col("e")[2 * i]).alias("a"), F.when(far | F.lit(p >= 1 - _SLACK), F.lit(float("inf"))).otherwise(F.col("e")[2 * i + 1]).alias("b"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(levels)]
    wanted = first.select(*keys, "n", F.array(*bounds).alias("w"))
    met = rows.join(F.broadcast(wanted), keys)
    below = met.groupBy(*keys).agg(*[F.count_if(F.col("x") < F.col("w")[i]["a"]).alias(f"_b{i}") for i in range(len(levels))])
    inside = met.select(*keys, "x", F.explode(F.filter("w", lambda w: (F.col("x") >= w["a"]) & (F.col("x") <= w["b"]))).alias("w"))
    counted = inside.groupBy(*keys, "w.i", "w.at", "x").agg(F.count("*").alias("c"))
    offset = F.element_at(F.array(*[F.col(f"_b{i}") for i in range(len(levels))]), F.col("i") + 1)
    cum = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("x")) + offset
    placed = counted.join(F.broadcast(below), keys).withColumn("cum", cum)
    low, high = (F.min(F.when(F.col("cum") > r, F.col("x"))) for r in (F.floor("at"), F.ceil("at")))
    one = placed.groupBy(*keys, "i", "at").agg(low.alias("lo"), high.alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    out = one.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("q"))
    return first.select(*keys, "n").join(out, keys).select(*by, "n", "q")


def past_order_statistics(rows: DataFrame, x: str, ranks: Callable[[Column], list[Column]], by: list[str] | None = None, window: int | None = None, bins: int = 1024) -> DataFrame:
    """by, qi, n, v: for each quarter the number of values of x in earlier quarters (or in the last `window` observed ones), and those of the given ranks (from 0).

    ranks: from n to the wanted ranks; a null rank, or one that is not below n, gives null.
    Rows are counted by quarter and bin of a common histogram; running sums of these say
    in which bin a rank lies, and only the rows of that bin are looked at again, instead of
    all past rows for every quarter. The quarters are a calendar and come to the driver.
    """
    by = by or []
    read = cut_lineage(rows.select(*by, "qi", F.col(x).cast("double").alias("x")))
    values = read.filter("x IS NOT NULL")
    quarters = sorted(r["qi"] for r in read.select("qi").distinct().collect())
    edges = values.agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], _ACCURACY)).first()[0] or []
    splits = [float("-inf"), *sorted(set(edges)), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="x", outputCol="bin").transform(values).withColumn("bin", F.col("bin").cast("int"))
    number = F.create_map(*[F.lit(z) for i, q in enumerate(quarters) for z in (q, i)]) if quarters else F.lit(None).cast("map<bigint,int>")
    binned = binned.withColumn("r", number[F.col("qi")])
    counts = binned.groupBy(*by, "bin", "r").agg(F.count("*").alias("c"))
    grid = counts.select(*by, "bin").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(max(len(quarters) - 1, 0)))))
    w = Window.partitionBy(*by, "bin").orderBy("r").rowsBetween(Window.unboundedPreceding if window is None else -window, -1)
    past = grid.join(counts, [*by, "bin", "r"], "left").withColumn("c", F.coalesce(F.sum("c").over(w), F.lit(0)))
    of = Window.partitionBy(*by, "r")
    summed = past.withColumns({"n": F.sum("c").over(of), "end": F.sum("c").over(of.orderBy("bin"))})
    wanted = summed.select("*", F.posexplode(F.array(*[k.cast("long") for k in ranks(F.col("n"))])).alias("j", "rank"))
    at = wanted.filter((F.col("rank") >= F.col("end") - F.col("c")) & (F.col("rank") < F.col("end"))).select(*by, F.col("r").alias("t"), "bin", "j", (F.col("rank") - F.col("end") + F.col("c")).alias("rest"))
    near = binned.join(at, [*by, "bin"]).filter(F.col("r") < F.col("t"))
    near = near if window is None else near.filter(F.col("r") >= F.col("t") - window)
    each = near.groupBy(*by, "t", "j", "rest", "x").agg(F.count("*").alias("c"))
    cum = F.sum("c").over(Window.partitionBy(*by, "t", "j").orderBy("x"))
    found = each.withColumn("cum", cum).groupBy(*by, "t", "j").agg(F.min(F.when(F.col("cum") > F.col("rest"), F.col("x"))).alias("v"))
    many = len(ranks(F.lit(0)))
    side = found.groupBy(*by, F.col("t").alias("r")).agg(*[F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"_v{j}") for j in range(many)])
    name = F.element_at(F.array(*[F.lit(q) for q in quarters]), F.col("r") + 1) if quarters else F.lit(None)
    whole = summed.groupBy(*by, "r").agg(F.first("n").alias("n"))
    return whole.join(side, [*by, "r"], "left").select(*by, name.cast("long").alias("qi"), "n", F.array(*[F.col(f"_v{j}") for j in range(many)]).alias("v"))
