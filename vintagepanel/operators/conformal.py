"""Conformal calibration of forecast bands over quarters."""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagepanel.functions.order import group_quantiles, past_order_statistics
from vintagepanel.functions.sizes import cut_lineage


def cqr_score(bands: DataFrame) -> DataFrame:
    """Adds score: how far the truth lies outside [q10, q90]; negative inside."""
    return bands.withColumn("score", F.greatest(F.col("q10") - F.col("y_true"), F.col("y_true") - F.col("q90")))


def conformal_quantile(scored: DataFrame, by: list[str] | None = None, alpha: float = 0.2, window: int | None = None) -> DataFrame:
    """Per quarter (and group of by): n_cal and q, the ceil((n+1)(1-alpha))-th smallest score of all earlier quarters, or of the last `window` observed ones; infinite if that is more than n, null without scores."""
    k = lambda n: F.ceil((n + 1) * (1 - alpha))
    found = past_order_statistics(scored, "score", lambda n: [k(n) - 1], by, window).filter("n > 0")
    return found.select(*(by or []), "qi", F.col("n").alias("n_cal"), F.when(k(F.col("n")) > F.col("n"), F.lit(math.inf)).otherwise(F.col("v")[0]).alias("q"))


def calibrate(bands: DataFrame, alpha: float = 0.2, min_cal: int = 150, window: int | None = None, by_group: bool = False) -> DataFrame:
    """bands with lo, hi, n_cal and q: widened by the quantile of past scores; left as they are with fewer than min_cal of these.

    by_group: a group's own quantile where it has a quarter of min_cal, else the global one.
    """
    scored = cqr_score(bands)
    whole = conformal_quantile(scored, None, alpha, window)
    out = scored.join(F.broadcast(whole), "qi", "left").withColumn("n_cal", F.coalesce("n_cal", F.lit(0)))
    q = F.when(F.col("n_cal") >= min_cal, F.col("q")).otherwise(0.0)
    if by_group:
        own = conformal_quantile(scored, ["grp"], alpha, window).select("qi", "grp", F.col("n_cal").alias("_n"), F.col("q").alias("_q"))
        out = out.join(F.broadcast(own), ["qi", "grp"], "left")
        q = F.when((F.col("n_cal") >= min_cal) & (F.coalesce("_n", F.lit(0)) >= min_cal // 4), F.col("_q")).otherwise(q)
        out = out.withColumn("q", q).drop("_n", "_q")
    else:
        out = out.withColumn("q", q)
    return out.withColumns({"lo": F.col("q10") - F.col("q"), "hi": F.col("q90") + F.col("q")}).drop("score")


@dataclass
class _Bin:
    """Scores in [low, high) counted by quarter; value where they are all one."""

    low: float
    high: float
    value: float | None
    counts: np.ndarray


class ScoreCounts:
    """Scores of all quarters as a histogram that is refined only where a rank is asked for.

    A bin in which a rank lies is read again: as distinct values where it has few rows, else
    by bins of its own quantiles, of which each quantile is a bin by itself, so that ties
    do not stand in the way. Only counts come to the driver.
    """

    def __init__(self, scored: DataFrame, bins: int = 1024, few: int = 20_000):
        self.rows = cut_lineage(scored.filter(F.col("score").isNotNull()).select("qi", F.col("score").cast("double").alias("score"))).persist()
        self.bins, self.few, self.jobs = bins, few, 1
        counted = sorted((r["qi"], r["count"]) for r in self.rows.groupBy("qi").count().collect())
        self.quarters = [q for q, _ in counted]
        self.nodes = [_Bin(-math.inf, math.inf, None, np.array([n for _, n in counted], np.int64))] if counted else []

    def _split(self, node: _Bin) -> list[_Bin]:
        own = self.rows if node.low == -math.inf else self.rows.filter(F.col("score") >= node.low)
        own = own if node.high == math.inf else own.filter(F.col("score") < node.high)
        place = {q: i for i, q in enumerate(self.quarters)}
        if node.counts.sum() <= self.few:
            found, starts = own.groupBy(F.col("score").alias("at"), "qi").count(), None
        else:
            edges = sorted(set(own.agg(F.percentile_approx("score", [i / self.bins for i in range(self.bins + 1)], 10 * self.bins)).first()[0]))
            self.jobs += 1
            starts = sorted({node.low, *edges, *(math.nextafter(e, math.inf) for e in edges)})
            starts = [x for x in starts if x < node.high]
            at = Bucketizer(splits=[*starts, math.inf], inputCol="score", outputCol="at").transform(own)
            found = at.groupBy(F.col("at").cast("int").alias("at"), "qi").count()
        cells: dict = {}
        for r in found.collect():
            cells.setdefault(r["at"], np.zeros(len(self.quarters), np.int64))[place[r["qi"]]] = r["count"]
        self.jobs += 1
        if starts is None:
            return [_Bin(x, math.nextafter(x, math.inf), x, cells[x]) for x in sorted(cells)]
        ends = [*starts[1:], node.high]
        return [_Bin(starts[i], ends[i], starts[i] if ends[i] == math.nextafter(starts[i], math.inf) else None, cells[i]) for i in sorted(cells)]

    def kth(self, k: int, before: int) -> int:
        """The place of the bin, of one value, that holds the k-th smallest score (from 1) of the first `before` quarters."""
        while True:
            below = 0
            for i, node in enumerate(self.nodes):
                below += int(node.counts[:before].sum())
                if below >= k:
                    break
            if node.value is not None:
                return i
            self.nodes[i : i + 1] = self._split(node)

    def above(self, place: int, quarter: int) -> int:
        """How many scores of a quarter are greater than those of the bin at place."""
        return int(sum(node.counts[quarter] for node in self.nodes[place + 1 :]))


def aci_schedule(bands: DataFrame, alpha: float = 0.2, gamma: float = 0.02, min_cal: int = 150, low: float = 0.01, high: float = 0.60, bins: int = 1024, few: int = 20_000) -> DataFrame:
    """Adaptive levels over quarters: qi, n_cal, q, alpha_used.

    The level of a quarter follows from the share of misses in the one before, so quarters
    are taken in turn, over counts of the scores by quarter and bin: no quarter needs a job
    but where its rank lies in a bin that was not read before. Null scores do not count.
    """
    counts = ScoreCounts(cqr_score(bands), bins, few)
    rows, level, n = [], alpha, 0
    here = sum(node.counts for node in counts.nodes) if counts.nodes else np.zeros(0, np.int64)
    for i, now in enumerate(counts.quarters):
        q, used = 0.0, level
        if n >= min_cal:
            k = math.ceil((n + 1) * (1 - level))
            if k > n:
                q, missed = math.inf, 0.0
            else:  # the k-th smallest
                at = counts.kth(k, i)
                q, missed = counts.nodes[at].value, counts.above(at, i) / int(here[i])
            level = min(high, max(low, level + gamma * (alpha - missed)))
        rows.append((now, n, q, used))
        n += int(here[i])
    counts.rows.unpersist()
    return bands.sparkSession.createDataFrame(rows, "qi long, n_cal long, q double, alpha_used double")


def calibrate_adaptive(bands: DataFrame, alpha: float = 0.2, gamma: float = 0.02, min_cal: int = 150) -> DataFrame:
    """bands with lo, hi, n_cal and q of the adaptive schedule."""
    found = aci_schedule(bands, alpha, gamma, min_cal).drop("alpha_used")
    return bands.join(F.broadcast(found), "qi").withColumns({"lo": F.col("q10") - F.col("q"), "hi": F.col("q90") + F.col("q")})


def schedule(calibrated: DataFrame) -> DataFrame:
    """n_cal and mean q of each quarter of calibrated bands."""
    return calibrated.groupBy("qi").agg(F.max("n_cal").alias("n_cal"), F.avg("q").alias("mean_q"))


def winkler(y: Column, lo: Column, hi: Column, alpha: float) -> Column:
    return (hi - lo) + (2 / alpha) * (F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0)))


def interval_report(calibrated: DataFrame, alpha: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """Coverage, widths, Winkler score, and the worst and the deviation of quarterly coverage."""
    by = by or []
    y, lo, hi = F.col("y_true"), F.col("lo"), F.col("hi")
    x = calibrated.withColumns({"_hit": ((y >= lo) & (y <= hi)).cast("double"), "_w": hi - lo, "_s": winkler(y, lo, hi, alpha)})
    whole = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_hit").alias("coverage"), F.avg("_w").alias("mean_width"), F.avg("_s").alias("winkler"))
    middle = group_quantiles(x, by, "_w", [0.5]).select(*by, F.get("q", F.lit(0)).alias("median_width"))
    each = x.groupBy(*by, "qi").agg(F.avg("_hit").alias("_c")).groupBy(*by).agg(F.min("_c").alias("worst_quarter"), F.stddev_samp("_c").alias("coverage_std"))
    each = each.join(middle, by) if by else each.crossJoin(F.broadcast(middle))  # a row each
    out = whole.join(each, by) if by else whole.crossJoin(F.broadcast(each))
    return out.withColumn("target", F.lit(1 - alpha))


def group_coverage(calibrated: DataFrame, methods: list[str]) -> DataFrame:
    """Coverage by group, one column a method."""
    hit = ((F.col("y_true") >= F.col("lo")) & (F.col("y_true") <= F.col("hi"))).cast("double")
    return calibrated.groupBy("grp").pivot("method", methods).agg(F.avg(hit))
