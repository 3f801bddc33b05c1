"""Window aggregates that stay null until enough values are present, and safe arithmetic.

Spark's aggregates skip nulls; a statistic over four quarters of which one is missing is
not the same statistic. Each function here states how many values it needs.
"""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(entity: str = "entity", time: str = "qi") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(time)


def guarded(aggregate: Column, x: Column, window: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(window) >= least, aggregate.over(window))


def trailing(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end lag rows before this one."""
    return w.rowsBetween(-lag - n + 1, -lag)


def expanding(w: WindowSpec, lag: int = 0) -> WindowSpec:
    """All rows up to lag rows before this one."""
    return w.rowsBetween(Window.unboundedPreceding, -lag)


def rolling_mean(x: Column, w: WindowSpec, n: int, least: int, lag: int = 0) -> Column:
    return guarded(F.avg(x), x, trailing(w, n, lag), least)


def rolling_std(x: Column, w: WindowSpec, n: int, least: int, lag: int = 0) -> Column:
    """Sample standard deviation; it needs two values in any case."""
    return guarded(F.stddev_samp(x), x, trailing(w, n, lag), max(2, least))


def rolling_sum(x: Column, w: WindowSpec, n: int, least: int | None = None, lag: int = 0) -> Column:
    return guarded(F.sum(x), x, trailing(w, n, lag), least or n)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def growth(x: Column, w: WindowSpec, k: int) -> Column:
    """Change against k rows before, as a share of it."""
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def between_open(x: Column, low: float, high: float) -> Column:
    """x strictly inside (low, high), else null: out-of-range values are blanked, not clipped."""
    return F.when((x > low) & (x < high), x)


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def correlation(a: Column, b: Column) -> Column:
    """Correlation over the rows that have both, as an aggregate; null where one of them does not vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
