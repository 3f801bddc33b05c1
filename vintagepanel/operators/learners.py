"""What fitted models find important: damage by permutation, for any of them, in one pass."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions.sizes import cut_lineage
from vintagepanel.operators import ridge

#: Rows of a cell within which columns are shuffled, about.
CELL_ROWS = 50_000


def linear_fitted(panel: DataFrame, y: str, features: list[str], before: int, penalty: float = 1.0, ratios: tuple[float, ...] | None = None, folds: int = 5, n_penalties: int = 40) -> Callable[[DataFrame], DataFrame]:
    """A function from tables with an array x of the features to the same with y_pred: a ridge, or with ratios a cross-validated elastic net, of the labelled rows of the quarters before `before`."""
    rows = panel.filter(F.col("qi") < before)
    cells = ridge._moments(rows, y, features, []).groupBy(F.pmod("qi", F.lit(folds)).cast("int").alias("fold"), "i", "j").agg(F.sum("v").alias("v")).collect()
    parts: dict[int, np.ndarray] = {}
    for c in cells:  # folds x columns squared: no row of the panel
        a = parts.setdefault(c["fold"], np.zeros((len(features) + 2,) * 2))
        a[c["i"], c["j"]] = a[c["j"], c["i"]] = c["v"]
    if not parts:
        beta = np.zeros(len(features) + 1)
    else:
        beta = ridge.best_net(parts, ratios, n_penalties)[0] if ratios else ridge._fit(sum(parts.values()), penalty)
    weights = F.array(*[F.lit(float(b)) for b in beta[1:]])
    dot = F.aggregate(F.zip_with("x", weights, lambda a, b: F.coalesce(a, F.lit(0.0)) * b), F.lit(float(beta[0])), lambda s, v: s + v)
    return lambda df: df.withColumn("y_pred", dot).drop("x")


def permutation_importance(panel: DataFrame, y: str, features: list[str], fitted: Callable[[DataFrame], DataFrame], split: int, repeats: int = 10, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """feature, damage (mean over the repeats), damage_std: rise of the error on labelled rows of quarters from `split` on when the feature is shuffled among them.

    fitted: from a table with an array x of the features to the same with y_pred. A row
    borrows the values of another row of its cell (rows dealt by a hash, so none is large),
    another one for each repeat; (feature, repeat) pairs are exploded beside the row and its
    lender, and one aggregation gives all errors: the plan does not grow with the features.
    """
    held = panel.filter(F.col(y).isNotNull() & (F.col("qi") >= split))
    n = held.count()
    x = F.array(*[F.col(f).cast("double") for f in features])
    row = F.xxhash64("entity", "qi")
    held = held.select(F.col(y).cast("double").alias("y"), x.alias("x"), F.pmod(row, F.lit(max(1, n // cell_rows))).alias("_cell"), row.alias("_key"))
    held = cut_lineage(held.withColumn("_at", F.row_number().over(Window.partitionBy("_cell").orderBy("_key"))))
    times = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    mixed = Window.partitionBy("_cell", "_k").orderBy(F.xxhash64("_key", "_k", F.lit(seed)), "_key")
    lenders = held.select("_cell", F.col("x").alias("_lent"), "_key", times.alias("_k")).withColumn("_at", F.row_number().over(mixed)).drop("_key")
    met = held.select("_cell", "_at", "y", "x", times.alias("_k")).join(lenders, ["_cell", "_k", "_at"])
    # feature -1 is the row as it is
    each = met.select("y", "x", "_lent", "_k", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("_f"))
    swapped = each.select("y", "_k", "_f", F.transform("x", lambda v, i: F.when(i == F.col("_f"), F.get("_lent", i)).otherwise(v)).alias("x"))
    off = F.col("y_pred") - F.col("y")
    errors = fitted(swapped).groupBy("_f", "_k").agg(F.sqrt(F.avg(off * off)).alias("rmse"))
    base = errors.filter("_f = -1").select("_k", F.col("rmse").alias("_base"))
    damage = errors.filter("_f >= 0").join(F.broadcast(base), "_k").withColumn("damage", F.col("rmse") - F.col("_base"))  # a row a repeat
    named = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_f") + 1)
    return damage.groupBy(named.alias("feature")).agg(F.avg("damage").alias("damage"), F.stddev_pop("damage").alias("damage_std"))
