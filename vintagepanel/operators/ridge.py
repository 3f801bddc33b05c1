"""Walk-forward linear models from sufficient statistics: ridge, elastic net and lasso.

The cross-product matrix of each quarter is aggregated once; running sums over quarters
give every training set's matrix, so a test quarter needs one small solve and no second
look at the training rows. The moments of all columns hold those of every subset of them,
so any number of configurations (sets of columns) is fitted from one pass, and those of a
fold give its squared error under any coefficients, so penalties are chosen without rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _moments(panel: DataFrame, y: str, features: list[str], by: list[str]) -> DataFrame:
    """Per quarter the entries (i, j) of the upper triangle of z'z, with z = (1, features, y); nulls count as 0 after centring by the caller."""
    z = F.array(F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], F.col(y).cast("double"))
    n = len(features) + 2
    # lambdas over the bound array, not one expression per entry: the generated code stays small however many features there are
    row = lambda a, i: F.transform(F.sequence(i, F.lit(n - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get(a, i) * F.get(a, j)).alias("v")))
    cells = F.explode(F.flatten(F.flatten(F.transform(F.array(z), lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: row(a, i))))))
    return panel.filter(F.col(y).isNotNull()).select(*by, "qi", cells.alias("c")).groupBy(*by, "qi", "c.i", "c.j").agg(F.sum("c.v").alias("v"))


def _fit(a: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and slopes from a moment matrix of z = (1, features, y): features standardised, the intercept not penalised."""
    count = a[0, 0]
    mean = a[0, 1:-1] / count
    sd = np.sqrt(np.maximum(np.diag(a)[1:-1] / count - mean**2, 0))
    sd[sd < 1e-12] = np.inf
    gram = (a[1:-1, 1:-1] - count * np.outer(mean, mean)) / np.outer(sd, sd)
    target = (a[1:-1, -1] - mean * a[0, -1]) / sd
    slope = np.linalg.solve(gram + penalty * np.eye(len(mean)), target) / sd
    return np.concatenate([[a[0, -1] / count - slope @ mean], slope])


def _best_penalty(folds: dict[int, np.ndarray], penalties: tuple[float, ...]) -> float:
    """The penalty with the least squared error over the folds, each forecast by the others; the errors follow from the moments of the fold."""
    whole = sum(folds.values())
    loss = dict.fromkeys(penalties, 0.0)
    for a in folds.values():
        rest = whole - a
        if a[0, 0] < 1 or rest[0, 0] < 2:
            continue
        for p in penalties:
            b = np.append(_fit(rest, p), -1.0)
            loss[p] += float(b @ a @ b)
    return min(penalties, key=lambda p: (loss[p], p))


def _standardised(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Correlations of the features, their covariances with the target, means and deviations (infinite where a feature does not vary)."""
    count, mean = a[0, 0], a[0, 1:-1] / a[0, 0]
    sd = np.sqrt(np.maximum(np.diag(a)[1:-1] / count - mean**2, 0))
    sd[sd < 1e-12] = np.inf
    return (a[1:-1, 1:-1] / count - np.outer(mean, mean)) / np.outer(sd, sd), (a[1:-1, -1] / count - mean * a[0, -1] / count) / sd, mean, sd


def net_penalties(a: np.ndarray, ratio: float, n: int) -> np.ndarray:
    """n penalties, from the least that sets all slopes to 0 to a thousandth of it, in equal steps of the logarithm."""
    top = float(np.abs(_standardised(a)[1]).max(initial=0.0)) / ratio
    return np.geomspace(max(top, 1e-12), max(top, 1e-12) * 1e-3, n)


def net_path(a: np.ndarray, ratio: float, penalties: np.ndarray, sweeps: int = 1000) -> list[np.ndarray]:
    """Intercept and slopes at each penalty (largest first), by coordinate descent on the moments.

    Least of (squared error / 2n + penalty (ratio |b| + (1 - ratio) b'b / 2)), features
    standardised; a ratio of 1 is the lasso. Each penalty starts from the one before.
    """
    c, target, mean, sd = _standardised(a)
    b, out = np.zeros(len(target)), []
    live = np.flatnonzero(np.isfinite(sd))
    near = 1e-10 * max(float(np.abs(target).max(initial=0.0)), 1e-300)
    for p in penalties:
        for _ in range(sweeps):
            most = 0.0
            for j in live:
                r = target[j] - c[j] @ b + c[j, j] * b[j]
                new = np.sign(r) * max(abs(r) - p * ratio, 0.0) / (c[j, j] + p * (1 - ratio))
                most = max(most, abs(new - b[j]))
                b[j] = new
            if most <= near:
                break
        slope = b / sd
        out.append(np.concatenate([[a[0, -1] / a[0, 0] - slope @ mean], slope]))
    return out


def best_net(folds: dict[int, np.ndarray], ratios: tuple[float, ...], n: int) -> tuple[np.ndarray, float, float]:
    """Coefficients, penalty and ratio of the elastic net that forecasts each fold best from the others; of equal ones the larger penalty and ratio."""
    whole, best = sum(folds.values()), None
    for ratio in sorted(ratios, reverse=True):
        penalties = net_penalties(whole, ratio, n)
        loss = np.zeros(n)
        for a in folds.values():
            rest = whole - a
            if a[0, 0] >= 1 and rest[0, 0] >= 2:
                loss += [float(z @ a @ z) for z in (np.append(b, -1.0) for b in net_path(rest, ratio, penalties))]
        i = int(np.argmin(loss))
        if best is None or loss[i] < best[0]:
            best = (loss[i], ratio, penalties[: i + 1])
    _, ratio, penalties = best
    return net_path(whole, ratio, penalties)[-1], float(penalties[-1]), ratio


def coefficients(
    panel: DataFrame, y: str, features: list[str], penalty: float = 1.0, warmup: int = 8, min_train: int = 100, purge: int = 0, by: list[str] | None = None,
    penalties: tuple[float, ...] | None = None, folds: int = 5, sets: dict[str, list[str]] | None = None, ratios: tuple[float, ...] | None = None, n_penalties: int = 40,
) -> DataFrame:
    """qi, beta (intercept first), n_train, penalty for every qualifying test quarter (and group of `by`).

    Features are standardised by the training rows; a null feature counts as 0. The
    penalty does not touch the intercept. penalties: of these, the one that does best in
    cross-validation over the training quarters, dealt to folds in turn. ratios: an elastic
    net instead of a ridge, its ratio and penalty chosen so from these and a path of
    n_penalties (column ratio is added). sets: a fit for each of these subsets of the
    features, under its name in column model, with 0 for the features that it leaves out.
    """
    by = by or []
    past = Window.partitionBy(*by, "fold", "i", "j").orderBy("qi").rangeBetween(Window.unboundedPreceding, -1 - purge)
    moments = _moments(panel, y, features, by)
    order = panel.filter(F.col(y).isNotNull()).select("qi").distinct().withColumn("nth", F.row_number().over(Window.orderBy("qi")))
    # every fold must have a row in every quarter for its running sum: rows of 0 stand in
    n_folds = folds if penalties or ratios else 1
    dealt = moments.withColumn("fold", F.pmod("qi", F.lit(n_folds)).cast("int"))
    if n_folds > 1:
        others = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
        dealt = dealt.unionByName(moments.withColumn("fold", others).filter(F.col("fold") != F.pmod("qi", F.lit(n_folds))).withColumn("v", F.lit(0.0)))
    summed = dealt.withColumn("v", F.sum("v").over(past)).filter("v IS NOT NULL")
    matrices = summed.groupBy(*by, "qi").agg(F.sort_array(F.collect_list(F.struct("fold", "i", "j", "v"))).alias("m")).join(F.broadcast(order), "qi").filter(F.col("nth") > warmup).drop("nth")
    if ratios:  # a row is little data and long work
        matrices = matrices.repartition(4 * panel.sparkSession.sparkContext.defaultParallelism, *by, "qi")
    n = len(features) + 2
    places = {name: [0, *(1 + features.index(c) for c in columns), n - 1] for name, columns in (sets or {"": features}).items()}

    def solve(frames):
        for pdf in frames:
            rows = []
            for keys, cells in zip(pdf.drop(columns="m").itertuples(index=False), pdf["m"], strict=True):
                parts: dict[int, np.ndarray] = {}
                for c in cells:
                    a = parts.setdefault(c["fold"], np.zeros((n, n)))
                    a[c["i"], c["j"]] = a[c["j"], c["i"]] = c["v"]
                if sum(parts.values())[0, 0] < min_train:
                    continue
                for name, at in places.items():
                    own = {f: a[np.ix_(at, at)] for f, a in parts.items()}
                    whole, ratio = sum(own.values()), None
                    if ratios:
                        found, chosen, ratio = best_net(own, ratios, n_penalties)
                    else:
                        chosen = _best_penalty(own, penalties) if penalties else penalty
                        found = _fit(whole, chosen)
                    beta = np.zeros(n - 1)
                    beta[at[:-1]] = found
                    rows.append((*keys, *([name] if sets else []), beta.tolist(), int(whole[0, 0]), float(chosen), *([ratio] if ratios else [])))
            yield pd.DataFrame(rows, columns=[*pdf.columns.drop("m"), *(["model"] if sets else []), "beta", "n_train", "penalty", *(["ratio"] if ratios else [])])

    kinds = {f.name: f.dataType.simpleString() for f in matrices.schema.fields}
    schema = [*(f"`{c}` {kinds[c]}" for c in matrices.columns if c != "m"), *(["model string"] if sets else []), "beta array<double>, n_train long, penalty double", *(["ratio double"] if ratios else [])]
    return matrices.mapInPandas(solve, ", ".join(schema))


def walk_forward(panel: DataFrame, y: str, features: list[str], name: str = "ridge", by: list[str] | None = None, sets: dict[str, list[str]] | None = None, **options) -> DataFrame:
    """Forecasts (model, entity, grp, qi, y_true, y_pred) of the qualifying test quarters; with by, a separate fit per group, whose keys come first; with sets, a model per set of features."""
    by = by or []
    beta = coefficients(panel, y, features, by=by, sets=sets, **options)
    x = F.array(F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    joined = panel.filter(F.col(y).isNotNull()).join(F.broadcast(beta), [*by, "qi"])
    p = F.aggregate(F.zip_with(x, "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    keys = [b for b in by if b not in ("entity", "grp", "qi")]
    return joined.select(*keys, F.col("model") if sets else F.lit(name).alias("model"), "entity", "grp", "qi", F.col(y).alias("y_true"), p.alias("y_pred"))


def shock_lasso(shocks: DataFrame, series: DataFrame, columns: list[str], folds: int = 5, n_penalties: int = 40) -> DataFrame:
    """Cross-validated lasso of quarterly shocks (qi, shock) on calendar series (qi, columns): feature, coefficient (per deviation of the feature), penalty, r2.

    Columns without a value in some quarter are left out. Quarters are dealt to folds in
    turn; their moments are one aggregation, which is all that comes to the driver.
    """
    spark = shocks.sparkSession
    x = shocks.filter("shock IS NOT NULL").join(series.select("qi", *columns), "qi")
    schema = "feature string, coefficient double, penalty double, r2 double"
    found = x.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    whole = [c for c in columns if found[c] == found["n"]]
    if not found["n"] or not whole:
        return spark.createDataFrame([], schema)
    cells = _moments(x, "shock", whole, []).groupBy(F.pmod("qi", F.lit(folds)).cast("int").alias("fold"), "i", "j").agg(F.sum("v").alias("v")).collect()
    parts: dict[int, np.ndarray] = {}
    for c in cells:
        a = parts.setdefault(c["fold"], np.zeros((len(whole) + 2,) * 2))
        a[c["i"], c["j"]] = a[c["j"], c["i"]] = c["v"]
    beta, penalty, _ = best_net(parts, (1.0,), n_penalties)
    a, z = sum(parts.values()), np.append(beta, -1.0)
    spread = a[-1, -1] - a[0, -1] ** 2 / a[0, 0]
    sd = _standardised(a)[3]
    r2 = float(1 - z @ a @ z / spread) if spread > 0 else None
    return spark.createDataFrame([(c, float(b * s) if np.isfinite(s) else 0.0, penalty, r2) for c, b, s in zip(whole, beta[1:], sd, strict=True)], schema)
