"""Comparisons and models across units."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import median
from ..functions.quantiles import pooled_quantiles


def sign_agreement(ranks: DataFrame, value: str = "spearman") -> DataFrame:
    """Per driver: how many units agree on the direction, and the range of the correlation."""
    sign = F.signum(value)
    return ranks.where(F.col(value).isNotNull()).groupBy("driver").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(sign > 0).alias("positive"),
        F.count_if(sign < 0).alias("negative"),
        (F.count_distinct(sign) == 1).alias("agree"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def unit_outliers(table: DataFrame, value: str = "length_days", limit: float = 2.0) -> DataFrame:
    """Units whose median lies far from the other units' medians, by z-score."""
    med = table.groupBy("unit").agg(F.count(value).alias("runs"), median(value).alias("median"))
    stats = med.agg(F.avg("median"), F.stddev_samp("median"))
    mean, std = (stats.select(c).scalar() for c in stats.columns)
    z = F.try_divide(F.col("median") - mean, std)
    return med.withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > limit, F.lit(False)))


def pooled_by_age(features: DataFrame, value: str = "dd_abs_max", width_days: float = 1.0) -> DataFrame:
    """Quartiles of a value by run age over all units' cycles."""
    rows = features.where(F.col("run_id").isNotNull() & F.col("cracking")).select(
        F.floor(F.col("run_age_days") / F.lit(float(width_days))).cast("int").alias("age_bin"), F.col(value)
    )
    return pooled_quantiles(rows, ["age_bin"], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


FORECAST_DRIVERS = ("run_age_days", "cot0", "steam_hc0", "feed_C5p0")


def forecast_rows(features: DataFrame, target: str = "dd_abs_max", start_days: float = 1.0) -> DataFrame:
    """Training rows: drift and run age with the drivers as they were at the start of the run."""
    rows = features.where(F.col("run_id").isNotNull() & F.col("cracking"))
    begin = F.col("run_age_days") <= F.lit(float(start_days))
    drivers = ("cot", "steam_hc", "feed_C5p")
    at_start = rows.groupBy("unit", "run_id").agg(
        *[F.avg(F.when(begin, F.col(c))).alias(f"{c}0") for c in drivers]
    )
    return (
        rows.select("unit", "run_id", "ts", "run_age_days", F.col(target).alias("label"))
        .join(at_start, ["unit", "run_id"])
        .dropna()
    )


def hold_out(rows: DataFrame, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Whole runs are held out, picked by a digest of their key."""
    key = F.concat_ws(":", "unit", F.col("run_id").cast("string"))
    part = F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long") % every
    return rows.where(part != 0), rows.where(part == 0)


def gram(rows: DataFrame, drivers=FORECAST_DRIVERS, by=("unit",)) -> DataFrame:
    """One row per key: number of rows, means and sums of centred products of the drivers and the label.

    Rows of different keys, days or loads can be merged (``merged_gram``), so a fit never needs the training rows again.
    """
    names = [*drivers, "label"]
    n = F.count(F.lit(1))
    means = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)]
    products = [(F.covar_pop(a, b) * n).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return rows.groupBy(*by).agg(n.alias("n"), *means, *products)


def merged_gram(grams: DataFrame, size: int = len(FORECAST_DRIVERS) + 1) -> DataFrame:
    """The Gram row of all rows together."""
    n = F.sum("n")
    mean = [F.sum(F.col("n") * F.col(f"m_{i}")) / n for i in range(size)]
    total = lambda i, j: F.sum(F.col(f"c_{i}_{j}") + F.col("n") * F.col(f"m_{i}") * F.col(f"m_{j}")) - n * mean[i] * mean[j]
    return grams.agg(n.alias("n"), *[m.alias(f"m_{i}") for i, m in enumerate(mean)], *[total(i, j).alias(f"c_{i}_{j}") for i in range(size) for j in range(i, size)])


@dataclass(frozen=True)
class LinearForecast:
    """Weights of the drivers; without training rows there is none, and predictions are NULL."""

    drivers: tuple[str, ...]
    weights: tuple[float, ...] | None
    intercept: float = 0.0

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.weights is None:
            return rows.withColumn("prediction", F.lit(None).cast("double"))
        return rows.withColumn("prediction", sum((F.lit(w) * F.col(c) for w, c in zip(self.weights, self.drivers)), F.lit(self.intercept)))


def solved(gram_row, drivers=FORECAST_DRIVERS) -> LinearForecast:
    """Least squares from a merged Gram row, a system of as many equations as drivers; drivers that say nothing new get the least weights."""
    if gram_row is None or not gram_row["n"]:
        return LinearForecast(tuple(drivers), None)
    k = len(drivers)
    c = np.array([[gram_row[f"c_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    means = np.array([gram_row[f"m_{i}"] for i in range(k + 1)])
    # Sums that were merged leave a constant driver a spread in its last bits.
    flat = np.diag(c)[:k] <= 1e-13 * gram_row["n"] * means[:k] ** 2
    c[:k][flat] = 0
    c[:, :k][:, flat] = 0
    scale = np.sqrt(np.where(flat, 1.0, np.diag(c)[:k]))
    weights = np.linalg.pinv(c[:k, :k] / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (c[:k, k] / scale) / scale
    weights[flat] = 0.0
    return LinearForecast(tuple(drivers), tuple(map(float, weights)), float(means[k] - weights @ means[:k]))


def fit_forecaster(train: DataFrame, kind: str = "linear", drivers=FORECAST_DRIVERS):
    """Model of the drift trajectory: in closed form from Gram sums, or boosted trees."""
    if kind == "linear":
        return solved(merged_gram(gram(train, drivers), len(drivers) + 1).first(), drivers)
    model = GBTRegressor(featuresCol="x", labelCol="label", maxIter=20, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=list(drivers), outputCol="x"), model]).fit(train)


def forecast_error(model, test: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Root mean squared error per unit on held-out runs; of ``units``, those without such a run are reported with 0 rows."""
    scored = model.transform(test)
    out = scored.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), F.lit(2.0)))).alias("rmse"),
    )
    if units is None:
        return out
    return units.select("unit").distinct().join(out, "unit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
