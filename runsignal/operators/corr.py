"""Pearson and Spearman correlation of many pairs of columns.

A rank belongs to a column and to the rows it is taken over, and pairs whose rows are the same share it: 17 columns with one
pattern of missing values are ranked 17 times, not once for every pair (``pair_stats``).  A partition holds at most one unit's grid rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_number, days_between, deviation, pearson, ratio, seconds
from ..functions.rolling import edges, lag_sums, whole_groups
from ..settings import PASSES, Settings

# Variables compared by default, in their documented order.
DEFAULT_COLUMNS = (
    "cot", "feed_total", "steam_hc", "resid_proxy", "coil_out_P", "draft",
    "feed_coilT", "feed_C2H6", "feed_C3H8", "feed_C5p", "feed_CO2",
    "tube_cot_mean", "dd_abs_max", "coking_rate", "run_age_days",
    "eff_C2H4", "eff_C3H6",
)


def active_rows(features: DataFrame) -> DataFrame:
    """Cracking rows, or all rows where the column is missing."""
    return features.where("cracking") if "cracking" in features.columns else features


def pairs_of(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """(keys, a, b, x, y): complete number pairs only."""
    used = sorted({c for p in pairs for c in p})
    numbers = df.select(*keys, *[as_number(df, c).alias(c) for c in used])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
            for a, b in pairs
        ]
    )
    return (
        numbers.select(*keys, F.explode(cells).alias("p"))
        .where(F.col("p.x").isNotNull() & F.col("p.y").isNotNull())
        .select(*keys, "p.a", "p.b", "p.x", "p.y")
    )


def _average_rank(value: str, by: list[str]) -> Column:
    """Rank of the full value, ties sharing their mean position."""
    w = Window.partitionBy(*by).orderBy(value)
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.rank().over(w) + F.count(F.lit(1)).over(upto)) / F.lit(2.0)


def pair_correlations(pairs: DataFrame, keys: list[str], spearman: bool = True) -> DataFrame:
    """(keys, a, b, n, pearson, spearman, x_std); correlations of constant sides are NULL."""
    by = [*keys, "a", "b"]
    ranked = pairs
    aggs = [F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("pearson")]
    if spearman:
        ranked = pairs.withColumn("_rx", _average_rank("x", by)).withColumn("_ry", _average_rank("y", by))
        aggs.append(pearson("_rx", "_ry").alias("spearman"))
    return ranked.groupBy(*by).agg(*aggs, deviation("x").alias("x_std"))


def pair_stats(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str], spearman: bool = True) -> DataFrame:
    """``pair_correlations`` of the complete rows of all pairs, with one ranking for each column and set of rows.

    Rows come together by ``keys`` once, a number a column; a batch of whole groups is then ranked and summed in arrays (``group_correlations``).
    """
    if not pairs:
        raise ValueError("no pair of columns")
    used = sorted({c for p in pairs for c in p})
    place = {c: i for i, c in enumerate(used)}
    sides = [(place[a], place[b]) for a, b in pairs]
    # Rows without any number stay: a filter over all columns would be moved below everything that makes them, and planning it has no bound.
    numbers = df.select(*keys, *[as_number(df, c).alias(f"_c{i}") for i, c in enumerate(used)])
    first, second = ([p[i] for p in pairs] for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            edge = edges(table, keys)
            columns = [table.column(f"_c{i}").to_numpy(zero_copy_only=False) for i in range(len(used))]
            group, pair, n, r, rho, std = group_correlations(columns, edge, sides, spearman)
            named = [pa.array(names, pa.string()).take(pa.array(pair)) for names in (first, second)]
            numbers = [pa.array(n), *(pa.array(v, from_pandas=True) for v in (r, rho, std))]
            yield pa.RecordBatch.from_arrays(
                [*(table.column(k).take(pa.array(edge[:-1][group])) for k in keys), *named, *numbers], names=[*keys, "a", "b", "n", "pearson", "spearman", "x_std"]
            )

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = numbers.repartition(*keys).sortWithinPartitions(*keys)
    out = rows.mapInArrow(run, f"{kinds}, a string, b string, n bigint, pearson double, spearman double, x_std double")
    return out if spearman else out.drop("spearman")


def group_correlations(columns: list[np.ndarray], edge: np.ndarray, pairs: list[tuple[int, int]], spearman: bool = True) -> tuple[np.ndarray, ...]:
    """(group, pair, n, pearson, spearman, x_std) of every group that has complete rows of the pair; NaN is no value, and no correlation.

    ``edge`` says where the groups begin in the columns, and the end.  Pairs with the same rows are done together and share ranks.
    """
    groups = len(edge) - 1
    group = np.repeat(np.arange(groups), np.diff(edge))
    has = [~np.isnan(c) for c in columns]
    by_rows: dict[bytes, list[int]] = {}
    for k, (a, b) in enumerate(pairs):
        by_rows.setdefault(np.packbits(has[a] & has[b]).tobytes(), []).append(k)
    order = {c: np.lexsort((columns[c], group)) for c in {c for p in pairs for c in p}}
    found = []
    for same in by_rows.values():
        taken = has[pairs[same[0]][0]] & has[pairs[same[0]][1]]
        rows = np.flatnonzero(taken)
        if not len(rows):
            continue
        g = group[rows]
        n = np.bincount(g, minlength=groups)
        some = np.flatnonzero(n)
        begin = np.concatenate(([0], np.cumsum(n)))

        def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = v - (np.bincount(g, v, groups)[some] / n[some])[np.searchsorted(some, g)]
            return apart, np.bincount(g, apart * apart, groups)

        sides = {}
        for c in sorted({c for k in same for c in pairs[k]}):
            at = order[c][taken[order[c]]]
            v, of = columns[c][at], group[at]
            varies = np.zeros(groups, bool)
            varies[some] = v[begin[some]] < v[begin[some + 1] - 1]
            ranks = None
            if spearman:
                new = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (of[1:] != of[:-1]))))
                ties = np.diff(np.append(new, len(v)))
                rank = np.empty(len(group))
                rank[at] = np.repeat(new - begin[of[new]] + (ties + 1) / 2.0, ties)
                ranks = centred(rank[rows])
            sides[c] = varies, centred(columns[c][rows]), ranks
        for k in same:
            (x_varies, x, rx), (y_varies, y, ry) = (sides[c] for c in pairs[k])
            with np.errstate(invalid="ignore", divide="ignore"):
                both = x_varies & y_varies

                def r(x, y):
                    spread = np.sqrt(x[1] / np.maximum(n, 1)) * np.sqrt(y[1] / np.maximum(n, 1))
                    return np.where(both & (spread > 0), np.bincount(g, x[0] * y[0], groups) / np.maximum(n, 1) / spread, np.nan)

                std = np.where(x_varies, np.sqrt(x[1] / np.maximum(n - 1, 1)), 0.0)
                found.append((some, np.full(len(some), k), n[some], r(x, y)[some], r(rx, ry)[some] if spearman else np.full(len(some), np.nan), std[some]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float, float))
    return tuple(np.concatenate(v) for v in zip(*found))


def correlation_matrix(
    features: DataFrame, cfg: Settings, columns=DEFAULT_COLUMNS, method: str = "spearman"
) -> DataFrame:
    """Long square matrix (unit, a, b, n, r) over active rows.

    Variables with too few values or no spread in a unit are left out there.
    """
    cols = [c for c in columns if c in features.columns]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    rows = active_rows(features)
    stats = pair_stats(rows, pairs, ["unit"], method == "spearman")
    # The pair of a variable with itself carries its count and spread.
    usable = (F.col("a") == F.col("b")) & (F.col("n") > cfg.min_count) & (F.col("x_std") > 0)
    kept = F.collect_set(F.when(usable, F.col("a"))).over(Window.partitionBy("unit"))
    half = (
        stats.withColumn("_kept", kept)
        .where(F.array_contains("_kept", F.col("a")) & F.array_contains("_kept", F.col("b")))
        .select("unit", "a", "b", "n", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col(method)).alias("r"))
    )
    sides = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)
    return half.select("unit", F.explode(both).alias("s"), "n", "r").select("unit", "s.a", "s.b", "n", "r")


def driver_rank(
    features: DataFrame, target: str, cfg: Settings, drivers=DEFAULT_COLUMNS, keys=("unit",)
) -> DataFrame:
    """Drivers of a target, strongest Spearman first: (keys, target, driver, n, pearson, spearman, place)."""
    keys = list(keys)
    names = [c for c in drivers if c in features.columns and c != target]
    stats = pair_stats(active_rows(features), [(c, target) for c in names], keys).where((F.col("n") >= cfg.min_pairs) & (F.col("x_std") != 0))
    place = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.abs(F.round("spearman", 12)).desc_nulls_last(), F.col("driver"))
    )
    return stats.select(
        *keys, F.col("b").alias("target"), F.col("a").alias("driver"), "n", "pearson", "spearman"
    ).withColumn("place", place)


def lagged_correlation(
    features: DataFrame, x: str, y: str, cfg: Settings, by_time: bool = False
) -> DataFrame:
    """Pearson of x(t) and y(t + lag) for every lag: (unit, lag_steps, n, corr).

    A lag counts active rows, so it skips idle time; with ``by_time`` it counts buckets instead.
    Positive lags mean that x leads.
    """
    rows = active_rows(features)
    rows = rows.select("unit", "ts", as_number(rows, x).alias("x"), as_number(rows, y).alias("y"))
    unit = Window.partitionBy("unit")
    if by_time:
        rows = rows.withColumn("_i", F.floor(seconds("ts") / cfg.bucket_s))
    else:
        rows = rows.withColumn("_i", F.row_number().over(unit.orderBy("ts")).cast("long"))
    # Sums around the unit's own means lose no digits.
    centre = lambda c: (F.col(c) - F.avg(c).over(unit)).alias(c)
    sums = lag_sums(rows.select("unit", F.col("_i").alias("_at"), centre("x"), centre("y")), ["unit"], cfg.max_lag)
    n, spread = F.col("n"), lambda c: F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n")
    varies = lambda c: spread(c) > F.lit(1e-13) * F.col(f"s{c}{c}")
    corr = F.when(varies("x") & varies("y"), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread("x") * spread("y")))
    found = sums.select("unit", F.col("lag").alias("lag_steps"), n.cast("long").alias("n"), corr.alias("corr"))
    # At most 2 * max_lag + 1 entries per unit; lags without a pair come back as NULL.
    per_unit = found.groupBy("unit").agg(
        F.map_from_entries(F.collect_list(F.struct("lag_steps", F.struct("n", "corr")))).alias("m")
    )
    lags = F.explode(F.sequence(F.lit(-cfg.max_lag), F.lit(cfg.max_lag))).alias("lag_steps")
    hit = F.try_element_at("m", F.col("lag_steps"))
    return per_unit.select("unit", lags, "m").select(
        "unit", "lag_steps", F.coalesce(hit["n"], F.lit(0)).alias("n"), hit["corr"].alias("corr")
    )


def best_lag(xcorr: DataFrame) -> DataFrame:
    """Lag of the largest absolute correlation; the smallest lag wins ties."""
    top = F.max_by(F.struct("lag_steps", "corr"), F.struct(F.abs("corr"), -F.col("lag_steps")))
    return (
        xcorr.where(F.col("corr").isNotNull()).groupBy("unit").agg(top.alias("t")).select("unit", "t.lag_steps", "t.corr")
    )


def phase_bin(age: Column, edges) -> Column:
    """Right-closed bins as text, e.g. ``(0,5]``; NULL outside, so age 0 is in no bin."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges[:-1], edges[1:]))):
        out = F.when((age > lo) & (age <= hi), F.lit(f"({lo:g},{hi:g}]")).otherwise(out)
    return out


def phase_rank(features: DataFrame, target: str, cfg: Settings, top: int = 5, drivers=DEFAULT_COLUMNS) -> DataFrame:
    """Driver ranking inside bins of run age; bins need more than ``phase_min_rows`` rows."""
    rows = active_rows(features).withColumn("phase", phase_bin(F.col("run_age_days"), cfg.phase_edges))
    size = F.count(F.lit(1)).over(Window.partitionBy("unit", "phase"))
    rows = rows.where(F.col("phase").isNotNull()).withColumn("_n", size).where(F.col("_n") > cfg.phase_min_rows)
    return driver_rank(rows, target, cfg, drivers, keys=("unit", "phase")).where(F.col("place") <= top)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def p_value(t: Column, df: Column, terms: int = 200) -> Column:
    """Two-sided p-value of a t statistic with a whole number of degrees of freedom, from built-in functions alone.

    It is the regularised incomplete beta function I(v / 2, 1 / 2) at v / (v + t^2), by its continued fraction (modified Lentz) as an
    aggregate over ``terms`` pairs of terms, on the side of the turning point where it converges fast.
    """
    one, half = F.lit(1.0), F.lit(0.5)
    square = t * t

    def of(x: Column) -> Column:
        v, z = x["v"], x["v"] / (x["v"] + x["tt"])
        turned = z > (v / 2 + 1) / (v / 2 + 2.5)
        side = F.when(turned, F.struct(half.alias("p"), (v / 2).alias("q"), (x["tt"] / (v + x["tt"])).alias("z"))).otherwise(F.struct((v / 2).alias("p"), half.alias("q"), z.alias("z")))
        return _let(side, lambda f: _let(tail(f, x["i"]), lambda y: F.when(turned, one - y).otherwise(y)))

    def tail(f: Column, i: Column) -> Column:
        # 1 / B(v / 2, 1 / 2): from k to k + 2 degrees it grows by (k + 1) / k; for many degrees by its series in 1 / v.
        odd, many = F.pmod(i, F.lit(2)) == 1, i > 1000
        steps = F.when((i > 2) & ~many, F.sequence(F.when(odd, F.lit(1)).otherwise(F.lit(2)).cast("long"), i - 2, F.lit(2).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        v = i.cast("double")
        series = F.sqrt(v / (2 * F.pi())) * (one - one / (4 * v) + one / (32 * v * v) + F.lit(5.0) / (128 * v * v * v))
        scale = F.when(many, series).otherwise(F.aggregate(steps, F.when(odd, one / F.pi()).otherwise(half), lambda acc, k: acc * (k + 1) / k))
        first = one / (one - (f["p"] + f["q"]) * f["z"] / (f["p"] + 1))
        begin = F.struct(one.alias("c"), first.alias("d"), first.alias("h"))
        number = F.sequence(F.lit(1), F.lit(terms))

        def pair(m: Column) -> Column:
            p, q, z = f["p"], f["q"], f["z"]
            up = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            down = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return F.array(up, down)

        def step(s: Column, n: Column) -> Column:
            c, d = one + n / s["c"], one / (one + n * s["d"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        numerators = F.flatten(F.transform(number, lambda m: pair(m.cast("double"))))
        fraction = F.aggregate(numerators, begin, step)["h"]
        return F.when(f["z"] > 0, F.pow(f["z"], f["p"]) * F.pow(one - f["z"], f["q"]) * scale / f["p"] * fraction).otherwise(F.lit(0.0))

    given = t.isNotNull() & ~F.isnan(t) & (df > 0)
    found = _let(F.struct(F.when(given, square).alias("tt"), F.when(given, df.cast("double")).alias("v"), F.when(given, df.cast("long")).alias("i")), of)
    return F.when(given, F.least(F.greatest(found, F.lit(0.0)), one))


def clean_phases(clean: DataFrame, days: float = 5.0) -> DataFrame:
    """Number of the consecutive phase of the run's clean window a row lies in."""
    return clean.withColumn("phase", F.floor(days_between("ts", "analysis_start") / F.lit(float(days))).cast("int"))


def phase_correlations(
    clean: DataFrame, target: str, drivers, days: float = 5.0, with_p: bool = True
) -> DataFrame:
    """Spearman per unit, phase and driver: (unit, phase, driver, n, rho, t, p).  ``t`` is NULL at |rho| = 1."""
    keys = ["unit", "phase"]
    rows = clean_phases(clean, days)
    names = [c for c in drivers if c in rows.columns and c != target]
    stats = pair_stats(rows, [(c, target) for c in names], keys)
    rho, n = F.col("rho"), F.col("n")
    # Correlations of exactly +-1 may differ from it in the last digit.
    square = F.when(F.abs(rho) < 1.0 - 1e-12, rho * rho)
    out = stats.select(*keys, F.col("a").alias("driver"), "n", F.col("spearman").alias("rho")).withColumn(
        "t", F.when(n > 2, rho * F.sqrt(ratio(n - 2, F.lit(1.0) - square)))
    )
    if with_p:
        perfect = (n > 2) & (F.abs(rho) >= 1.0 - 1e-12)
        out = out.withColumn("p", F.when(perfect, F.lit(0.0)).otherwise(p_value(F.col("t"), n - 2)))
    return out


def classify_drivers(phases: DataFrame, level: float = 0.10, alpha: float = 0.05, min_n: int = 10) -> DataFrame:
    """Cause or feedback, per unit and driver.

    Phases with fewer than ``min_n`` rows do not count.  Early is phase 0, late the last phase with a correlation.
    Correlations are compared with ``level`` to 12 digits: one of exactly 0.1 may differ from it in the last digit.
    Tests run in this order: weak (below ``level`` everywhere), reversal (the sign differs late, or by ``level`` or
    more in any later phase), feedback (late exceeds early by
    ``level``), causal (early strong, significant and same sign in phases 0 and 1).
    """
    at = lambda k, c: F.max(F.when(F.col("phase") == k, F.col(c)))
    wide = phases.where(F.col("rho").isNotNull() & (F.col("n") >= min_n)).groupBy("unit", "driver").agg(
        at(0, "rho").alias("rho0"),
        at(0, "p").alias("p0"),
        at(1, "rho").alias("rho1"),
        F.max_by("rho", "phase").alias("late"),
        F.max(F.abs("rho")).alias("strongest"),
        F.min(F.when(F.col("phase") > 0, F.col("rho"))).alias("_lowest"),
        F.max(F.when(F.col("phase") > 0, F.col("rho"))).alias("_highest"),
    )
    even = lambda r: F.round(r, 12)
    early, late, second = even(F.col("rho0")), even(F.col("late")), even(F.col("rho1"))
    turned = ((early > 0) & (even(F.col("_lowest")) <= -level)) | ((early < 0) & (even(F.col("_highest")) >= level))
    sign = F.signum
    kind = (
        F.when(even(F.col("strongest")) < level, "weak")
        .when((sign(late) != sign(early)) | turned, "spurious_reversal")
        .when(even(F.abs(late) - F.abs(early)) > level, "feedback_reinforcement")
        .when(
            (F.abs(early) >= level) & (F.col("p0") < alpha) & (sign(early) == sign(second)), "causal"
        )
        .otherwise("unclassified")
    )
    return wide.withColumn("class", kind).drop("_lowest", "_highest")


def pass_correlations(features: DataFrame, cfg: Settings) -> DataFrame:
    """Drivers of each pass's own worst drift: the pass levers and the levers of the whole unit."""
    shared = ["cot", "resid_proxy", "run_age_days", "steam_hc_spread"]
    pairs = [
        (driver, f"dd_abs_max_{p}")
        for p in PASSES
        for driver in [f"feed_{p}", f"steam_{p}", f"steam_hc_{p}", *shared]
    ]
    stats = pair_stats(active_rows(features), pairs, ["unit"])
    return stats.where((F.col("n") >= cfg.min_pairs) & (F.col("x_std") != 0)).select(
        "unit", F.substring("b", -1, 1).alias("grp"), F.col("a").alias("driver"), "n", "pearson", "spearman"
    )


def pair_points(features: DataFrame, x: str, y: str) -> DataFrame:
    """Complete points of a pair with their run age, active rows only."""
    rows = active_rows(features)
    cols = list(dict.fromkeys([x, y, "run_age_days"]))
    out = rows.select("unit", "ts", *[as_number(rows, c).alias(c) for c in cols])
    return out.dropna(subset=cols)


def pair_label(points: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman of the points of a pair."""
    return pair_correlations(pairs_of(points, [(x, y)], ["unit"]), ["unit"]).select("unit", "n", "spearman")


def run_level_correlations(summary: DataFrame, drivers=("cot", "steam_hc", "feed_C5p")) -> DataFrame:
    """Run length against the run's mean drivers."""
    pairs = [(d, "length_days") for d in drivers]
    return pair_correlations(pairs_of(summary, pairs, ["unit"]), ["unit"]).select(
        "unit", F.col("a").alias("driver"), "n", "pearson", "spearman"
    )
