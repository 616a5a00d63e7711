"""Rolling medians and lag sums in blocks, against the whole series at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runsignal.functions.rolling import lag_sums, rolling_medians, sliding_median


@pytest.mark.parametrize("behind,ahead,least,block", [(3, 3, 1, 7), (47, 0, 16, 5), (0, 0, 1, 100), (5, 4, 4, 4096), (60, 60, 2, 8)])
def test_medians(spark, behind, ahead, least, block):
    rng = np.random.default_rng(behind)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b", None], 150), "i": np.tile(np.arange(150) - 40, 3), "x": np.round(rng.normal(size=450), 1), "y": rng.normal(size=450)})
    pdf.loc[rng.random(450) < 0.3, "x"] = np.nan
    pdf = pdf[(pdf.i != 20) & ((pdf.i < 60) | (pdf.i > 75))]  # positions may be missing
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, i int, x double, y double").repartition(5)
    got = rolling_medians(df, ["k"], F.col("i"), ["x", "y"], behind, ahead, least, block).toPandas()
    assert len(got) == len(pdf)
    for _, r in got.iterrows():
        own = pdf[(pdf.k.isna() if r.k is None else pdf.k == r.k) & (pdf.i >= r.i - behind) & (pdf.i <= r.i + ahead)]
        for c in "xy":
            want = own[c].median() if own[c].count() >= least else np.nan
            assert r[f"{c}_med"] == pytest.approx(want, nan_ok=True)


def test_equal_values_leave_one_at_a_time():
    v = np.array([1.0, 1.0, 1.0, 5.0, 5.0, np.nan, 5.0])
    got = sliding_median(np.arange(7), v, np.ones(7, bool), 2, 0, 1)
    assert got.tolist() == [1, 1, 1, 1, 5, 5, 5]


@pytest.mark.parametrize("reach,block", [(4, 7), (30, 8), (3, 4096)])
def test_lag_sums(spark, reach, block):
    rng = np.random.default_rng(reach)
    x, y = rng.normal(size=(2, 2, 200))
    x[rng.random((2, 200)) < 0.2] = np.nan
    y[rng.random((2, 200)) < 0.2] = np.nan
    rows = [(f"u{u}", i - 30, *(None if np.isnan(v) else float(v) for v in (x[u, i], y[u, i]))) for u in range(2) for i in range(200) if i not in (50, 51, 52)]
    df = spark.createDataFrame(rows, "unit string, _at long, x double, y double").repartition(3)
    got = {(r.unit, r.lag): r for r in lag_sums(df, ["unit"], reach, block).collect()}
    there = {(u, i): (a, b) for u, i, a, b in rows}
    for u in ("u0", "u1"):
        for lag in range(-reach, reach + 1):
            pairs = [(a, there[u, i + lag][1]) for (w, i), (a, _) in there.items() if w == u and a is not None and there.get((u, i + lag), (0, None))[1] is not None]
            a, b = np.array(pairs).T
            r = got[u, lag]
            assert (r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy) == pytest.approx((len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b))


def test_no_rows(spark):
    df = spark.createDataFrame([], "unit string, _at long, x double, y double")
    assert rolling_medians(df, ["unit"], F.col("_at"), ["x"], 2, 2, 1).count() == 0 and lag_sums(df, ["unit"], 3).count() == 0
