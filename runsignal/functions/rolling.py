"""Rolling medians and lag sums over long series, block by block.

A series is cut into blocks of positions.  Every row goes to its own block and, as a halo, to those whose windows reach it, so a
unit's series spreads over tasks and a task holds one block at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def rolling_medians(
    df: DataFrame, keys: list[str], position: Column, values: list[str], behind: int, ahead: int, least: int, block: int = BLOCK
) -> DataFrame:
    """df with ``<value>_med`` added: the median over the positions from ``behind`` before a row to ``ahead`` after it.

    NULLs do not count; NULL where fewer than ``least`` values are left.  A window is kept sorted, so a step costs the logarithm of its length.
    """
    rows = _blocks(df.select(F.struct(*df.columns).alias("row"), *keys, position.cast("long").alias("_at"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]), keys, ahead, behind, block)
    rows = rows.withColumn("row", F.when(F.col("_own"), F.col("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [*keys, "_block"]):
            edge = edges(table, [*keys, "_block"])
            at, own = table.column("_at").to_numpy(), table.column("_own").to_numpy(zero_copy_only=False)
            medians = []
            for i in range(len(values)):
                v = table.column(f"_v{i}").to_numpy(zero_copy_only=False)
                out = np.full(len(v), np.nan)
                for a, b in zip(edge, edge[1:]):
                    out[a:b] = sliding_median(at[a:b], v[a:b], own[a:b], behind, ahead, least)
                medians.append(pa.array(out[own], from_pandas=True))
            yield pa.RecordBatch.from_arrays([table.column("row").filter(pa.array(own)), *medians], names=["row", *(f"m{i}" for i in range(len(values)))])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"m{i} double" for i in range(len(values)))
    return rows.mapInArrow(run, schema).select("row.*", *[F.col(f"m{i}").alias(f"{v}_med") for i, v in enumerate(values)])


def sliding_median(at: np.ndarray, v: np.ndarray, own: np.ndarray, behind: int, ahead: int, least: int) -> np.ndarray:
    """Medians of sorted positions; NaN is no value.  The mean of the two middle values where their number is even."""
    out, window, enter, leave = np.full(len(v), np.nan), [], 0, 0
    first, last = np.searchsorted(at, at - behind), np.searchsorted(at, at + ahead, "right")
    value, missing = v.tolist(), np.isnan(v).tolist()
    for i in np.flatnonzero(own).tolist():
        while enter < last[i]:
            if not missing[enter]:
                insort(window, value[enter])
            enter += 1
        while leave < first[i]:
            if not missing[leave]:
                window.pop(bisect_left(window, value[leave]))
            leave += 1
        n = len(window)
        if n >= least and n:
            out[i] = window[n // 2] if n % 2 else 0.5 * window[n // 2 - 1] + 0.5 * window[n // 2]
    return out


def lag_sums(rows: DataFrame, keys: list[str], reach: int, block: int = BLOCK) -> DataFrame:
    """``(keys, lag, n, sx, sy, sxx, syy, sxy)`` over the pairs x at position i and y at i + lag, for every lag up to ``reach`` either way.

    ``rows`` has the columns ``_at`` (each position once), ``x`` and ``y``; a pair counts where neither is NULL.  The blocks of a batch are
    summed together, lag by lag; sums of blocks are added.
    """
    rows = _blocks(rows.select(*keys, "_at", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), keys, reach, reach, block)
    rows = rows.withColumn("x", F.when(F.col("_own"), F.col("x")))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [*keys, "_block"]):
            edge = edges(table, [*keys, "_block"])
            at, own = table.column("_at").to_numpy(), table.column("_own").to_numpy(zero_copy_only=False)
            xs, ys = (table.column(c).to_numpy(zero_copy_only=False) for c in "xy")
            groups, sizes = len(edge) - 1, np.diff(edge)
            # The positions of all groups side by side, with room for the reach between them.
            begin = np.cumsum(at[edge[1:] - 1] - at[edge[:-1]] + 1 + reach)
            here = np.repeat(np.concatenate(([0], begin[:-1])) - at[edge[:-1]] + reach, sizes) + at
            y = np.full(begin[-1] + 2 * reach, np.nan)
            y[here] = ys
            used = np.flatnonzero(own & ~np.isnan(xs))
            x, here, of = xs[used], here[used], np.repeat(np.arange(groups), sizes)[used]
            for lag in range(-reach, reach + 1):
                there = y[here + lag]
                both = np.flatnonzero(~np.isnan(there))
                a, b, g = x[both], there[both], of[both]
                n = np.bincount(g, minlength=groups)
                some = np.flatnonzero(n)
                if len(some):
                    sums = [n, *(np.bincount(g, v, groups) for v in (a, b, a * a, b * b, a * b))]
                    group = [table.column(k).take(pa.array(edge[:-1][some])) for k in keys]
                    lags = pa.array(np.full(len(some), lag, np.int32))
                    yield pa.RecordBatch.from_arrays([*group, lags, *(pa.array(s[some].astype(float)) for s in sums)], names=[*keys, "lag", *names])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = rows.mapInArrow(run, f"{kinds}, lag int, " + ", ".join(f"{n} double" for n in names))
    return out.groupBy(*keys, "lag").agg(*[F.sum(n).alias(n) for n in names])


def _blocks(rows: DataFrame, keys: list[str], back: int, forth: int, block: int) -> DataFrame:
    """Every row in the blocks of the positions from ``back`` before to ``forth`` after it, sorted; ``_own`` in its own one."""
    blocks = F.sequence(F.floor((F.col("_at") - back) / block), F.floor((F.col("_at") + forth) / block))
    rows = rows.withColumn("_block", F.explode(blocks))
    rows = rows.withColumn("_own", F.col("_block") == F.floor(F.col("_at") / block))
    return rows.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_at")


def edges(table: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where each group of equal keys begins, and the end."""
    new = np.zeros(table.num_rows - 1, bool)
    for k in keys:
        code = pa.compute.fill_null(table.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches that hold all rows of their groups; the input is sorted."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            now = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            end = int(edges(now, keys)[-2])
            if end:
                yield now.slice(0, end)
            rest = now.slice(end)
    if rest is not None:
        yield rest
