"""Change points of a run's signals: penalised exact search with a Gaussian kernel cost.

The pruned search (Killick, Fearnhead and Eckley, 2012) is sequential within a run, so each run is
one group; runs spread over the cluster.  Short runs of equal length are searched together, in arrays.  For longer ones memory
stays linear in the run length: kernel rows are computed as the search reaches them and block sums are updated, no n x n matrix is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import edges, whole_groups
from ..settings import Settings

# Fixed values of the kernel cost: scaled squared distances are kept within these limits.
NEAREST, FARTHEST = 1e-2, 1e2
_BLOCK = 2048


def _distances(x: np.ndarray, rows: slice, before: int) -> np.ndarray:
    """Squared distances from some rows to rows [0, before)."""
    d = np.zeros((rows.stop - rows.start, before))
    for k in range(x.shape[1]):
        d += (x[rows, k][:, None] - x[None, :before, k]) ** 2
    return d


def _pair_blocks(x: np.ndarray):
    """All pairwise squared distances (each pair once), a block of rows at a time."""
    n = len(x)
    for lo in range(0, n, _BLOCK):
        rows = slice(lo, min(lo + _BLOCK, n))
        d = _distances(x, rows, rows.stop)
        i = np.arange(rows.start, rows.stop)[:, None]
        yield d[np.arange(rows.stop)[None, :] < i]


def _ranked(x: np.ndarray, rank: int) -> float:
    """The ``rank``-th smallest pairwise distance, by repeatedly narrowing a histogram."""
    lo, hi = np.inf, 0.0
    for d in _pair_blocks(x):
        if len(d):
            lo, hi = min(lo, d.min()), max(hi, d.max())
    below = 0
    while True:
        count = sum(int(((d >= lo) & (d <= hi)).sum()) for d in _pair_blocks(x))
        if count <= 4_000_000 or lo == hi:
            left = np.sort(np.concatenate([d[(d >= lo) & (d <= hi)] for d in _pair_blocks(x)])) if lo < hi else None
            return float(lo if left is None else left[rank - below])
        edges = np.linspace(lo, hi, 4097)
        tally = np.zeros(4096, dtype=np.int64)
        for d in _pair_blocks(x):
            tally += np.histogram(d[(d >= lo) & (d <= hi)], bins=edges)[0]
        ends = below + np.cumsum(tally)
        b = int(np.searchsorted(ends, rank, side="right"))
        new_lo, new_hi = edges[b], edges[b + 1]
        if new_lo <= lo and new_hi >= hi:
            return float(lo)
        lo, hi = float(new_lo), float(new_hi)
        below = sum(int((d < lo).sum()) for d in _pair_blocks(x))


def kernel_width(x: np.ndarray) -> float:
    """1 / median squared pairwise distance, 1 when that median is 0."""
    pairs = len(x) * (len(x) - 1) // 2
    if pairs == 0:
        return 1.0
    if pairs <= 4_000_000:
        mid = float(np.median(np.concatenate(list(_pair_blocks(x)))))
    else:
        mid = (_ranked(x, (pairs - 1) // 2) + _ranked(x, pairs // 2)) / 2.0
    return 1.0 / mid if mid != 0 else 1.0


def segment(x: np.ndarray, min_rows: int, penalty: float) -> list[int]:
    """Interior change points (index of the first row of each new segment)."""
    n = len(x)
    if n < 2 * min_rows:
        return []
    gamma = kernel_width(x)
    starts = np.array([0])                # candidate segment starts
    block = np.zeros(1)                   # kernel sum over rows [start, t) squared
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    before = np.zeros(n + 1, dtype=np.int64)
    for t in range(1, n + 1):
        row = t - 1
        first = int(starts[0])
        d = ((x[first:row] - x[row]) ** 2).sum(axis=1) * gamma
        k = np.exp(-np.clip(d, NEAREST, FARTHEST))
        # tail[i] = kernel sum of the new row with rows [first + i, row)
        tail = np.concatenate([np.cumsum(k[::-1])[::-1], [0.0]])
        block = block + 2.0 * tail[starts - first] + 1.0
        length = t - starts
        usable = length >= min_rows
        if usable.any():
            cost = np.where(usable, best[starts] + length - block / length, np.inf)
            pick = int(np.argmin(cost))
            best[t] = cost[pick] + penalty
            before[t] = starts[pick]
            # A start that cannot win even without paying for a new segment is dropped for good.
            keep = ~usable | (cost <= best[t])
            starts, block = starts[keep], block[keep]
        if t >= min_rows and t < n and np.isfinite(best[t]):
            starts = np.append(starts, t)
            block = np.append(block, 0.0)
    points, t = [], n
    while before[t] > 0:
        t = int(before[t])
        points.append(t)
    return sorted(points)


# Runs up to this length are searched many at once.
SHORT_RUN = 128
_PAIRS = 4_000_000


def segment_many(x: np.ndarray, min_rows: int, penalty: float) -> list[list[int]]:
    """``segment`` of runs of equal length, (runs, rows, signals): the same steps, for all runs together."""
    runs, n, signals = x.shape
    if n < 2 * min_rows or not runs:
        return [[] for _ in range(runs)]
    d = np.zeros((runs, n, n))
    for k in range(signals):
        d += (x[:, :, None, k] - x[:, None, :, k]) ** 2
    i, j = np.tril_indices(n, -1)
    mid = np.median(d[:, i, j], axis=1)
    gamma = np.divide(1.0, mid, out=np.ones(runs), where=mid != 0)
    kernel = np.exp(-np.clip(d * gamma[:, None, None], NEAREST, FARTHEST))
    alive = np.zeros((runs, n + 1), bool)
    alive[:, 0] = True
    block = np.zeros((runs, n + 1))
    best = np.full((runs, n + 1), np.inf)
    best[:, 0] = 0.0
    before = np.zeros((runs, n + 1), dtype=np.int64)
    for t in range(1, n + 1):
        row = t - 1
        tail = np.zeros((runs, t))
        tail[:, :row] = np.cumsum(kernel[:, row, :row][:, ::-1], axis=1)[:, ::-1]
        block[:, :t] += 2.0 * tail + 1.0
        if t >= min_rows:
            old = t - min_rows + 1            # starts whose segment is long enough
            length = t - np.arange(old)
            cost = np.where(alive[:, :old], best[:, :old] + length - block[:, :old] / length, np.inf)
            pick = np.argmin(cost, axis=1)
            best[:, t] = cost[np.arange(runs), pick] + penalty
            before[:, t] = pick
            alive[:, :old] &= cost <= best[:, t, None]
            if t < n:
                alive[:, t] = np.isfinite(best[:, t])
    found = []
    for r in range(runs):
        points, t = [], n
        while before[r, t] > 0:
            t = int(before[r, t])
            points.append(t)
        found.append(sorted(points))
    return found


def segments(x: np.ndarray, used: np.ndarray, edge: np.ndarray, min_rows: int, penalty: float) -> list[list[int]]:
    """Change points of every run of a batch; ``edge`` says where the runs begin, ``used`` how many of the signals each has."""
    sizes, found = np.diff(edge), [[] for _ in edge[1:]]
    ready = [r for r in range(len(sizes)) if used[r] and np.isfinite(x[edge[r] : edge[r + 1], : used[r]]).all()]
    alike: dict[tuple[int, int], list[int]] = {}
    for r in ready:
        alike.setdefault((int(sizes[r]), int(used[r])), []).append(r)
    for (n, k), runs in alike.items():
        step = max(1, _PAIRS // (n * n)) if n <= SHORT_RUN else 1
        for lo in range(0, len(runs), step):
            some = runs[lo : lo + step]
            if n > SHORT_RUN:
                results = [segment(x[edge[r] : edge[r + 1], :k], min_rows, penalty) for r in some]
            else:
                results = segment_many(np.stack([x[edge[r] : edge[r + 1], :k] for r in some]), min_rows, penalty)
            for r, breaks in zip(some, results):
                found[r] = breaks
    return found


def change_points(rows: DataFrame, signals: list[str], cfg: Settings, used: str | None = None) -> DataFrame:
    """(unit, run_id, breaks): row positions within the run where a new regime starts.

    Gaps in a signal are filled forward, then backward; signals are scaled by their population
    deviation.  Runs shorter than three segments get no breaks.  The column ``used`` says how many of the signals
    a run's unit has; without it all are used.
    """
    order = Window.partitionBy("unit", "run_id").orderBy("ts")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy("unit", "run_id")
    filled = rows.select("unit", "run_id", "ts", *signals, *([used] if used else []))
    for c in signals:
        # Before the first value only that first value can fill.
        first = F.first(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        filled = filled.withColumn(f"_{c}", F.coalesce(F.last(c, ignorenulls=True).over(past), first))
    scaled = filled.select(
        "unit",
        "run_id",
        "ts",
        F.count(F.lit(1)).over(run).alias("_n"),
        (F.col(used) if used else F.lit(len(signals))).alias("_used"),
        *[
            ((F.col(f"_{c}") - F.avg(f"_{c}").over(run)) / (F.stddev_pop(f"_{c}").over(run) + 1e-9)).alias(c)
            for c in signals
        ],
    ).where(F.col("_n") >= 3 * cfg.cp_min_rows)
    min_rows, penalty, keys = cfg.cp_min_rows, cfg.cp_penalty, ["unit", "run_id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            edge = edges(table, keys)
            x = np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in signals])
            found = segments(x, table.column("_used").to_numpy()[edge[:-1]], edge, min_rows, penalty)
            yield pa.RecordBatch.from_arrays([*(table.column(k).take(pa.array(edge[:-1])) for k in keys), pa.array(found, pa.list_(pa.int32()))], names=[*keys, "breaks"])

    unit_type = rows.schema["unit"].dataType.simpleString()
    sorted_rows = scaled.select("unit", "run_id", "ts", "_used", *signals).repartition(*keys).sortWithinPartitions(*keys, "ts")
    return sorted_rows.mapInArrow(search, f"unit {unit_type}, run_id int, breaks array<int>")
