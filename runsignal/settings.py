"""Every threshold of the analysis in one place.

All durations are parameters, so the same operators serve half-hourly plant data and weekly
buckets alike.  Anything expressed in rows is derived from a duration and the bucket width.

Size bound used throughout: a unit-level series has at most
``(end - start) / bucket_s`` rows, however many raw samples it came from (seven years of
half hours are about 123 000 rows).  Windows partitioned by ``unit`` rely on that bound;
anything that would exceed it (raw samples, pooled units) is aggregated instead.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Topology of the plant the feature names come from.
PASSES = ("A", "B", "C", "D")
SENSORS_PER_PASS = 48
SENSORS_PER_UNIT = 192
PLANT = "PLANT"

# Fixed value: kg/h of steam to normal m3/h (molar volume over molar mass of water).
STEAM_TO_VOLUME = 22.414 / 18.015


@dataclass(frozen=True)
class Settings:
    bucket_s: int = 1800

    # runs
    hot: float = 500.0              # a sensor above this is live; unit online if the median is
    feed_frac: float = 0.30         # feed above this share of its running level is "on"
    level_floor: float = 0.10       # running level = median of values above this share of max
    min_run_days: float = 3.0
    min_gap_hours: float = 6.0
    edge_hours: float = 24.0        # complete cycles keep this distance to the data edges

    # drift
    baseline_hours: float = 12.0
    rate_hours: float = 24.0

    # analysis windows
    warmup_hours: float = 12.0
    settled_frac: float = 0.95
    run_level_floor: float = 0.50
    roll_rows: int = 8
    roll_min: int = 2
    cot_std: float = 2.0
    air_on: float = 0.0
    setpoint_step: float = 0.5
    setpoint_std: float = 1.0
    cp_penalty: float = 10.0
    cp_min_rows: int = 12

    # quality classes of a window
    red_hours: float = 48.0
    warmup_amber_hours: float = 30.0
    tail_amber_hours: float = 24.0
    context_hours: float = 12.0

    # derived curves
    band_hours: float = 6.0
    fleet_hours: float = 24.0

    # data quality
    prealarm: float = 30.0
    alarm: float = 45.0
    spike: float = 60.0
    spike_hours: float = 3.0
    flat_share: float = 0.93

    # correlation
    min_pairs: int = 30
    min_count: int = 10
    max_lag: int = 96
    tail_rows: int = 48
    phase_edges: tuple = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 35.0)
    phase_min_rows: int = 50

    @property
    def gap_steps(self) -> int:
        return max(1, int(self.min_gap_hours * 3600 / self.bucket_s))

    @property
    def gap_limit_s(self) -> int:
        """Distance between two active rows from which they belong to different runs.

        Rows k steps apart enclose k-1 idle rows, and a run breaks at ``gap_steps`` idle rows.
        """
        return (self.gap_steps + 1) * self.bucket_s

    def rows(self, hours: float, least: int = 1) -> int:
        return max(least, int(hours * 3600 / self.bucket_s))

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)
