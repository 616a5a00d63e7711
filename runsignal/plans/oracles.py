"""The registered queries as DuckDB SQL.

Steps shared by many queries are named common table expressions; each query pulls in only those
it mentions.  Durations and levels come from the same settings the Spark side uses, the logic is
written independently (interval joins instead of windowed labels, for example).
"""

from __future__ import annotations

import re

from ..settings import PASSES, STEAM_TO_VOLUME
from .present import HALF_UP, LARGE
from .samples import EFFLUENT, FEED, HALF_DAY, LINE_ROLES, WEEKLY

CTE: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _cte_names(sql: str) -> set[str]:
    return {w for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql) if w in CTE}


def _with(body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in sorted(_cte_names(CTE[name]) - {name}):
            visit(dep)
        order.append(name)

    for name in sorted(_cte_names(body)):
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in order) + "\n" + body


def _shown(spec: str) -> str:
    name, _, kind = spec.partition(":")
    quoted = f'"{name}"'
    if kind == "t":
        return f"strftime({quoted}, '%Y-%m-%d %H:%M:%S') AS {quoted}"
    if kind == "i":
        return f"CAST({quoted} AS BIGINT) AS {quoted}"
    if kind == "m":  # whole number that may be missing
        return f"CAST({quoted} AS DOUBLE) AS {quoted}"
    if kind == "d":
        x = f"CAST({quoted} AS DOUBLE)"
        digits = f"(CASE WHEN abs({x}) < {LARGE} THEN 1e6 ELSE 1e4 END)"
        return f"CASE WHEN NOT isnan({x}) THEN floor({x} * {digits} + {HALF_UP}) / {digits} END AS {quoted}"
    return quoted


def oracle(name: str, columns: str, body: str) -> None:
    ORACLES[name] = _with(f"SELECT {', '.join(_shown(c) for c in columns.split())}\nFROM ({body.strip()}) AS answer")


def pearson(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def steady_sum(x: str, more: str = "") -> str:
    """Sum of doubles in whole numbers and steps of 2**-46, the same in any order of the rows; ``more``: FILTER or OVER."""
    x, steps = f"CAST({x} AS DOUBLE)", f"{2**46}e0"
    wholes, parts = f"CAST(floor({x}) AS BIGINT)", f"CAST(floor(({x} - floor({x})) * {steps}) AS BIGINT)"
    return f"(CAST(sum({wholes}) {more} AS DOUBLE) + CAST(sum({parts}) {more} AS DOUBLE) / {steps})"


def steady_mean(x: str, more: str = "") -> str:
    return f"({steady_sum(x, more)} / nullif(count({x}) {more}, 0))"


def bucket(ts: str, width: int) -> str:
    return f"make_timestamp(CAST(floor(epoch({ts}) / {width}) * {width} * 1000000 AS BIGINT))"


def hours(h: float) -> str:
    return f"to_seconds({int(round(h * 3600))})"


W = WEEKLY
WEEK = W.bucket_s
PAIRS = "(VALUES ('A'), ('B'), ('C'), ('D')) AS passes(grp)"

# ---- events ----------------------------------------------------------------------------------

CTE["samples_e"] = """
SELECT CAST(user_id AS VARCHAR) AS unit, CAST(user_id AS VARCHAR) || ':' || event_type AS id, event_type AS role,
       ts AS time, CASE WHEN event_type = 'error' THEN 'Bad' ELSE 'Good' END AS status, value,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
FROM events"""
CTE["means_e"] = f"""
SELECT unit, id, role, {bucket('time', HALF_DAY.bucket_s)} AS ts, {steady_mean('value')} AS value
FROM samples_e WHERE status = 'Good' AND value IS NOT NULL GROUP BY ALL"""

oracle("bucket_mean", "id ts:t value:d", "SELECT id, ts, value FROM means_e")
oracle(
    "bucket_mean_variant",
    "id ts:t value:d",
    f"""SELECT id, {bucket('time', HALF_DAY.bucket_s)} AS ts, {steady_mean('k')} AS value FROM samples_e
        WHERE status = 'Good' AND k IS NOT NULL GROUP BY ALL""",
)
oracle(
    "history_load",
    "unit id role ts:t value:d",
    f"""SELECT unit, id, role, {bucket('time', HALF_DAY.bucket_s)} AS ts, {steady_mean('value')} AS value FROM samples_e
        WHERE status = 'Good' AND time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-25' GROUP BY ALL""",
)
oracle(
    "coverage",
    "id n:i t0:t t1:t vmin:d vmax:d vmean:d",
    """SELECT id, count(*) AS n, date_trunc('second', min(time)) AS t0, date_trunc('second', max(time)) AS t1,
              min(value) AS vmin, max(value) AS vmax, avg(value) AS vmean FROM samples_e GROUP BY id""",
)
oracle(
    "role_year",
    "role yr:i n:i",
    """SELECT role, yr, count(*) FILTER (year(time) = yr) AS n FROM samples_e, (SELECT DISTINCT year(time) AS yr FROM samples_e) GROUP BY role, yr""",
)

# ---- line items as history -------------------------------------------------------------------

CTE["lines"] = f"""
SELECT *, CAST(l_suppkey AS VARCHAR) AS unit, l_linenumber AS ln, substr('ABCD', (l_linenumber - 1) % 4 + 1, 1) AS grp,
       {bucket('l_shipdate', WEEK)} AS ts FROM lineitem"""

WHOLE = ("cot_ctrl", "effluent_GC", "coil_out_P", "draft", "feed_coilT")
for role, expr in LINE_ROLES.items():
    CTE[f"h_{role}"] = f"""
SELECT unit, unit || ':{role}:' || ln AS id, '{role}' AS role, ln,
       {'NULL' if role in WHOLE else 'grp'} AS grp, ts, {steady_mean(expr)} AS value FROM lines GROUP BY ALL"""
CTE["h_plant"] = f"""
SELECT 'PLANT' AS unit, 'PLANT:feed_GC:' || ln AS id, 'feed_GC' AS role, ln, NULL AS grp, ts, {steady_mean('l_discount')} AS value
FROM lines GROUP BY ALL"""

oracle("coverage_by_year", "id yr:i n:i", "SELECT unit || ':' || ln AS id, year(l_shipdate) AS yr, count(*) AS n FROM lines GROUP BY ALL")
oracle(
    "coverage_matrix",
    "id yr:i n:i",
    """SELECT unit || ':' || ln AS id, yr, count(*) FILTER (year(l_shipdate) = yr) AS n
       FROM lines, (SELECT DISTINCT year(l_shipdate) AS yr FROM lines) GROUP BY unit, ln, yr""",
)
oracle(
    "lever_wide",
    "unit ts:t feed_flow_1:d cot_ctrl_2:d",
    """WITH named AS (SELECT unit, ts, value, 'f' AS k FROM h_feed_flow WHERE ln = 1
                      UNION ALL SELECT unit, ts, value, 'c' FROM h_cot_ctrl WHERE ln = 2),
            cells AS (SELECT unit, unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY)) AS ts FROM named GROUP BY unit)
       SELECT c.unit, c.ts, max(value) FILTER (k = 'f') AS feed_flow_1, max(value) FILTER (k = 'c') AS cot_ctrl_2
       FROM cells c LEFT JOIN named n ON n.unit = c.unit AND n.ts = c.ts GROUP BY 1, 2""",
)
CTE["plant_span"] = "SELECT min(ts) AS p0, max(ts) AS p1 FROM h_plant"
oracle(
    "dense_grid",
    "unit ts:t",
    """SELECT unit, unnest(generate_series(least(min(ts), any_value(p0)), greatest(max(ts), any_value(p1)), INTERVAL 7 DAY)) AS ts
       FROM h_feed_flow, plant_span GROUP BY unit""",
)

# ---- frames and runs -------------------------------------------------------------------------


def run_ctes(suffix: str, grid: str, cfg, online: bool) -> None:
    """Level, mask, runs and labelled rows from a grid with feed_total (and sensor_median)."""
    CTE[f"top_{suffix}"] = f"SELECT unit, max(feed_total) AS top FROM {grid} GROUP BY unit"
    CTE[f"level_{suffix}"] = f"""
SELECT g.unit, median(feed_total) FILTER (feed_total > top * {cfg.level_floor}) AS level
FROM {grid} g JOIN top_{suffix} USING (unit) GROUP BY g.unit"""
    both = f" AND coalesce(sensor_median > {cfg.hot}, false)" if online else ""
    CTE[f"mask_{suffix}"] = f"""
SELECT g.*, coalesce(feed_total > level * {cfg.feed_frac}, false){both} AS cracking
FROM {grid} g JOIN level_{suffix} USING (unit)"""
    CTE[f"islands_{suffix}"] = f"""
SELECT unit, ts, sum(fresh) OVER (PARTITION BY unit ORDER BY ts) AS island FROM (
  SELECT unit, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY unit ORDER BY ts)) < {cfg.gap_limit_s} THEN 0 ELSE 1 END AS fresh
  FROM mask_{suffix} WHERE cracking)"""
    CTE[f"runs_{suffix}"] = f"""
SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY t0) - 1 AS run, t0 AS run_start, t1 AS run_end FROM (
  SELECT unit, island, min(ts) AS t0, max(ts) AS t1 FROM islands_{suffix} GROUP BY 1, 2)
WHERE epoch(t1) - epoch(t0) >= {cfg.min_run_days} * 86400"""
    CTE[f"rows_{suffix}"] = f"""
SELECT m.*, run AS run_id, run_start, run_end, (epoch(ts) - epoch(run_start)) / 86400.0 AS run_age_days
FROM mask_{suffix} m LEFT JOIN runs_{suffix} r ON m.unit = r.unit AND m.ts BETWEEN r.run_start AND r.run_end"""


# Feed only.
CTE["feed_f"] = f"SELECT unit, ts, {steady_sum('value')} AS feed FROM h_feed_flow GROUP BY 1, 2"
CTE["grid_f"] = """
SELECT c.unit, c.ts, coalesce(feed, 0) AS feed_total
FROM (SELECT unit, unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY)) AS ts FROM feed_f GROUP BY unit) c
LEFT JOIN feed_f USING (unit, ts)"""
run_ctes("f", "grid_f", W, online=False)

CTE["run_table_f"] = """
SELECT unit, run, run_start AS start, run_end AS "end", round_even((epoch(run_end) - epoch(run_start)) / 86400.0, 2) AS length_days
FROM runs_f"""
oracle("run_table", "unit run:i start:t end:t length_days:d", "SELECT * FROM run_table_f")
oracle(
    "run_stats",
    "unit count:i mean:d std:d min:d max:d",
    """SELECT unit, count(*) AS "count", round_even(avg(length_days), 1) AS "mean", round_even(stddev_samp(length_days), 1) AS "std",
              round_even(min(length_days), 1) AS "min", round_even(max(length_days), 1) AS "max" FROM run_table_f GROUP BY unit""",
)
oracle(
    "run_hist",
    "bin:i lo:d hi:d runs:i",
    """SELECT bin, bin * 14.0 AS lo, (bin + 1) * 14.0 AS hi, count(*) AS runs
       FROM (SELECT least(floor(length_days / 14.0), 18) AS bin FROM run_table_f WHERE length_days <= 266) GROUP BY bin""",
)
oracle("run_median", "runs:i median_days:d", "SELECT count(*) AS runs, median(length_days) AS median_days FROM run_table_f")
oracle(
    "gaps",
    "unit run:i gap_start:t gap_end:t gap_days:d",
    """SELECT a.unit, a.run, a.run_end AS gap_start, b.run_start AS gap_end, (epoch(b.run_start) - epoch(a.run_end)) / 86400.0 AS gap_days
       FROM runs_f a JOIN runs_f b ON a.unit = b.unit AND b.run = a.run + 1""",
)
oracle("run_age", "unit ts:t run_id:m run_age_days:d", "SELECT * FROM rows_f WHERE run_id IS NOT NULL")
oracle(
    "run_lookup",
    "unit ts:t run_id:m run_age_days:d",
    """SELECT s.unit, s.ts, run AS run_id, (epoch(s.ts) - epoch(run_start)) / 86400.0 AS run_age_days
       FROM (SELECT DISTINCT unit, l_shipdate AS ts FROM lines) s
       LEFT JOIN runs_f r ON s.unit = r.unit AND s.ts BETWEEN run_start AND run_end""",
)
oracle(
    "complete_cycles",
    "unit run:i start:t end:t",
    f"""SELECT unit, run, run_start AS start, run_end AS "end" FROM runs_f
        WHERE epoch(run_start) - (SELECT min(epoch(l_shipdate)) FROM lineitem) >= {W.edge_hours * 3600}
          AND (SELECT max(epoch(l_shipdate)) FROM lineitem) - epoch(run_end) >= {W.edge_hours * 3600}""",
)
oracle(
    "unit_outliers",
    "unit runs:i median:d z:d outlier",
    """WITH m AS (SELECT unit, count(*) AS runs, median(length_days) AS "median" FROM run_table_f GROUP BY unit),
            s AS (SELECT avg("median") AS mu, stddev_samp("median") AS sd FROM m)
       SELECT unit, runs, "median", ("median" - mu) / nullif(sd, 0) AS z,
              coalesce(abs(("median" - mu) / nullif(sd, 0)) > 2, false) AS outlier FROM m, s""",
)

# Events: all values of a unit are its feed.
CTE["feed_e"] = f"SELECT unit, ts, {steady_sum('value')} AS feed FROM means_e GROUP BY 1, 2"
CTE["grid_e"] = f"""
SELECT c.unit, c.ts, coalesce(feed, 0) AS feed_total
FROM (SELECT unit, unnest(generate_series(min(ts), max(ts), {hours(12)})) AS ts FROM feed_e GROUP BY unit) c
LEFT JOIN feed_e USING (unit, ts)"""
run_ctes("e", "grid_e", HALF_DAY, online=False)
oracle(
    "event_runs",
    "unit run:i start:t end:t length_days:d",
    """SELECT unit, run, run_start AS start, run_end AS "end",
              round_even((epoch(run_end) - epoch(run_start)) / 86400.0, 2) AS length_days FROM runs_e""",
)


def frame_ctes(suffix: str, sensor_role: str, plant: bool) -> None:
    """Unit frame with sensors: levers, mask, runs."""
    CTE[f"unit_span_{suffix}"] = (
        "SELECT unit, least(min(ts), any_value(p0)) AS t0, greatest(max(ts), any_value(p1)) AS t1 FROM h_feed_flow, plant_span GROUP BY unit"
        if plant
        else "SELECT unit, min(ts) AS t0, max(ts) AS t1 FROM h_feed_flow GROUP BY unit"
    )
    CTE[f"cells_{suffix}"] = f"SELECT unit, unnest(generate_series(t0, t1, INTERVAL 7 DAY)) AS ts FROM unit_span_{suffix}"
    CTE[f"hot_{suffix}"] = f"""
SELECT unit, ts, median(value) AS sensor_median, {steady_mean('value', f'FILTER (value > {W.hot})')} AS tube_cot_mean FROM h_{sensor_role} GROUP BY 1, 2"""
    per = ", ".join(
        f"coalesce(feed_{p}, 0) AS feed_{p}, coalesce(steam_{p}, 0) AS steam_{p}" for p in PASSES
    )
    CTE[f"grid_{suffix}"] = f"""
SELECT c.unit, c.ts, sensor_median, tube_cot_mean, cot, coalesce(feed_total, 0) AS feed_total, coalesce(steam_total, 0) AS steam_total, {per}
FROM cells_{suffix} c LEFT JOIN feed_w USING (unit, ts) LEFT JOIN steam_w USING (unit, ts)
LEFT JOIN cot_w USING (unit, ts) LEFT JOIN hot_{suffix} USING (unit, ts)"""
    run_ctes(suffix, f"grid_{suffix}", W, online=True)
    CTE[f"live_{suffix}"] = f"""
SELECT h.unit, h.id, h.grp, h.ts, h.value, m.run_id, m.run_start FROM h_{sensor_role} h JOIN rows_{suffix} m ON h.unit = m.unit AND h.ts = m.ts
WHERE m.cracking AND h.value > {W.hot}"""
    CTE[f"delta_{suffix}"] = f"SELECT *, value - {steady_mean('value', 'OVER (PARTITION BY unit, grp, ts)')} AS delta FROM live_{suffix}"
    CTE[f"base_{suffix}"] = f"""
SELECT unit, run_id, id, {steady_mean('delta')} AS baseline FROM delta_{suffix}
WHERE run_id IS NOT NULL AND ts <= run_start + {hours(W.baseline_hours)} GROUP BY ALL"""
    CTE[f"drift_{suffix}"] = f"""
SELECT d.*, baseline, delta - baseline AS drift FROM delta_{suffix} d
LEFT JOIN base_{suffix} b ON d.unit = b.unit AND d.run_id = b.run_id AND d.id = b.id"""
    passes = ", ".join(f"max(abs(drift)) FILTER (grp = '{p}') AS dd_abs_max_{p}" for p in PASSES)
    CTE[f"health_{suffix}"] = f"""
SELECT unit, ts, max(delta) - min(delta) AS delta_spread, max(drift) AS dd_max, max(abs(drift)) AS dd_abs_max,
       quantile_cont(drift, 0.95) AS dd_p95, {passes}
FROM drift_{suffix} GROUP BY 1, 2"""
    win = W.rows(W.rate_hours, 2)
    ahead = (win - 1) // 2
    names = ", ".join(f"dd_abs_max_{p}" for p in PASSES)
    CTE[f"smooth_{suffix}"] = f"""
SELECT *, CASE WHEN run_id IS NOT NULL AND count(dd_abs_max) OVER w >= {max(2, win // 3)}
               THEN quantile_cont(dd_abs_max, 0.5) OVER w END AS smooth
FROM (SELECT r.*, delta_spread, dd_max, dd_abs_max, dd_p95, {names}
      FROM rows_{suffix} r LEFT JOIN health_{suffix} h ON r.unit = h.unit AND r.ts = h.ts)
WINDOW w AS (PARTITION BY unit, run_id ORDER BY ts ROWS BETWEEN {win - 1 - ahead} PRECEDING AND {ahead} FOLLOWING)"""
    CTE[f"levels_{suffix}"] = "SELECT g.unit, " + ", ".join(
        f"median(feed_{p}) FILTER (feed_{p} > 0.1 * m{p}) AS l{p}, any_value(m{p}) AS m{p}" for p in PASSES
    ) + f""" FROM grid_{suffix} g JOIN (SELECT unit, {", ".join(f"max(feed_{p}) AS m{p}" for p in PASSES)} FROM grid_{suffix} GROUP BY unit) USING (unit)
GROUP BY g.unit"""
    ratios = ", ".join(
        f"CASE WHEN m{p} > 0 AND feed_{p} > {W.feed_frac} * l{p} THEN steam_{p} / feed_{p} END AS steam_hc_{p}" for p in PASSES
    )
    hc = [f"steam_hc_{p}" for p in PASSES]
    dd = [f"dd_abs_max_{p}" for p in PASSES]
    worst = " ".join(f"WHEN dd_abs_max_{p} = greatest({', '.join(dd)}) THEN '{p}'" for p in PASSES)
    CTE[f"feat_{suffix}"] = f"""
SELECT *, greatest({', '.join(hc)}) - least({', '.join(hc)}) AS steam_hc_spread,
       greatest({', '.join(dd)}) - least({', '.join(dd)}) AS pass_imbalance,
       CASE {worst} END AS worst_pass
FROM (SELECT s.*, {ratios},
       CASE WHEN run_id IS NOT NULL THEN (smooth - lag(smooth) OVER (PARTITION BY s.unit, run_id ORDER BY ts)) / {WEEK / 3600} * 24 END AS coking_rate,
       CASE WHEN feed_total > 0 THEN steam_total / feed_total END AS steam_hc,
       CASE WHEN feed_total + steam_total * {STEAM_TO_VOLUME!r} > 0 THEN 1.0 / (feed_total + steam_total * {STEAM_TO_VOLUME!r}) END AS resid_proxy
      FROM smooth_{suffix} s JOIN levels_{suffix} l ON s.unit = l.unit)"""


CTE["feed_w"] = f"SELECT unit, ts, {steady_sum('value')} AS feed_total, " + ", ".join(
    steady_sum("value", f"FILTER (grp = '{p}')") + f" AS feed_{p}" for p in PASSES
) + " FROM h_feed_flow GROUP BY 1, 2"
CTE["steam_w"] = f"SELECT unit, ts, {steady_sum('value')} AS steam_total, " + ", ".join(
    steady_sum("value", f"FILTER (grp = '{p}')") + f" AS steam_{p}" for p in PASSES
) + " FROM h_dil_steam GROUP BY 1, 2"
CTE["cot_w"] = f"SELECT unit, ts, {steady_mean('value')} AS cot FROM h_cot_ctrl GROUP BY 1, 2"
frame_ctes("c", "tube_COT", plant=False)        # core roles
frame_ctes("a", "tube_COT", plant=True)         # all roles, plant-wide tags widen the grid
frame_ctes("p", "tube_COT_long", plant=False)   # sparse sensors

oracle("cracking_mask", "unit ts:t feed_total:d sensor_median:d cracking", "SELECT * FROM mask_c")
oracle(
    "run_table_online",
    "unit run:i start:t end:t length_days:d",
    """SELECT unit, run, run_start AS start, run_end AS "end",
              round_even((epoch(run_end) - epoch(run_start)) / 86400.0, 2) AS length_days FROM runs_c""",
)

# ---- drift -----------------------------------------------------------------------------------

oracle("delta_pass", "unit id grp ts:t delta:d", "SELECT * FROM delta_c")
oracle("delta_unit", "unit id ts:t delta:d", f"SELECT unit, id, ts, value - {steady_mean('value', 'OVER (PARTITION BY unit, ts)')} AS delta FROM live_c")
oracle("drift", "unit id ts:t run_id:m baseline:d drift:d", "SELECT * FROM drift_c")
oracle("health", "unit ts:t delta_spread:d dd_max:d dd_abs_max:d dd_p95:d", "SELECT * FROM health_c")
oracle(
    "pass_health",
    "unit ts:t " + " ".join(f"dd_abs_max_{p}:d" for p in PASSES) + " pass_imbalance:d worst_pass",
    "SELECT * FROM feat_c",
)
oracle("drift_rate", "unit ts:t run_id:m dd_abs_max:d coking_rate:d", "SELECT * FROM feat_c")

# ---- features --------------------------------------------------------------------------------

oracle("feature_totals", "unit ts:t feed_total:d steam_total:d steam_hc:d resid_proxy:d", "SELECT * FROM feat_c")
oracle(
    "feature_pass",
    "unit ts:t " + " ".join(f"{k}_{p}:d" for p in PASSES for k in ("feed", "steam", "steam_hc")) + " steam_hc_spread:d",
    "SELECT * FROM feat_c",
)
CTE["means_a"] = f"""
SELECT c.unit, c.ts, p.value AS coil_out_P, d.value AS draft, t.value AS feed_coilT FROM cells_a c
LEFT JOIN (SELECT unit, ts, {steady_mean('value')} AS value FROM h_coil_out_P GROUP BY 1, 2) p ON p.unit = c.unit AND p.ts = c.ts
LEFT JOIN (SELECT unit, ts, {steady_mean('value')} AS value FROM h_draft GROUP BY 1, 2) d ON d.unit = c.unit AND d.ts = c.ts
LEFT JOIN (SELECT unit, ts, {steady_mean('value')} AS value FROM h_feed_coilT GROUP BY 1, 2) t ON t.unit = c.unit AND t.ts = c.ts"""


def gas(column: str, source: str, names, token: str) -> str:
    """(unit, ts, value) of the first analyser whose name matches, per unit."""
    listed = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(names))
    return f"""
SELECT h.unit, h.ts, h.value AS {column} FROM {source} h
JOIN (SELECT unit, min(s.ln) AS ln FROM (SELECT DISTINCT unit, ln FROM {source}) s
      JOIN (VALUES {listed}) AS g(ln, gas) ON g.ln = s.ln WHERE regexp_matches(gas, '{token}') GROUP BY unit) c
ON h.unit = c.unit AND h.ln = c.ln"""


FEED_GASES = (("feed_C2H6", "C2H6"), ("feed_C3H8", "C3H8"), ("feed_C4H10", "C4H10"), ("feed_C5p", "C5+"), ("feed_CO2", "CO2"))
EFF_GASES = (("eff_C2H4", "C2H4"), ("eff_C3H6", "C3H6"), ("eff_CH4", "CH4"), ("eff_C2H6", "C2H6"), ("eff_C3H8", "C3H8"))
for name, token in FEED_GASES:
    CTE[f"gas_{name}"] = gas(name, "h_plant", FEED, token)
for name, token in EFF_GASES:
    CTE[f"gas_{name}"] = gas(name, "h_effluent_GC", EFFLUENT, token)
CTE["species_a"] = (
    "SELECT c.unit, c.ts, " + ", ".join(n for n, _ in FEED_GASES + EFF_GASES) + " FROM cells_a c "
    + " ".join(f"LEFT JOIN gas_{n} ON gas_{n}.ts = c.ts" for n, _ in FEED_GASES)
    + " " + " ".join(f"LEFT JOIN gas_{n} ON gas_{n}.unit = c.unit AND gas_{n}.ts = c.ts" for n, _ in EFF_GASES)
)
SPECIES = [n for n, _ in FEED_GASES + EFF_GASES]
CTE["features_a"] = f"""
SELECT f.*, coil_out_P, draft, feed_coilT, {', '.join(SPECIES)} FROM feat_a f
JOIN means_a m ON f.unit = m.unit AND f.ts = m.ts JOIN species_a s ON f.unit = s.unit AND f.ts = s.ts"""
oracle(
    "feature_means",
    "unit ts:t cot:d coil_out_P:d draft:d feed_coilT:d tube_cot_mean:d",
    "SELECT g.*, coil_out_P, draft, feed_coilT FROM grid_a g JOIN means_a m ON g.unit = m.unit AND g.ts = m.ts",
)
oracle("feature_species", "unit ts:t " + " ".join(f"{c}:d" for c in SPECIES), "SELECT * FROM species_a")

MATRIX = (
    ["cot", "feed_total", "steam_total", "steam_hc", "resid_proxy", "coil_out_P", "draft", "feed_coilT"]
    + SPECIES
    + ["tube_cot_mean", "dd_abs_max", "dd_p95", "delta_spread", "coking_rate"]
    + [f"{k}_{p}" for p in PASSES for k in ("feed", "steam", "steam_hc", "dd_abs_max")]
    + ["steam_hc_spread", "pass_imbalance", "run_age_days"]
)
oracle(
    "feature_matrix",
    "unit ts:t " + " ".join(f"{c}:d" for c in MATRIX) + " worst_pass run_id:m cracking",
    "SELECT * FROM features_a",
)
oracle(
    "feature_matrix_proxy",
    "unit ts:t tube_cot_mean:d dd_abs_max:d dd_p95:d delta_spread:d run_id:m run_age_days:d",
    "SELECT * FROM feat_p",
)

DRIVERS = ["cot", "feed_total", "steam_hc", "resid_proxy", "coil_out_P", "draft", "feed_C2H6", "feed_C3H8", "feed_C5p", "eff_C2H4"]
CTE["summary_a"] = f"""
SELECT unit, run_id AS run, min(run_start) AS start,
       round_even((epoch(max(run_end)) - epoch(min(run_start))) / 86400.0, 2) AS length_days,
       {', '.join(f'avg({c}) AS {c}' for c in DRIVERS)},
       median(dd_abs_max) FILTER (back <= {W.tail_rows}) AS dd_end,
       CASE WHEN regr_count(dd_abs_max, run_age_days) > 5 THEN round_even(regr_slope(dd_abs_max, run_age_days), 3) END AS coking_slope_Cpd
FROM (SELECT *, row_number() OVER (PARTITION BY unit, run_id ORDER BY ts DESC) AS back FROM features_a WHERE run_id IS NOT NULL AND cracking)
GROUP BY unit, run_id"""
oracle(
    "run_summary",
    "unit run:i start:t length_days:d " + " ".join(f"{c}:d" for c in DRIVERS) + " dd_end:d coking_slope_Cpd:d",
    "SELECT * FROM summary_a",
)

# ---- correlation -----------------------------------------------------------------------------


def pairs(rows: str, combos, keys: str = "unit") -> str:
    """Complete pairs (keys, a, b, x, y)."""
    parts = [f"SELECT {keys}, '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM {rows} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combos]
    return "\nUNION ALL ".join(parts)


def kernel(pair_sql: str, keys: str = "unit") -> str:
    by = f"{keys}, a, b"
    return f"""
SELECT {by}, count(*) AS n, {pearson('x', 'y')} AS pearson, {pearson('rx', 'ry')} AS spearman, stddev_samp(x) AS x_std
FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry
      FROM ({pair_sql})) GROUP BY {by}"""


CTE["active_c"] = "SELECT * FROM feat_c WHERE cracking"
CTE["active_a"] = "SELECT * FROM features_a WHERE cracking"
COLUMNS = [
    "cot", "feed_total", "steam_hc", "resid_proxy", "coil_out_P", "draft", "feed_coilT", "feed_C2H6", "feed_C3H8",
    "feed_C5p", "feed_CO2", "tube_cot_mean", "dd_abs_max", "coking_rate", "run_age_days", "eff_C2H4", "eff_C3H6",
]
CTE["square_pairs"] = pairs("active_a", [(a, b) for a in COLUMNS for b in COLUMNS])
CTE["square"] = kernel("SELECT * FROM square_pairs")
CTE["square_kept"] = f"SELECT unit, a FROM square WHERE a = b AND n > {W.min_count} AND x_std > 0"
for name, method in (("corr_matrix", "spearman"), ("corr_matrix_pearson", "pearson")):
    oracle(
        name,
        "unit a b n:i r:d",
        f"""SELECT s.unit, s.a, s.b, n, CASE WHEN s.a = s.b THEN 1.0 ELSE {method} END AS r FROM square s
            SEMI JOIN square_kept k ON k.unit = s.unit AND k.a = s.a
            WHERE EXISTS (SELECT 1 FROM square_kept q WHERE q.unit = s.unit AND q.a = s.b)""",
    )

RANKED = ["cot", "feed_total", "steam_total", "steam_hc", "resid_proxy", "tube_cot_mean", "run_age_days"]


def ranking(target: str, rows: str, keys: str = "unit") -> str:
    stats = kernel(pairs(rows, [(c, target) for c in RANKED], keys), keys)
    return f"""
SELECT {keys}, b AS target, a AS driver, n, pearson, spearman,
       row_number() OVER (PARTITION BY {keys} ORDER BY abs(round(spearman, 12)) DESC NULLS LAST, a) AS place
FROM ({stats}) WHERE n >= {W.min_pairs} AND x_std <> 0"""


CTE["rank_dd"] = ranking("dd_abs_max", "active_c")
oracle("driver_rank", "unit target driver n:i pearson:d spearman:d place:i", "SELECT * FROM rank_dd")
oracle("driver_rank_rate", "unit target driver n:i pearson:d spearman:d place:i", ranking("coking_rate", "active_c"))
oracle(
    "sign_agreement",
    "driver units:i positive:i negative:i agree lowest:d highest:d",
    """SELECT driver, count(*) AS units, count(*) FILTER (spearman > 0) AS positive, count(*) FILTER (spearman < 0) AS negative,
              count(DISTINCT sign(spearman)) = 1 AS agree, min(spearman) AS lowest, max(spearman) AS highest
       FROM rank_dd WHERE spearman IS NOT NULL GROUP BY driver""",
)


def lagged(index: str) -> str:
    return f"""
WITH r AS (SELECT unit, {index} AS i, cot AS x, dd_abs_max AS y FROM active_c),
     lags AS (SELECT unnest(generate_series(-{W.max_lag}, {W.max_lag})) AS lag_steps),
     found AS (SELECT a.unit, l.lag_steps, count(*) AS n, {pearson('a.x', 'b.y')} AS corr
               FROM lags l JOIN r a ON true JOIN r b ON b.unit = a.unit AND b.i = a.i + l.lag_steps
               WHERE a.x IS NOT NULL AND b.y IS NOT NULL GROUP BY 1, 2)
SELECT u.unit, l.lag_steps, coalesce(n, 0) AS n, corr
FROM (SELECT DISTINCT unit FROM r) u JOIN lags l ON true LEFT JOIN found f ON f.unit = u.unit AND f.lag_steps = l.lag_steps"""


CTE["lags_rows"] = lagged("row_number() OVER (PARTITION BY unit ORDER BY ts)")
oracle("lag_xcorr", "unit lag_steps:i n:i corr:d", "SELECT * FROM lags_rows")
oracle("lag_xcorr_time", "unit lag_steps:i n:i corr:d", lagged(f"CAST(epoch(ts) / {WEEK} AS BIGINT)"))
oracle(
    "best_lag",
    "unit lag_steps:i corr:d",
    """SELECT unit, lag_steps, corr FROM lags_rows WHERE corr IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY unit ORDER BY abs(corr) DESC, lag_steps) = 1""",
)
EDGES = list(zip(W.phase_edges[:-1], W.phase_edges[1:]))
CTE["phased_c"] = (
    "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY unit, phase) AS members FROM (SELECT *, CASE "
    + " ".join(f"WHEN run_age_days > {lo} AND run_age_days <= {hi} THEN '({lo:g},{hi:g}]'" for lo, hi in EDGES)
    + f" END AS phase FROM active_c) WHERE phase IS NOT NULL) WHERE members > {W.phase_min_rows}"
)
oracle(
    "phase_rank",
    "unit phase target driver n:i pearson:d spearman:d place:i",
    f"SELECT * FROM ({ranking('dd_abs_max', 'phased_c', 'unit, phase')}) WHERE place <= 5",
)
LEVERS = [(c, f"dd_abs_max_{p}") for p in PASSES for c in (f"feed_{p}", f"steam_{p}", f"steam_hc_{p}", "cot", "resid_proxy", "run_age_days", "steam_hc_spread")]
oracle(
    "pass_corr",
    "unit grp driver n:i pearson:d spearman:d",
    f"""SELECT unit, right(b, 1) AS grp, a AS driver, n, pearson, spearman FROM ({kernel(pairs('active_c', LEVERS))})
        WHERE n >= {W.min_pairs} AND x_std <> 0""",
)
CTE["points_c"] = """
SELECT unit, ts, steam_hc, coking_rate, run_age_days FROM active_c
WHERE steam_hc IS NOT NULL AND coking_rate IS NOT NULL AND run_age_days IS NOT NULL"""
oracle("pair_points", "unit ts:t steam_hc:d coking_rate:d run_age_days:d", "SELECT * FROM points_c")
oracle("pair_label", "unit n:i spearman:d", kernel(pairs("points_c", [("steam_hc", "coking_rate")])))
oracle(
    "run_level_corr",
    "unit driver n:i pearson:d spearman:d",
    f"SELECT unit, a AS driver, n, pearson, spearman FROM ({kernel(pairs('summary_a', [(c, 'length_days') for c in ('cot', 'steam_hc', 'feed_C5p')]))})",
)

# ---- windows ---------------------------------------------------------------------------------

CTE["run_feed"] = f"""
SELECT r.unit, r.run_id, median(feed_total) FILTER (feed_total > top * {W.run_level_floor}) AS med
FROM feat_c r JOIN (SELECT unit, run_id, max(feed_total) AS top FROM feat_c WHERE run_id IS NOT NULL GROUP BY 1, 2) t
ON r.unit = t.unit AND r.run_id = t.run_id GROUP BY 1, 2"""
CTE["judged"] = f"""
SELECT r.*, coalesce(feed_total > {W.settled_frac} * med, false) AS feed_ok,
       CASE WHEN count(cot) OVER w >= 2 THEN stddev_samp(cot) OVER w END AS roll
FROM feat_c r JOIN run_feed f ON r.unit = f.unit AND r.run_id = f.run_id
WINDOW w AS (PARTITION BY r.unit, r.run_id ORDER BY ts ROWS BETWEEN {W.roll_rows - 1} PRECEDING AND CURRENT ROW)"""
CTE["window_ends"] = f"""
SELECT unit, run_id AS run, run_start, run_end,
       min(ts) FILTER (feed_ok AND coalesce(roll < {W.cot_std}, false) AND ts >= run_start + {hours(W.warmup_hours)}) AS settled_at,
       max(ts) FILTER (feed_ok) AS fed_until
FROM judged GROUP BY ALL"""
CTE["windows_c"] = f"""
SELECT *, round_even((epoch(analysis_start) - epoch(run_start)) / 3600.0, 1) AS warmup_hours,
       round_even((epoch(run_end) - epoch(analysis_end)) / 3600.0, 1) AS tail_hours,
       round_even((epoch(run_end) - epoch(run_start)) / 86400.0, 2) AS length_days,
       round_even((epoch(analysis_end) - epoch(analysis_start)) / 86400.0, 2) AS clean_days
FROM (SELECT *, CASE WHEN fed_until > analysis_start THEN fed_until ELSE run_end END AS analysis_end
      FROM (SELECT *, coalesce(settled_at, run_start + {hours(W.warmup_hours)}) AS analysis_start, settled_at IS NOT NULL AS settled FROM window_ends))"""
oracle(
    "windows_v1",
    "unit run:i run_start:t run_end:t analysis_start:t analysis_end:t warmup_hours:d tail_hours:d length_days:d clean_days:d settled",
    "SELECT * FROM windows_c",
)
CTE["clean_c"] = """
SELECT f.*, analysis_start, analysis_end FROM feat_c f JOIN windows_c w ON f.unit = w.unit AND f.run_id = w.run
WHERE analysis_end > analysis_start AND ts BETWEEN analysis_start AND analysis_end"""
oracle("clean_rows", "unit ts:t run_id:m phase feed_total:d cot:d", "SELECT *, 'clean' AS phase FROM clean_c")
oracle(
    "retention",
    "unit total_rows:i clean_rows:i runs:i pct_kept:d",
    """SELECT unit, total_rows, coalesce(kept, 0) AS clean_rows, coalesce(runs, 0) AS runs, 100.0 * coalesce(kept, 0) / total_rows AS pct_kept
       FROM (SELECT unit, count(*) AS total_rows FROM feat_c GROUP BY unit)
       LEFT JOIN (SELECT unit, count(*) AS kept, count(DISTINCT run_id) AS runs FROM clean_c GROUP BY unit) USING (unit)""",
)
oracle(
    "window_averages",
    "unit runs:i settled:i warmup_avg:d tail_avg:d clean_avg:d length_avg:d",
    """SELECT unit, count(*) AS runs, count(*) FILTER (settled) AS settled, avg(warmup_hours) AS warmup_avg, avg(tail_hours) AS tail_avg,
              avg(clean_days) AS clean_avg, avg(length_days) AS length_avg FROM windows_c GROUP BY unit""",
)
FLAGGED = f"warmup_hours > {W.red_hours} OR tail_hours > {W.tail_amber_hours}"
oracle("suspicious", "unit run:i warmup_hours:d tail_hours:d", f"SELECT * FROM windows_c WHERE {FLAGGED}")
oracle(
    "window_quality",
    "unit run:i warmup_class tail_class",
    f"""SELECT unit, run,
        CASE WHEN warmup_hours > {W.red_hours} THEN 'red' WHEN warmup_hours > {W.warmup_amber_hours} THEN 'amber' ELSE 'green' END AS warmup_class,
        CASE WHEN tail_hours > {W.red_hours} THEN 'red' WHEN tail_hours > {W.tail_amber_hours} THEN 'amber' ELSE 'green' END AS tail_class
        FROM windows_c""",
)
oracle(
    "zones",
    "unit run_id:m ts:t zone feed_total:d",
    """SELECT f.*, CASE WHEN ts < analysis_start THEN 'warmup' WHEN ts <= analysis_end THEN 'clean' ELSE 'tail' END AS zone
       FROM feat_c f JOIN windows_c w ON f.unit = w.unit AND f.run_id = w.run""",
)
oracle(
    "context_rows",
    "unit run:i ts:t zone feed_total:d",
    f"""SELECT f.unit, w.run, f.ts, feed_total,
           CASE WHEN ts < w.run_start THEN 'before' WHEN ts < analysis_start THEN 'warmup' WHEN ts <= analysis_end THEN 'clean'
                WHEN ts <= w.run_end THEN 'tail' ELSE 'after' END AS zone
        FROM feat_c f JOIN windows_c w ON f.unit = w.unit
         AND f.ts BETWEEN w.run_start - {hours(W.context_hours)} AND w.run_end + {hours(W.context_hours)}
        WHERE {FLAGGED}""",
)
oracle(
    "windows_from_clean",
    "unit run:i analysis_start:t analysis_end:t run_start:t run_end:t",
    """SELECT unit, run_id AS run, min(ts) AS analysis_start, max(ts) AS analysis_end, min(ts) AS run_start, max(ts) AS run_end
       FROM clean_c GROUP BY 1, 2""",
)
CTE["faults"] = """
SELECT unit, 'run' || run || '_fault' AS reason, run_start + INTERVAL 28 DAY AS t0, run_start + INTERVAL 35 DAY AS t1
FROM runs_c WHERE run % 3 = 0"""
oracle(
    "exclusions",
    "unit ts:t run_id:m cot:d excluded",
    """SELECT c.unit, c.ts, c.run_id, CASE WHEN reason IS NULL THEN cot END AS cot, reason AS excluded
       FROM clean_c c LEFT JOIN faults f ON c.unit = f.unit AND c.ts BETWEEN t0 AND t1""",
)
oracle(
    "exclusion_counts",
    "unit reason n:i",
    "SELECT c.unit, reason, count(*) AS n FROM clean_c c JOIN faults f ON c.unit = f.unit AND c.ts BETWEEN t0 AND t1 GROUP BY 1, 2",
)
oracle(
    "clean_share",
    "unit run:i length_days:d clean_days:d mean_clean_days:d",
    "SELECT *, avg(clean_days) OVER (PARTITION BY unit) AS mean_clean_days FROM windows_c",
)

# Second method.  The partition by dynamic programming: ``best`` and ``path`` hold the cost of the first t rows and the breaks that give
# it; ``alive`` are the starts that the published pruning rule leaves (with a least length of segments, it may miss the optimum).
CTE["air_w"] = """
SELECT unit, ts, max(v) AS air FROM (SELECT unit, ts, grp, avg(value) AS v FROM h_decoke_air GROUP BY 1, 2, 3) GROUP BY 1, 2"""
CTE["run_rows"] = """
SELECT r.unit, r.run_id, r.ts, r.run_start, r.run_end, feed_total, cot, air, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY r.unit, r.run_id) AS n
FROM rows_c r LEFT JOIN air_w a ON a.unit = r.unit AND a.ts = r.ts WHERE run_id IS NOT NULL
WINDOW w AS (PARTITION BY r.unit, r.run_id ORDER BY r.ts)"""
CTE["run_filled"] = """
SELECT unit, run_id, i, n, feed_total AS f,
       coalesce(last_value(cot IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(cot IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS c
FROM run_rows WINDOW w AS (PARTITION BY unit, run_id ORDER BY i)"""
CTE["run_scaled"] = f"""
SELECT unit, run_id, i, n, (f - avg(f) OVER w) / (stddev_pop(f) OVER w + 1e-9) AS f, (c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-9) AS c
FROM run_filled WHERE n >= {3 * W.cp_min_rows} WINDOW w AS (PARTITION BY unit, run_id)"""
CTE["run_pairs"] = """
SELECT x.unit, x.run_id, x.i, y.i AS j, pow(x.f - y.f, 2) + pow(x.c - y.c, 2) AS d
FROM run_scaled x JOIN run_scaled y ON x.unit = y.unit AND x.run_id = y.run_id AND x.i < y.i WHERE x.c IS NOT NULL"""
CTE["run_kernel"] = """
SELECT p.unit, p.run_id, i, j, exp(-least(greatest(d * g, 0.01), 100)) AS k
FROM run_pairs p JOIN (SELECT unit, run_id, CASE WHEN median(d) = 0 THEN 1.0 ELSE 1 / median(d) END AS g FROM run_pairs GROUP BY 1, 2) m
ON p.unit = m.unit AND p.run_id = m.run_id"""
CTE["run_costs"] = f"""
SELECT unit, run_id, j + 1 AS e, list(struct_pack(s := i, c := (j + 1 - i) - ((j + 1 - i) + 2 * block) / (j + 1 - i))) AS costs
FROM (SELECT unit, run_id, i, j, sum(tail) OVER (PARTITION BY unit, run_id, i ORDER BY j) AS block
      FROM (SELECT unit, run_id, i, j, sum(k) OVER (PARTITION BY unit, run_id, j ORDER BY i DESC) AS tail FROM run_kernel))
WHERE j + 1 - i >= {W.cp_min_rows} GROUP BY 1, 2, 3"""
CTE["run_breaks"] = f"""
WITH RECURSIVE dp AS (
  SELECT DISTINCT unit, run_id, n, 0::BIGINT AS t, [0.0::DOUBLE] AS best, [''] AS path, [0::BIGINT] AS alive FROM run_scaled
  UNION ALL
  SELECT unit, run_id, n, t + 1, list_append(best, now), list_append(path, CASE WHEN coalesce(m.s, 0) = 0 THEN '' WHEN path[m.s + 1] = '' THEN m.s::VARCHAR ELSE path[m.s + 1] || ',' || m.s END),
         list_concat(list_concat(list_transform(list_filter(cand, lambda x: x.v <= now), lambda x: x.s), list_filter(alive, lambda s: t + 1 - s < {W.cp_min_rows})),
                     CASE WHEN now < 1e299 AND t + 1 >= {W.cp_min_rows} THEN [t + 1] ELSE [] END)
  FROM (SELECT *, coalesce(m.v + {W.cp_penalty}, 1e300) AS now
        FROM (SELECT *, list_sort(cand)[1] AS m
              FROM (SELECT d.*, coalesce(list_filter(list_transform(list_filter(costs, lambda x: list_contains(alive, x.s)), lambda x: struct_pack(v := best[x.s + 1] + x.c, s := x.s)), lambda x: x.v < 1e299), []) AS cand
                    FROM dp d LEFT JOIN run_costs q ON q.unit = d.unit AND q.run_id = d.run_id AND q.e = d.t + 1 WHERE d.t < d.n))))
SELECT unit, run_id, path[n + 1] AS breaks FROM dp WHERE t = n"""
oracle("changepoints", "unit run_id:m breaks", "SELECT * FROM run_breaks")


def second_method(suffix: str, preferred: bool) -> None:
    """Windows of the second method with its preferred signals, or with its fallbacks."""
    stable = f"NOT coalesce(abs(r.cot - lag(r.cot) OVER o) > {W.setpoint_step}, false) AND " if preferred else ""
    limit = W.setpoint_std if preferred else W.cot_std
    on = "CASE WHEN has_air THEN NOT coalesce(air > {air}, false) ELSE feed_ok END".format(air=W.air_on) if preferred else "feed_ok"
    CTE[f"valid_{suffix}"] = f"""
SELECT r.*, has_air, breaks, {on} AS on_feed,
       CASE WHEN has_cot THEN {stable}coalesce(CASE WHEN count(r.cot) OVER (o ROWS BETWEEN {W.roll_rows - 1} PRECEDING AND CURRENT ROW) >= {W.roll_min}
            THEN stddev_samp(r.cot) OVER (o ROWS BETWEEN {W.roll_rows - 1} PRECEDING AND CURRENT ROW) END, 999.0) < {limit} ELSE true END AS stable,
       CASE WHEN coalesce(breaks, '') = '' THEN true ELSE i BETWEEN split_part(breaks, ',', 1)::BIGINT
            AND CASE WHEN contains(breaks, ',') THEN split_part(breaks, ',', -1)::BIGINT ELSE n - 1 END END AS inside
FROM run_rows r
JOIN (SELECT r.unit, count(air) > 0 AS has_air, count(cot) > 0 AS has_cot FROM rows_c r LEFT JOIN air_w a ON a.unit = r.unit AND a.ts = r.ts GROUP BY 1) h ON h.unit = r.unit
JOIN (SELECT unit, run_id, ts, feed_ok FROM judged) j ON j.unit = r.unit AND j.run_id = r.run_id AND j.ts = r.ts
LEFT JOIN run_breaks b ON b.unit = r.unit AND b.run_id = r.run_id
WINDOW o AS (PARTITION BY r.unit, r.run_id ORDER BY r.ts)"""
    good = f"inside AND on_feed AND stable AND ts >= run_start + {hours(W.warmup_hours)} AND n >= {2 * W.cp_min_rows}"
    air = "bool_or(has_air)" if preferred else "false"
    CTE[f"windows_{suffix}"] = f"""
SELECT unit, run, run_start, run_end, analysis_start, analysis_end, analysis_start IS NOT NULL AS settled,
       round_even((epoch(analysis_start) - epoch(run_start)) / 3600.0, 1) AS warmup_hours,
       round_even((epoch(run_end) - epoch(analysis_end)) / 3600.0, 1) AS tail_hours,
       round_even((epoch(run_end) - epoch(run_start)) / 86400.0, 2) AS length_days,
       round_even((epoch(analysis_end) - epoch(analysis_start)) / 86400.0, 2) AS clean_days,
       found AND long AS pelt_used, CASE WHEN NOT long THEN 'none' WHEN found THEN 'pelt' ELSE 'heuristic_{W.warmup_hours:g}h' END AS warmup_method,
       CASE WHEN NOT long THEN 'none' WHEN air THEN 'decoke_air' ELSE 'feed_heuristic' END AS decoke_method
FROM (SELECT unit, run_id AS run, run_start, run_end, min(ts) FILTER ({good}) AS analysis_start, max(ts) FILTER ({good}) AS analysis_end,
             any_value(n) >= {2 * W.cp_min_rows} AS long, coalesce(any_value(breaks), '') <> '' AS found, {air} AS air
      FROM valid_{suffix} GROUP BY 1, 2, 3, 4)"""


second_method("v2", True)
second_method("v2f", False)
SECOND = "unit run:i run_start:t run_end:t analysis_start:t analysis_end:t warmup_hours:d tail_hours:d length_days:d clean_days:d settled pelt_used warmup_method decoke_method"
oracle("windows_v2", SECOND, "SELECT * FROM windows_v2")
oracle("windows_v2_fallback", SECOND, "SELECT * FROM windows_v2f")
oracle(
    "window_compare",
    "unit run:i warmup_h_v1:d tail_h_v1:d clean_d_v1:d warmup_h_v2:d tail_h_v2:d clean_d_v2:d pelt_used decoke_method delta_clean_days:d delta_warmup_h:d",
    """SELECT b.unit, b.run, a.warmup_hours AS warmup_h_v1, a.tail_hours AS tail_h_v1, a.clean_days AS clean_d_v1, b.warmup_hours AS warmup_h_v2,
              b.tail_hours AS tail_h_v2, b.clean_days AS clean_d_v2, pelt_used, decoke_method,
              round_even(b.clean_days - a.clean_days, 2) AS delta_clean_days, round_even(b.warmup_hours - a.warmup_hours, 1) AS delta_warmup_h
       FROM windows_v2 b LEFT JOIN windows_c a ON a.unit = b.unit AND a.run = b.run""",
)
oracle(
    "method_counts",
    "unit runs:i settled:i pelt_runs:i air_runs:i",
    """SELECT unit, count(*) AS runs, count(*) FILTER (settled) AS settled, count(*) FILTER (pelt_used) AS pelt_runs,
              count(*) FILTER (decoke_method = 'decoke_air') AS air_runs FROM windows_v2 GROUP BY unit""",
)
CTE["phases_c"] = "SELECT *, CAST(floor((epoch(ts) - epoch(analysis_start)) / 86400.0 / 35.0) AS INTEGER) AS phase FROM clean_c"
PHASE_DRIVERS = ("cot", "feed_total", "steam_hc", "run_age_days", "steam_hc_spread")
oracle(
    "phase_corr",
    "unit phase:i driver n:i rho:d t:d",
    f"""SELECT unit, phase, a AS driver, n, spearman AS rho,
           CASE WHEN n > 2 AND abs(spearman) < 1 - 1e-12 THEN spearman * sqrt((n - 2) / (1 - spearman * spearman)) END AS t
        FROM ({kernel(pairs('phases_c', [(c, 'dd_abs_max') for c in PHASE_DRIVERS], 'unit, phase'), 'unit, phase')})""",
)

# The finite series of Student's distribution, a sum of (df - 1) / 2 or df / 2 terms, another way than the operator's.
CTE["phase_t"] = f"""
SELECT unit, phase, a AS driver, n, spearman AS rho, n - 2 AS df,
       CASE WHEN n > 2 AND abs(spearman) < 1 - 1e-12 THEN spearman * sqrt((n - 2) / (1 - spearman * spearman)) END AS t
FROM ({kernel(pairs('phases_c', [(c, 'dd_abs_max') for c in PHASE_DRIVERS], 'unit, phase'), 'unit, phase')})"""
CTE["phase_series"] = """
SELECT *, atan(abs(t) / sqrt(df)) AS a, cos(atan(abs(t) / sqrt(df))) AS c, sin(atan(abs(t) / sqrt(df))) AS s,
       list_transform(range(1, (df - 1) // 2 + 1), lambda m: list_reduce([1.0::DOUBLE] || list_transform(range(1, m), lambda k: CASE WHEN df % 2 = 1 THEN 2.0 * k / (2 * k + 1) ELSE (2.0 * k - 1) / (2 * k) END), lambda x, y: x * y)) AS odd_terms,
       list_transform(range(1, df // 2 + 1), lambda m: list_reduce([1.0::DOUBLE] || list_transform(range(1, m), lambda k: (2.0 * k - 1) / (2 * k)), lambda x, y: x * y)) AS even_terms
FROM phase_t WHERE t IS NOT NULL"""
CTE["phase_p"] = """
SELECT unit, phase, driver, CASE WHEN df % 2 = 1
    THEN 1 - 2 / pi() * (a + s * coalesce(list_sum(list_transform(odd_terms, lambda v, i: v * pow(c, 2 * i - 1))), 0))
    ELSE 1 - s * coalesce(list_sum(list_transform(even_terms, lambda v, i: v * pow(c, 2 * (i - 1)))), 0) END AS p
FROM phase_series"""
CTE["phase_tested"] = """
SELECT t.unit, t.phase, t.driver, n, rho, t, CASE WHEN n > 2 AND abs(rho) >= 1 - 1e-12 THEN 0.0 ELSE p END AS p
FROM phase_t t LEFT JOIN phase_p p ON p.unit = t.unit AND p.phase = t.phase AND p.driver = t.driver"""
oracle("phase_pvalue", "unit phase:i driver n:i rho:d t:d p:d", "SELECT * FROM phase_tested")
oracle(
    "driver_class",
    "unit driver rho0:d p0:d rho1:d late:d strongest:d class",
    """SELECT *, CASE WHEN strongest < 0.10 THEN 'weak'
              WHEN sign(round(late, 12)) <> sign(round(rho0, 12)) OR (rho0 > 0 AND lowest <= -0.10) OR (rho0 < 0 AND highest >= 0.10) THEN 'spurious_reversal'
              WHEN abs(late) > abs(rho0) + 0.10 THEN 'feedback_reinforcement'
              WHEN abs(rho0) >= 0.10 AND p0 < 0.05 AND sign(round(rho0, 12)) = sign(round(rho1, 12)) THEN 'causal' ELSE 'unclassified' END AS class
       FROM (SELECT unit, driver, max(rho) FILTER (phase = 0) AS rho0, max(p) FILTER (phase = 0) AS p0, max(rho) FILTER (phase = 1) AS rho1,
                    arg_max(rho, phase) AS late, max(abs(rho)) AS strongest, min(rho) FILTER (phase > 0) AS lowest, max(rho) FILTER (phase > 0) AS highest
             FROM phase_tested WHERE rho IS NOT NULL AND n >= 10 GROUP BY 1, 2)""",
)

# ---- curves ----------------------------------------------------------------------------------

CTE["spread_c"] = """
SELECT unit, grp, ts, min(drift) AS lo, max(drift) AS hi, quantile_cont(drift, 0.25) AS q1, quantile_cont(drift, 0.5) AS med,
       quantile_cont(drift, 0.75) AS q3, avg(drift) AS mean FROM drift_c WHERE drift IS NOT NULL GROUP BY 1, 2, 3"""
CTE["bands_raw"] = """
SELECT c.unit, g.grp, c.ts, lo, q1, med, q3, hi, mean FROM cells_c c
JOIN (SELECT DISTINCT unit, grp FROM spread_c) g ON g.unit = c.unit
LEFT JOIN spread_c s ON s.unit = c.unit AND s.grp = g.grp AND s.ts = c.ts"""
BAND = ("lo", "q1", "med", "q3", "hi", "mean")
BAND_ROWS = W.rows(W.band_hours)
CTE["bands_c"] = (
    "SELECT unit, grp, ts, " + ", ".join(f"quantile_cont({c}, 0.5) OVER w AS {c}" for c in BAND)
    + " FROM bands_raw WINDOW w AS (PARTITION BY unit, grp ORDER BY ts "
    + f"ROWS BETWEEN {BAND_ROWS - 1 - (BAND_ROWS - 1) // 2} PRECEDING AND {(BAND_ROWS - 1) // 2} FOLLOWING)"
)
SHAPE = "unit grp ts:t " + " ".join(f"{c}:d" for c in BAND)
oracle("pass_distribution", SHAPE, "SELECT * FROM bands_raw")
oracle("pass_bands", SHAPE, "SELECT * FROM bands_c")
oracle(
    "axis_range",
    "unit ymin:d ymax:d",
    """SELECT unit, least(quantile_cont(lo, 0.01), -10) * 1.15 AS ymin, greatest(quantile_cont(hi, 0.99), 10) * 1.15 AS ymax
       FROM bands_c GROUP BY unit""",
)
oracle("trajectories", "unit run_id:m ts:t run_age_days:d dd_max:d", "SELECT * FROM feat_c WHERE run_id IS NOT NULL")
oracle(
    "overlay",
    "unit run_id:m ts:t age_days:d dd_abs_max:d",
    "SELECT *, (epoch(ts) - epoch(analysis_start)) / 86400.0 AS age_days FROM clean_c WHERE ts >= analysis_start",
)
FLEET_ROWS = W.rows(W.fleet_hours)
oracle(
    "fleet_smooth",
    "unit ts:t dd_abs_max:d smooth:d",
    f"""WITH times AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM feat_c)),
             own AS (SELECT unit, pos, dd_abs_max FROM feat_c JOIN times USING (ts)),
             reach AS (SELECT unit, min(pos) AS p0, max(pos) + {FLEET_ROWS - 1} AS p1 FROM own GROUP BY unit)
        SELECT r.unit, t.ts, o.dd_abs_max,
               CASE WHEN count(o.dd_abs_max) OVER w >= {max(1, FLEET_ROWS // 3)} THEN quantile_cont(o.dd_abs_max, 0.5) OVER w END AS smooth
        FROM reach r JOIN times t ON t.pos BETWEEN p0 AND p1 LEFT JOIN own o ON o.unit = r.unit AND o.pos = t.pos
        WINDOW w AS (PARTITION BY r.unit ORDER BY t.pos ROWS BETWEEN {FLEET_ROWS - 1} PRECEDING AND CURRENT ROW)""",
)

# ---- quality ---------------------------------------------------------------------------------

CORE_ROLES = ("tube_COT", "feed_flow", "dil_steam", "cot_ctrl")
CTE["history_c"] = " UNION ALL ".join(f"SELECT unit, id, ts, value FROM h_{r}" for r in CORE_ROLES)
oracle(
    "tag_health",
    "unit id n:i vmin:d vmax:d vmean:d flat_share:d gaps:i exclude",
    f"""SELECT *, coalesce(flat_share >= {W.flat_share}, false) AS exclude FROM (
        SELECT unit, id, count(*) AS n, min(value) AS vmin, max(value) AS vmax, avg(value) AS vmean,
               avg(CASE WHEN before IS NOT NULL THEN CAST(value = before AS INTEGER) END) AS flat_share,
               count(*) FILTER (epoch(ts) - epoch(prev) > {WEEK}) AS gaps
        FROM (SELECT *, lag(value) OVER w AS before, lag(ts) OVER w AS prev FROM history_c WINDOW w AS (PARTITION BY unit, id ORDER BY ts))
        GROUP BY 1, 2)""",
)
CTE["spiky"] = f"""
SELECT unit, ts, dd_abs_max, high, part, count(*) OVER (PARTITION BY unit, part) * {WEEK} < {W.spike_hours * 3600} AS brief FROM (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts) - row_number() OVER (PARTITION BY unit, high ORDER BY ts) AS d,
         high || ':' || (row_number() OVER (PARTITION BY unit ORDER BY ts) - row_number() OVER (PARTITION BY unit, high ORDER BY ts)) AS part
  FROM (SELECT unit, ts, dd_abs_max, coalesce(dd_abs_max > {W.spike}, false) AS high FROM feat_c))"""
oracle(
    "spikes",
    "unit ts:t dd_abs_max:d spike",
    """SELECT unit, ts, CASE WHEN NOT (high AND brief) THEN dd_abs_max END AS dd_abs_max,
              CASE WHEN high AND brief THEN 'removed' WHEN high THEN 'kept' END AS spike FROM spiky""",
)
oracle(
    "spike_counts",
    "unit removed:i kept:i rows_blanked:i",
    """SELECT unit, count(DISTINCT part) FILTER (high AND brief) AS removed, count(DISTINCT part) FILTER (high AND NOT brief) AS kept,
              count(*) FILTER (high AND brief) AS rows_blanked FROM spiky GROUP BY unit""",
)
oracle(
    "alarms",
    "unit run:i normal_rows:i prealarm_rows:i alarm_rows:i first_prealarm:t first_alarm:t days_to_alarm:d",
    f"""SELECT unit, run_id AS run, count(*) FILTER (dd_abs_max < {W.prealarm}) AS normal_rows,
           count(*) FILTER (dd_abs_max >= {W.prealarm} AND dd_abs_max < {W.alarm}) AS prealarm_rows,
           count(*) FILTER (dd_abs_max >= {W.alarm}) AS alarm_rows,
           min(ts) FILTER (dd_abs_max >= {W.prealarm}) AS first_prealarm, min(ts) FILTER (dd_abs_max >= {W.alarm}) AS first_alarm,
           min(run_age_days) FILTER (dd_abs_max >= {W.alarm}) AS days_to_alarm
        FROM feat_c WHERE run_id IS NOT NULL GROUP BY 1, 2""",
)
oracle(
    "pass_mean_check",
    "unit grp n:i bias:d std:d corr:d",
    f"""SELECT unit, grp, count(*) AS n, avg(built - recorded) AS bias, stddev_samp(built - recorded) AS std, {pearson('built', 'recorded')} AS corr
        FROM (SELECT unit, grp, ts, avg(value) AS built FROM h_tube_COT GROUP BY 1, 2, 3)
        JOIN (SELECT unit, grp, ts, max(value) AS recorded FROM h_tube_COT_long GROUP BY 1, 2, 3) USING (unit, grp, ts) GROUP BY 1, 2""",
)
oracle(
    "proxy_check",
    "unit n:i bias:d std:d corr:d",
    f"""SELECT unit, count(*) AS n, avg(y - x) AS bias, stddev_samp(y - x) AS std, {pearson('x', 'y')} AS corr
        FROM (SELECT a.unit, a.dd_abs_max AS x, b.dd_abs_max AS y FROM smooth_c a JOIN smooth_p b ON a.unit = b.unit AND a.ts = b.ts
              WHERE a.dd_abs_max IS NOT NULL AND b.dd_abs_max IS NOT NULL) GROUP BY unit""",
)
CTE["history_q"] = " UNION ALL ".join(f"SELECT unit, id, ts, value FROM h_{r}" for r in ("feed_flow", "dil_steam", "effluent_GC"))
oracle(
    "pinned",
    "unit id n:i distinct_values:i mode_share:d zero_share:d",
    """SELECT unit, id, sum(c) AS n, count(*) AS distinct_values, max(c) / sum(c) AS mode_share,
              coalesce(sum(c) FILTER (value = 0), 0) / sum(c) AS zero_share
       FROM (SELECT unit, id, round(value, 9) AS value, count(*) AS c FROM history_q GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
oracle(
    "pooled_age",
    "age_bin:i n:i p25:d p50:d p75:d",
    """SELECT CAST(floor(run_age_days / 28.0) AS INTEGER) AS age_bin, count(dd_abs_max) AS n, quantile_cont(dd_abs_max, 0.25) AS p25,
              quantile_cont(dd_abs_max, 0.5) AS p50, quantile_cont(dd_abs_max, 0.75) AS p75
       FROM feat_c WHERE run_id IS NOT NULL AND cracking AND dd_abs_max IS NOT NULL GROUP BY 1""",
)

# ---- catalog ---------------------------------------------------------------------------------

CTE["meta"] = r"""
SELECT CASE kind
         WHEN 0 THEN '01TI' || (k % 7 + 1) || n3 || 'A.PV' WHEN 1 THEN '01TI' || (k % 7 + 1) || n3 || 'A.PV'
         WHEN 2 THEN '01TI' || (k % 7 + 1) || n3 || 'B.PV'
         WHEN 3 THEN '01TI' || lpad(CAST(k % 20 * 100 + 2 AS VARCHAR), 4, '0') || '.PV'
         WHEN 8 THEN '01TC' || serial || '.PV' WHEN 9 THEN '01PI' || serial || '.PV' WHEN 10 THEN '01PC' || serial || '.PV'
         WHEN 11 THEN '01TI' || serial || '.PV'
         WHEN 12 THEN '01AI1' || (k % 7 + 3) || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '.PV'
         WHEN 13 THEN '01AI01' || (k % 3) || (k % 10) || '.PV'
         ELSE '01FC' || serial || '.PV' END AS id,
       CASE kind
         WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'H-1' || letter || ' TUBE CUR COT' END
         WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'Main brg temp' ELSE '' END
         WHEN 3 THEN ' BANK #' || pass || ' PQE #' || (k % 4 + 5) || ' '
         WHEN 4 THEN 'H1' || letter || ' FD  #' || pass || ' PASS'
         WHEN 5 THEN 'HI' || letter || ' FD #' || pass || ' PASS'
         WHEN 6 THEN 'H1' || letter || ' DS ' || CASE WHEN k % 2 = 0 THEN '#' ELSE '' END || pass || ' PASS'
         WHEN 7 THEN 'FUR ' || letter || ' PASS' || CASE WHEN k % 2 = 0 THEN ' ' ELSE '' END || pass || ' DECOKE AIR'
         WHEN 8 THEN 'H-1' || letter || ' COT'
         WHEN 9 THEN 'EFFL FM  1-E-1' || (k % 3 + 5) || letter
         WHEN 10 THEN 'H1' || letter || ' CONV DRAFT'
         WHEN 11 THEN 'FD COIL 1-H-1' || letter
         WHEN 12 THEN '1-H-1' || letter || ' ' || gas
         WHEN 13 THEN 'FEED ' || CASE WHEN k % 2 = 0 THEN 'TO ' ELSE '' END || 'FUR ' || gas END AS description
FROM (SELECT p_partkey AS k, p_partkey // 28 % 14 AS kind, chr(CAST(65 + p_partkey % 7 AS INTEGER)) AS letter,
             chr(CAST(65 + p_partkey % 4 AS INTEGER)) AS pass,
             lpad(CAST(p_partkey % 210 AS VARCHAR), 3, '0') AS n3, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS serial,
             ['CH4', 'C2H4', 'C2H6', 'C3H6', 'C3H8', 'O2'][p_partkey % 6 + 1] AS gas FROM part)"""


def _tag_rule(i: int, role: str, desc: str, tag: str, unit: str, grp: str, extra: str = "") -> str:
    where = f"regexp_matches(id, '{tag}')" + (f" AND regexp_matches(d, '{desc}')" if desc else "") + extra
    return f"SELECT id, description, '{role}' AS role, {unit} AS unit, {grp} AS grp FROM trimmed WHERE {where}"


def _letter(pattern: str) -> str:
    return f"'1H' || nullif(regexp_extract(d, '{pattern}', 1), '')"


CTE["trimmed"] = "SELECT id, description, trim(coalesce(description, '')) AS d FROM meta"
_PASS = r"nullif(regexp_extract(d, '(?:#\s*|PASS\s?)([A-D])\b', 1), '')"
_NUM = "TRY_CAST(substr(id, 6, 3) AS INTEGER)"
_BLOCK = r"TRY_CAST(regexp_extract(id, '01[A-Z]+(\d+)', 1) AS INTEGER) // 100"
CTE["tags"] = "SELECT DISTINCT id, unit, role, description, 'C' AS uom, grp FROM (" + "\nUNION ALL ".join(
    [
        _tag_rule(
            0, "tube_COT", "", r"^01TI[1-7]\d{3}A\.PV$", "'1H' || chr(64 + CAST(substr(id, 5, 1) AS INTEGER))",
            f"substr('ABCD', least({_NUM} - 1, 191) // 48 + 1, 1)",
            f" AND {_NUM} BETWEEN 1 AND 192 AND NOT regexp_matches(d, '(?i)BRG|TURB|CASNG|\\bK[12]\\b|GOV|INACT')",
        ),
        _tag_rule(
            1, "tube_COT_long", r"BANK #[A-D] PQE #[58]\b", "^01TI", f"'1H' || chr({_BLOCK} + 57)",
            "regexp_extract(d, 'BANK #([A-D])', 1)", f" AND {_BLOCK} BETWEEN 8 AND 14",
        ),
        _tag_rule(2, "feed_flow", r"H[1I][A-G]\s+FD\s*#\s*[A-D]", r"^01FC.*\.PV$", _letter("H[1I]([A-G])"), _PASS),
        _tag_rule(3, "dil_steam", r"H[1I][A-G]\s+DS\s*#?\s*[A-D]", r"^01FC.*\.PV$", _letter("H[1I]([A-G])"), _PASS),
        _tag_rule(4, "decoke_air", r"FUR [A-G] PASS\s?[A-D] DE-?COKE AIR", r"^01FC.*\.PV$", _letter("FUR ([A-G]) PASS"), _PASS),
        _tag_rule(5, "cot_ctrl", "H-1[A-G] COT", r"^01TC.*\.PV$", _letter("H-1([A-G]) COT"), "NULL"),
        _tag_rule(6, "coil_out_P", r"EFFL FM\s+1-E-1[56][A-G]", r"^01PI.*\.PV$", _letter("1-E-1[56]([A-G])"), "NULL"),
        _tag_rule(7, "draft", r"H1[A-G] CONV\s+DRAFT", r"^01PC.*\.PV$", _letter("H1([A-G])"), "NULL"),
        _tag_rule(8, "feed_coilT", r"FD COIL\s+1-H-1[A-G]", r"^01TI.*\.PV$", _letter("1-H-1([A-G])"), "NULL"),
        _tag_rule(
            9, "effluent_GC", r"1-H-1[A-G]\s+(?:CH4|C2H4|C2H6|C3H6|C3H8)", r"^01AI1[4-9]\d\d\.PV$", _letter("1-H-1([A-G])"), "NULL",
        ),
        _tag_rule(10, "feed_GC", r"FEED (?:TO\s+FUR|FUR)", r"^01AI01[12]\d\.PV$", "'PLANT'", "NULL"),
    ]
) + ") WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, role ORDER BY description NULLS FIRST, unit) = 1"

ROLES = (
    "tube_COT", "tube_COT_long", "feed_flow", "dil_steam", "decoke_air", "cot_ctrl", "coil_out_P", "draft", "feed_coilT",
    "effluent_GC", "feed_GC",
)
oracle("tag_catalog", "id unit role description uom grp", "SELECT * FROM tags")
oracle(
    "catalog_matrix",
    "unit " + " ".join(f"{r}:i" for r in ROLES),
    "SELECT unit, " + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}" for r in ROLES) + " FROM tags GROUP BY unit",
)
CTE["tags_by_pass"] = (
    "SELECT unit, " + ", ".join(f"count(*) FILTER (grp = '{p}') AS {p}" for p in PASSES)
    + " FROM tags WHERE role = 'tube_COT' GROUP BY unit"
)
oracle("pass_matrix", "unit " + " ".join(f"{p}:i" for p in PASSES), "SELECT * FROM tags_by_pass")
oracle("incomplete_passes", "unit grp n:i", "SELECT * FROM (UNPIVOT tags_by_pass ON A, B, C, D INTO NAME grp VALUE n) WHERE n <> 48")
oracle(
    "sensor_role",
    "unit sensor_role",
    """SELECT unit, CASE WHEN bool_or(role = 'tube_COT_long') THEN 'tube_COT_long' ELSE 'tube_COT' END AS sensor_role
       FROM tags WHERE role IN ('tube_COT', 'tube_COT_long') GROUP BY unit""",
)

# ---- forecast --------------------------------------------------------------------------------

# Least squares by orthogonalising the drivers one after the other, another way than solving the normal equations.
CTE["fc_rows"] = """
SELECT r.unit, r.run_id, r.ts, run_age_days AS x1, c0 AS x2, s0 AS x3, f0 AS x4, dd_abs_max AS y,
       ('0x' || substr(md5(r.unit || ':' || r.run_id), 1, 7))::BIGINT % 5 = 0 AS test
FROM features_a r JOIN (SELECT unit, run_id, avg(cot) FILTER (run_age_days <= 28) AS c0, avg(steam_hc) FILTER (run_age_days <= 28) AS s0,
                               avg(feed_C5p) FILTER (run_age_days <= 28) AS f0 FROM features_a WHERE run_id IS NOT NULL AND cracking GROUP BY 1, 2) s
ON s.unit = r.unit AND s.run_id = r.run_id
WHERE r.run_id IS NOT NULL AND cracking AND run_age_days IS NOT NULL AND c0 IS NOT NULL AND s0 IS NOT NULL AND f0 IS NOT NULL AND dd_abs_max IS NOT NULL"""
CTE["fc_0"] = """
SELECT unit, test, x1 - m1 AS x1, x2 - m2 AS x2, x3 - m3 AS x3, x4 - m4 AS x4, y, my AS p, y - my AS e
FROM fc_rows, (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4, avg(y) AS my FROM fc_rows WHERE NOT test)"""
for k in range(1, 5):
    later = [f"x{i}" for i in range(k + 1, 5)]
    slopes = ", ".join(f"sum(x{k} * {c}) / nullif(sum(x{k} * x{k}), 0) AS b_{c}" for c in [*later, "e"])
    rest = "".join(f"{c} - coalesce(b_{c}, 0) * x{k} AS {c}, " for c in later)
    CTE[f"fc_{k}"] = f"""
SELECT unit, test, {rest}y, p + coalesce(b_e, 0) * x{k} AS p, e - coalesce(b_e, 0) * x{k} AS e
FROM fc_{k - 1}, (SELECT {slopes} FROM fc_{k - 1} WHERE NOT test)"""
oracle(
    "forecast",
    "unit n:i rmse:d",
    """SELECT u.unit, count(f.y) AS n, sqrt(avg(pow(p - y, 2))) AS rmse
       FROM (SELECT DISTINCT unit FROM features_a) u LEFT JOIN (SELECT * FROM fc_4 WHERE test) f ON f.unit = u.unit GROUP BY u.unit""",
)

# ---- stored tables ---------------------------------------------------------------------------

# What has been stored and read back equals what was given.
for stored, plain in {
    "store_range": "history_load",
    "states_mean": "bucket_mean",
    "states_coverage": "coverage",
    "states_role_year": "role_year",
    "saved_catalog": "tag_catalog",
    "saved_frame": "cracking_mask",
    "saved_clean": "clean_rows",
    "saved_windows": "windows_v1",
    "saved_runs": "run_table",
}.items():
    ORACLES[stored] = ORACLES[plain]
for scan in ("scan_events", "scan_managed"):
    oracle(scan, "ID EventTime:t Status Value:d", 'SELECT id AS "ID", time AS "EventTime", status AS "Status", value AS "Value" FROM samples_e')
oracle("scan_metadata", "ID Description UoM", """SELECT id AS "ID", description AS "Description", 'C' AS "UoM" FROM meta""")
oracle(
    "store_around",
    "error ID EventTime:t Status Value:d",
    """SELECT e.error, s.id AS "ID", s.time AS "EventTime", s.status AS "Status", s.value AS "Value"
       FROM (SELECT id AS error, date_trunc('second', min(time)) AS at FROM samples_e WHERE status = 'Bad' GROUP BY id) e
       JOIN samples_e s ON s.time >= e.at - INTERVAL 1 HOUR AND s.time < e.at + INTERVAL 1 HOUR""",
)
oracle(
    "saved_buckets",
    "unit run_id:m end:t n:i feed:d",
    """SELECT unit, run_id, run_end AS "end", count(*) AS n, sum(feed_total) AS feed FROM rows_f WHERE run_id IS NOT NULL GROUP BY 1, 2, 3""",
)
oracle("unit_tags", "id unit role grp", "SELECT * FROM tags WHERE unit IN ('1HC', 'PLANT')")
oracle(
    "role_ids",
    "id grp",
    """SELECT id, 'all' AS grp FROM tags WHERE role = 'feed_flow' AND unit IN ('1HC', 'PLANT')
       UNION ALL SELECT id, 'B' FROM tags WHERE role = 'feed_flow' AND unit IN ('1HC', 'PLANT') AND grp = 'B'""",
)
oracle("sensor_passes", "unit id grp", "SELECT * FROM tags WHERE role = 'tube_COT' AND grp IS NOT NULL")
