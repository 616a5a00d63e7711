"""The given tables seen as sensor histories.

``lineitem`` is a plant: supplier = unit, ship date = time, line number = sensor.  All roles of a
line share its key, so the rows are averaged per (unit, line number, bucket) first and spread over
the roles afterwards.  ``events`` is a plant with bad samples and irregular times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bucket, steady_mean
from ..settings import PLANT, Settings
from ..sources.tables import stage_by

WEEK = 7 * 86400

# Durations are multiples of the weekly bucket; levels follow the value ranges of the columns.
WEEKLY = Settings(
    bucket_s=WEEK,
    hot=5000.0,
    min_gap_hours=336.0,
    min_run_days=28.0,
    edge_hours=336.0,
    baseline_hours=672.0,
    rate_hours=1344.0,
    warmup_hours=672.0,
    settled_frac=0.5,
    cot_std=900.0,
    air_on=20.0,
    setpoint_step=2500.0,
    setpoint_std=900.0,
    cp_penalty=1.0,
    cp_min_rows=4,
    red_hours=1344.0,
    warmup_amber_hours=1008.0,
    tail_amber_hours=672.0,
    context_hours=336.0,
    band_hours=672.0,
    fleet_hours=1344.0,
    prealarm=30000.0,
    alarm=45000.0,
    spike=40000.0,
    spike_hours=504.0,
    max_lag=8,
    tail_rows=8,
    phase_edges=(0.0, 35.0, 70.0, 105.0, 140.0, 700.0),
    phase_min_rows=10,
)
HALF_DAY = Settings(bucket_s=43200, min_gap_hours=24.0, min_run_days=2.0)

# One value per line and role.
LINE_ROLES = {
    "tube_COT": "l_extendedprice",
    "feed_flow": "l_quantity",
    "dil_steam": "l_quantity * l_tax",
    "cot_ctrl": "l_extendedprice / l_quantity",
    "effluent_GC": "l_tax",
    "coil_out_P": "1.5 + l_tax",
    "draft": "0.0 - l_discount",
    "feed_coilT": "300.0 + l_quantity",
    "decoke_air": "CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END",
    "tube_COT_long": "l_extendedprice * 1.0625",
}
LINES_PER_TASK = 100_000
SAMPLES_PER_TASK = 50_000
LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
CORE = ("tube_COT", "feed_flow", "dil_steam", "cot_ctrl")
FULL = tuple(r for r in LINE_ROLES if r not in ("tube_COT_long", "decoke_air"))
# Composition named by a line number's analyser; line 6 repeats one, line 7 names none.
EFFLUENT = ("C2H4", "C3H6", "CH4", "C2H6", "C3H8", "C2H4", "H2")
FEED = ("C2H6", "C3H8", "C4H10", "C5+", "CO2", "C2H6", "H2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pass() -> Column:
    """Pass letter of a line number, A-D in turn."""
    return F.substring(F.lit("ABCD"), (F.col("l_linenumber") - 1) % 4 + 1, F.lit(1))


def line_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("time", F.col("l_shipdate").cast("timestamp"))


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Number of tasks, or buckets of units, that the lines are dealt to."""
    return max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK)


def line_history(
    spark: SparkSession, sf_dir: str, roles=CORE, plant: bool = False, bucket_s: int = WEEK, kept: bool = False
) -> DataFrame:
    """Bucketed history (unit, id, role, grp, ts, value) of the chosen roles.

    Nearly every line is a cell of its own, so sums of cells would be wider than the lines: the bare columns are distributed by unit
    instead, and every later step by unit, or unit and time, finds its rows together.  ``kept``: the cells are written in buckets of
    units, for queries of several passes, which would each distribute the lines anew.
    """
    lines = line_times(spark, sf_dir).withColumn("ts", bucket("time", bucket_s))
    own = lines.withColumn("unit", F.col("l_suppkey").cast("string")).select("unit", "l_linenumber", "ts", *LINE_COLUMNS)
    tasks = line_tasks(spark, sf_dir)
    means = own.repartition(tasks, "unit").groupBy("unit", "l_linenumber", "ts").agg(
        *[steady_mean(F.expr(LINE_ROLES[r])).alias(r) for r in roles]
    )
    if kept:
        means = stage_by(means, "cells", ("unit",), tasks, ("unit", "ts"))
    per_role = F.explode(
        F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("value")) for r in roles])
    )
    whole = F.col("x.role").isin("cot_ctrl", "effluent_GC", "coil_out_P", "draft", "feed_coilT")
    out = means.select("unit", "l_linenumber", "ts", per_role.alias("x")).select(
        "unit",
        F.concat_ws(":", "unit", "x.role", F.col("l_linenumber").cast("string")).alias("id"),
        "x.role",
        F.when(~whole, _pass()).alias("grp"),
        "ts",
        "x.value",
    )
    return out.unionByName(_plant_history(lines)) if plant else out


def _plant_history(lines: DataFrame) -> DataFrame:
    """Feed analysers: one tag per line number for the whole plant."""
    return (
        lines.groupBy("l_linenumber", "ts")
        .agg(steady_mean("l_discount").alias("value"))
        .select(
            F.lit(PLANT).alias("unit"),
            F.concat_ws(":", F.lit(PLANT), F.lit("feed_GC"), F.col("l_linenumber").cast("string")).alias("id"),
            F.lit("feed_GC").alias("role"),
            F.lit(None).cast("string").alias("grp"),
            "ts",
            "value",
        )
    )


def line_catalog(spark: SparkSession, sf_dir: str, roles=CORE, plant: bool = False) -> DataFrame:
    """Catalog of the tags ``line_history`` returns, from the (supplier, line number) pairs present."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    unit = F.col("l_suppkey").cast("string")
    ln = F.col("l_linenumber")
    role = F.explode(F.array(*[F.lit(r) for r in roles]))
    whole = F.col("role").isin("cot_ctrl", "effluent_GC", "coil_out_P", "draft", "feed_coilT")
    species = F.element_at(F.array(*[F.lit(s) for s in EFFLUENT]), ln)
    out = pairs.withColumn("role", role).select(
        F.concat_ws(":", unit, "role", ln.cast("string")).alias("id"),
        unit.alias("unit"),
        "role",
        F.when(F.col("role") == "effluent_GC", F.concat(F.lit("1-H-1A "), species)).alias("description"),
        F.lit(None).cast("string").alias("uom"),
        ln.alias("ord"),
        F.when(~whole, _pass()).alias("grp"),
    )
    if not plant:
        return out
    feed = F.element_at(F.array(*[F.lit(s) for s in FEED]), ln)
    analysers = pairs.select("l_linenumber").distinct().select(
        F.concat_ws(":", F.lit(PLANT), F.lit("feed_GC"), ln.cast("string")).alias("id"),
        F.lit(PLANT).alias("unit"),
        F.lit("feed_GC").alias("role"),
        F.concat(F.lit("FEED TO FUR "), feed).alias("description"),
        F.lit(None).cast("string").alias("uom"),
        ln.alias("ord"),
        F.lit(None).cast("string").alias("grp"),
    )
    return out.unionByName(analysers)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw samples (ID, EventTime, Status, Value); errors are bad samples."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("ID"),
        F.col("ts").cast("timestamp").alias("EventTime"),
        F.when(F.col("event_type") == "error", F.lit("Bad")).otherwise(F.lit("Good")).alias("Status"),
        F.col("value").alias("Value"),
    )


def event_variant_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same samples with the variant value found in the event properties."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("ID"),
        F.col("ts").cast("timestamp").alias("EventTime"),
        F.when(F.col("event_type") == "error", F.lit("Bad")).otherwise(F.lit("Good")).alias("Status"),
        F.expr("variant_get(parse_json(props), '$.k', 'variant')").alias("Value"),
    )


def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of ``events``: the event type is the role, the user the unit."""
    return (
        table(spark, sf_dir, "events")
        .select("user_id", "event_type")
        .distinct()
        .select(
            F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"),
            F.col("user_id").cast("string").alias("unit"),
            F.col("event_type").alias("role"),
            F.lit(None).cast("string").alias("grp"),
        )
    )


def part_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as tag metadata: key and size decide the naming scheme, so every rule finds rows.

    Includes the odd cases: blank descriptions, bearings, numbers out of range, a letter I for the
    digit 1, double spaces, blocks outside the plant.
    """
    k = F.col("p_partkey")
    letter = F.chr(F.lit(65) + (k.cast("int") % 7))
    grp = F.chr(F.lit(65) + (k.cast("int") % 4))
    kind = F.floor(k / 28) % 14
    n3 = F.lpad((k % 210).cast("string"), 3, "0")
    digit = (k % 7 + 1).cast("string")
    serial = F.lpad((k % 10000).cast("string"), 4, "0")
    fc = F.concat(F.lit("01FC"), serial, F.lit(".PV"))

    def pick(*values):
        out = F.lit(None).cast("string")
        for i, v in reversed(list(enumerate(values))):
            out = F.when(kind == i, v if not isinstance(v, str) else F.lit(v)).otherwise(out)
        return out

    sensor = F.concat(F.lit("01TI"), digit, n3, F.lit("A.PV"))
    ids = pick(
        sensor,
        sensor,
        F.concat(F.lit("01TI"), digit, n3, F.lit("B.PV")),
        F.concat(F.lit("01TI"), F.lpad((k % 20 * 100 + 2).cast("string"), 4, "0"), F.lit(".PV")),
        fc,
        fc,
        fc,
        fc,
        F.concat(F.lit("01TC"), serial, F.lit(".PV")),
        F.concat(F.lit("01PI"), serial, F.lit(".PV")),
        F.concat(F.lit("01PC"), serial, F.lit(".PV")),
        F.concat(F.lit("01TI"), serial, F.lit(".PV")),
        F.concat(F.lit("01AI1"), (k % 7 + 3).cast("string"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(".PV")),
        F.concat(F.lit("01AI01"), (k % 3).cast("string"), (k % 10).cast("string"), F.lit(".PV")),
    )
    gas = F.element_at(F.array(*[F.lit(s) for s in ("CH4", "C2H4", "C2H6", "C3H6", "C3H8", "O2")]), (k % 6 + 1).cast("int"))
    desc = pick(
        F.when(k % 3 == 0, F.concat(F.lit("H-1"), letter, F.lit(" TUBE CUR COT"))),
        F.when(k % 2 == 0, F.lit("Main brg temp")).otherwise(F.lit("")),
        F.lit(None).cast("string"),
        F.concat(F.lit(" BANK #"), grp, F.lit(" PQE #"), (k % 4 + 5).cast("string"), F.lit(" ")),
        F.concat(F.lit("H1"), letter, F.lit(" FD  #"), grp, F.lit(" PASS")),
        F.concat(F.lit("HI"), letter, F.lit(" FD #"), grp, F.lit(" PASS")),
        F.concat(F.lit("H1"), letter, F.lit(" DS "), F.when(k % 2 == 0, F.lit("#")).otherwise(F.lit("")), grp, F.lit(" PASS")),
        F.concat(F.lit("FUR "), letter, F.lit(" PASS"), F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("")), grp, F.lit(" DECOKE AIR")),
        F.concat(F.lit("H-1"), letter, F.lit(" COT")),
        F.concat(F.lit("EFFL FM  1-E-1"), (k % 3 + 5).cast("string"), letter),
        F.concat(F.lit("H1"), letter, F.lit(" CONV DRAFT")),
        F.concat(F.lit("FD COIL 1-H-1"), letter),
        F.concat(F.lit("1-H-1"), letter, F.lit(" "), gas),
        F.concat(F.lit("FEED "), F.when(k % 2 == 0, F.lit("TO ")).otherwise(F.lit("")), F.lit("FUR "), gas),
    )
    return table(spark, sf_dir, "part").select(ids.alias("ID"), desc.alias("Description"), F.lit("C").alias("UoM"))
