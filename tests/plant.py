"""A plant in closed form: no random numbers, every border known (7 units, 60 days, 30 minutes)."""

from pyspark.sql import functions as F

T0 = 1735689600  # 2025-01-01 00:00:00 UTC
STEP = 1800
STEPS = 2880
OUTAGE = (1500, 1519)


def steps(spark):
    df = spark.range(7).select(F.col("id").cast("int").alias("u")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    df = df.where(~F.col("i").between(*OUTAGE)).withColumn("L", 960 + 48 * F.col("u")).withColumn("age", F.col("i") % F.col("L"))
    on = (F.col("age") < F.col("L") - 48) & ~F.col("age").between(300, 303)
    return df.withColumn("on", on).withColumn("time", F.timestamp_seconds(F.lit(T0) + F.col("i") * STEP))


def letter(c):
    return F.chr(F.lit(65) + c)


def events(spark):
    """Raw events (ID, EventTime, Status, Value variant) under the plant's own tag names."""
    base = steps(spark)
    p = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p")
    feed = base.select("*", p).select(
        F.format_string("01FC%d%d01.PV", F.col("u"), F.col("p")).alias("ID"), "time",
        F.when(F.col("on"), 100.0 + F.col("p")).otherwise(0.0).alias("v"),
    )
    steam = base.select("*", p).select(
        F.format_string("01FC%d%d02.PV", F.col("u"), F.col("p")).alias("ID"), "time",
        F.when(F.col("on"), 30.0 + F.col("p") + 0.5 * (F.col("i") % 3)).otherwise(40.0).alias("v"),
    )
    cot = base.select(
        F.format_string("01TC%d.PV", F.col("u")).alias("ID"), "time", (830.0 + 0.5 * (F.floor(F.col("i") / 48) % 7)).alias("v")
    )
    s = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")
    tube = base.select("*", p).select("*", s).where((F.col("i") * 7 + F.col("s")) % 97 != 0)
    drift = F.when(F.col("on"), F.col("age") * F.col("s") / 64.0).otherwise(0.0)
    value = 820.0 + 2 * F.col("p") + 0.25 * F.col("s") + 0.5 * ((F.col("i") + F.col("s")) % 4) + drift
    dead = (F.col("p") == 3) & (F.col("s") == 3) & (F.col("i") % 100 < 5)
    tube = tube.select(
        F.format_string("01TI%d%03dA.PV", F.col("u") + 1, F.col("p") * 48 + F.col("s") + 1).alias("ID"), "time",
        F.when(dead, 0.0).otherwise(value).alias("v"),
    )
    gas = base.where("u = 0").select(F.lit("01AI011%d.PV") .alias("f"), "time", "i").select(
        F.lit("01AI0115.PV").alias("ID"), "time", (2.0 + 0.25 * (F.col("i") % 8)).alias("v")
    )
    rows = feed.union(steam).union(cot).union(tube).union(gas)
    bad = rows.where(F.col("ID").startswith("01TC")).select("ID", "time", F.lit(9999.0).alias("v"))
    good = rows.withColumn("Status", F.lit("Good")).union(bad.withColumn("Status", F.lit("Bad")))
    return good.select(F.col("ID"), F.col("time").alias("EventTime"), "Status", F.expr("CAST(v AS VARIANT)").alias("Value"))


def metadata(spark):
    rows = []
    for u in range(7):
        x = chr(65 + u)
        rows.append((f"01TC{u}.PV", f"H-1{x} COT", "C"))
        for p in range(4):
            q = chr(65 + p)
            rows.append((f"01FC{u}{p}01.PV", f"H1{x} FD #{q} PASS", "NM3/H"))
            rows.append((f"01FC{u}{p}02.PV", f"H1{x} DS #{q} PASS", "KG/H"))
            for s in range(4):
                rows.append((f"01TI{u + 1}{p * 48 + s + 1:03d}A.PV", None, "C"))
    rows.append(("01AI0115.PV", "FEED TO FUR C5+", "WT%"))
    return spark.createDataFrame(rows, "ID string, Description string, UoM string")


# Run lengths in days per unit, rounded to two decimals.
LENGTHS = {
    0: [18.98, 11.23, 7.31, 18.98],
    1: [19.98, 10.23, 9.31, 17.98],
    2: [20.98, 9.23, 11.31, 15.98],
    3: [21.98, 8.23, 13.31, 13.98],
    4: [22.98, 7.23, 15.31, 11.98],
    5: [23.98, 6.23, 17.31, 9.98],
    6: [24.98, 5.23, 19.31, 7.98],
}
