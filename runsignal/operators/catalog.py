"""Tag catalog: which unit, role and pass each tag belongs to.

Rules are plain data.  One pass over the metadata tests every rule per row and explodes the
matches, so the table is read once however many rules there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import PASSES, PLANT, SENSORS_PER_PASS, SENSORS_PER_UNIT

# ---- Fixed values: how this plant names its tags -------------------------------------------
SENSOR_ID = r"^01TI([1-7])(\d{3})A\.PV$"
NOT_A_SENSOR = r"(?i)BRG|TURB|CASNG|\bK[12]\b|GOV|INACT"
BLOCK_NUMBER = r"01[A-Z]+(\d+)"
FIRST_BLOCK, LAST_BLOCK = 8, 14  # hundreds blocks 8..14 are units A..G


@dataclass(frozen=True)
class Rule:
    role: str
    description: str        # searched in the trimmed description; "" accepts every row
    id: str                 # anchored at the start of the tag id
    unit_from: str          # "sensor_id", "block", "plant", or a pattern capturing the unit letter


RULES = (
    Rule("tube_COT", "", SENSOR_ID, "sensor_id"),
    Rule("tube_COT_long", r"BANK #[A-D] PQE #[58]\b", r"^01TI", "block"),
    Rule("feed_flow", r"H[1I][A-G]\s+FD\s*#\s*[A-D]", r"^01FC.*\.PV$", r"H[1I]([A-G])"),
    Rule("dil_steam", r"H[1I][A-G]\s+DS\s*#?\s*[A-D]", r"^01FC.*\.PV$", r"H[1I]([A-G])"),
    Rule("decoke_air", r"FUR [A-G] PASS\s?[A-D] DE-?COKE AIR", r"^01FC.*\.PV$", r"FUR ([A-G]) PASS"),
    Rule("cot_ctrl", r"H-1[A-G] COT", r"^01TC.*\.PV$", r"H-1([A-G]) COT"),
    Rule("coil_out_P", r"EFFL FM\s+1-E-1[56][A-G]", r"^01PI.*\.PV$", r"1-E-1[56]([A-G])"),
    Rule("draft", r"H1[A-G] CONV\s+DRAFT", r"^01PC.*\.PV$", r"H1([A-G])"),
    Rule("feed_coilT", r"FD COIL\s+1-H-1[A-G]", r"^01TI.*\.PV$", r"1-H-1([A-G])"),
    Rule("effluent_GC", r"1-H-1[A-G]\s+(?:CH4|C2H4|C2H6|C3H6|C3H8)", r"^01AI1[4-9]\d\d\.PV$", r"1-H-1([A-G])"),
    Rule("feed_GC", r"FEED (?:TO\s+FUR|FUR)", r"^01AI01[12]\d\.PV$", "plant"),
)

LABELLED_PASS = r"(?:#\s*|PASS\s?)([A-D])\b"
BANK_PASS = r"BANK #([A-D])"
# ---- end of fixed values --------------------------------------------------------------------


def _captured(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _sensor_number() -> Column:
    return _captured(F.col("id"), SENSOR_ID, 2).cast("int")


def _unit(rule: Rule) -> Column:
    if rule.unit_from == "plant":
        return F.lit(PLANT)
    if rule.unit_from == "sensor_id":
        return F.concat(F.lit("1H"), F.chr(F.lit(64) + _captured(F.col("id"), SENSOR_ID, 1).cast("int")))
    if rule.unit_from == "block":
        block = F.floor(F.expr(rf"try_cast(nullif(regexp_extract(id, r'{BLOCK_NUMBER}', 1), '') AS BIGINT)") / 100)
        return F.when(
            block.between(FIRST_BLOCK, LAST_BLOCK), F.concat(F.lit("1H"), F.chr(block - FIRST_BLOCK + 65))
        )
    return F.concat(F.lit("1H"), _captured(F.col("desc"), rule.unit_from))


def _matches(rule: Rule) -> Column:
    hit = F.col("id").rlike(rule.id)
    if rule.description:
        hit = hit & F.col("desc").rlike(rule.description)
    if rule.unit_from == "sensor_id":
        hit = hit & _sensor_number().between(1, SENSORS_PER_UNIT) & ~F.col("desc").rlike(NOT_A_SENSOR)
    return hit


def sensor_pass(number: Column) -> Column:
    """Pass letter of a sensor number, in blocks of 48, clamped to the first and last pass."""
    band = F.floor((number - 1) / SENSORS_PER_PASS)
    band = F.least(F.greatest(band, F.lit(0)), F.lit(len(PASSES) - 1))
    return F.substring(F.lit("".join(PASSES)), band.cast("int") + 1, F.lit(1))


def add_pass(catalog: DataFrame) -> DataFrame:
    """Add ``grp``: the pass of a tag, NULL for tags that serve the whole unit or plant."""
    desc = F.coalesce(F.col("description"), F.lit(""))
    role = F.col("role")
    return catalog.withColumn(
        "grp",
        F.when(role.isin("feed_flow", "dil_steam", "decoke_air"), _captured(desc, LABELLED_PASS))
        .when(role == "tube_COT_long", _captured(desc, BANK_PASS))
        .when(role == "tube_COT", sensor_pass(_sensor_number())),
    )


def build_catalog(metadata: DataFrame, rules=RULES) -> DataFrame:
    """(id, unit, role, description, uom, ord, grp); one row per tag and role it plays.

    ``ord`` is the position of the rule; within a rule tags are ordered by id.
    """
    base = metadata.select(
        F.col("ID").alias("id"),
        F.col("Description").alias("description"),
        F.col("UoM").alias("uom"),
        F.regexp_replace(F.coalesce(F.col("Description"), F.lit("")), r"^\s+|\s+$", "").alias("desc"),
    )
    found = F.array(
        *[
            F.when(
                _matches(r), F.struct(F.lit(i).alias("ord"), F.lit(r.role).alias("role"), _unit(r).alias("unit"))
            )
            for i, r in enumerate(rules)
        ]
    )
    labelled = (
        base.withColumn("m", F.explode(F.filter(found, lambda m: m.isNotNull() & m["unit"].isNotNull())))
        .groupBy("id", F.col("m.role").alias("role"))
        .agg(F.min(F.struct("m.ord", "description", "uom", "m.unit")).alias("f"))
        .select("id", "f.unit", "role", "f.description", "f.uom", "f.ord")
    )
    return add_pass(labelled)


def tags_for(catalog: DataFrame, unit: str, roles=None) -> DataFrame:
    """Tags of one unit; plant-wide tags always belong."""
    out = catalog.where((F.col("unit") == unit) | (F.col("unit") == PLANT))
    return out.where(F.col("role").isin(list(roles))) if roles is not None else out


def ids_for(catalog: DataFrame, unit: str, role: str, grp: str | None = None) -> DataFrame:
    out = tags_for(catalog, unit, [role])
    if grp is not None:
        out = out.where(F.col("grp") == grp)
    return out.orderBy("ord", "id").select("id")


def pass_map(catalog: DataFrame, role: str = "tube_COT", unit: str | None = None) -> DataFrame:
    """(unit, id, grp) of one sensor role, tags with a known pass only."""
    out = tags_for(catalog, unit, [role]) if unit else catalog.where(F.col("role") == role)
    return out.where(F.col("grp").isNotNull()).select("unit", "id", "grp")


def count_roles(catalog: DataFrame, roles=None) -> DataFrame:
    """Tags per unit and role, 0 where there are none."""
    roles = list(roles or [r.role for r in RULES])
    return catalog.groupBy("unit").pivot("role", roles).count().na.fill(0, roles)


def count_passes(catalog: DataFrame, role: str = "tube_COT") -> DataFrame:
    """Tags per unit and pass A-D of one role."""
    return (
        catalog.where((F.col("role") == role) & F.col("grp").isNotNull())
        .groupBy("unit")
        .pivot("grp", list(PASSES))
        .count()
        .na.fill(0, list(PASSES))
    )


def incomplete_passes(catalog: DataFrame, role: str = "tube_COT", expected: int = SENSORS_PER_PASS) -> DataFrame:
    """(unit, grp, n) where a pass does not have the expected number of sensors."""
    counts = count_passes(catalog, role)
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("grp"), F.col(p).alias("n")) for p in PASSES]))
    return counts.select("unit", pairs.alias("x")).select("unit", "x.grp", "x.n").where(F.col("n") != expected)


def choose_sensor_role(catalog: DataFrame, proxy: bool = False) -> DataFrame:
    """(unit, sensor_role): the wanted sensor set, or the other where a unit has no tag of it."""
    wanted, other = ("tube_COT_long", "tube_COT") if proxy else ("tube_COT", "tube_COT_long")
    has = F.bool_or(F.col("role") == wanted)
    return (
        catalog.where(F.col("role").isin(wanted, other))
        .groupBy("unit")
        .agg(F.when(has, F.lit(wanted)).otherwise(F.lit(other)).alias("sensor_role"))
    )
