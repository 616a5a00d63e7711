import pytest
from pyspark.sql import functions as F

from runsignal.operators import catalog as ct

ROWS = [
    ("01TI1048A.PV", None, ("tube_COT", "1HA", "A")),
    ("01TI1049A.PV", "", ("tube_COT", "1HA", "B")),
    ("01TI7192A.PV", "H-G TUBE CUR COT", ("tube_COT", "1HG", "D")),
    ("01TI1193A.PV", None, None),                                   # above 192
    ("01TI1000A.PV", None, None),                                   # number 0
    ("01TI1010A.PV", "Turb brg temp", None),                        # bearing
    ("01TI1012B.PV", None, None),                                   # duplex
    ("01TI0802.PV", " BANK #A PQE #5 ", ("tube_COT_long", "1HA", "A")),
    ("01TI1403.PV", "BANK #D PQE #8", ("tube_COT_long", "1HG", "D")),
    ("01TI1503.PV", "BANK #D PQE #8", None),                        # block outside the plant
    ("01TI0804.PV", "BANK #D PQE #88", None),
    ("01FC0605.PV", "HIE FD #A PASS", ("feed_flow", "1HE", "A")),   # letter I
    ("01FC0411.PV", "H1C FD  #D PASS", ("feed_flow", "1HC", "D")),  # two spaces
    ("01FC0412.PV", "H1C DS D PASS", ("dil_steam", "1HC", None)),   # no label to read the pass from
    ("01FC0413.PV", "H1C DS #B PASS", ("dil_steam", "1HC", "B")),
    ("01FC0414.PV", "FUR C PASSB DECOKE AIR", ("decoke_air", "1HC", "B")),
    ("01FC0415.PV", "FUR C PASS D DE-COKE AIR", ("decoke_air", "1HC", "D")),
    ("01TC0805.PV", "H-1A COT", ("cot_ctrl", "1HA", None)),
    ("01PI1404.PV", "EFFL FM 1-E-15G", ("coil_out_P", "1HG", None)),
    ("01PC0801.PV", "H1A CONV  DRAFT", ("draft", "1HA", None)),
    ("01TI0855.PV", "FD COIL 1-H-1A", ("feed_coilT", "1HA", None)),
    ("01AI1401.PV", "1-H-1A C2H4", ("effluent_GC", "1HA", None)),
    ("01AI1301.PV", "1-H-1A C2H4", None),
    ("01AI0115.PV", "FEED TO FUR C5+", ("feed_GC", "PLANT", None)),
    ("01FC0100.SP", "H1A FD #A PASS", None),
]


@pytest.fixture(scope="module")
def catalog(spark):
    meta = spark.createDataFrame([(i, d, "x") for i, d, _ in ROWS], "ID string, Description string, UoM string")
    return ct.build_catalog(meta)


def test_rules(catalog):
    got = {r.id: (r.role, r.unit, r.grp) for r in catalog.collect()}
    assert got == {i: want for i, _, want in ROWS if want}


def test_tag_may_play_several_roles(spark):
    meta = spark.createDataFrame([("01FC1.PV", "H1A FD #A H1A DS #A", "x")] * 2, "ID string, Description string, UoM string")
    assert sorted(r.role for r in ct.build_catalog(meta).collect()) == ["dil_steam", "feed_flow"]


def test_lookups(catalog):
    assert ct.tags_for(catalog, "1HC").where("unit = 'PLANT'").count() == 1
    assert [r.id for r in ct.ids_for(catalog, "1HC", "feed_flow", "D").collect()] == ["01FC0411.PV"]
    assert ct.pass_map(catalog, unit="1HA").count() == 2
    counts = {r.unit: r.asDict() for r in ct.count_passes(catalog).collect()}
    assert counts["1HA"] == {"unit": "1HA", "A": 1, "B": 1, "C": 0, "D": 0}
    assert {r.n for r in ct.incomplete_passes(catalog).where("unit = '1HG'").collect()} == {0, 1}
    roles = {r.unit: r for r in ct.count_roles(catalog).collect()}
    assert roles["1HC"].feed_flow == 1 and roles["PLANT"].tube_COT == 0


def test_fallback_sensor_set(catalog):
    only_proxy = catalog.where("NOT (unit = '1HA' AND role = 'tube_COT')")
    got = {r.unit: r.sensor_role for r in ct.choose_sensor_role(only_proxy).collect()}
    assert got["1HA"] == "tube_COT_long" and got["1HG"] == "tube_COT"


def test_old_cache_gets_pass_column(catalog):
    again = ct.add_pass(catalog.drop("grp"))
    assert again.where(~F.col("grp").eqNullSafe(ct.sensor_pass(F.lit(1))) & (F.col("id") == "01TI1048A.PV")).count() == 0
