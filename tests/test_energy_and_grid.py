import math
import unicodedata

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomway.functions import energy as en
from loomway.functions import grid as gr
from loomway.functions import modes as md
from loomway.functions.text import ascii_fold, is_express_bus, normalise_ref, normalise_text


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_published_values(spark):
    stairs, stop, flat, g = one(spark, en.stairs_energy_kj(F.lit(10.0), F.lit(True), 70.0), en.stop_energy_kj(F.lit(16 / 3.6), F.lit(85.0)), en.walking_speed(F.lit(0.0), F.lit(1.3)), en.gradient_factor(F.lit(0.0)))
    assert stairs == pytest.approx(22.9, abs=0.05) and stop == pytest.approx(3.5, abs=0.05) and flat == pytest.approx(1.3) and g == 1


def test_bike_speed_solves_the_balance():
    r = np.random.default_rng(0)
    p, g, m = r.uniform(20, 300, 200), r.uniform(-0.02, 0.08, 200), r.uniform(70, 110, 200)
    v = en.bike_speed_np(p, g, m)
    need = v * (m * en.GRAVITY * (0.006 * np.cos(np.arctan(g)) + np.sin(np.arctan(g))) + 0.5 * 1.2 * 0.55 * v * v) / 0.976
    assert np.allclose(need, p)
    assert en.bike_speed_np(np.array([0.0, 0.0]), np.array([0.0, -0.1]), np.array([85.0, 85.0]))[0] == 0
    assert en.bike_speed_np(np.array([0.0]), np.array([-0.1]), np.array([85.0]))[0] > 5


def test_assisted_ride(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (-0.15,)], "g double")
    lit = F.lit
    r = df.select("g", en.ebike_ride("g", lit(80.0), lit(8.0), lit(250.0), lit(97.0), lit(1.5), lit(250.0), lit(25 / 3.6), lit(40 / 3.6)).alias("r")).select("g", "r.*").orderBy("g").collect()
    down, flat, up = r
    assert down.speed == pytest.approx(40 / 3.6) and down.motor_w == 0
    assert flat.speed <= 25 / 3.6 + 1e-9 and up.speed < flat.speed and up.motor_w > 0
    null = spark.createDataFrame([(None, 0.0, 85.0), (100.0, 0.0, 85.0)], "p double, g double, m double").select(en.bike_speed("p", "g", "m")).collect()
    assert null[0][0] is None and null[1][0] > 5


def test_cells(spark):
    cell, code, beyond, neg = one(spark, gr.cell_id(F.lit(2_800_450.0), F.lit(3_900_999.0), 1000), gr.cell_code(F.lit(2_800_450.0), F.lit(3_900_999.0), 1000), gr.cell_id(F.lit(0.0), F.lit(1e8), 1000), gr.cell_id(F.lit(-1.0), F.lit(1.0), 1000))
    assert cell == 2800 * 100_000 + 3900 and code == "CRS3035RES1000mN2800000E3900000" and beyond is None and neg is None
    kids, near, parsed = one(spark, gr.children(F.lit(cell), 1000, 200), gr.neighbours(F.lit(cell)), F.struct(*gr.parse_code(F.lit(code))))
    assert len(kids) == 25 and kids[0] == 14000 * 100_000 + 19500 and kids[1] == kids[0] + 1 and kids[5] == kids[0] + 100_000
    assert len(near) == 24 and cell not in near and tuple(parsed) == (2_800_000, 3_900_000, 1000)
    assert tuple(one(spark, F.struct(*gr.parse_code(F.lit("CRS3035RES1000mN28E39"))))[0]) == (None, None, None)
    assert tuple(one(spark, gr.tile_bounds(F.lit(12_345), F.lit(67_890), 10_000, 500))[0]) == (9_500, 59_500, 20_500, 70_500)
    with pytest.raises(ValueError):
        gr.children(F.lit(cell), 1000, 300)


def test_projection(spark):
    x, y = gr.project(F.lit(10.0), F.lit(52.0))
    assert one(spark, x, y) == pytest.approx((4_321_000.0, 3_210_000.0), abs=1e-6)
    x, y = gr.project(F.lit(5.0), F.lit(50.0))  # published test point of the projection
    assert one(spark, x, y) == pytest.approx((3_962_799.45, 2_999_718.85), abs=0.05)


def test_segment_distance(spark):
    d = lambda *v: gr.segment_distance(*(F.lit(float(x)) for x in v))
    assert one(spark, d(1, 1, 0, 0, 2, 0), d(-3, 4, 0, 0, 2, 0), d(3, 4, 0, 0, 0, 0)) == (1, 5, 5)


def test_text_keys(spark):
    rows = ["Ligne T 12", "line-5", "M2", "Té", "", None, "Æther Straße № 3", "L'Éclair"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = df.select("i", normalise_ref(F.col("t")), normalise_text(F.col("t")), ascii_fold("t")).orderBy("i").collect()
    assert [r[1] for r in got[:4]] == ["12", "5", "2", "e"] and got[4][1] == got[5][1] == "" and got[7][2] == "leclair"
    assert [r[3] for r in got[:4]] == ["Ligne T 12", "line-5", "M2", "Te"]
    assert one(spark, is_express_bus(F.lit("Liane 5"), F.lit(None).cast("string")), is_express_bus(F.lit("5"))) == (True, False)


def test_income_and_modes(spark):
    m = lambda s: md.income_midpoint(F.lit(s).cast("string"))
    assert one(spark, m("De 1 250 € à moins de 1 600 €"), m("Moins de 450 € (3 000 F)"), m("9 000 € ou plus"), m(""), m(None), m("ne sait pas")) == (1425, 225, 13500, None, None, None)
    f = lambda a, i, o: md.mode_group(F.lit(a).cast("double"), F.lit(i).cast("int"), F.lit(o).cast("int"))
    assert one(spark, f(3.2, 0, 1), f(3.2, 1, 1), f(3.2, None, 2), f(5.8, 0, 0), f(None, 0, 0), f(1.2, 0, 0), f(9999, 0, 0)) == ("car_passenger_carpool", "car_passenger_household", "car_passenger_carpool", "train", "other", "walk", "other")
    d = lambda s, t: md.density_class(F.lit(s).cast("string"), F.lit(t).cast("string"))
    assert one(spark, d("C", "8"), d("C", "5"), d("C", "1"), d("B", "8"), d("B", "0"), d("I", "8"), d("R", None), d(None, "8"), d("9", "8")) == ("dense", "intermediate", "sparse", "intermediate", "sparse", "sparse", "very_sparse", "intermediate", "intermediate")


def test_vehicle_tables():
    t = en.vehicle_tables("kh")
    assert t.wait_min["ter"] == 4 and t.wait_min["metro"] == pytest.approx(2 * (1 + 0.15**2))
    assert t.stairs_min["tram"] == 0 and t.stairs_kj["metro"] == pytest.approx(2.6 * t.stairs_min["metro"])
    assert math.isclose(t.ride_kj_per_min["intercites"], 1.5)


def test_fold_is_that_of_the_whole_of_unicode(spark):
    texts = ["ế ﬁ Ａ ² ĳ", "Ǆ ™ ½ ㎏", "𝐀𝟗", "İK ſ", "日本 straße", "é", "Ŀa", None, "", "plain", "a" * 5000 + "ﬁ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode() for t in texts]
    got = df.select("i", ascii_fold(F.col("t")).alias("f"), normalise_text(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.f for r in got] == want
    assert got[0].n == "efia2ij"
    assert [r.n for r in got] == ["".join(c for c in w.lower() if c.isalnum()) for w in want]


def test_references(spark):
    texts = ["Ligne 12", "  line-A", "T3a", "M 14", "L", "l.e", "tram", "T-", "ligneT4", "LIGNE  T : 5", "linea", "t--a", "É5", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(normalise_ref(F.col("t"))).collect()]
    assert got == ["12", "a", "3a", "14", "l", "e", "ram", "t", "4", "5", "a", "ta", "e5", ""]
