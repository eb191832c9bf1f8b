"""Expectations on closed-form weather: sinusoidal years of known mean, amplitude and daily range."""
import math

import pytest
from pyspark.sql import functions as F

from graftline.functions import calendar as cal
from graftline.functions import numeric as nu
from graftline.functions import weather as wx
from graftline.operators import scoring as sc
from graftline.operators import spatial as sp
from graftline.plans.place_features import place_features

CLIMATES = {"temperate": (51.2, 10.5, 7.5, 3.5, 3), "tropical": (1.3, 27, 0.7, 4, 3), "arctic": (70, -2, 11, 3, 3), "hot": (33.4, 23, 11, 8.5, 3), "south": (-41, 11, 6, 3.5, 3),
            "mirror": (41, 11, 6, 3.5, 3), "warm": (33, 19.5, 5.5, 5, 3), "cold": (45, 6.5, 17, 5, 3), "cool": (45, 5.5, 15, 4.5, 3), "wet": (52, 10, 7, 3, 1), "desert": (23, 24.5, 10.5, 9, 40)}


def weather(spark):
    rows = spark.createDataFrame([(k, float(lat), float(tm), float(ta), float(dr), rain) for k, (lat, tm, ta, dr, rain) in CLIMATES.items()], "place_id string, lat double, tm double, ta double, dr double, rain int")
    d = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(3651))).alias("i")).withColumn("day", F.date_add(F.lit("2015-01-01").cast("date"), F.col("i")))
    m = F.col("tm") + F.col("ta") * F.cos(F.lit(2 * math.pi) * (F.dayofyear("day") - F.when(F.col("lat") >= 0, 200).otherwise(17)) / 365.25)
    return d.select("place_id", "lat", "day", (m + F.col("dr")).alias("tmax"), (m - F.col("dr")).alias("tmin"), F.when(F.col("i") % F.col("rain") == 0, 4.0).otherwise(0.0).alias("prcp"))


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features"))
    place_features(weather(spark)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows(features):
    return {r["place_id"]: r for r in features.collect()}


def test_place_features(features):
    f = rows(features)
    t = f["temperate"]
    assert 95 < t["bloom_vi"] < 140 and t["chill_mean"] > 1200 and t["hot32"] == 0 and t["koppen_code"][0] in "CD"
    assert t["n_cycles"] == 9 and len(t["gdd_curve"]) == 27 and f["south"]["n_cycles"] == 8
    assert f["tropical"]["tropical"] and f["tropical"]["chill_mean"] < 5
    assert f["arctic"]["no_bloom"] and f["arctic"]["bloom_label"] is None
    assert f["hot"]["hot32"] > 20
    assert abs(f["south"]["chill_mean"] - f["mirror"]["chill_mean"]) < 0.08 * f["mirror"]["chill_mean"]
    assert f["south"]["bloom_label"].split()[0] in ("Sep", "Oct", "Nov")
    assert f["wet"]["scab_events"] > f["desert"]["scab_events"]


def variety(spark, *records):
    base = dict(flower_group=3, harvest_doy=268, chill_hours=1000, hardiness_zone=5, heat_tolerance=3, colour_cool_nights=False, scab=3, canker=3, mildew=3, fire_blight=3, rust=3, climate_needs=None)
    schema = "variety_id string, flower_group int, harvest_doy int, chill_hours int, hardiness_zone int, heat_tolerance int, colour_cool_nights boolean, scab int, canker int, mildew int, fire_blight int, rust int, climate_needs string"
    return spark.createDataFrame([{"variety_id": i, **base, **r} for i, r in records], schema)


@pytest.fixture(scope="module")
def scores(spark, features):
    nothing = dict.fromkeys(["flower_group", "harvest_doy", "chill_hours", "hardiness_zone", "heat_tolerance", "colour_cool_nights", "scab", "canker", "mildew", "fire_blight", "rust"])
    v = variety(spark, ("plain", {}), ("low_chill", dict(chill_hours=300, hardiness_zone=8, heat_tolerance=4)), ("high_chill", dict(chill_hours=1400)), ("hardy", dict(harvest_doy=240, chill_hours=800, hardiness_zone=3)),
                ("tender", dict(harvest_doy=240, chill_hours=800, hardiness_zone=8)), ("early", dict(harvest_doy=215)), ("late", dict(harvest_doy=300)), ("resistant", dict.fromkeys(["scab", "canker", "mildew", "fire_blight", "rust"], 1)),
                ("susceptible", dict.fromkeys(["scab", "canker", "mildew", "fire_blight", "rust"], 5)), ("unknown", nothing))
    p = sc.prepare_places(features.withColumns({"fire_blight_status": F.lit("present"), "rust_present": F.lit(False)}))
    pairs = v.select("variety_id", F.explode(F.array(*[F.lit(k) for k in CLIMATES])).alias("place_id"))
    out = sc.score(pairs, v, p, sc.reference_place(p, "temperate")).select("variety_id", "place_id", "climate", "disease", "both", "label", "limiting", "harvest", "shift", "disease_assumed")
    return {(r["variety_id"], r["place_id"]): r for r in out.collect()}


def test_scores(scores):
    s = lambda v, p: scores[(v, p)]["climate"]                                  # noqa: E731
    assert s("plain", "temperate") >= 70 and s("plain", "tropical") <= 5 and s("plain", "arctic") == 0
    assert scores[("plain", "arctic")]["limiting"] == "season" and scores[("plain", "arctic")]["disease"] is None
    assert s("low_chill", "warm") > s("high_chill", "warm") + 15
    assert s("hardy", "cold") > s("tender", "cold") + 30
    assert s("early", "cool") > s("late", "cool")
    a, b = scores[("resistant", "wet")], scores[("susceptible", "wet")]
    assert a["disease"] > b["disease"] + 20 and a["climate"] == b["climate"] and b["both"] == min(b["climate"], b["disease"])
    assert scores[("plain", "temperate")]["shift"] == 0
    u = scores[("unknown", "temperate")]
    assert 0 <= u["climate"] <= 100 and u["disease_assumed"] and u["harvest"] is None
    assert s("plain", "desert") <= 15


def test_extrapolation(spark, features):
    two = features.where("place_id IN ('temperate', 'wet')").withColumn("lon", F.when(F.col("place_id") == "wet", 1.0).otherwise(0.0))
    pts = spark.createDataFrame([(1, 51.6, 0.5), (2, 51.2, 0.0), (3, -51.0, 0.0), (4, 0.5, -30.0)], "point_id int, lat double, lon double")
    out = {r["point_id"]: r for r in sp.extrapolate(pts, two, sp.knn_places(pts, two)).collect()}
    assert set(out) == {1, 2}
    lo, hi = sorted(r["chill_mean"] for r in two.collect())
    assert lo <= out[1]["chill_mean"] <= hi and len(out[1]["gdd_curve"]) == 27 and [x["place_id"] for x in out[2]["sources"]][0] == "temperate"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]


def test_small_functions(spark):
    L = F.lit
    r = one(spark, nu.piecewise(L(5.0), [(0, 0), (10, 1)]), nu.piecewise(L(-3.0), [(0, 0), (10, 1)]), nu.half_up(L(-2.5)), wx.chill_units(L(5.0), L(5.0)), wx.chill_units(L(30.0), L(20.0)), wx.chill_units(L(-5.0), L(-15.0)),
            wx.usda_zone(L(-28.0))["label"], wx.usda_zone(L(-17.7))["value"], cal.vi_label(L(0.0), L(False)), cal.vi_label(L(110.0), L(False)), cal.vi_label(L(0.0), L(True)), nu.ordinal(L(112)), nu.ordinal(L(23)),
            cal.year_span(F.array(L("2003"), L("1999"))), cal.parse_harvest(L("mid Sep-early Oct")), cal.parse_harvest(L("mid Foo")))
    assert list(r)[:6] == [0.5, 0.0, -2, 24.0, 0.0, 12.0]
    assert r["c6"] == "5a" and abs(r["c7"] - 7.0) < 0.05 and (r["c8"], r["c9"], r["c10"]) == ("Jan 1", "Apr 21", "Jul 1")
    assert (r["c11"], r["c12"], r["c13"], r["c14"], r["c15"]) == ("112th", "23rd", "1999-2003", 269, None)
    r = one(spark, F.transform(wx.resample(F.array(L(0.0), L(10.0)), L(5)), lambda x: x), wx.mills_hours(L(1.0)), wx.mills_hours(L(28.0)), wx.mills_hours(L(20.0)), nu.weeks_shift(L(-11)), nu.clamp(L(None).cast("double"), 0.0, 1.0))
    assert list(r["c0"]) == [0, 2.5, 5, 7.5, 10] and r["c1"] is None and r["c2"] is None and r["c3"] == 9 and r["c4"] == -2 and r["c5"] is None


def test_koppen(spark):
    def code(t, p, south=False):
        return one(spark, wx.koppen(F.array(*map(F.lit, map(float, t))), F.array(*map(F.lit, map(float, p))), F.lit(south)))["c0"]

    assert code([5, 5, 7, 9, 13, 16, 18, 18, 15, 11, 8, 5.5], [55, 40, 41, 44, 49, 45, 45, 50, 49, 69, 59, 55]) == "Cfb"
    assert code([27] * 12, [200] * 12) == "Af"
    assert code([-8, -6, 0, 7, 14, 18, 20, 19, 13, 7, 0, -6], [30, 25, 35, 60, 80, 90, 90, 85, 80, 60, 50, 35]) == "Dfb"
    assert code([14, 17, 21, 26, 32, 35, 36, 36, 33, 28, 21, 16], [5, 5, 5, 3, 1, 0, 0, 0, 0, 1, 3, 5]) == "BWh"


def test_in_polygon(spark):
    square = [(0, 0), (0, 10), (10, 10), (10, 0)]
    r = one(spark, sp.in_polygon(F.lit(5.0), F.lit(5.0), square), sp.in_polygon(F.lit(15.0), F.lit(5.0), square), sp.in_polygon(F.lit(-74.0), F.lit(42.0), __import__("graftline.fixed_values", fromlist=["x"]).RUST_RANGE))
    assert list(r) == [True, False, True]


def test_equal_distances_across_the_date_line(spark):
    """Places as far to the east as to the west take the order that the plain formula gives, in its own steps."""
    import math

    from graftline.operators import spatial

    def at(s):
        return (s, -55.0 + (s * 37) % 115, -180.0 + (s * 71) % 360)

    def km(p, q):
        a, b = (math.sin((y - x) * math.pi / 360) ** 2 for x, y in ((p[1], q[1]), (p[2], q[2])))
        return 2 * 6371 * math.asin(math.sqrt(a + math.cos(p[1] * math.pi / 180) * math.cos(q[1] * math.pi / 180) * b))

    points = [(c, -65 + (c * 53) % 140 + 0.25 * (c % 4), ((c * 97) % 720 - 360 + 0.5 * (c % 2) + 540) % 360 - 180.0) for c in (2147, 2481, 4667, 5001)]
    places = [at(s) for s in (2885, 5760, 3027, 5902)]
    got = spatial.knn_places(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(places, "place_id long, lat double, lon double")).collect()
    for p in points:
        near = sorted((km(p, q), q[0]) for q in places if (p[1] < 0) == (q[1] < 0) and km(p, q) <= 1500)[:4]
        assert [r["place_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["point_id"] == p[0]] == [s for _, s in near]
