"""Places, clocks, levels, profiles, files, registry and checks, against DuckDB or closed forms."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlake.operators import aggregate, climate, clock, kernels, levels, profiles, space
from gridlake.plans import catalogue, checks, derived, registry
from gridlake.plans.query import PRIORITY, RUN, Query, register_step
from gridlake.sources import catalog, exports, weather_files
from tests.test_catalogue import SF, duck, same  # noqa: F401 - duck is a fixture

DERIVED = [n for n, f in catalogue.QUERIES.items() if n in catalogue.ORACLE_SQL and f.__module__ == derived.__name__]


@pytest.mark.parametrize("name", DERIVED)
def test_twin(spark, duck, name):  # noqa: F811
    df, rel = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted([tuple(same(r[c]) for c in cols) for r in df.collect()], key=repr) == sorted([tuple(same(r[i]) for i in at) for r in rel.fetchall()], key=repr)


def hours(spark, start, n):
    return spark.range(n).select(F.lit("a").alias("k"), F.expr(f"timestampadd(HOUR, id, timestamp_ntz'{start}')").alias("time"), F.col("id").cast("double").alias("v"))


def test_quantiles_of_large_and_small_keys(spark):
    rng, q = np.random.default_rng(5), [0.0, 0.0002, 0.05, 0.5, 0.77, 0.9999, 1.0, 0.5]
    have = {
        "even": rng.random(5000), "tail": np.exp(rng.normal(0, 4, 5001)), "ties": rng.integers(0, 3, 6000).astype(float), "one": np.full(3000, 7.0),
        "small": rng.random(9), "two": np.array([1.0, 2.0]), None: rng.normal(0, 1, 4000),
    }
    rows = pd.DataFrame([(k, float(x)) for k, v in have.items() for x in v], columns=["k", "v"]).sample(frac=1, random_state=1)
    df = spark.createDataFrame(rows.astype({"k": object}), "k string, v double").repartition(7)
    df = df.unionByName(spark.createDataFrame([("none", None), ("none", float("nan")), ("even", None), ("tail", float("nan"))], "k string, v double"))
    got = {r.k: r.p for r in aggregate.quantiles(df, ["k"], "v", q, accuracy=500).collect()}
    assert set(got) == {*have, "none"} and (got["none"] is None or set(got["none"]) == {None})
    for k, v in have.items():
        assert got[k] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), k
    whole = np.concatenate(list(have.values()))
    assert aggregate.quantiles(df, [], "v", [0.3], accuracy=500).first().p[0] == pytest.approx(np.quantile(whole, 0.3), rel=1e-12)
    assert aggregate.quantiles(df.limit(0), ["k"], "v", q).isEmpty()


def test_local_time_gap_and_repeat(spark):
    spring = clock.to_local(hours(spark, "2020-03-08 06:00:00", 8), ["k"], "America/Los_Angeles", reindex=True).orderBy("time").collect()
    assert [r.time.hour for r in spring] == [22, 23, 0, 1, 2, 3, 4, 5, 6] and [r.v for r in spring][4] is None
    autumn = clock.to_local(hours(spark, "2020-11-01 07:00:00", 4), ["k"], "America/Los_Angeles", reindex=True).orderBy("time").collect()
    assert [(r.time.hour, r.v) for r in autumn] == [(0, 0.0), (1, 1.0), (2, 3.0)]
    leap = clock.to_local(hours(spark, "2020-03-01 02:00:00", 1), ["k"], "America/Los_Angeles", keep_common=True).first()
    assert (leap.time.month, leap.time.day) == (2, 28)


def test_polygon_with_hole_and_touching(spark):
    rings = space.parse_wkt("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))")
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 4.2, 2.0), (4, 9.0, 9.0), (5, None, 1.0)], "cell_id int, lon double, lat double")
    assert [r.cell_id for r in space.bridge(df, {"p": rings}).orderBy("cell_id").collect()] == [1]
    assert [r.cell_id for r in space.bridge(df, {"p": rings}, (0.25, 0.25)).orderBy("cell_id").collect()] == [1, 3]
    assert space.bridge(df, {}).count() == 0
    with pytest.raises(ValueError):
        space.parse_wkt("POINT(1 1)")


def test_derivative_is_exact_for_parabolas(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate((0.0, 0.1, 0.3, 0.35, 0.8))], "r int, i int, lon double").withColumn("lat", F.lit(0.0))
    df = df.withColumn("z", F.pow(F.radians("lon") * space.EARTH_RADIUS_M, F.lit(2)))
    for r in space.derivative(df, ["r"], "z", "i", "d").collect():
        assert abs(r.d - 2 * np.radians(r.lon) * space.EARTH_RADIUS_M) < 1e-3


def test_levels(spark):
    t = spark.createDataFrame([("Historical", 2000, 0.1, 0.4, 1.6), ("s", 2015, 0.5, 1.0, 1.7), ("s", 2016, 1.0, 1.6, 2.0), ("s", 2017, 1.7, 2.0, 2.5)], "scenario string, year int, low double, mean double, high double")
    assert tuple(levels.year_at_level(t, 1.5).first()) == ("s", 2000, 2016, 2017)
    assert [r.year for r in levels.timing(t.where("scenario = 's'"), [0.9, 1.5]).orderBy("level").collect()] == [None, 2016]
    assert [tuple(r) for r in levels.level_at_year(t, 2015).collect()] == [("s", 0.5, 1.0, 1.7)]
    dummy = levels.dummy_time(spark.createDataFrame([("a", i) for i in range(-1, 1500)], "k string, time_delta int"), ["k"]).orderBy("time_delta").collect()
    assert dummy[59].time == dt.datetime(2000, 3, 1) and dummy[365].time == dt.datetime(2001, 1, 1) and len({r.time for r in dummy}) == 1501
    assert levels.dummy_time(spark.createDataFrame([("a", 0), ("a", 25)], "k string, time_delta int"), ["k"], "HOUR").orderBy("time_delta").collect()[1].time == dt.datetime(2000, 1, 2, 1)


def test_month_joint_keeps_its_ends(spark):
    df = hours(spark, "2001-01-31 12:00:00", 24).withColumn("v", F.when(F.month("time") == 1, 0.0).otherwise(10.0))
    got = [r.v for r in profiles.smooth_joints(df, ["k"], ["v"]).orderBy("time").collect()]
    assert abs(got[6]) < 0.2 and abs(got[17] - 10) < 0.2 and got[5] == 0.0 and got[18] == 10.0 and 2 < got[11] < 8


def test_shock_month(spark):
    rows = [("a", dt.datetime(2000 + y, 1, d), float(d + shift)) for y, shift in enumerate((0, 50, -50)) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "k string, time timestamp_ntz, v double")
    assert [profiles.shock_months(df, ["k"], "v", e).first().year for e in ("hot", "cold")] == [2001, 2002]
    assert profiles.shock_months(df, ["k"], "v", "cold", skip_last=True).first().year == 2000


def test_8760_hours(spark, tmp_path):
    leap = hours(spark, "2020-01-01 00:00:00", 8784)
    short = hours(spark, "2021-01-01 00:00:00", 8760).where("v <> 1000.0")
    for df in (leap, short):
        got = weather_files.hours_8760(df, ["k"], ["v"])
        assert got.count() == 8760 and got.select("time").distinct().count() == 8760
    assert weather_files.hours_8760(short, ["k"], ["v"]).where("v = 999.0").count() == 2
    assert weather_files.problems(hours(spark, "2021-01-01 00:00:00", 100), ["k"]).count() == 1
    place = weather_files.Place("Town", 9, 1.0, 2.0, "CA", -8, 3.0, (2000, 2001))
    h = hours(spark, "2021-01-01 00:00:00", 2).select("k", "time", *[F.lit(1.5).alias(c) for c in weather_files.VALUES])
    weather_files.write(h, ["k"], place, str(tmp_path / "epw"))
    text = [r.value for r in spark.read.text(str(tmp_path / "epw" / "k=a")).collect()]
    assert len(text) == 10 and text[0].startswith("LOCATION,TOWN") and all(len(x.split(",")) == 35 for x in text[8:]) and text[9].startswith("2021,1,1,2,0,?9")
    assert weather_files.lines(h, ["k"], place, "tmy").where("n < 2").count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "k string, lat double, lon double, v double")
    for _ in range(2):
        exports.export(df, str(tmp_path), filename="x.csv", file_format="CSV", units={"v": "K"})
    assert (tmp_path / "x").exists() and (tmp_path / "x_1").exists()
    exports.export(df, str(tmp_path), filename="p", separated=True, location_based_naming=True)
    assert (tmp_path / "p" / "lat=1.0" / "lon=2.0").exists()
    exports.export(df, str(tmp_path), filename="p", export_method="skip_existing")
    assert not (tmp_path / "p_1").exists()
    assert exports.from_template("{name}_{lat}N", "a", 1.50) == "a_1.5N" and exports.readable(2048) == "2.00 KB" and exports.size_bytes(df, "csv") > 0
    for bad in ({"file_format": "tif"}, {"separated": 1}, {"filename": "../x"}, {"what": 1}):
        with pytest.raises(ValueError):
            exports.check(bad)


@pytest.mark.parametrize("kind", ["gamma", "weibull", "genpareto", "pearson3", "gev", "gumbel"])
def test_distributions_invert_and_fit(kind):
    rng = np.random.default_rng(3)
    x = {"gamma": 5 + 2 * rng.gamma(3, size=2000), "weibull": 1 + 4 * rng.weibull(1.7, size=2000), "genpareto": 3 + 20 * ((1 - rng.random(2000)) ** -0.1 - 1), "pearson3": -rng.gamma(4, size=2000)}.get(kind, rng.gumbel(size=2000))
    fit = kernels.FITS[kind][0](x)
    assert kernels.ks(x, kernels.cdf(x, fit, kind))[1] > 0.05
    assert np.allclose(kernels.cdf(kernels.quantile([0.1, 0.5, 0.99], fit, kind), fit, kind), [0.1, 0.5, 0.99], atol=1e-9)
    assert np.allclose(kernels.return_period(kernels.return_value([5.0, 50.0], fit, kind), fit, kind), [5, 50], rtol=1e-2)


def test_one_in_x_without_enough_blocks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", None)], "k string, v double")
    assert {tuple(r)[2:] for r in kernels.one_in_x(df, ["k"], "v", [10]).collect()} == {(None,) * 4}
    few = spark.createDataFrame([("a", float(i)) for i in range(9)], "k string, v double")
    assert kernels.one_in_x(few, ["k"], "v", [10], alpha=None).first().conf_low is None or np.isnan(kernels.one_in_x(few, ["k"], "v", [10], alpha=None).first().conf_low)


def test_two_sample_ks_by_hand(spark):
    df = spark.createDataFrame([("x", s, v) for s, v in zip("aaaabbbb", (1.0, 2.0, 3.0, 4.0, 3.0, 4.0, 5.0, 6.0), strict=True)] + [("y", "a", 1.0)], "k string, s string, v double")
    got = {r.k: r for r in kernels.two_sample_ks(df, ["k"], "v", "s", "a", "b").collect()}
    assert got["x"].statistic == 0.5 and abs(got["x"].p_value - kernels.kolmogorov(2**0.5 * 0.5)) < 1e-9 and got["y"].p_value is None


def test_quantile_delta_by_day_shifts_the_mean(spark):
    day = pd.date_range("2001-01-01", "2004-12-31")
    pdf = pd.DataFrame({"k": "a", "time": day, "h": np.sin(np.arange(len(day)) / 58.1), "t": np.sin(np.arange(len(day)) / 58.1)})
    df = spark.createDataFrame(pdf.assign(o=pdf.h + 2)).select("k", F.col("time").cast("timestamp_ntz").alias("time"), "o", "h", "t")
    got = kernels.quantile_delta_by_day(df, ["k"], "o", "h", "t").toPandas()
    assert len(got) == 365 * 4 and np.allclose(got.adjusted - got.t, 2)


def test_grouped_exceedance_counts_missing_as_none(spark):
    df = spark.createDataFrame([("a", dt.datetime(2000, m, d), v) for m, d, v in ((1, 1, 5.0), (1, 2, None), (2, 1, 6.0), (3, 1, 1.0))], "k string, time timestamp_ntz, v double")
    assert aggregate.grouped_exceedance(df, ["k"], "v", 4, group="month").first().n == 2
    assert aggregate.grouped_exceedance(df, ["k"], "v", 4, group="month", group_duration=2).first().n == 1
    with pytest.raises(ValueError):
        aggregate.grouped_exceedance(df, ["k"], "v", 4, group="year", period="month")


def test_registry(spark):
    r = registry.Registry()
    r.add("sum", ["a", "b"], lambda a, b: a + b, keep=True)

    @r.derived("twice", ["sum"], units="K")
    def twice(x):
        return x * 2

    df = spark.createDataFrame([(1, 2, 9)], "a int, b int, c int")
    assert r.apply(df, "twice").first().asDict() == {"a": 1, "b": 2, "c": 9, "twice": 6} and r.apply(df, "sum").columns == ["a", "b", "c", "sum"]
    assert r.missing("twice", ["a"]) == ["b"] and r.names() == ["sum", "twice"] and r.info("twice").units == "K"
    for bad in (("x", "a", abs), ("x", ["a"], 1), ("", ["a"], abs), ("x", ["a"], lambda p, q: p)):
        with pytest.raises(ValueError):
            r.add(*bad)
    r.add("loop", ["loop2"], abs)
    r.add("loop2", ["loop"], abs)
    for broken in (lambda: r.apply(df.drop("a"), "twice"), lambda: r.apply(df, "loop")):
        with pytest.raises(ValueError):
            broken()


def test_query_saves_and_takes_steps(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 30.0)], "k int, v double")
    q = Query(df).where(k=[1, 2]).step("metric", kind="max", key=["k"])
    assert Query(df).load(q.save()) == q and q.reset().steps == {}
    assert [r.k for r in q.options("k").collect()] == [1, 2]
    try:
        register_step("halve", 6)(lambda d, value: d.withColumn(value, F.col(value) / 2))
        assert sorted(r.v for r in q.step("halve").plan().collect()) == [5.0, 15.0]
        with pytest.raises(ValueError):
            register_step("halve", 6)(None)
    finally:
        RUN.pop("halve", None), PRIORITY.pop("halve", None)


def test_checks(spark):
    table = spark.createDataFrame([("KSFO", "San Francisco International (KSFO)"), ("KSAN", "San Diego International (KSAN)")], "ID string, station string")
    assert checks.stations(["ksfo", "diego"], table) == ["KSFO", "KSAN"] and checks.boundary("ALAMEDA", ["Alameda"]) == "Alameda"
    assert checks.expand("ssp", ["historical", "ssp370", "ssp585"]) == ["ssp370", "ssp585"] and "degC" in checks.unit_options("K")
    checks.time_slice(1990, "2000"), checks.box((1, 2), (3, 4)), checks.metric("max", [5], {"return_periods": [10]})
    bad = [
        (checks.stations, ("international", table)), (checks.stations, ("KXYZ", table)), (checks.facets, ("cadcat", {})), (checks.facets, ("cadcats", {})), (checks.steps, ("hdp", {"clip": 1})),
        (checks.time_slice, (2000, 1990)), (checks.convert_units, ("K", "m")), (checks.box, ((2, 1), (3, 4))), (checks.points, ([(99, 0)],)), (checks.boundary, ("x", ["a"])), (checks.warming_level, ([],)),
        (checks.metric, ("mode",)), (checks.metric, (None, None, {})), (checks.bias_adjust, (400,)), (checks.expand, ("zzz", ["a"])),
    ]
    for f, args in bad:
        with pytest.raises(ValueError):
            f(*args)


def test_catalog_inference_and_stations(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "catalog string, variable string, n int")
    assert catalog.infer(df, "catalog", variable="x") == "a" and catalog.infer(df, "catalog", n=1) is None and catalog.infer(df, "catalog", variable="z") is None
    assert catalog.resolve("cadcta", ["cadcat", "hdp"]) == "cadcat" and catalog.resolve("zzz", ["hdp"]) is None
    (tmp_path / "s.csv").write_text("ID,LON_X,LAT_Y\nKSFO,-122.4,37.6\nNone,nan,1\n")
    assert [tuple(r) for r in catalog.read_stations(spark, str(tmp_path / "s.csv")).select("ID", "lon", "lat").collect()] == [("KSFO", -122.4, 37.6)]


def test_weather_file_has_the_lines_of_all_stations(spark):
    lines = catalogue.QUERIES["weather_file_lines"](spark, SF)
    got = {r.station: r["count"] for r in lines.groupBy("station").count().collect()}
    hourly = catalogue.hourly(spark, SF).groupBy("station").agg(F.count_distinct(F.date_trunc("hour", "time")).alias("n"))
    assert got == {r.station: r.n + 8 for r in hourly.collect()} and len(got) > 1


def test_queries_take_all_bins_and_bootstrap_runs(spark, monkeypatch):
    fs = {tuple(r)[:3]: r.fs for r in climate.fs_statistic(catalogue.series(spark, SF), ["sim"], "v", bins=1023).collect()}
    best = {(s, m): min((v, y) for (a, b, y), v in fs.items() if (a, b) == (s, m))[1] for s, m, _ in fs}
    got = catalogue.QUERIES["top_month_rows"](spark, SF).select("sim", "month", "year").distinct().collect()
    assert {(r.sim, r.month): r.year for r in got} == best
    seen, real = [], climate.fs_statistic
    monkeypatch.setattr(climate, "fs_statistic", lambda df, key, value, bins=1023, *a: seen.append(bins) or real(df, key, value, bins, *a))
    catalogue.QUERIES["tmy_months"](spark, SF)
    assert seen == [1023]
    blocks = aggregate.block_extremes(catalogue.daily(spark, SF), ["sim"], "v")
    for name, want in [
        ("return_value_gamma", kernels.one_in_x(blocks, ["sim"], "v", [2, 10], "value", "gamma", runs=100)),
        ("return_probability", kernels.one_in_x(blocks, ["sim"], "v", [400000.0, 450000.0], "probability", "gumbel", runs=100)),
        ("return_period_gumbel", kernels.return_values(blocks, ["sim"], "v", [2, 10, 50], "gumbel", runs=100)),
    ]:
        assert sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect())) == sorted(map(repr, want.collect()))
