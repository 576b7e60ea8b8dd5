"""Array stores, boundary files, catalogs by name, whole analyses, and the query's own checks."""

import datetime as dt
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import aggregate, select
from gridlake.plans import recipes
from gridlake.plans.query import CHECKS, Query, register_check, steps
from gridlake.sources import catalog, shapes, zarr


def test_array_store_round_trip(spark, tmp_path):
    rows = [(dt.datetime(2001, 1, 1, h), 30.0 + y, -120.0 + x, float(100 * h + 10 * y + x)) for h in range(5) for y in range(3) for x in range(4) if (h, y, x) != (2, 1, 1)]
    rows += [(dt.datetime(2001, 1, 1, 6), 31.0, -119.0, None), (None, 31.0, -119.0, 1.0)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, t2 double")
    for kind in (None, "zlib", "gzip", "zstd"):
        store = str(tmp_path / f"s{kind}.zarr")
        zarr.write(df, store, "t2", ["time", "lat", "lon"], "t2", [2, 2, 3], kind)
        back = zarr.scan(spark, store, "t2")
        assert back.columns == ["time", "lat", "lon", "t2"]
        assert sorted(map(tuple, back.collect())) == sorted(r for r in rows if r[3] is not None and r[0])
    assert zarr.axis(spark, store, "lat").tolist() == [30.0, 31.0, 32.0]
    with pytest.raises(ValueError):
        zarr.scan(spark, store, "none")
    with pytest.raises(Exception, match="two rows"):
        zarr.write(df.union(df), str(tmp_path / "twice.zarr"), "t2", ["time", "lat", "lon"], "t2", [2, 2, 3])


def test_foreign_array_store(spark, tmp_path):
    """Fortran order, integers with a fill value, a missing chunk, a nested key, CF days, and stations as text."""
    store = tmp_path / "f.zarr"

    def put(name, meta, dims, chunks, **attributes):
        (store / name).mkdir(parents=True)
        (store / name / ".zarray").write_text(json.dumps({"zarr_format": 2, "filters": None, **meta}))
        (store / name / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **attributes}))
        for k, data in chunks.items():
            (store / name / k).parent.mkdir(parents=True, exist_ok=True)
            (store / name / k).write_bytes(data)

    data = np.array([[1, 2, 3], [4, -9, 6]], "<i2")
    put("time", {"shape": [2], "chunks": [2], "dtype": "<i8", "order": "C", "fill_value": 0, "compressor": None}, ["time"], {"0": np.array([0, 31], "<i8").tobytes()}, units="days since 2000-01-01")
    put("station", {"shape": [4], "chunks": [4], "dtype": "<U2", "order": "C", "fill_value": "", "compressor": None}, ["station"], {"0": np.array(["a", "bb", "c", "d"], "<U2").tobytes()})
    meta = {"shape": [2, 4], "chunks": [2, 3], "dtype": "<i2", "order": "F", "fill_value": -9, "compressor": {"id": "zlib"}, "dimension_separator": "/"}
    put("v", meta, ["time", "station"], {"0/0": zlib.compress(data.tobytes("F"))})
    got = sorted((r.time.month, r.station, r.v) for r in zarr.scan(spark, str(store), "v").collect())
    assert got == [(1, "a", 1.0), (1, "bb", 2.0), (1, "c", 3.0), (2, "a", 4.0), (2, "c", 6.0)]


def shapefile(path, polygons):
    body, rows = b"", b""
    for i, (name, rings) in enumerate(polygons):
        points = [p for r in rings for p in r]
        first = [sum(map(len, rings[:k])) for k in range(len(rings))]
        record = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *first) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", i + 1, len(record) // 2) + record
        rows += b" " + name.encode().ljust(10)
    (path / "b.shp").write_bytes(struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + body)
    field = b"NAME\0\0\0\0\0\0\0C" + bytes(4) + bytes([10, 0]) + bytes(14)
    (path / "b.dbf").write_bytes(struct.pack("<B3xIHH20x", 3, len(polygons), 32 + 32 + 1, 11) + field + b"\r" + rows + b"\x1a")
    return str(path / "b.shp")


def test_shapefile_clip(spark, tmp_path):
    square = lambda a, b, n: [(a, b), (a, b + n), (a + n, b + n), (a + n, b), (a, b)]
    path = shapefile(tmp_path, [("west", [square(0, 0, 4), square(1, 1, 2)]), ("east", [square(4, 0, 4)]), ("east", [square(20, 20, 1)])])
    assert shapes.names(spark, path, "NAME") == ["east", "west"]
    cells = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 5.0, 1.0), (4, 20.5, 20.5), (5, 9.0, 9.0)], "cell_id int, lon double, lat double")
    assert sorted(r.cell_id for r in shapes.clip(cells, cells, path, "NAME").collect()) == [1, 3, 4]
    assert sorted((r.cell_id, r.name) for r in shapes.clip(cells, cells, path, "NAME", ["east"], separated=True).collect()) == [(3, "east"), (4, "east")]
    for wrong in (lambda: shapes.clip(cells, cells, path, "NAME", ["north"]), lambda: shapes.names(spark, path, "ID"), lambda: shapes.polygons(b"x")):
        with pytest.raises(ValueError):
            wrong()


def test_catalogs_by_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text("source_id,path\nm1,a\nm2,NA\n")
    known = catalog.Catalogs(spark)
    known.register("stations", str(tmp_path / "c.csv"))
    known.register("grids", spark.createDataFrame([("m1", "b", "daily")], "source_id string, path string, scale string"))
    assert known.names() == ["grids", "stations"] and known.open("Station").count() == 2 and known.whole().count() == 3
    assert known.holding(source_id="m1") == ["grids", "stations"] and known.holding(scale="daily") == ["grids"] and known.holding(source_id="m2") == ["stations"]
    with pytest.raises(KeyError):
        known.open("radar")
    shown = spark.createDataFrame([("a", "TRUE", "hourly, daily", "Dynamical"), ("b", "False", "daily", "Dynamical"), ("c", "true", "daily", "Statistical")], "v string, show string, timescale string, method string")
    assert [r.v for r in catalog.variables(shown, "Daily", "dynamical").collect()] == ["a"]


def test_query_discovery_checks_and_attributes(spark):
    df = spark.createDataFrame([("a", 1, 280.0), ("b", 2, 290.0)], "sim string, cell_id int, v double").withColumn("time", F.lit("1996-03-01 00:00:00").cast("timestamp_ntz"))
    q = Query(df).where(sim="a").step("update_attributes", source="made up", flag=True).step("convert_units", unit="K", to="degC")
    assert q.facet_names() == ["sim", "cell_id"] and q.describe() == {"facets": {"sim": "a"}, "steps": ["convert_units", "update_attributes"], "open": ["cell_id"]}
    meta = q.plan().schema["v"].metadata
    assert meta == {"source": "made up", "flag": "true", "history": "convert_units, update_attributes"}
    other = q.copy()
    other.steps["convert_units"]["to"] = "K"
    assert q.steps["convert_units"]["to"] == "degC"
    for wrong in (q.step("convert_units", unit="K", to="mm"), q.step("time_slice", start=1999, end=1998), q.step("one_in_x", key=["sim"], return_values=[1.0], event_duration=(3, "day"))):
        with pytest.raises(ValueError):
            wrong.plan()
    order = [n for n, _, _ in steps()]
    assert order.index("clip") < order.index("metric") < order.index("update_attributes") < order.index("export")

    @register_check("metric")
    def known(kind, key):
        if kind not in aggregate.METRICS:
            raise ValueError(kind)

    with pytest.raises(ValueError, match="mode"):
        q.step("metric", kind="mode", key=["sim"]).plan()
    CHECKS["metric"].remove(known)


def hourly(spark, years=3):
    """Years of hours from 2001 on; the second year is hotter in its first half and colder in its second."""
    n = F.col("id")
    d = recipes.common_hours(spark.range(1, years * 8760 + 1).withColumnRenamed("id", "i"), "i").withColumn("id", F.col("i") - 1)
    year = F.floor(n / 8760)
    t = 10 + 8 * F.sin(2 * math.pi * (n % 8760) / 8760) + 3 * F.sin(2 * math.pi * (n % 24) / 24) + F.when(year == 1, F.when(n % 8760 < 4380, 4.0).otherwise(-4.0)).otherwise(year * 0.1)
    return d.select(F.lit("s").alias("k"), "time", t.alias("t_c"), (t - 3).alias("dew_c"), (5 + t / 10).alias("wind"), F.greatest(t, F.lit(0.0)).alias("global_wh"), F.lit(1.0).alias("direct_wh"))


def test_common_hours_have_no_leap_day(spark):
    got = recipes.common_hours(spark.range(1, 5 * 8760 + 1).withColumnRenamed("id", "i"), "i")
    assert got.where(select.leap_day()).isEmpty() and got.select("time").distinct().count() == 5 * 8760
    assert got.agg(F.min("time"), F.max("time")).first()[:] == (dt.datetime(2001, 1, 1), dt.datetime(2005, 12, 31, 23))


def test_typical_shock_and_persistence_years(spark):
    h = hourly(spark).cache()
    tmy = recipes.typical_year(h, ["k"], ["t_c"]).cache()
    assert tmy.count() == 8760 and tmy.select("time").distinct().count() == 8760 and {r.year for r in tmy.select("year").distinct().collect()} <= {2001, 2003}
    for extreme, months in (("hot", range(1, 7)), ("cold", range(8, 13))):
        shock = recipes.shock_year(h, ["k"], "t_c", extreme, ["t_c"])
        assert {r.year for r in shock.where(F.col("month").isin(*months)).select("year").distinct().collect()} == {2002}
    kept = recipes.persistence_year(h, ["k"], "t_c", 1.0)
    assert kept.count() == 8760
    assert {(r.year, r.half) for r in kept.select("year", (F.col("hour") <= 4380).alias("half")).distinct().collect()} == {(1, True), (2, False)}
    last = recipes.persistence_year(h, ["k"], "t_c", 1.0, skip_last=True).where("hour > 8050").select("year").distinct().collect()
    assert {r.year for r in last} == {0}


def test_profiles_and_metrics(spark, tmp_path):
    h = hourly(spark, 2)
    p = recipes.standard_year(h, ["k"], "t_c").withColumn("warming_level", F.lit(1.5))
    paths = recipes.write_profiles(p, str(tmp_path), ["k"], "t_c", "profile", [1.5])
    assert paths[0].endswith("profile_near-future") and spark.read.csv(paths[0], header=True).count() == 8760
    zero = recipes.standard_year(h, ["k"], "t_c", baseline=h)
    assert zero.agg(F.max(F.abs("t_c"))).first()[0] == 0.0
    for wrong in ({}, {"threshold": 1.0, "percentile": 5}):
        with pytest.raises(ValueError):
            recipes.vulnerability(h, ["k"], "t_c", **wrong)
    once = recipes.vulnerability(h, ["k"], "t_c", one_in_x=[2.0], distribution="gumbel")
    assert once.columns[:2] == ["k", "one_in_x"] and once.count() == 1
    slp = h.limit(20).select("k", "time", F.lit(90000.0).alias("p"), F.lit(290.0).alias("t"), F.lit(0.005).alias("q"), F.lit(1000.0).alias("z"))
    got = [r.x for r in slp.withColumn("x", recipes.sea_level(slp, ["k"], "p", "t", "q", "z")).orderBy("time").collect()]
    assert got[:11] == [None] * 11 and all(abs(x / 100 - 1010.89) < 0.01 for x in got[11:])
