"""The query catalogue against DuckDB, and the parts that SQL cannot say against closed forms."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import units, weather
from gridlake.operators import aggregate, kernels, select
from gridlake.plans import catalogue, registry
from gridlake.plans.query import Query
from gridlake.sources import catalog
from gridlake.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(v):
    return round(v, 4) if isinstance(v, float) else v


NEW = (
    "merge_variables clip_separated month_filter scenario_intersect top_months_fs fs_statistic warming_slice snapshot_mean first_true category_order first_options facet_regex year_day_date batch_concat batch_points "
    "block_max_grouped vulnerability_days vulnerability_percentile vulnerability_table persistence_year anomaly remove_season_cycle profile_value n_day_resample block_max_two_year facet_contains"
).split()


@pytest.mark.parametrize("name", ["flagship_monthly_max", "clip_points", "nearest_3x3_fill", "metric_sum", "metric_percentiles", "block_max_sustained", "exceed_sustained", "multi_model_stats", "hist_cdf", "rolling_centred_even", "paired_difference", "heat_index", "ess", "slp", "fosberg_by_name", "unit_ms_to_mph", *NEW])
def test_twin(spark, duck, name):
    df, rel = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted([tuple(same(r[c]) for c in cols) for r in df.collect()], key=repr) == sorted([tuple(same(r[i]) for i in at) for r in rel.fetchall()], key=repr)


def test_missing_values(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "k string, v double")
    assert {r.k: r.v for r in aggregate.metric(df, ["k"], "v", "sum").collect()} == {"a": 2.0, "b": 0.0}
    assert {r.k: r.v for r in aggregate.metric(df, ["k"], "v", "mean").collect()} == {"a": 2.0, "b": None}


def test_steps_run_by_priority(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 30.0)], "k int, v double").withColumn("time", F.lit("1996-02-29 00:00:00").cast("timestamp_ntz"))
    q = Query(df).step("metric", kind="max", key=["k"]).step("convert_units", unit="degC", to="degF").where(k=2)
    assert [tuple(r) for r in q.plan().collect()] == [(2, 86.0)]
    assert q.step("drop_leap_days").plan().isEmpty()
    with pytest.raises(ValueError):
        q.step("unknown")


def test_bounds():
    assert select.bound(1996, True).isoformat() == "1996-12-31T23:59:59" and select.bound("1996-03-04", True).hour == 0


def test_closest():
    assert catalog.closest("TASMAX", ["tasmax", "tasmin"]) == ["tasmax"] and catalog.closest("min", ["tasmax", "tasmin"]) == ["tasmin"]


def test_fits_recover_parameters():
    rng = np.random.default_rng(5)
    u = rng.random(5000)
    _, mu, s = kernels.fit_gumbel(10 - 2 * np.log(-np.log(u)))
    assert abs(mu - 10) < 0.15 and abs(s - 2) < 0.1
    xi, mu, s = kernels.fit_gev(10 + 2 * ((-np.log(u)) ** -0.2 - 1) / 0.2)
    assert abs(xi - 0.2) < 0.05 and abs(mu - 10) < 0.15 and abs(s - 2) < 0.1
    assert abs(kernels.quantile(kernels.cdf(12.0, (xi, mu, s)), (xi, mu, s)) - 12) < 1e-9


def test_kolmogorov_and_effective_size():
    assert abs(kernels.kolmogorov(1.3581) - 0.05) < 1e-3
    x = np.random.default_rng(1).normal(size=4000)
    y = np.zeros(4000)
    for i in range(1, 4000):
        y[i] = 0.5 * y[i - 1] + x[i]
    assert math.isclose(kernels.effective_size(y, positive_only=True), 4000 / 3, rel_tol=0.25)
    z = [3.0, 1.0, 4.0, 1.0, 5.0]
    d = np.array(z) - np.mean(z)
    r = [(d[: 5 - k] * d[k:]).sum() / (d * d).sum() for k in range(1, 5)]
    assert math.isclose(kernels.effective_size(z), 5 / (1 + 2 * sum((1 - k / 5) * r[k - 1] for k in range(1, 5))))
    w = y[:40]
    lags = np.geomspace(1, 10, 20).astype(int)
    assert math.isclose(kernels.effective_size_sampled(w), 40 / (1 + 2 * sum(np.corrcoef(w[:-k], w[k:])[0, 1] * (40 - k) / 40 for k in lags)))
    assert kernels.effective_size(np.ones(4)) == 4.0 and kernels.effective_size(np.zeros(0)) == 0.0 and kernels.effective_size_sampled(np.ones(40)) == 40.0


def test_formulas_by_hand(spark):
    df = spark.createDataFrame([(80.0, 10.0), (81.0, 5.0), (79.9, 90.0), (90.0, 70.0), (82.0, 95.0), (None, 5.0)], "t double, rh double")
    got = [r.x for r in df.select(weather.heat_index_f(F.col("t"), F.col("rh")).alias("x")).collect()]
    assert abs(got[0] - 78.17) < 1e-9 and abs(got[1] - 79.035) < 1e-9 and got[2] == 79.9 and round(got[3], 1) == 105.9 and round(got[4], 1) == 94.0 and got[5] is None
    one = spark.createDataFrame([(90000.0, 290.0, 0.005, 1000.0)], "p double, t double, q double, z double")
    assert abs(one.select(weather.sea_level_pressure(*map(F.col, "ptqz")).alias("x")).first().x / 100 - 1010.89) < 0.01
    assert set(registry.BUILT_IN.info("fosberg_fire_weather_index").depends_on) == {"t2", "q2", "psfc", "u10", "v10"}
    v, days = F.lit(2.0), F.lit(31)
    wanted = {("m s-1", "knots"): 3.887689, ("m/s", "mph"): 4.473872, ("Pa", "inHg"): 0.0005906, ("mm/h", "inches/h"): 2 / 25.4, ("kg kg-1", "g kg-1"): 2000.0, ("mm", "kg m-2 s-1"): 2 / 86400}
    for (a, b), x in wanted.items():
        assert math.isclose(spark.range(1).select(units.convert(v, a, b).alias("x")).first().x, x)
    assert math.isclose(spark.range(1).select(units.convert(v, "kg m-2 s-1", "inches", days).alias("x")).first().x, 2 * 31 * 86400 / 25.4)
    assert math.isclose(spark.range(1).select(units.convert(v, "mm", "kg m-2 s-1", days).alias("x")).first().x, 2 / 86400 / 31)
    assert spark.range(1).select(units.convert(v, "hPa", "Pa", compat=True).alias("x"), units.convert(v, "hPa", "Pa").alias("y")).first()[:] == (0.02, 200.0)
    with pytest.raises(ValueError):
        units.convert(v, "K", "mm")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, float(i), i * 600) for i in range(30)], "k int, v double, s long").select("k", "v", F.timestamp_seconds("s").alias("time"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.window_stats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, live.window_stats(rows, ["k"], "v").collect()))


def test_statistics_of_many_points(spark):
    rng = np.random.default_rng(8)
    lats, lons = [30.0, 30.5, 31.0, 33.0, 33.125, 40.0], [-120.0, -119.75, -119.0, -110.0]
    cells = spark.createDataFrame([(10 * i + j, a, b) for i, a in enumerate(lats) for j, b in enumerate(lons)] + [(99, 30.5, -119.0), (98, None, -119.0)], "cell_id long, lat double, lon double")
    df = spark.createDataFrame([(int(c), float(c * 7 % 13)) for c in rng.permutation(100)], "cell_id long, v double").withColumn("time", F.lit("1996-03-01 00:00:00").cast("timestamp_ntz"))
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(25, 45, 300), rng.uniform(-125, -105, 300), strict=True)]
    places += [(30.25, -119.375), (33.0625, -114.5), (None, -200.0), (1e300, float("nan")), (float("-inf"), 1e17), (30.5, -119.0)]
    rows = [(i % 290, *p) for i, p in enumerate(places)]  # some points have two places
    points = spark.createDataFrame(rows, "point int, at double, on double")
    stats = [F.count("*").alias("n"), F.max("v").alias("high"), F.avg("v").alias("mean")]

    def nearest(axis, x):
        return min(axis, key=lambda a: (0.0 if x is None or math.isnan(x) else abs(a - x), a))

    of_point = {}
    for k, a, b in rows:
        i, j = lats.index(nearest(lats, a)), lons.index(nearest(lons, b))
        of_point.setdefault(k, []).extend(c * 7 % 13 for c in [10 * i + j, *([99] if (i, j) == (1, 2) else [])])
    got = {r.point: (r.n, r.high, round(r["mean"], 9)) for r in select.batch_points(df, cells, points, stats=stats).collect()}
    assert got == {k: (len(v), max(v), round(sum(v) / len(v), 9)) for k, v in of_point.items()}
    one = spark.createDataFrame([(1, 5.0, 6.0)], "cell_id long, lat double, lon double")
    assert {r.cell_id for r in select.nearest_cells(one, [(4.0, 9.0), (5.0, 6.0)]).collect()} == {1}
