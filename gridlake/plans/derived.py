"""More queries of the catalogue: places, clocks, levels, profiles, tests and further formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import weather
from ..operators import aggregate, climate, clock, kernels, levels, profiles, select, space
from ..sources import catalog, weather_files
from . import catalogue, query, registry
from .catalogue import DAILY, DAY_SQL, GRID, HOURLY, SERIES, cells, counted, daily, day, grid, hourly, register, rounded, series

# Formulas

_F = "((t2 - 273.15) * 1.8 + 32)"
_E = "(0.611 * exp(2500000 / 461.0::DOUBLE * (1 / 273.0::DOUBLE - 1 / {})))"
_HI = "-42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh"
_c = F.col
_FORMULAS = {
    "rh_mixing": (
        lambda: weather.relative_humidity_mixing(_c("psfc") / 100, _c("t2") - 273.15, _c("rh") / 10),
        "(SELECT CASE WHEN r > 0.5 THEN least(r, 100.0) ELSE 0.5 END FROM (SELECT 100 * rh / 10 / (621.97 * e / (psfc / 100 - e)) AS r FROM (SELECT 6.11 * pow(10, 7.5 * (t2 - 273.15) / (237.7 + t2 - 273.15)) AS e)))",
    ),
    "dew_point_vapour": (
        lambda: weather.dew_point_vapour(_c("t2"), _c("rh") + 1),
        "1 / (1 / 273.0::DOUBLE - 0.0001844 * ln(exp(5423 * (1 / 273.0::DOUBLE - 1 / t2)) * (rh + 1) / 100))",
    ),
    "spec_hum_dew": (lambda: weather.specific_humidity_dew(_c("t2"), _c("psfc")), f"1000 * 0.622 * {_E.format('t2')} / (psfc / 1000)"),
    "rh_specific": (lambda: weather.relative_humidity_specific(_c("t2"), _c("rh") / 100, _c("psfc")), f"100 * (rh / 100 / 1000 * psfc / 1000) / (0.622 * {_E.format('t2')})"),
    "wind_dir_north": (lambda: weather.wind_direction_north(_c("u10"), _c("v10") + 0.5), "((90 - degrees(atan2(-(v10 + 0.5), -u10))) % 360 + 360) % 360"),
    "wind_rotate": (lambda: weather.rotate(_c("u10"), _c("v10"), F.lit(0.6), F.lit(0.8))[0], "u10 * 0.8::DOUBLE - v10 * 0.6::DOUBLE"),
    "hdd_mask": (lambda: weather.degree_masks(_c("t2"))[0].cast("double"), "(t2 < 291.483)::INT::DOUBLE"),
    "cdd_mask": (lambda: weather.degree_masks(_c("t2"))[1].cast("double"), "(t2 > 291.483)::INT::DOUBLE"),
    "monthly_precipitation": (lambda: weather.monthly_precipitation(_c("rh") / 1e7, _c("time")), 'greatest(rh / 1e7 * 86400 * day(last_day("time")), 0.1)'),
}
for _n, (_f, _sql) in _FORMULAS.items():
    register(_n, f"WITH {HOURLY} SELECT id, round({_sql}, 3) AS value FROM hourly")(lambda s, d, f=_f: hourly(s, d).select("id", F.round(f(), 3).alias("value")))
register(
    "heat_index_tools",
    f"""WITH {HOURLY}, f AS (SELECT id, rh, {_F} AS t FROM hourly), g AS (SELECT *, {_HI} AS hi, 0.5 * (t + 61 + (t - 68) * 1.2 + rh * 0.094) AS low FROM f)
    SELECT id, round(CASE WHEN t < 40 THEN t WHEN low < 80 THEN low WHEN rh > 85 AND t > 80 AND t < 87 THEN hi + (rh - 85) / 10 * (87 - t) / 5
    WHEN rh < 13 AND t > 80 AND t < 112 THEN hi - (13 - rh) / 4 * sqrt((17 - abs(t - 95)) / 17) ELSE hi END, 2) AS value FROM g""",
)(lambda s, d: hourly(s, d).select("id", F.round(weather.heat_index_simple_f((_c("t2") - 273.15) * 1.8 + 32, _c("rh")), 2).alias("value")))
register("derived_by_name", f"WITH {HOURLY} SELECT id, round(sqrt(u10 * u10 + v10 * v10), 4) AS wind_speed_10m FROM hourly")(
    lambda s, d: rounded(registry.BUILT_IN.apply(hourly(s, d), "wind_speed_10m").select("id", "wind_speed_10m"), "wind_speed_10m")
)

register(
    "require_all_facets", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 2) AND p_brand IN (SELECT p_brand FROM part WHERE p_size IN (1, 2) GROUP BY p_brand HAVING count(DISTINCT p_size) = 2)"
)(lambda s, d: catalog.require_all(s.read.parquet(f"{d}/part.parquet"), ["p_brand"], "p_size", [1, 2]).select("p_partkey", "p_brand", "p_size"))

# Aggregations and windows

register("metric_plus_percentiles", f"WITH {GRID} SELECT sim, round(avg(v), 4) AS v_mean, round(quantile_cont(v, 0.1), 4) AS v_p10, round(quantile_cont(v, 0.9), 4) AS v_p90 FROM grid GROUP BY sim")(
    lambda s, d: rounded(aggregate.metric_and_percentiles(grid(s, d), ["sim"], "v", "mean", [10, 90]), "v_mean", "v_p10", "v_p90")
)
register("daily_quantile", f"WITH {HOURLY}, a AS (SELECT sim, \"time\"::DATE AS d, max(t2) AS t2 FROM hourly GROUP BY ALL) SELECT sim, round(quantile_cont(t2, 0.95), 4) AS t2 FROM a GROUP BY sim")(
    lambda s, d: rounded(aggregate.daily_quantile(hourly(s, d), ["sim"], "t2", "max", 0.95), "t2")
)
register(
    "exceed_grouped",
    f"""WITH {DAILY}, g AS (SELECT sim, date_trunc('month', "time") AS t, coalesce(max((v > 300000)::INT), 0) AS e FROM daily GROUP BY ALL),
    r AS (SELECT sim, t, CASE WHEN count(e) OVER w = 2 THEN min(e) OVER w END AS e FROM g WINDOW w AS (PARTITION BY sim ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
    SELECT sim, year(t)::INT AS year, coalesce(sum(e), 0)::DOUBLE AS n FROM r GROUP BY ALL""",
)(lambda s, d: aggregate.grouped_exceedance(daily(s, d), ["sim"], "v", 300000, group="month", group_duration=2).select("sim", F.year("period").alias("year"), "n"))
_MONTHLY = f"""{DAILY}, monthly AS (SELECT sim, date_trunc('month', "time") AS "time", avg(v) AS v FROM daily GROUP BY ALL)"""


def monthly(s, d):
    return aggregate.resample(daily(s, d), ["sim"], "v", "month", "mean")


register(
    "rolling_day_weighted",
    f"""WITH {_MONTHLY} SELECT sim, {DAY_SQL}, CASE WHEN count(v) OVER w = 12 THEN round(sum(v * day(last_day("time"))) OVER w / sum(day(last_day("time"))) OVER w, 3) END AS v
    FROM monthly WINDOW w AS (PARTITION BY sim ORDER BY "time" ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""",
)(lambda s, d: monthly(s, d).select("sim", day(), F.round(aggregate.day_weighted_rolling(monthly(s, d), ["sim"], "v", 12), 3).alias("v")))
register("volcanic_years", f'WITH {GRID} SELECT sim, count(*) AS n, round(sum(v), 2) AS total FROM grid WHERE year("time") NOT IN (1991, 1992, 1993, 1994) GROUP BY sim')(lambda s, d: counted(profiles.drop_volcanic_years(grid(s, d))))
register(
    "edge_trim", f"WITH {GRID} SELECT sim, count(*) AS n, round(sum(v), 2) AS total FROM grid WHERE x_idx BETWEEN (SELECT min(x_idx) + 1 FROM grid) AND (SELECT max(x_idx) - 1 FROM grid) AND y_idx BETWEEN (SELECT min(y_idx) FROM grid) + 1 AND (SELECT max(y_idx) FROM grid) - 1 GROUP BY sim"
)(lambda s, d: counted(space.trim_edges(grid(s, d), 1)))

# Places

_TRIANGLE = "POLYGON((-124.2 31.8, -119.3 31.9, -121.7 36.3))"


def _right_of(a, b):
    (ax, ay), (bx, by) = a, b
    return f"(({ay}::DOUBLE > lat) <> ({by}::DOUBLE > lat) AND lon < ({bx - ax:.1f}::DOUBLE) * (lat - {ay}::DOUBLE) / ({by - ay:.1f}::DOUBLE) + ({ax}::DOUBLE))::INT"


_PTS = [(-124.2, 31.8), (-119.3, 31.9), (-121.7, 36.3)]
register(
    "clip_polygon",
    f"WITH {GRID} SELECT sim, count(*) AS n, round(sum(v), 2) AS total FROM grid WHERE ({' + '.join(_right_of(a, b) for a, b in zip(_PTS, _PTS[1:] + _PTS[:1], strict=True))}) % 2 = 1 GROUP BY sim",
)(lambda s, d: counted(select.clip_region(grid(s, d), space.bridge(cells(s, d), {"triangle": space.parse_wkt(_TRIANGLE)}), ["triangle"])))

_CELLMAX = f"""{GRID}, g AS (SELECT y_idx, x_idx, lat, lon, max(v) AS z FROM grid GROUP BY ALL)"""


def _slope_sql(line: str, along: str) -> str:
    w = f"OVER (PARTITION BY {line} ORDER BY {along})"
    at = {k: f"{'lag' if k < 0 else 'lead'}({{}}, {abs(k)}) {w}" for k in (-2, -1, 1, 2)}
    cols = ", ".join(f"{at[k].format(c)} AS {c}{n}" for k, n in ((-2, "p2"), (-1, "p1"), (1, "n1"), (2, "n2")) for c in ("z", "lat", "lon"))

    def gc(a, b):
        pick = lambda c, x: c if not x else c + x
        return f"2 * 6371229.0::DOUBLE * asin(sqrt(pow(sin(radians({pick('lat', b)} - {pick('lat', a)}) / 2), 2) + cos(radians({pick('lat', a)})) * cos(radians({pick('lat', b)})) * pow(sin(radians({pick('lon', b)} - {pick('lon', a)}) / 2), 2)))"

    return f"""(SELECT y_idx, x_idx, CASE WHEN hp1 IS NOT NULL AND hn1 IS NOT NULL THEN (hp1 * hp1 * zn1 + (hn1 * hn1 - hp1 * hp1) * z - hn1 * hn1 * zp1) / (hp1 * hn1 * (hp1 + hn1))
      WHEN hn2 IS NOT NULL THEN -(2 * hn1 + hn2) / (hn1 * (hn1 + hn2)) * z + (hn1 + hn2) / (hn1 * hn2) * zn1 - hn1 / (hn2 * (hn1 + hn2)) * zn2
      WHEN hp2 IS NOT NULL THEN (2 * hp1 + hp2) / (hp1 * (hp1 + hp2)) * z - (hp1 + hp2) / (hp1 * hp2) * zp1 + hp1 / (hp2 * (hp1 + hp2)) * zp2
      WHEN hn1 IS NOT NULL THEN (zn1 - z) / hn1 WHEN hp1 IS NOT NULL THEN (z - zp1) / hp1 END AS d
      FROM (SELECT *, {gc('p2', 'p1')} AS hp2, {gc('p1', '')} AS hp1, {gc('', 'n1')} AS hn1, {gc('n1', 'n2')} AS hn2 FROM (SELECT *, {cols} FROM g)))"""


register(
    "geostrophic_wind",
    f"""WITH {_CELLMAX}, a AS {_slope_sql("y_idx", "x_idx")}, b AS {_slope_sql("x_idx", "y_idx")}, n AS (SELECT *, 9.81 / (2 * 7.292115e-5::DOUBLE * sin(radians(lat))) AS k FROM g)
    SELECT y_idx::BIGINT AS y, x_idx::BIGINT AS x, round(-k * b.d, 3) AS u, round(k * a.d, 3) AS v FROM n JOIN a USING (y_idx, x_idx) JOIN b USING (y_idx, x_idx)""",
)(
    lambda s, d: space.geostrophic_wind(grid(s, d).groupBy("y_idx", "x_idx", "lat", "lon").agg(F.max("v").alias("z")), [], "z").select(
        F.col("y_idx").cast("long").alias("y"), F.col("x_idx").cast("long").alias("x"), F.round("u", 3).alias("u"), F.round("v", 3).alias("v")
    )
)

# Clocks

register("local_time", f"""WITH {HOURLY} SELECT id, strftime("time" - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS at FROM hourly""")(
    lambda s, d: clock.to_local(hourly(s, d).select("id", "time"), [], "America/Los_Angeles").select("id", F.date_format("time", "yyyy-MM-dd HH:mm").alias("at"))
)
register(
    "local_time_summer", f"""WITH {DAILY} SELECT k, strftime("time" + INTERVAL 12 HOUR - CASE WHEN "time" + INTERVAL 12 HOUR >= make_timestamp(year("time"), 4, 1, 10, 0, 0) + ((7 - dayofweek(make_date(year("time"), 4, 1))) % 7)::INT * INTERVAL 1 DAY
      AND "time" + INTERVAL 12 HOUR < make_timestamp(year("time"), 10, 31, 9, 0, 0) - dayofweek(make_date(year("time"), 10, 31))::INT * INTERVAL 1 DAY THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END, '%Y-%m-%d %H:%M') AS at FROM daily"""
)(
    lambda s, d: clock.to_local(daily(s, d).select("k", (F.col("time").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOUR")).alias("time")), [], "America/Los_Angeles").select("k", F.date_format("time", "yyyy-MM-dd HH:mm").alias("at"))
)
register("fixed_offset", f"""WITH {HOURLY} SELECT id, strftime("time" - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS at FROM hourly""")(
    lambda s, d: clock.fixed_offset(hourly(s, d).select("id", "time"), -8).select("id", F.date_format("time", "yyyy-MM-dd HH:mm").alias("at"))
)
register("gap_detection", f"""WITH {SERIES}, g AS (SELECT sim, "time", lead("time") OVER (PARTITION BY sim ORDER BY "time") AS n FROM series) SELECT sim, count(*) AS gaps FROM g WHERE n > "time" + INTERVAL 1 HOUR GROUP BY sim""")(
    lambda s, d: clock.gaps(series(s, d), ["sim"]).groupBy("sim").agg(F.count("*").alias("gaps"))
)
register(
    "dense_reindex", f"""WITH {SERIES}, a AS (SELECT DISTINCT "time" FROM series), k AS (SELECT DISTINCT sim FROM series) SELECT k.sim, count(*) AS n, count(v) AS given FROM k CROSS JOIN a LEFT JOIN series s ON s.sim = k.sim AND s."time" = a."time" GROUP BY k.sim"""
)(lambda s, d: clock.dense(series(s, d), ["sim"], series(s, d).select("time").distinct()).groupBy("sim").agg(F.count("*").alias("n"), F.count("v").alias("given")))

# Warming levels

_TRAJ = f"""{DAILY}, traj AS (SELECT CASE WHEN sim < '2' THEN 'Historical' ELSE sim END AS scenario, year("time")::INT AS year, quantile_cont(v, 0.45) / 100000 AS low, avg(v) / 100000 AS mean, quantile_cont(v, 0.55) / 100000 AS high FROM daily GROUP BY ALL)"""


def trajectories(s, d):
    by = daily(s, d).groupBy(F.when(F.col("sim") < "2", "Historical").otherwise(F.col("sim")).alias("scenario"), F.year("time").alias("year"))
    return by.agg((F.percentile("v", 0.45) / 100000).alias("low"), (F.avg("v") / 100000).alias("mean"), (F.percentile("v", 0.55) / 100000).alias("high"))


register("gwl_at_year", f"WITH {_TRAJ} SELECT scenario, round(low, 2) AS low, round(mean, 2) AS mean, round(high, 2) AS high FROM traj WHERE year = 1996 AND scenario = 'Historical'")(lambda s, d: levels.level_at_year(trajectories(s, d), 1996))
register(
    "year_at_gwl",
    f"""WITH {_TRAJ}, b AS (SELECT scenario, min(year) FILTER (high > 2.55) AS early, min(year) FILTER (mean > 2.55) AS mean, min(year) FILTER (low > 2.55) AS late, min(high) AS least FROM traj GROUP BY scenario),
    h AS (SELECT early AS before FROM b WHERE scenario = 'Historical') SELECT scenario, CASE WHEN least > 2.55 THEN coalesce(before, early) ELSE early END AS early, mean, late FROM b LEFT JOIN h ON true WHERE scenario <> 'Historical'""",
)(lambda s, d: levels.year_at_level(trajectories(s, d), 2.55))
register(
    "gwl_timing",
    f"""WITH {_TRAJ} SELECT scenario, l.level AS level, CASE WHEN min(year) FILTER (mean > l.level) > min(year) THEN min(year) FILTER (mean > l.level) END AS year FROM traj, (VALUES (2.5::DOUBLE), (2.6::DOUBLE), (9.0::DOUBLE)) l(level) GROUP BY ALL""",
)(lambda s, d: levels.timing(trajectories(s, d), [2.5, 2.6, 9.0]))
register(
    "gwl_table",
    f"""WITH {GRID}, c AS (SELECT sim, date_trunc('month', "time") AS "time", lon, sum(v * sqrt(cos(radians(lat)))) / sum(sqrt(cos(radians(lat)))) AS v FROM grid GROUP BY ALL), m AS (SELECT sim, "time", avg(v) AS v FROM c GROUP BY ALL),
    r AS (SELECT sim, sum(v * day(last_day("time"))) / sum(day(last_day("time"))) AS ref FROM m WHERE year("time") BETWEEN 1995 AND 1997 GROUP BY sim),
    w AS (SELECT sim, "time", avg(v - ref) OVER x AS v, count(v) OVER x AS n FROM m JOIN r USING (sim) WINDOW x AS (PARTITION BY sim ORDER BY "time" ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING))
    SELECT sim, l.level AS level, strftime(min("time") FILTER (v >= l.level), '%Y-%m-%d') AS at FROM w, (VALUES (50.0::DOUBLE), (200.0::DOUBLE), (1e9::DOUBLE)) l(level) WHERE n = 12 GROUP BY ALL""",
)(
    lambda s, d: levels.table(
        levels.global_mean(grid(s, d).withColumn("time", F.date_trunc("month", "time")), ["sim"], "v"), ["sim"], "v", (1995, 1997), [50.0, 200.0, 1e9], steps=12
    ).select("sim", "level", F.date_format("at", "yyyy-MM-dd").alias("at"))
)
register("window_range_join", f'WITH {SERIES}, c(level, lo, hi) AS (VALUES (1.5::DOUBLE, 1994, 1997), (2.0::DOUBLE, 1996, 1999)) SELECT sim, level, count(*) AS n, max(v) AS high FROM series JOIN c ON year("time") BETWEEN lo AND hi GROUP BY ALL')(
    lambda s, d: series(s, d)
    .join(F.broadcast(levels.window_years(s.createDataFrame([(1.5, 1995), (2.0, 1997)], "level double, year int"), (1, 2))), F.year("time").between(F.col("first"), F.col("last")))
    .groupBy("sim", "level").agg(F.count("*").alias("n"), F.max("v").alias("high"))
)

# Representative years


@register(
    "shock_month",
    f"""WITH {SERIES}, {catalogue._MY}, {catalogue._cdf_sql('own', 'sim, month, year')}, {catalogue._cdf_sql('whole', 'sim, month')},
    oc AS (SELECT *, sum(p) OVER (PARTITION BY sim, month, year ORDER BY bin) AS c FROM own), wc AS (SELECT *, sum(p) OVER (PARTITION BY sim, month ORDER BY bin) AS c FROM whole),
    om AS (SELECT sim, month, year, min_by(lo + bin * ((hi - lo) / 1023), (round(abs(c - 0.5), 9), bin)) AS o FROM oc GROUP BY ALL), wm AS (SELECT sim, month, min_by(lo + bin * ((hi - lo) / 1023), (round(abs(c - 0.5), 9), bin)) AS w FROM wc GROUP BY ALL)
    SELECT sim, month, year, round(anomaly, 3) AS anomaly FROM (SELECT sim, month, year, o - w AS anomaly, row_number() OVER (PARTITION BY sim, month ORDER BY o - w DESC, year) AS r FROM om JOIN wm USING (sim, month)) WHERE r = 1""",
)
def shock_month(spark, d):
    return rounded(profiles.shock_months(series(spark, d), ["sim"], "v", "hot"), "anomaly", places=3)


@register(
    "hour_nearest_quantile",
    """WITH i AS (SELECT l_returnflag AS sim, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    y AS (SELECT sim, v, i % 8760 + 1 AS hour, i // 8760 AS year FROM i WHERE i < n // 8760 * 8760), q AS (SELECT *, round(abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY sim, hour)), 6) AS off FROM y)
    SELECT sim, hour::BIGINT AS hour, year::BIGINT AS year, round(v, 4) AS v FROM (SELECT *, row_number() OVER (PARTITION BY sim, hour ORDER BY off, year) AS r FROM q) WHERE r = 1""",
)
def hour_nearest_quantile(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("sim"), F.col("l_extendedprice").alias("v"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("time"))
    return rounded(profiles.quantile_hours(rows, ["sim"], "v", 0.5).select("sim", F.col("hour").cast("long").alias("hour"), F.col("year").cast("long").alias("year"), "v"), "v")


@register("tmy_months")
def tmy_months(spark, d):
    daily_stats = daily(spark, d).groupBy("sim", F.date_trunc("day", "time").alias("time")).agg(F.max("v").alias("t_max"), F.min("v").alias("t_min"), F.avg("v").alias("t_mean"))
    weights = {c: float(profiles.TMY_WEIGHTS[c]) for c in ("t_max", "t_min", "t_mean")}
    return rounded(climate.top_months(profiles.skip_last_month(profiles.weighted_fs(daily_stats, ["sim"], weights), ["sim"]), ["sim"]), "fs", places=6)


@register("top_month_rows", f"WITH {SERIES}, {catalogue._FS} SELECT sim, month, year, {DAY_SQL}, v FROM m JOIN top USING (sim, month, year)")
def top_month_rows(spark, d):
    top = climate.top_months(climate.fs_statistic(series(spark, d), ["sim"], "v"), ["sim"])
    return profiles.assemble(series(spark, d), top, ["sim"]).select("sim", "month", "year", day(), "v")


@register("month_smoothing")
def month_smoothing(spark, d):
    return rounded(profiles.smooth_joints(series(spark, d), ["sim"], ["v"]).select("sim", day(), "v"), "v", places=3)


@register("weather_file_lines")
def weather_file(spark, d):
    place = weather_files.Place("Example", 1, 37.5, -121.5, "CA", -8.0, 12.0, (1995, 1997))
    h = hourly(spark, d).groupBy("station", F.date_trunc("hour", "time").alias("time")).agg(F.avg("t2").alias("t2"), F.avg("rh").alias("rh"), F.avg("psfc").alias("psfc"))
    given = {"t_c": F.round(_c("t2") - 273.15, 2), "rh": F.round("rh", 1), "pressure_pa": F.round("psfc", 0)}
    return weather_files.lines(h.select("station", "time", *[given.get(c, F.lit(None).cast("double")).alias(c) for c in weather_files.VALUES]), ["station"], place)


# Tests and kernels

register(
    "ks_two_sample",
    f"""WITH {SERIES}, x AS (SELECT sim, v, year("time") < 1998 AS a FROM series), t AS (SELECT sim, v, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS b FROM x GROUP BY ALL),
    s AS (SELECT sim, abs(sum(a) OVER w / sum(a) OVER k - sum(b) OVER w / sum(b) OVER k) AS d, sum(a) OVER k AS n_first, sum(b) OVER k AS n_second FROM t WINDOW w AS (PARTITION BY sim ORDER BY v ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY sim))
    SELECT sim, round(max(d), 6) AS statistic, n_first::BIGINT AS n_first, n_second::BIGINT AS n_second FROM s GROUP BY ALL""",
)(
    lambda s, d: rounded(
        kernels.two_sample_ks(series(s, d).withColumn("part", F.when(F.year("time") < 1998, "a").otherwise("b")), ["sim"], "v", "part", "a", "b").select("sim", "statistic", "n_first", "n_second"), "statistic", places=6
    )
)
for _n in ("genpareto", "weibull", "gamma", "pearson3"):
    register(f"return_value_{_n}")(lambda s, d, k=_n: kernels.one_in_x(aggregate.block_extremes(daily(s, d), ["sim"], "v"), ["sim"], "v", [2, 10], "value", k))
register("return_probability")(lambda s, d: kernels.one_in_x(aggregate.block_extremes(daily(s, d), ["sim"], "v"), ["sim"], "v", [400000.0, 450000.0], "probability", "gumbel"))
register("one_in_x_query")(lambda s, d: query.Query(daily(s, d)).step("one_in_x", key=["sim"], return_values=[400000.0], distribution="gev").plan())


@register("qdm_by_day")
def qdm_by_day(spark, d):
    y = F.year("time")
    part = lambda cond, name: F.when(cond, F.col("v")).alias(name)
    o = series(spark, d).select("sim", "time", part(y < 1998, "observed"), part(y < 1999, "historical"), part(y >= 1998, "target"))
    return rounded(kernels.quantile_delta_by_day(o, ["sim"], "observed", "historical", "target").select("sim", day(), "target", "adjusted"), "adjusted")
