"""Every operator as a query over the driver tables, with its DuckDB twin where SQL can say it.

lineitem plays a daily grid (cells are suppliers, simulations the flag pairs),
orders a daily series for each priority, events an hourly weather record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units, weather
from ..operators import aggregate, climate, kernels, select
from ..sources import catalog
from . import query, recipes, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GRID = """grid AS (SELECT l_shipdate AS "time", l_suppkey AS cell_id, l_returnflag || l_linestatus AS sim, l_extendedprice AS v,
  l_suppkey // 10 AS y_idx, l_suppkey % 10 AS x_idx, 32 + 0.5::DOUBLE * (l_suppkey // 10) AS lat, -124 + 0.5::DOUBLE * (l_suppkey % 10) AS lon FROM lineitem)"""
DAILY = """daily AS (SELECT o_orderdate AS "time", o_orderpriority AS sim, o_totalprice AS v, o_orderkey AS k FROM orders)"""
SERIES = f"""{DAILY}, series AS (SELECT date_trunc('day', "time") AS "time", sim, max(v) AS v FROM daily GROUP BY 1, 2)"""
HOURLY = """hourly AS (SELECT event_id AS id, ts AS "time", event_type AS sim, user_id % 10 AS station, 253.15 + 0.12::DOUBLE * value AS t2, (event_id * 37) % 101 + 0.0::DOUBLE AS rh,
  user_id % 21 - 10.0::DOUBLE AS u10, (event_id * 7) % 21 - 10.0::DOUBLE AS v10, 90000 + 100.0::DOUBLE * (user_id % 100) AS psfc FROM events)"""
BRIDGE = """bridge AS (SELECT s_suppkey AS cell_id, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    cell = F.col("l_suppkey")
    y, x = F.floor(cell / 10), cell % 10
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_shipdate").alias("time"), cell.alias("cell_id"), F.concat("l_returnflag", "l_linestatus").alias("sim"), F.col("l_extendedprice").alias("v"),
        y.alias("y_idx"), x.alias("x_idx"), (32 + 0.5 * y).alias("lat"), (-124 + 0.5 * x).alias("lon"),
    )


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The dimension of grid(): one row for each supplier."""
    cell = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(cell.alias("cell_id"), (32 + 0.5 * F.floor(cell / 10)).alias("lat"), (-124 + 0.5 * (cell % 10)).alias("lon"))


def bridge(spark: SparkSession, d: str) -> DataFrame:
    s, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "nation"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("cell_id"), F.col("n_name").alias("name"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").alias("time"), F.col("o_orderpriority").alias("sim"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """One value a day and simulation."""
    return daily(spark, d).groupBy(F.date_trunc("day", "time").alias("time"), "sim").agg(F.max("v").alias("v"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("id"), F.col("ts").alias("time"), F.col("event_type").alias("sim"), (F.col("user_id") % 10).alias("station"),
        (253.15 + 0.12 * F.col("value")).alias("t2"), ((F.col("event_id") * 37) % 101).cast("double").alias("rh"), (F.col("user_id") % 21 - 10).cast("double").alias("u10"),
        ((F.col("event_id") * 7) % 21 - 10).cast("double").alias("v10"), (90000 + 100.0 * (F.col("user_id") % 100)).alias("psfc"),
    )


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


day = lambda c="time": F.date_format(c, "yyyy-MM-dd").alias("day")
DAY_SQL = """strftime("time", '%Y-%m-%d') AS day"""


# The flagship: facet, region, closed interval, monthly maximum


@register(
    "flagship_monthly_max",
    f"""WITH {GRID}, {BRIDGE} SELECT sim, cell_id, month("time")::INT AS month, max(v) AS v FROM grid WHERE sim IN ('AF', 'NO') AND year("time") BETWEEN 1996 AND 1998
    AND cell_id IN (SELECT cell_id FROM bridge JOIN nation ON name = n_name WHERE n_regionkey = 1) GROUP BY ALL""",
)
def flagship(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 1").select("n_name")
    region = bridge(spark, d).join(F.broadcast(n), F.col("name") == F.col("n_name"), "left_semi").select("cell_id")
    found = query.Query(grid(spark, d)).where(sim=["AF", "NO"]).step("time_slice", start=1996, end=1998).plan()
    return aggregate.metric(found.join(region, "cell_id", "left_semi").withColumn("month", F.month("time")), ["sim", "cell_id", "month"], "v", "max")


# Sources


@register("facet_filter", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_brand = 'Brand#12'")
def facet_filter(spark, d):
    return catalog.search(spark.read.parquet(f"{d}/part.parquet"), p_size=[1, 5, 9], p_brand="Brand#12").select("p_partkey", "p_brand", "p_size")


@register("facet_contains", "SELECT DISTINCT p_brand FROM part WHERE lower(p_type) LIKE '%eco%' OR lower(p_type) LIKE '%um%'")
def facet_contains(spark, d):
    return catalog.options(spark.read.parquet(f"{d}/part.parquet"), "p_brand", p_type=["ECO", "um"])


@register("option_distinct", "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def option_distinct(spark, d):
    return catalog.options(spark.read.parquet(f"{d}/part.parquet"), "p_type")


@register("catalog_merge", "SELECT 'suppliers' AS catalog, s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customers', c_custkey, c_name, c_mktsegment FROM customer")
def catalog_merge(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return catalog.merge(("suppliers", s), ("customers", c)).select("catalog", "id", "name", "segment")


# Filters

_COUNTED = "SELECT sim, count(*) AS n, round(sum(v), 2) AS total FROM"


def counted(df):
    return df.groupBy("sim").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


register("time_slice_closed", f"WITH {GRID} {_COUNTED} grid WHERE \"time\" BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-06-30' GROUP BY sim")(lambda s, d: counted(select.time_slice(grid(s, d), "1996-03-01", "1996-06-30")))
register("time_slice_year", f'WITH {DAILY} {_COUNTED} daily WHERE year("time") BETWEEN 1997 AND 1998 GROUP BY sim')(lambda s, d: counted(select.time_slice(daily(s, d), 1997, "1998")))
register("season_djf", f'WITH {GRID} {_COUNTED} grid WHERE year("time") BETWEEN 1995 AND 1999 AND month("time") IN (12, 1, 2) GROUP BY sim')(lambda s, d: counted(select.time_slice(grid(s, d), 1995, 1999, ["DJF"])))
register("drop_leap_days", f'WITH {GRID} {_COUNTED} grid WHERE NOT (month("time") = 2 AND day("time") = 29) GROUP BY sim')(lambda s, d: counted(select.drop_leap_days(grid(s, d))))
register("month_filter", f'WITH {DAILY} {_COUNTED} daily WHERE month("time") IN (6, 7, 8) GROUP BY sim')(lambda s, d: counted(select.months(daily(s, d), [6, 7, 8])))
register("deny_models", f"WITH {GRID} {_COUNTED} grid WHERE sim NOT IN ('AF', 'RF') GROUP BY sim")(lambda s, d: counted(select.deny(grid(s, d), ["sim"], ["AF", "RF"])))
register("allow_models", f"WITH {GRID} {_COUNTED} grid WHERE sim LIKE '%O%' OR sim LIKE '%R%' GROUP BY sim")(lambda s, d: counted(select.allow(grid(s, d), "sim", ["O", "R"])))
register("clip_bbox", f"WITH {GRID} {_COUNTED} grid WHERE lat BETWEEN 32 AND 33.5 AND lon BETWEEN -123 AND -121 GROUP BY sim")(lambda s, d: counted(select.clip_box(grid(s, d), (32, 33.5), (-123, -121))))
register("clip_region", f"WITH {GRID}, {BRIDGE} {_COUNTED} grid WHERE cell_id IN (SELECT cell_id FROM bridge WHERE name = (SELECT min(n_name) FROM nation)) GROUP BY sim")(
    lambda s, d: counted(grid(s, d).join(bridge(s, d).join(F.broadcast(s.read.parquet(f"{d}/nation.parquet").agg(F.min("n_name").alias("name"))), "name").select("cell_id"), "cell_id", "left_semi"))
)
register("clip_union", f"WITH {GRID}, {BRIDGE} {_COUNTED} grid WHERE cell_id IN (SELECT cell_id FROM bridge WHERE name IN ('NATION_1', 'NATION_2', 'NATION_11')) GROUP BY sim")(
    lambda s, d: counted(select.clip_region(grid(s, d), bridge(s, d), ["NATION_1", "NATION_2", "NATION_11"]))
)
register("clip_separated", f"WITH {GRID}, {BRIDGE} SELECT name, count(*) AS n, max(v) AS high FROM grid JOIN bridge USING (cell_id) WHERE name IN ('NATION_1', 'NATION_11', 'NATION_12') GROUP BY name")(
    lambda s, d: select.clip_separated(grid(s, d), bridge(s, d), ["NATION_1", "NATION_11", "NATION_12"]).groupBy("name").agg(F.count("*").alias("n"), F.max("v").alias("high"))
)

_POINTS = [(32.3, -123.1), (33.9, -121.2), (40.0, -119.9)]


@register(
    "clip_points",
    f"""WITH {GRID}, c AS (SELECT s_suppkey AS cell_id, 32 + 0.5::DOUBLE * (s_suppkey // 10) AS lat, -124 + 0.5::DOUBLE * (s_suppkey % 10) AS lon FROM supplier),
    p AS (SELECT * FROM (VALUES (0, 32.3::DOUBLE, -123.1::DOUBLE), (1, 33.9::DOUBLE, -121.2::DOUBLE), (2, 40.0::DOUBLE, -119.9::DOUBLE)) p(point, a, b)),
    la AS (SELECT point, lat FROM (SELECT point, lat, row_number() OVER (PARTITION BY point ORDER BY abs(lat - a), lat) r FROM p, (SELECT DISTINCT lat FROM c)) WHERE r = 1),
    lo AS (SELECT point, lon FROM (SELECT point, lon, row_number() OVER (PARTITION BY point ORDER BY abs(lon - b), lon) r FROM p, (SELECT DISTINCT lon FROM c)) WHERE r = 1)
    SELECT point, count(*) AS n, max(v) AS high FROM la JOIN lo USING (point) JOIN c USING (lat, lon) JOIN grid USING (cell_id) GROUP BY point""",
)
def clip_points(spark, d):
    return select.clip_points(grid(spark, d), cells(spark, d), _POINTS).groupBy("point").agg(F.count("*").alias("n"), F.max("v").alias("high"))


@register(
    "nearest_3x3_fill",
    f"""WITH {GRID}, m AS (SELECT cell_id, y_idx, x_idx, CASE WHEN cell_id % 7 <> 3 THEN max(v) END AS v FROM grid GROUP BY cell_id, y_idx, x_idx),
    f AS (SELECT a.cell_id, a.v, avg(b.v) AS near FROM m a LEFT JOIN m b ON abs(a.y_idx - b.y_idx) <= 1 AND abs(a.x_idx - b.x_idx) <= 1 GROUP BY a.cell_id, a.v) SELECT cell_id, round(coalesce(v, near), 6) AS v FROM f""",
)
def nearest_fill(spark, d):
    m = grid(spark, d).groupBy("cell_id", "y_idx", "x_idx").agg(F.max("v").alias("v")).withColumn("v", F.when(F.col("cell_id") % 7 != 3, F.col("v")))
    return rounded(select.fill_from_neighbours(m, [], "v").select("cell_id", "v"), "v", places=6)


# Aggregations

for _k, _f in {"min": "min(v)", "max": "max(v)", "mean": "round(avg(v), 4)", "median": "round(quantile_cont(v, 0.5), 4)", "sum": "round(sum(v), 2)"}.items():
    register(f"metric_{_k}", f"WITH {GRID} SELECT sim, cell_id, {_f} AS v FROM grid GROUP BY ALL")(
        lambda s, d, k=_k: rounded(aggregate.metric(grid(s, d), ["sim", "cell_id"], "v", k), "v", places=2 if k == "sum" else 4)
    )
register(
    "metric_percentiles",
    f"WITH {GRID} SELECT sim, p AS percentile, round(v, 4) AS v FROM (SELECT sim, unnest([5.0::DOUBLE, 50.0, 95.0]) AS p, unnest(quantile_cont(v, [0.05, 0.5, 0.95])) AS v FROM grid GROUP BY sim)",
)(lambda s, d: rounded(aggregate.percentiles(grid(s, d), ["sim"], "v", [5, 50, 95]), "v"))
register("area_weighted_mean", f"WITH {GRID} SELECT sim, round(sum(v * cos(radians(lat))) / sum(cos(radians(lat))), 4) AS v FROM grid GROUP BY sim")(lambda s, d: rounded(aggregate.area_mean(grid(s, d), ["sim"], "v"), "v"))
register(
    "gwl_weighted_mean",
    f"WITH {GRID} SELECT sim, round(sum(v * sqrt(cos(radians(lat)))) / sum(sqrt(cos(radians(lat)))), 4) AS v FROM grid GROUP BY sim",
)(lambda s, d: rounded(aggregate.weighted_mean(grid(s, d), ["sim"], "v", F.sqrt(F.cos(F.radians("lat")))), "v"))
register(
    "day_weighted_annual_mean",
    f"""WITH {DAILY}, m AS (SELECT sim, date_trunc('month', "time") AS t, avg(v) AS v FROM daily GROUP BY ALL)
    SELECT sim, year(t)::INT AS year, round(sum(v * day(last_day(t))) / sum(day(last_day(t))), 4) AS v FROM m GROUP BY ALL""",
)(lambda s, d: rounded(aggregate.day_weighted_year(aggregate.resample(daily(s, d), ["sim"], "v", "month", "mean"), ["sim"], "v"), "v"))
register("daily_resample", f"WITH {HOURLY} SELECT sim, {DAY_SQL}, max(t2) AS t2 FROM hourly GROUP BY ALL")(lambda s, d: aggregate.resample(hourly(s, d), ["sim"], "t2", "day", "max").select("sim", day(), "t2"))
register(
    "n_day_resample",
    f"""WITH {DAILY}, f AS (SELECT sim, v, date_diff('day', min("time"::DATE) OVER (PARTITION BY sim), "time"::DATE) // 5 AS bin FROM daily) SELECT sim, bin, max(v) AS v FROM f GROUP BY ALL""",
)(lambda s, d: aggregate.bins_of_days(daily(s, d), ["sim"], "v", 5, "max"))
for _k in ("max", "min"):
    register(f"block_{_k}", f'WITH {DAILY} SELECT sim, year("time")::INT AS block, {_k}(v) AS v FROM daily GROUP BY ALL')(lambda s, d, k=_k: aggregate.block_extremes(daily(s, d), ["sim"], "v", k))
register(
    "block_max_two_year",
    f"""WITH {DAILY}, f AS (SELECT sim, v, year("time") AS y, min(year("time")) OVER (PARTITION BY sim) AS y0 FROM daily) SELECT sim, (y0 + 2 * ((y - y0) // 2 + 1) - 1)::INT AS block, max(v) AS v FROM f GROUP BY ALL""",
)(lambda s, d: aggregate.block_extremes(daily(s, d), ["sim"], "v", "max", years=2))
_ROLL3 = 'OVER (PARTITION BY sim ORDER BY "time" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)'
for _n, _how in (("sustained", "min"), ("cumulative", "sum")):
    register(
        f"block_max_{_n}",
        f"""WITH {SERIES}, r AS (SELECT sim, "time", CASE WHEN count(v) {_ROLL3} = 3 THEN {_how}(v) {_ROLL3} END AS v FROM series) SELECT sim, year("time")::INT AS block, round(max(v), 2) AS v FROM r WHERE v IS NOT NULL GROUP BY ALL""",
    )(lambda s, d, n=_n: rounded(aggregate.block_extremes(series(s, d), ["sim"], "v", "max", duration=3, how=n), "v", places=2))
register("exceed_year", f'WITH {DAILY} SELECT sim, year("time")::INT AS year, sum((v > 200000)::INT)::BIGINT AS n FROM daily GROUP BY ALL')(
    lambda s, d: aggregate.exceedance(daily(s, d), ["sim"], "v", 200000).select("sim", F.year("period").alias("year"), "n")
)
register("exceed_below", f'WITH {DAILY} SELECT sim, year("time")::INT AS year, sum((v < 50000)::INT)::BIGINT AS n FROM daily GROUP BY ALL')(
    lambda s, d: aggregate.exceedance(daily(s, d), ["sim"], "v", 50000, above=False).select("sim", F.year("period").alias("year"), "n")
)
register("exceed_month", f"""WITH {DAILY} SELECT sim, strftime("time", '%Y-%m') AS month, sum((v > 200000)::INT)::BIGINT AS n FROM daily GROUP BY ALL""")(
    lambda s, d: aggregate.exceedance(daily(s, d), ["sim"], "v", 200000, period="month").select("sim", F.date_format("period", "yyyy-MM").alias("month"), "n")
)
register(
    "exceed_sustained",
    f"""WITH {SERIES}, r AS (SELECT sim, "time", CASE WHEN count(v) {_ROLL3} = 3 THEN min((v > 150000)::INT) {_ROLL3} END AS o FROM series) SELECT sim, year("time")::INT AS year, sum(o)::BIGINT AS n FROM r GROUP BY ALL""",
)(lambda s, d: aggregate.exceedance(series(s, d), ["sim"], "v", 150000, duration=3).select("sim", F.year("period").alias("year"), "n"))
register(
    "hot_days_per_year",
    f"""WITH {DAILY}, a AS (SELECT sim, "time"::DATE AS d, max(v) AS v FROM daily GROUP BY ALL), b AS (SELECT sim, year(d) AS y, sum((v > 250000)::INT) AS n FROM a GROUP BY ALL) SELECT sim, round(avg(n), 4) AS days FROM b GROUP BY sim""",
)(lambda s, d: rounded(aggregate.hot_days(daily(s, d), ["sim"], "v", 250000), "days"))
register("hdd_cdd", f"WITH {HOURLY} SELECT sim, round(sum(greatest(291.483 - t2, 0)), 3) AS hdd, round(sum(greatest(t2 - 291.483, 0)), 3) AS cdd FROM hourly GROUP BY sim")(
    lambda s, d: hourly(s, d).select("sim", *[c.alias(n) for c, n in zip(weather.degree_days(F.col("t2"), 291.483, 291.483), ("hdd", "cdd"), strict=True)]).groupBy("sim").agg(F.round(F.sum("hdd"), 3).alias("hdd"), F.round(F.sum("cdd"), 3).alias("cdd"))
)
register("hdh_cdh", f"WITH {HOURLY} SELECT {DAY_SQL}, count_if(t2 < 291.483)::BIGINT AS hdh, count_if(t2 > 291.483)::BIGINT AS cdh FROM hourly GROUP BY ALL")(
    lambda s, d: hourly(s, d).groupBy(day()).agg(F.count_if(F.col("t2") < 291.483).alias("hdh"), F.count_if(F.col("t2") > 291.483).alias("cdh"))
)
register("annual_per_cell", f'WITH {GRID} SELECT sim, year("time")::INT AS year, round(sum(v) / count(DISTINCT cell_id), 4) AS v FROM grid GROUP BY ALL')(
    lambda s, d: grid(s, d).groupBy("sim", F.year("time").alias("year")).agg(F.round(F.sum("v") / F.count_distinct("cell_id"), 4).alias("v"))
)
register(
    "multi_model_stats",
    f"""WITH {GRID}, m AS (SELECT cell_id, sim, max(v) AS v FROM grid GROUP BY ALL) SELECT cell_id, sim, round(v, 4) AS v FROM m
    UNION ALL SELECT cell_id, 'mean', round(avg(v), 4) FROM m GROUP BY 1 UNION ALL SELECT cell_id, 'min', min(v) FROM m GROUP BY 1
    UNION ALL SELECT cell_id, 'max', max(v) FROM m GROUP BY 1 UNION ALL SELECT cell_id, 'median', round(quantile_cont(v, 0.5), 4) FROM m GROUP BY 1""",
)(lambda s, d: rounded(aggregate.model_stats(aggregate.metric(grid(s, d), ["cell_id", "sim"], "v", "max"), ["cell_id"], "v"), "v"))
register(
    "trendline",
    f"""WITH {DAILY}, a AS (SELECT sim, year("time") AS y, avg(v) AS v FROM daily GROUP BY ALL) SELECT sim, round(regr_slope(v, y), 3) AS slope, round(regr_intercept(v, y), 1) AS intercept FROM a GROUP BY sim""",
)(lambda s, d: aggregate.trend(daily(s, d).groupBy("sim", F.year("time").alias("year")).agg(F.avg("v").alias("v")), ["sim"], "v").select("sim", F.round("slope", 3).alias("slope"), F.round("intercept", 1).alias("intercept")))
register(
    "hist_cdf",
    f"""WITH {SERIES}, e AS (SELECT sim, min(v) AS lo, max(v) AS hi, count(*) AS n FROM series GROUP BY sim),
    b AS (SELECT sim, lo, hi, n, CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 100)) + 1, 100) ELSE 100 END::INT AS bin FROM series JOIN e USING (sim) WHERE n > 1),
    c AS (SELECT sim, n, bin, count(*) AS k FROM b GROUP BY ALL) SELECT sim, bin, round(sum(k) OVER (PARTITION BY sim ORDER BY bin) / n, 6) AS prob FROM c""",
)(lambda s, d: rounded(aggregate.cdf(series(s, d), ["sim"], "v", 100).select("sim", "bin", "prob"), "prob", places=6))

# Windows

_W = 'PARTITION BY sim ORDER BY "time"'


def with_rolling(df, n, kind, centred=False):
    return df.select("sim", day(), F.round(aggregate.rolling(df, ["sim"], "v", n, kind, centred), 4).alias("v"))


register("rolling_trailing", f"WITH {SERIES} SELECT sim, {DAY_SQL}, CASE WHEN count(v) OVER w = 5 THEN round(avg(v) OVER w, 4) END AS v FROM series WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")(lambda s, d: with_rolling(series(s, d), 5, "mean"))
register("rolling_centred_even", f"WITH {SERIES} SELECT sim, {DAY_SQL}, CASE WHEN count(v) OVER w = 6 THEN round(avg(v) OVER w, 4) END AS v FROM series WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)")(
    lambda s, d: with_rolling(series(s, d), 6, "mean", True)
)
register("effective_temp", f"WITH {SERIES} SELECT sim, {DAY_SQL}, round(0.5 * v + 0.25 * lag(v, 1) OVER w + 0.125 * lag(v, 2) OVER w + 0.125 * lag(v, 3) OVER w, 5) AS v FROM series WINDOW w AS ({_W})")(
    lambda s, d: rounded(climate.effective_temperature(series(s, d), ["sim"], "v").select("sim", day(), "v"), "v", places=5)
)
register("anomaly", f"""WITH {SERIES} SELECT sim, {DAY_SQL}, round(v - avg(v) FILTER (year("time") BETWEEN 1995 AND 1997) OVER (PARTITION BY sim) + 1e-7, 3) AS v FROM series""")(
    lambda s, d: rounded(climate.anomaly(series(s, d), ["sim"], "v", (1995, 1997)).select("sim", day(), (F.col("v") + 1e-7).alias("v")), "v", places=3)
)
register("remove_season_cycle", f"""WITH {SERIES} SELECT sim, {DAY_SQL}, round(v - avg(v) OVER (PARTITION BY sim, month("time")) + 1e-7, 3) AS v FROM series""")(
    lambda s, d: rounded(climate.without_season(series(s, d), ["sim"], "v").select("sim", day(), (F.col("v") + 1e-7).alias("v")), "v", places=3)
)
register(
    "season_separated",
    f"""WITH {SERIES}, q AS (SELECT *, CASE WHEN month("time") IN (12, 1, 2) THEN 'DJF' WHEN month("time") <= 5 THEN 'MAM' WHEN month("time") <= 8 THEN 'JJA' ELSE 'SON' END AS season FROM series)
    SELECT sim, season, {DAY_SQL}, CASE WHEN count(v) OVER w = 5 THEN round(avg(v) OVER w, 3) END AS v FROM q WINDOW w AS (PARTITION BY sim, season ORDER BY "time" ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
)(lambda s, d: rounded(climate.within_season(series(s, d), ["sim"], "v", 5).select("sim", "season", day(), "v"), "v", places=3))
register("time_delta", f"WITH {SERIES} SELECT sim, {DAY_SQL}, (row_number() OVER ({_W}) - 1 + floor(-count(*) OVER (PARTITION BY sim) / 2))::INT AS time_delta FROM series")(
    lambda s, d: climate.time_delta(series(s, d), ["sim"]).select("sim", day(), "time_delta")
)
register("hour_of_year", f"""WITH {HOURLY} SELECT id, ((row_number() OVER (PARTITION BY sim ORDER BY id) - 1) % 8760 + 1)::BIGINT AS hour FROM hourly""")(
    lambda s, d: climate.hour_of_year(hourly(s, d), ["sim"], "id").select("id", F.col("hour").cast("bigint").alias("hour"))
)
register(
    "first_crossing",
    f"""WITH {SERIES} SELECT sim, l.level AS level, strftime(min("time") FILTER (v >= l.level), '%Y-%m-%d') AS at FROM series, (VALUES (200000.0::DOUBLE), (300000.0::DOUBLE), (1e12::DOUBLE)) l(level) GROUP BY ALL""",
)(lambda s, d: climate.first_crossing(series(s, d), ["sim"], "v", [200000, 300000, 1e12]).select("sim", "level", F.date_format("at", "yyyy-MM-dd").alias("at")))

# Arg-extrema and representative years

_YEARLY = f"""{DAILY}, y AS (SELECT sim, month("time")::INT AS month, year("time")::INT AS year, avg(v) AS v FROM daily GROUP BY ALL)"""


@register(
    "profile_value",
    f"""WITH {_YEARLY}, q AS (SELECT *, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY sim, month)) AS off FROM y)
    SELECT sim, month, year, round(v, 4) AS v FROM (SELECT *, row_number() OVER (PARTITION BY sim, month ORDER BY round(off, 6), year) AS r FROM q) WHERE r = 1""",
)
def profile_value(spark, d):
    y = daily(spark, d).groupBy("sim", F.month("time").alias("month"), F.year("time").alias("year")).agg(F.avg("v").alias("v"))
    return rounded(climate.nearest_to_quantile(y, ["sim", "month"], "v", 0.5).select("sim", "month", "year", "v"), "v")


_MY = """m AS (SELECT sim, month("time")::INT AS month, year("time")::INT AS year, "time", v FROM series)"""


def _cdf_sql(name: str, by: str, bins: int = 1023) -> str:
    """Counts of the bins that occur, as shares."""
    return f"""{name}_e AS (SELECT {by}, min(v) AS lo, max(v) AS hi, count(*) AS n FROM m GROUP BY ALL HAVING count(*) > 1),
    {name} AS (SELECT {by}, lo, hi, CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / {bins})) + 1, {bins}) ELSE {bins} END::INT AS bin, count(*)::DOUBLE / any_value(n) AS p FROM m JOIN {name}_e USING ({by}) GROUP BY ALL)"""


_FS = f"""{_MY}, {_cdf_sql('own', 'sim, month, year')}, {_cdf_sql('whole', 'sim, month')},
    bins AS (SELECT sim, month, year, unnest(range(1, 1024)) AS bin FROM own_e),
    cum AS (SELECT e.sim, e.month, e.year, sum(coalesce(o.p, 0)) OVER w AS own, sum(coalesce(a.p, 0)) OVER w AS whole FROM bins e LEFT JOIN own o USING (sim, month, year, bin) LEFT JOIN whole a ON a.sim = e.sim AND a.month = e.month AND a.bin = e.bin
      WINDOW w AS (PARTITION BY e.sim, e.month, e.year ORDER BY e.bin)),
    fs AS (SELECT sim, month, year, sum(abs(own - whole)) / list_extract([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], month) AS fs FROM cum GROUP BY sim, month, year),
    top AS (SELECT sim, month, year, fs FROM (SELECT *, row_number() OVER (PARTITION BY sim, month ORDER BY round(fs, 9), year) AS r FROM fs) WHERE r = 1)"""


@register("top_months_fs", f"WITH {SERIES}, {_FS} SELECT sim, month, year, round(fs, 6) AS fs FROM top")
def top_months(spark, d):
    return rounded(climate.top_months(climate.fs_statistic(series(spark, d), ["sim"], "v"), ["sim"]), "fs", places=6)


@register("fs_statistic", f"WITH {SERIES}, {_FS} SELECT sim, month, year, round(fs, 6) AS fs FROM fs")
def fs_statistic(spark, d):
    return rounded(climate.fs_statistic(series(spark, d), ["sim"], "v"), "fs", places=6)


@register(
    "warming_slice",
    f"""WITH {SERIES}, c AS (SELECT sim, l.level, year(min("time") FILTER (v >= l.level)) + 3 AS centre FROM series, (VALUES (200000.0::DOUBLE), (300000.0::DOUBLE)) l(level) GROUP BY ALL),
    w AS (SELECT s.sim, level AS warming_level, "time", v FROM series s JOIN c ON s.sim = c.sim AND year("time") BETWEEN centre - 2 AND centre + 1 WHERE centre - 2 >= 1990 AND centre + 1 <= 2100 AND NOT (month("time") = 2 AND day("time") = 29))
    SELECT sim, warming_level, {DAY_SQL}, (row_number() OVER (PARTITION BY sim, warming_level ORDER BY "time") - 1 + floor(-count(*) OVER (PARTITION BY sim, warming_level) / 2))::INT AS time_delta, v FROM w""",
)
def warming(spark, d):
    centres = climate.first_crossing(series(spark, d), ["sim"], "v", [200000.0, 300000.0]).select("sim", "level", (F.year("at") + 3).alias("year")).where("year IS NOT NULL")
    return climate.warming_slice(series(spark, d), centres, ["sim"], 2, (1990, 2100)).select("sim", "warming_level", day(), "time_delta", "v")


# Combinations, discovery and whole analyses

register("snapshot_mean", f"""WITH {SERIES}, c(level, lo, hi) AS (VALUES (1.5::DOUBLE, 1993, 1996), (2.0::DOUBLE, 1995, 1998)) SELECT level AS warming_level, sim, round(avg(v), 4) AS v FROM series JOIN c ON year("time") BETWEEN lo AND hi WHERE NOT (month("time") = 2 AND day("time") = 29) GROUP BY ALL""")(
    lambda s, d: rounded(climate.snapshot_mean(climate.warming_slice(series(s, d), series(s, d).select("sim").distinct().crossJoin(s.createDataFrame([(1.5, 1995), (2.0, 1997)], "level double, year int")), ["sim"], 2), ["sim"], "v"), "v")
)
register("first_true", f"""WITH {SERIES} SELECT sim, strftime(coalesce(min("time") FILTER (v > 400000), min("time")), '%Y-%m-%d') AS at FROM series GROUP BY sim""")(
    lambda s, d: climate.first_where(series(s, d), ["sim"], F.col("v") > 400000, else_first=True).select("sim", F.date_format("at", "yyyy-MM-dd").alias("at"))
)
register(
    "category_order", """SELECT p_brand, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#33' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 3 END, p_brand)::INT AS rank FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)"""
)(lambda s, d: catalog.ranked(s.read.parquet(f"{d}/part.parquet"), "p_brand", ["Brand#33", "Brand#12"]))
register("first_options", "SELECT p_brand, p_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS r FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_type IS NOT NULL)) WHERE r <= 3")(
    lambda s, d: catalog.first_options(s.read.parquet(f"{d}/part.parquet"), ["p_brand"], "p_type", 3)
)
register("facet_regex", "SELECT DISTINCT p_brand FROM part WHERE regexp_matches(lower(p_type), '^eco|l$')")(lambda s, d: catalog.options(s.read.parquet(f"{d}/part.parquet"), "p_brand", p_type=["^ECO", "l$"]))
register("year_day_date", "SELECT event_id AS id, strftime(make_date(1996, 1, 1) + (event_id % 366)::INT, '%Y-%m-%d') AS at FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.date_format(weather.date_of_year_day(F.lit(1996), F.col("event_id") % 366 + 1), "yyyy-MM-dd").alias("at"))
)
register("batch_concat", f"""WITH {DAILY} SELECT part, sim, count(*) AS n, count(k) AS keys FROM (SELECT 'early' AS part, sim, k FROM daily WHERE year("time") < 1995 UNION ALL SELECT 'late', sim, NULL FROM daily WHERE year("time") >= 1995) GROUP BY ALL""")(
    lambda s, d: climate.concat_frames({"early": daily(s, d).where(F.year("time") < 1995), "late": daily(s, d).where(F.year("time") >= 1995).drop("k")}, "part").groupBy("part", "sim").agg(F.count("*").alias("n"), F.count("k").alias("keys"))
)
register(
    "batch_points",
    f"""WITH {GRID}, c AS (SELECT s_suppkey AS cell_id, 32 + 0.5::DOUBLE * (s_suppkey // 10) AS lat, -124 + 0.5::DOUBLE * (s_suppkey % 10) AS lon FROM supplier),
    p AS (SELECT c_custkey AS point, 32 + (c_custkey % 97) / 10.0::DOUBLE AS pa, -124 + (c_custkey % 41) / 8.0::DOUBLE AS po FROM customer),
    la AS (SELECT point, min_by(lat, (abs(lat - pa), lat)) AS lat FROM p, (SELECT DISTINCT lat FROM c) GROUP BY point), lo AS (SELECT point, min_by(lon, (abs(lon - po), lon)) AS lon FROM p, (SELECT DISTINCT lon FROM c) GROUP BY point)
    SELECT point, count(*) AS n, max(v) AS high FROM la JOIN lo USING (point) JOIN c USING (lat, lon) JOIN grid USING (cell_id) WHERE NOT (month("time") = 2 AND day("time") = 29) GROUP BY point""",
)(
    lambda s, d: select.batch_points(
        grid(s, d), cells(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("point"), (32 + F.col("c_custkey") % 97 / 10).alias("at"), (-124 + F.col("c_custkey") % 41 / 8).alias("on")),
        stats=[F.count("*").alias("n"), F.max("v").alias("high")],
    )
)
register(
    "block_max_grouped",
    f"""WITH {DAILY}, f AS (SELECT sim, v, "time"::DATE AS d, min("time"::DATE) OVER (PARTITION BY sim) AS d0 FROM daily), g AS (SELECT sim, d0 + (date_diff('day', d0, d) // 3 * 3)::INT AS "time", max(v) AS v FROM f GROUP BY ALL),
    r AS (SELECT sim, "time", CASE WHEN count(v) OVER w = 2 THEN min(v) OVER w END AS v FROM g WINDOW w AS (PARTITION BY sim ORDER BY "time" ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) SELECT sim, year("time")::INT AS block, max(v) AS v FROM r WHERE v IS NOT NULL GROUP BY ALL""",
)(lambda s, d: aggregate.block_extremes(daily(s, d), ["sim"], "v", group_days=3, group_duration=2))
register(
    "vulnerability_days", f"""WITH {DAILY}, a AS (SELECT sim, "time"::DATE AS d, max(v) AS v FROM daily WHERE month("time") IN (6, 7, 8) GROUP BY ALL), y AS (SELECT sim, sum((v > 250000)::INT) AS n FROM a GROUP BY sim, year(d)) SELECT sim, round(avg(n), 4) AS v FROM y GROUP BY sim"""
)(lambda s, d: rounded(recipes.vulnerability(daily(s, d), ["sim"], "v", "max", [6, 7, 8], threshold=250000), "v"))
register("vulnerability_percentile", f"""WITH {DAILY}, a AS (SELECT sim, "time"::DATE AS d, min(v) AS v FROM daily WHERE month("time") IN (12, 1, 2) GROUP BY ALL) SELECT sim, round(quantile_cont(v, 0.05), 4) AS v FROM a GROUP BY sim""")(
    lambda s, d: rounded(recipes.vulnerability(daily(s, d), ["sim"], "v", "min", [12, 1, 2], percentile=5), "v")
)
register(
    "vulnerability_table",
    f"""WITH {DAILY}, a AS (SELECT sim, "time"::DATE AS d, max(v) AS hi, min(v) AS lo FROM daily GROUP BY ALL), p AS (SELECT sim, year(d) < 1996 AS early, hi, lo, d FROM a WHERE year(d) BETWEEN 1993 AND 1998),
    y AS (SELECT sim, early, year(d) AS y, sum((hi > 250000)::INT) AS n FROM p GROUP BY ALL), m AS (SELECT sim, 'hot days' AS metric, early, avg(n) AS x FROM y GROUP BY ALL UNION ALL SELECT sim, 'low', early, quantile_cont(lo, 0.1) FROM p GROUP BY ALL)
    SELECT sim, metric, round(max(x) FILTER (early), 4) AS first, round(max(x) FILTER (NOT early), 4) AS second FROM m GROUP BY ALL""",
)(
    lambda s, d: rounded(recipes.vulnerability_table(daily(s, d), ["sim"], "v", {"hot days": {"metric": "max", "threshold": 250000}, "low": {"metric": "min", "percentile": 10}}, {"first": (1993, 1995), "second": (1996, 1998)}), "first", "second")
)
_HOURS = """i AS (SELECT l_returnflag AS sim, l_extendedprice AS v, l_quantity AS w, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    y AS (SELECT sim, v, w, i % 8760 + 1 AS hour, i // 8760 AS year FROM i WHERE i < n // 8760 * 8760), q AS (SELECT *, round(abs(v - quantile_cont(v, 0.9) OVER (PARTITION BY sim, hour)), 6) AS off FROM y)"""


@register("persistence_year", f"WITH {_HOURS} SELECT sim, hour::BIGINT AS hour, year::BIGINT AS year, round(v, 4) AS v, w FROM (SELECT *, row_number() OVER (PARTITION BY sim, hour ORDER BY off, year) AS r FROM q) WHERE r = 1")
def persistence_year(spark, d):
    placed = Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    # one row an hour from a first of March on, so that no leap day falls among the first 8,760 hours of any year kept
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("sim"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"), F.row_number().over(placed).alias("i"))
    return rounded(recipes.persistence_year(recipes.common_hours(rows, "i"), ["sim"], "v", 0.9).select("sim", F.col("hour").cast("long").alias("hour"), F.col("year").cast("long").alias("year"), "v", "w"), "v")


# Scenarios

register("concat_sim", "SELECT lower(replace(o_orderpriority, ' ', '')) || '_' || lower(o_orderstatus) AS sim, count(*) AS n FROM orders GROUP BY 1")(
    lambda s, d: climate.concat_sim(s.read.parquet(f"{d}/orders.parquet"), ["o_orderpriority", "o_orderstatus"]).groupBy("sim").agg(F.count("*").alias("n"))
)
_SCEN = f"""{GRID}, x AS (SELECT cell_id, CASE WHEN year("time") < 1998 THEN 'historical' WHEN cell_id % 2 = 0 THEN 'ssp370' ELSE 'ssp585' END AS scenario, v FROM grid)"""


def scenarios(s, d):
    return grid(s, d).select("cell_id", F.when(F.year("time") < 1998, "historical").when(F.col("cell_id") % 2 == 0, "ssp370").otherwise("ssp585").alias("scenario"), "v")


register("concat_time", f"WITH {_SCEN}, m AS (SELECT DISTINCT cell_id, scenario FROM x WHERE scenario <> 'historical'), u AS (SELECT scenario, v FROM x WHERE scenario <> 'historical' UNION ALL SELECT m.scenario, v FROM x JOIN m USING (cell_id) WHERE x.scenario = 'historical') SELECT scenario, count(*) AS n, round(sum(v), 2) AS total FROM u GROUP BY scenario")(
    lambda s, d: climate.concat_time(scenarios(s, d), ["cell_id"], "scenario", "historical").groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))
)
register("scenario_intersect", f"WITH {_SCEN} SELECT cell_id FROM x WHERE scenario = 'historical' INTERSECT SELECT cell_id FROM x WHERE scenario = 'ssp370'")(
    lambda s, d: select.shared(scenarios(s, d).where("scenario = 'historical'"), scenarios(s, d).where("scenario = 'ssp370'"), ["cell_id"])
)
register("leap_except", f"""WITH {SERIES} SELECT sim, {DAY_SQL} FROM series EXCEPT SELECT sim, {DAY_SQL} FROM series WHERE month("time") = 2 AND day("time") = 29""")(
    lambda s, d: series(s, d).select("sim", day()).exceptAll(series(s, d).where(select.leap_day()).select("sim", day()))
)


@register(
    "paired_difference",
    f"""WITH {DAILY}, a AS (SELECT sim, month("time")::INT AS month, avg(v) AS v FROM daily WHERE year("time") >= 1998 GROUP BY ALL), h AS (SELECT sim, month("time")::INT AS month, avg(v) AS v FROM daily WHERE year("time") < 1998 AND sim <> '1-URGENT' GROUP BY ALL),
    m AS (SELECT month, avg(v) AS v FROM h GROUP BY month) SELECT a.sim, a.month, round(a.v - coalesce(h.v, m.v), 3) AS v FROM a LEFT JOIN h USING (sim, month) LEFT JOIN m ON m.month = a.month""",
)
def paired(spark, d):
    by = lambda df: df.groupBy("sim", F.month("time").alias("month")).agg(F.avg("v").alias("v"))
    o = daily(spark, d)
    return rounded(climate.paired_difference(by(o.where(F.year("time") >= 1998)), by(o.where((F.year("time") < 1998) & (F.col("sim") != "1-URGENT"))), ["sim"], "v", "month"), "v", places=3)


@register(
    "merge_variables",
    f"""WITH {SERIES}, low AS (SELECT sim, date_trunc('day', "time") AS "time", min(v) AS low FROM daily WHERE v < 100000 GROUP BY ALL)
    SELECT sim, {DAY_SQL}, s.v, low FROM (SELECT * FROM series WHERE v > 200000) s FULL JOIN low USING (sim, "time")""",
)
def merge_variables(spark, d):
    low = daily(spark, d).where("v < 100000").groupBy("sim", F.date_trunc("day", "time").alias("time")).agg(F.min("v").alias("low"))
    return climate.merge_variables([series(spark, d).where("v > 200000"), low], ["sim"]).select("sim", day(), "v", "low")


# Scalar functions

def C():
    return F.col("t2")


def R():
    return F.col("rh")


def U():
    return F.col("u10")


def V():
    return F.col("v10")


def P():
    return F.col("psfc")


_F = "((t2 - 273.15) * 1.8 + 32)"
_SCALARS = {
    "unit_k_to_f": (lambda: units.convert(C(), "K", "degF"), f"{_F}"),
    "unit_pa_to_hpa": (lambda: units.convert(P(), "Pa", "hPa"), "psfc / 100"),
    "unit_ms_to_mph": (lambda: units.convert(U(), "m/s", "mph"), "u10 * 2.236936"),
    "wind_speed": (lambda: weather.wind_speed(U(), V()), "sqrt(u10 * u10 + v10 * v10)"),
    "wind_dir": (lambda: weather.wind_direction(U(), V()), "CASE WHEN 270 - degrees(atan2(v10, u10)) >= 360 THEN 270 - degrees(atan2(v10, u10)) - 360 ELSE 270 - degrees(atan2(v10, u10)) END"),
    "dew_point": (
        lambda: weather.dew_point(C(), R() + 1),
        "237.7 * (17.27 * (t2 - 273.15) / (237.7 + t2 - 273.15) + ln((rh + 1) / 100)) / (17.27 - (17.27 * (t2 - 273.15) / (237.7 + t2 - 273.15) + ln((rh + 1) / 100))) + 273.15",
    ),
    "spec_hum": (
        lambda: weather.specific_humidity(C(), R(), P()) * 1000,
        "1000 * 0.622 * (611.2 * exp(17.67 * (t2 - 273.15) / (t2 - 273.15 + 243.5)) * rh / 100) / (psfc - 0.378 * (611.2 * exp(17.67 * (t2 - 273.15) / (t2 - 273.15 + 243.5)) * rh / 100))",
    ),
    "rh": (
        lambda: weather.relative_humidity(C(), R() / 10000, P()),
        "least(greatest(rh / 10000 * psfc / (0.622 + 0.378 * rh / 10000) / (611.2 * exp(17.67 * (t2 - 273.15) / (t2 - 273.15 + 243.5))) * 100, 0), 100)",
    ),
    "wind_chill": (
        lambda: weather.wind_chill_f(units.convert(C(), "K", "degF"), weather.wind_speed(U(), V()) * 2.237),
        f"CASE WHEN {_F} <= 50 AND sqrt(u10 * u10 + v10 * v10) * 2.237 > 3 THEN 35.74 + 0.6215 * {_F} - 35.75 * pow(sqrt(u10 * u10 + v10 * v10) * 2.237, 0.16) + 0.4275 * {_F} * pow(sqrt(u10 * u10 + v10 * v10) * 2.237, 0.16) ELSE {_F} END",
    ),
    "slp": (lambda: weather.sea_level_pressure(P(), C(), R() / 10000, F.lit(100.0)), "psfc * exp(100.0 / (287.04 * ((2 * ((1 + 1.609 * rh / 10000) / (1 + rh / 10000)) * t2 + 0.0065 * 100) / 2) / 9.81))"),
}
for _n, (_c, _sql) in _SCALARS.items():
    register(_n, f"WITH {HOURLY} SELECT id, round({_sql}, 3) AS value FROM hourly")(lambda s, d, c=_c: hourly(s, d).select("id", F.round(c(), 3).alias("value")))

_HI = """-42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh"""
register(
    "heat_index",
    f"""WITH {HOURLY}, f AS (SELECT id, rh, {_F} AS t FROM hourly), g AS (SELECT *, {_HI} AS hi, 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + rh * 0.094) AS low FROM f)
    SELECT id, round(CASE WHEN t < 80 THEN t WHEN low < 80 THEN low WHEN rh < 13 AND t BETWEEN 80 AND 112 THEN hi - (13 - rh) / 4 * sqrt((17 - abs(t - 95)) / 17) WHEN rh > 85 AND t BETWEEN 80 AND 87 THEN hi + (rh - 85) / 10 * (87 - t) / 5 ELSE hi END, 2) AS value FROM g""",
)(lambda s, d: hourly(s, d).select("id", F.round(weather.heat_index_f(units.convert(C(), "K", "degF"), R()), 2).alias("value")))
register(
    "fosberg",
    f"""WITH {HOURLY}, f AS (SELECT id, rh, {_F} AS t, sqrt(u10 * u10 + v10 * v10) * 2.23694 AS w FROM hourly),
    m AS (SELECT *, CASE WHEN rh < 10 THEN 0.03229 + 0.281073 * rh - 0.000578 * rh * t WHEN rh <= 50 THEN 2.22749 + 0.160107 * rh - 0.01478 * t ELSE 21.0606 + 0.005565 * rh * rh - 0.00035 * rh * t - 0.483199 * rh END / 30 AS m FROM f)
    SELECT id, round(least(greatest((1 - 2 * m + 1.5 * m * m - 0.5 * m * m * m) * sqrt(1 + w * w) / 0.3002, 0), 100), 3) AS value FROM m""",
)(lambda s, d: hourly(s, d).select("id", F.round(weather.fosberg(units.convert(C(), "K", "degF"), R(), weather.wind_speed(U(), V()) * 2.23694), 3).alias("value")))

register(
    "fosberg_by_name",
    f"""WITH {HOURLY}, f AS (SELECT id, {_F} AS t, sqrt(u10 * u10 + v10 * v10) * 2.23694 AS w,
      least(greatest(rh / 10000 * psfc / (0.622 + 0.378 * rh / 10000) / (611.2 * exp(17.67 * (t2 - 273.15) / (t2 - 273.15 + 243.5))) * 100, 0), 100) AS rh FROM hourly),
    m AS (SELECT *, CASE WHEN rh < 10 THEN 0.03229 + 0.281073 * rh - 0.000578 * rh * t WHEN rh <= 50 THEN 2.22749 + 0.160107 * rh - 0.01478 * t ELSE 21.0606 + 0.005565 * rh * rh - 0.00035 * rh * t - 0.483199 * rh END / 30 AS m FROM f)
    SELECT id, round(least(greatest((1 - 2 * m + 1.5 * m * m - 0.5 * m * m * m) * sqrt(1 + w * w) / 0.3002, 0), 100), 3) AS value FROM m""",
)(lambda s, d: registry.BUILT_IN.apply(hourly(s, d).withColumn("q2", R() / 10000), "fosberg_fire_weather_index").select("id", F.round("fosberg_fire_weather_index", 3).alias("value")))

# Kernels


@register("return_value_gev")
def return_value_gev(spark, d):
    blocks = aggregate.block_extremes(grid(spark, d), ["sim", "cell_id"], "v").groupBy("sim", "block").agg(F.max("v").alias("v"))
    return kernels.return_values(blocks, ["sim"], "v", [2, 10, 50], "gev")


@register("return_period_gumbel")
def return_value_gumbel(spark, d):
    return kernels.return_values(aggregate.block_extremes(daily(spark, d), ["sim"], "v"), ["sim"], "v", [2, 10, 50], "gumbel")


@register(
    "ess",
    f"""WITH {SERIES}, x AS (SELECT sim, v - avg(v) OVER (PARTITION BY sim) AS d, row_number() OVER (PARTITION BY sim ORDER BY "time") AS i, count(*) OVER (PARTITION BY sim) AS n FROM series),
    s AS (SELECT sim, n, sum(d * d) AS s FROM x GROUP BY ALL), p AS (SELECT a.sim, sum(a.d * b.d * (1 - (b.i - a.i) / a.n::DOUBLE)) AS p FROM x a JOIN x b ON a.sim = b.sim AND a.i < b.i GROUP BY a.sim)
    SELECT sim, n, round(n / (1 + 2 * p / s), 4) AS ess FROM s JOIN p USING (sim)""",
)
def ess(spark, d):
    return rounded(kernels.sample_sizes(series(spark, d), ["sim"], "v"), "ess")


@register("qdm")
def qdm(spark, d):
    o = series(spark, d)
    part = lambda cond, name: F.when(cond, F.col("v")).alias(name)
    y = F.year("time")
    return kernels.quantile_delta(o.select("sim", part(y < 1997, "observed"), part((y >= 1997) & (y < 1999), "historical"), part(y >= 1999, "target")), ["sim"], "observed", "historical", "target")
