"""Warming levels: from global means to when each level is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import days_in_month
from . import aggregate

LEVELS = (0.8, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0)
#: (years before the centre, years after it) of the two conventions for windows.
SLICE, CENTRED = (15, 14), (14, 15)


def global_mean(df: DataFrame, key: list[str], value: str, time: str = "time") -> DataFrame:
    """Monthly global means: weighted by sqrt(cos(lat)) over latitudes, plain over longitudes."""
    weight = F.sqrt(F.cos(F.radians("lat")))
    column = df.groupBy(*key, time, "lon").agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(value))
    return column.groupBy(*key, time).agg(F.avg(value).alias(value))


def smoothed_anomaly(df: DataFrame, key: list[str], value: str, years: tuple[int, int], steps: int = 240, time: str = "time") -> DataFrame:
    """Monthly means less the day-weighted mean of the reference years, as a centred mean of `steps` months (NULL where fewer)."""
    days = days_in_month(time)
    ref = df.where(F.year(time).between(*years) & F.col(value).isNotNull()).groupBy(*key).agg((F.sum(F.col(value) * days) / F.sum(days)).alias("_ref"))
    d = df.join(ref, key).withColumn(value, F.col(value) - F.col("_ref")).drop("_ref")
    return d.withColumn(value, aggregate.rolling(d, key, value, steps, "mean", centred=True, time=time))


def table(df: DataFrame, key: list[str], value: str, years: tuple[int, int], levels=LEVELS, steps: int = 240, time: str = "time") -> DataFrame:
    """(key, level, at): when each model's smoothed anomaly first reaches each level; NULL if never."""
    smooth = smoothed_anomaly(df, key, value, years, steps, time).where(F.col(value).isNotNull())
    level = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    return smooth.select("*", level).groupBy(*key, "level").agg(F.min(F.when(F.col(value) >= F.col("level"), F.col(time))).alias("at"))


def level_at_year(trajectories: DataFrame, year: int, scenarios: list[str] | None = None) -> DataFrame:
    """(scenario, low, mean, high) of a year, to two places; before 2015 the historical run speaks for all.

    trajectories: scenario, year, low, mean, high.
    """
    past = F.col("scenario") == "Historical"
    df = trajectories.where((F.col("year") == year) & (past if year < 2015 else ~past))
    if scenarios and year >= 2015:
        df = df.where(F.col("scenario").isin(scenarios))
    return df.select("scenario", *[F.round(c, 2).alias(c) for c in ("low", "mean", "high")])


def year_at_level(trajectories: DataFrame, level: float) -> DataFrame:
    """(scenario, early, mean, late): the first years strictly above a level.

    The early bound reads the high trajectory and the late one the low. A scenario
    whose high trajectory is above the level all along takes its early bound from
    the historical run.
    """
    first = lambda c: F.min(F.when(F.col(c) > level, F.col("year")))
    by = trajectories.groupBy("scenario").agg(first("high").alias("early"), first("mean").alias("mean"), first("low").alias("late"), F.min(F.col("high")).alias("_least"))
    past = by.where("scenario = 'Historical'").select(F.col("early").alias("_before"))
    early = F.when(F.col("_least") > level, F.coalesce("_before", "early")).otherwise(F.col("early"))
    return by.where("scenario <> 'Historical'").join(F.broadcast(past), how="left").select("scenario", early.alias("early"), "mean", "late")


def timing(trajectories: DataFrame, levels: list[float]) -> DataFrame:
    """(scenario, level, year) of mean trajectories; a level that the first row exceeds counts as not reached, too."""
    level = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    over = F.min(F.when(F.col("mean") > F.col("level"), F.col("year"))).alias("year")
    found = trajectories.select("*", level).groupBy("scenario", "level").agg(over, F.min("year").alias("_first"))
    return found.select("scenario", "level", F.when(F.col("year") > F.col("_first"), F.col("year")).alias("year"))


def window_years(centres: DataFrame, convention: tuple[int, int] = CENTRED, last: int = 2100) -> DataFrame:
    """centres (..., year) with first and last of the window around; windows beyond `last` are left out."""
    before, after = convention
    return centres.where(F.col("year") + after <= last).withColumns({"first": F.col("year") - before, "last": F.col("year") + after})


def dummy_time(df: DataFrame, key: list[str], unit: str = "DAY", delta: str = "time_delta", out: str = "time") -> DataFrame:
    """df with a time from 2000-01-01 on for positions from each series' middle, in steps of HOUR, DAY or MONTH.

    Leap days do not occur: whole days are counted in years of 365.
    """
    from pyspark.sql import Window

    n = F.col(delta) - F.min(delta).over(Window.partitionBy(*key))
    if unit == "MONTH":
        return df.withColumn(out, F.expr("timestamp_ntz'2000-01-01 00:00:00'") + F.make_ym_interval(F.lit(0), n.cast("int")))
    per = 24 if unit == "HOUR" else 1
    day = F.floor(n / per)
    year, of_year = 2000 + F.floor(day / 365), day % 365
    # positions in a common year; leap years skip over 29 February
    date = F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (of_year + F.when((of_year >= 59) & (F.dayofmonth(F.last_day(F.make_date(year.cast("int"), F.lit(2), F.lit(1)))) == 29), 1).otherwise(0)).cast("int"))
    return df.withColumn(out, date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (n % per).cast("int")) if unit == "HOUR" else date.cast("timestamp_ntz"))
