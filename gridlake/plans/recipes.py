"""Whole analyses as one call: typical and extreme years, standard-year profiles, vulnerability metrics and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, climate, kernels, profiles, select
from ..sources import exports, weather_files

#: Daily statistics of the typical-year selection: (variable, statistic) of each weighted column.
STATISTICS = {
    "t_max": ("t_c", "max"), "t_min": ("t_c", "min"), "t_mean": ("t_c", "mean"), "dew_max": ("dew_c", "max"), "dew_min": ("dew_c", "min"), "dew_mean": ("dew_c", "mean"),
    "wind_max": ("wind", "max"), "wind_mean": ("wind", "mean"), "global_irradiance": ("global_wh", "sum"), "direct_irradiance": ("direct_wh", "sum"),
}


def daily_statistics(hourly: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """The ten daily statistics of hourly weather, from one aggregation."""
    made = [aggregate.METRICS[how](variable).alias(name) for name, (variable, how) in STATISTICS.items()]
    return hourly.groupBy(*key, F.date_trunc("day", time).alias(time)).agg(*made)


def typical_year(hourly: DataFrame, key: list[str], columns: list[str], time: str = "time", weights: dict[str, float] | None = None, skip_last: bool = True) -> DataFrame:
    """A typical meteorological year of each series: its hours, with the year that each month came from.

    Volcanic years go; each month's year has the least weighted statistic of
    daily values; joints of months are smoothed in `columns`.
    """
    kept = profiles.drop_volcanic_years(select.drop_leap_days(hourly, time), time)
    fs = profiles.weighted_fs(daily_statistics(kept, key, time), key, weights or profiles.TMY_WEIGHTS, time=time)
    top = climate.top_months(profiles.skip_last_month(fs, key) if skip_last else fs, key)
    return profiles.smooth_joints(_in_one_year(profiles.assemble(kept, top, key, time), time), key, columns, time=time)


def shock_year(hourly: DataFrame, key: list[str], value: str, extreme: str, columns: list[str], time: str = "time", skip_last: bool = False) -> DataFrame:
    """An extreme year: of each month the hottest or coldest by its daily medians, joints smoothed."""
    daily = aggregate.resample(hourly, key, value, "day", "mean", time)
    months = profiles.shock_months(daily, key, value, extreme, skip_last=skip_last, time=time)
    return profiles.smooth_joints(_in_one_year(profiles.assemble(select.drop_leap_days(hourly, time), months, key, time), time), key, columns, time=time)


def _in_one_year(df: DataFrame, time: str) -> DataFrame:
    """Hours of months of several years as one common year, 2001; `year` says where each came from."""
    moved = F.make_timestamp_ntz(F.lit(2001), F.month(time), F.dayofmonth(time), F.hour(time), F.minute(time), F.second(time).cast("decimal(8,6)"))
    return df.withColumn(time, moved.cast(dict(df.dtypes)[time]))


def common_hours(df: DataFrame, position: str, time: str = "time") -> DataFrame:
    """df with a time for positions from 1 on: hours from 1 January 2001 in years without leap days."""
    n = F.col(position) - 1
    day = F.floor(n / 24)
    date = F.date_add(F.make_date((2001 + F.floor(day / 365)).cast("int"), F.lit(1), F.lit(1)), (day % 365).cast("int"))
    # from 29 February of a leap year on a common year's day is a day later
    late = (F.dayofyear(date) >= 60) & (F.dayofmonth(F.last_day(F.make_date(F.year(date), F.lit(2), F.lit(1)))) == 29)
    return df.withColumn(time, F.when(late, F.date_add(date, 1)).otherwise(date).cast("timestamp_ntz") + F.make_dt_interval(hours=(n % 24).cast("int")))


def hours_of_years(df: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """df with hour (1 to 8,760) and year (0 on) by position in each series; an incomplete last year goes."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(time)) - 1, "_n": F.count("*").over(w)}).where(F.col("_i") < F.floor(F.col("_n") / 8760) * 8760)
    return d.withColumns({"hour": F.col("_i") % 8760 + 1, "year": F.floor(F.col("_i") / 8760)}).drop("_i", "_n")


def persistence_year(hourly: DataFrame, key: list[str], value: str, q: float, time: str = "time", skip_last: bool = False) -> DataFrame:
    """A year of hours, each from the year whose value at that hour is nearest to the quantile over the years.

    skip_last leaves the last month of each series out of the choice. Rows keep
    all columns of their hour; year counts from 0, hour from 1.
    """
    placed = hours_of_years(select.drop_leap_days(hourly, time), key, time)
    able = placed
    if skip_last:
        last = placed.groupBy(*key).agg(F.date_trunc("month", F.max(time)).alias("_last"))
        able = placed.join(last, key).where(F.col(time) < F.col("_last")).drop("_last")
    top = climate.nearest_to_quantile(able.select(*key, "hour", "year", value), [*key, "hour"], value, q).select(*key, "hour", "year")
    return placed.join(top, [*key, "hour", "year"])


def standard_year(df: DataFrame, key: list[str], value: str, q: float = 0.5, baseline: DataFrame | None = None, time: str = "time") -> DataFrame:
    """(key, hour, value): the standard-year profile, or its difference from the baseline's."""
    return profiles.quantile_hours(df, key, value, q, time).drop("year") if baseline is None else profiles.difference_profile(df, baseline, key, value, q, time)


def write_profiles(profile: DataFrame, folder: str, key: list[str], value: str, stem: str, levels: list[float]) -> list[str]:
    """One CSV folder for each warming level, hours down and series across; their paths.

    Rows of a profile are 8,760 a series; series are pivoted by name.
    """
    out = []
    for level in levels:
        name = exports.safe(f"{stem}_{profiles.level_label(level)}".replace(".", "p"))
        one = profile.where(F.col("warming_level") == level).withColumn("_s", F.concat_ws("_", *key))
        one.groupBy("hour").pivot("_s").agg(F.first(value)).orderBy("hour").coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
        out.append(f"{folder}/{name}")
    return out


def vulnerability(
    df: DataFrame, key: list[str], value: str, metric: str = "max", months: list[int] | None = None, threshold: float | None = None, percentile: float | None = None,
    one_in_x: list[float] | None = None, distribution: str = "gev", precipitation: bool = False, time: str = "time", **block,
) -> DataFrame:
    """One metric of each series: mean days a year beyond a threshold, a percentile of daily values, or values once in x years.

    Exactly one of threshold, percentile (0-100) and one_in_x is given. months
    keeps some of the year; precipitation is summed by day before its maxima.
    """
    if sum(x is not None for x in (threshold, percentile, one_in_x)) != 1:
        raise ValueError("exactly one of threshold, percentile and one_in_x")
    d = select.months(df, months, time) if months else df
    if threshold is not None:
        day = aggregate.resample(d, key, value, "day", metric, time)
        year = day.groupBy(*key, F.year(time).alias("_y")).agg(F.sum((F.col(value) > threshold).cast("int")).alias("n"))
        return year.groupBy(*key).agg(F.avg("n").alias(value))
    if percentile is not None:
        return aggregate.daily_quantile(d, key, value, metric, percentile / 100, time)
    if precipitation:
        d = aggregate.resample(d, key, value, "day", "sum", time)
    return kernels.return_values(aggregate.block_extremes(d, key, value, metric, time=time, **block), key, value, one_in_x, distribution)


def vulnerability_table(df: DataFrame, key: list[str], value: str, metrics: dict[str, dict], periods: dict[str, tuple[int, int]], time: str = "time") -> DataFrame:
    """(key, metric, a column for each period): metrics of several periods of years side by side.

    metrics: by name the options of vulnerability() but one_in_x, which has several rows.
    """
    rows = None
    for name, options in metrics.items():
        for period, years in periods.items():
            found = vulnerability(df.where(F.year(time).between(*years)), key, value, time=time, **options)
            found = found.select(*key, F.lit(name).alias("metric"), F.lit(period).alias("period"), value)
            rows = found if rows is None else rows.unionByName(found)
    return rows.groupBy(*key, "metric").pivot("period", list(periods)).agg(F.first(value))


def write_year(df: DataFrame, key: list[str], place: weather_files.Place, path: str, kind: str = "epw", time: str = "time") -> None:
    """A representative year as weather files, after it is brought to 8,760 hours."""
    whole = weather_files.hours_8760(df, key, [c for c in df.columns if c not in (*key, time)], time)
    weather_files.write(whole, key, place, path, kind, time=time)


def sea_level(df: DataFrame, key: list[str], p: str, t: str, q: str, elevation: str, average: bool = True, time: str = "time") -> Column:
    """Sea-level pressure; average takes the mean temperature of the last 12 steps, NULL on the first 11."""
    from ..functions import weather

    warm = aggregate.rolling(df, key, t, 12, "mean", time=time) if average else F.col(t)
    return weather.sea_level_pressure(F.col(p), warm, F.col(q), F.col(elevation))
