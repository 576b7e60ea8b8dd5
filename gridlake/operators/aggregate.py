"""Aggregations over time, space and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import by_time, days_in_month, joined_back

METRICS = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0))}


#: Sketches of quantiles are off by one in ACCURACY of a key's values at most; brackets reach MARGIN times as far.
ACCURACY, MARGIN = 10_000, 3


def metric(df: DataFrame, key: list[str], value: str, kind: str) -> DataFrame:
    """One value a key; the sum of nothing but missing values is 0."""
    if kind == "median":
        return quantiles(df, key, value, [0.5]).withColumn("p", F.col("p")[0]).withColumnRenamed("p", value)
    return df.groupBy(*key).agg(METRICS[kind](value).alias(value))


def quantiles(df: DataFrame, key: list[str], value: str, q: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(key, p): exact quantiles (0-1) of each key as an array, linear between values, however many values a key has.

    Keys of up to `accuracy` values are gathered. For any other a sketch, merged
    from partial ones, gives a bracket of values that each quantile must lie in.
    Values outside all brackets are counted at the next bracket's start, so
    partial aggregation leaves of them one row a bracket; those inside are
    ranked. So a task sorts about 2 * MARGIN / accuracy of a large key's values
    for each quantile. NaN counts as missing; a key of nothing but missing
    values has NULLs; a NULL key is a key.
    """
    if not key:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, q, accuracy).drop("_all")
    v = F.col(value).cast("double")
    some = df.select(*key, F.when(~F.isnan(v), v).alias("_v"))
    large = some.groupBy(*key).agg(F.count("_v").alias("_n")).where(F.col("_n") > accuracy)
    few = joined_back(some, large, key, "left_anti").groupBy(*key).agg(F.percentile("_v", [float(x) for x in q]).alias("p"))
    many = joined_back(some.where("_v IS NOT NULL"), large, key)
    levels, reach = sorted(set(q)), MARGIN / accuracy
    sketch = many.groupBy(*key).agg(F.percentile_approx("_v", [min(max(x + d, 0.0), 1.0) for x in levels for d in (-reach, reach)], accuracy).alias("_ends"))
    at, end = F.col("_v"), F.col("_ends")
    inside, starts = F.lit(False), [F.lit(None), F.lit(None)]
    for i, x in enumerate(levels):  # a bracket that would begin below 0 or end beyond 1 is open there
        above = at >= end[2 * i] if x > reach else F.lit(True)
        inside = inside | (above & (at <= end[2 * i + 1] if x < 1 - reach else F.lit(True)))
        starts.append(F.when(~above, end[2 * i]))
    counted_at = F.when(inside, at).otherwise(F.coalesce(F.least(*[s.cast("double") for s in starts]), end[2 * len(levels) - 1]))
    counted = joined_back(many, sketch, key).groupBy(*key, "_n", counted_at.alias("_at")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)

    def pick(x: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(x))
        low, high = (F.min(F.when(F.col("_upto") > f(place), F.col("_at"))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    ranked = counted.withColumn("_upto", F.sum("_c").over(upto)).groupBy(*key).agg(F.array(*[pick(x) for x in q]).alias("p"))
    return few.unionByName(ranked)


def percentiles(df: DataFrame, key: list[str], value: str, levels: list[float]) -> DataFrame:
    """Exact percentiles (0-100), linear between values, one row each."""
    found = quantiles(df, key, value, [x / 100 for x in levels])
    return found.select(*key, F.posexplode("p").alias("i", value)).select(*key, F.element_at(F.array(*[F.lit(float(x)) for x in levels]), F.col("i") + 1).alias("percentile"), value)


def weighted_mean(df: DataFrame, key: list[str], value: str, weight: Column) -> DataFrame:
    """Mean by weights; missing values weigh nothing."""
    v = F.col(value)
    return df.groupBy(*key).agg((F.sum(v * weight) / F.sum(F.when(v.isNotNull(), weight))).alias(value))


def area_mean(df: DataFrame, key: list[str], value: str, lat: str = "lat") -> DataFrame:
    return weighted_mean(df, key, value, F.cos(F.radians(lat)))


def day_weighted_year(df: DataFrame, key: list[str], value: str, time: str = "time") -> DataFrame:
    """Annual means of monthly values by the days of the months."""
    return weighted_mean(df.withColumn("year", F.year(time)), [*key, "year"], value, days_in_month(time))


def resample(df: DataFrame, key: list[str], value: str, unit: str, kind: str, time: str = "time") -> DataFrame:
    """One value a day, month or year, under its first instant."""
    return df.withColumn(time, F.date_trunc(unit, time)).groupBy(*key, time).agg(METRICS[kind](value).alias(value))


def bins_of_days(df: DataFrame, key: list[str], value: str, n: int, kind: str, time: str = "time") -> DataFrame:
    """One value for each n days, counted from the first day of the series."""
    first = df.groupBy(*key).agg(F.to_date(F.min(time)).alias("_first"))
    return metric(joined_back(df, first, key).withColumn("bin", F.floor(F.datediff(F.to_date(time), "_first") / n)), [*key, "bin"], value, kind)


def rolling(df: DataFrame, key: list[str], value: str, n: int, kind: str, centred: bool = False, time: str = "time") -> Column:
    """A rolling aggregate of n steps; NULL unless all n are there."""
    frame = (-(n // 2), (n - 1) // 2) if centred else (-(n - 1), 0)
    w = by_time(key, time).rowsBetween(*frame)
    return F.when(F.count(value).over(w) == n, {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}[kind](value).over(w))


def block_extremes(
    df: DataFrame, key: list[str], value: str, kind: str = "max", years: int = 1, duration: int = 1, how: str = "sustained",
    time: str = "time", group_days: int | None = None, group_duration: int = 1,
) -> DataFrame:
    """Extremes of blocks of calendar years that begin with the series' first, partial ones included; blocks without a value go.

    In stages: steps are rolled over `duration` of them, then reduced to one
    extreme for each `group_days` days, then rolled over `group_duration` such
    groups, then reduced to blocks. Rolling that is sustained takes the opposite
    extreme, cumulative the sum, average the mean; it is NULL unless all steps are there.
    """
    roll = {"cumulative": "sum", "average": "mean", "sustained": "min" if kind == "max" else "max"}[how]
    if duration > 1:
        df = df.withColumn(value, rolling(df, key, value, duration, roll, time=time))
    if group_days is None and group_duration > 1:
        raise ValueError("groups are rolled only if there are any: give group_days")
    if group_days is not None:
        start = df.groupBy(*key).agg(F.to_date(F.min(time)).alias("_start"))
        day = F.floor(F.datediff(F.to_date(time), "_start") / group_days) * group_days
        df = joined_back(df, start, key).withColumn(time, F.date_add("_start", day.cast("int")).cast("timestamp_ntz"))
        df = metric(df, [*key, time], value, kind)
        if group_duration > 1:
            df = df.withColumn(value, rolling(df, key, value, group_duration, roll, time=time))
    year = F.year(time)
    if years == 1:
        df = df.withColumn("block", year.cast("int"))
    else:
        # the year in which the block ends, from the first year of each series
        first = df.groupBy(*key).agg(F.min(year).alias("_first"))
        df = joined_back(df, first, key).withColumn("block", (F.col("_first") + years * (F.floor((year - F.col("_first")) / years) + 1) - 1).cast("int"))
    return df.groupBy(*key, "block").agg(METRICS[kind](value).alias(value)).where(F.col(value).isNotNull())


def exceedance(df: DataFrame, key: list[str], value: str, threshold: float, above: bool = True, duration: int = 1, period: str = "year", time: str = "time") -> DataFrame:
    """How many steps of each period lie strictly beyond a threshold, or end a run of `duration` that does; NULL where all are missing."""
    v = F.col(value)
    df = df.withColumn("over", F.when(v.isNotNull(), (v > threshold if above else v < threshold).cast("int")))
    if duration > 1:
        df = df.withColumn("over", rolling(df, key, "over", duration, "min", time=time))
    return df.withColumn("period", F.date_trunc(period, time)).groupBy(*key, "period").agg(F.sum("over").alias("n"))


def hot_days(df: DataFrame, key: list[str], value: str, threshold: float, time: str = "time") -> DataFrame:
    """Mean number of days a year whose maximum is over a threshold."""
    day = df.groupBy(*key, F.to_date(time).alias("day")).agg(F.max(value).alias("high"))
    year = day.groupBy(*key, F.year("day").alias("year")).agg(F.sum((F.col("high") > threshold).cast("int")).alias("n"))
    return year.groupBy(*key).agg(F.avg("n").alias("days"))


def model_stats(df: DataFrame, key: list[str], value: str, sim: str = "sim") -> DataFrame:
    """df and its mean, min, max and median over simulations as four more simulations; one aggregation serves all."""
    stats = df.groupBy(*key).agg(*[METRICS[k](value).alias(k) for k in ("mean", "min", "max", "median")])
    more = stats.unpivot(key, ["mean", "min", "max", "median"], sim, value)
    return df.select(*key, sim, value).unionByName(more.select(*key, sim, value))


def trend(df: DataFrame, key: list[str], value: str, x: str = "year") -> DataFrame:
    return df.groupBy(*key).agg(F.regr_slope(value, x).alias("slope"), F.regr_intercept(value, x).alias("intercept"))


def cdf(df: DataFrame, key: list[str], value: str, bins: int = 1023) -> DataFrame:
    """(bin, edge, prob): the share of values up to each of equal bins between the series' extremes.

    The last bin is closed; a series of equal values has one bin that ends there.
    """
    some = df.where(F.col(value).isNotNull())
    ends = some.groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("all")).where("all > 1")
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(value) - F.col("low")) / width) + 1, F.lit(bins))).otherwise(F.lit(bins))
    counted = some.join(ends, key).groupBy(*key, "low", "high", "all", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select(*key, "bin", (F.col("low") + F.col("bin") * width).alias("edge"), (F.sum("n").over(upto) / F.col("all")).alias("prob"))


def grouped_exceedance(
    df: DataFrame, key: list[str], value: str, threshold: float, above: bool = True, duration: int = 1, group: str | None = None,
    group_duration: int = 1, period: str = "year", smoothing: int | None = None, time: str = "time",
) -> DataFrame:
    """(key, period, n): events in each period, in stages.

    A step counts if it ends `duration` steps beyond the threshold; a group (day,
    month) counts if any of its steps does, then if it ends `group_duration` such
    groups. Missing values count as no event once summed; smoothing is a centred
    mean over periods. The group may not be longer than the period.
    """
    order = ["hour", "day", "month", "year"]
    if group and order.index(group) > order.index(period):
        raise ValueError("a group is not longer than the period")
    v = F.col(value)
    d = df.select(*key, time, F.when(v.isNotNull(), (v > threshold if above else v < threshold).cast("int")).alias("_e"))
    if duration > 1:
        d = d.withColumn("_e", rolling(d, key, "_e", duration, "min", time=time))
    if group:
        d = d.groupBy(*key, F.date_trunc(group, time).alias(time)).agg((F.coalesce(F.sum("_e"), F.lit(0)) > 0).cast("int").alias("_e"))
    if group_duration > 1:
        d = d.withColumn("_e", rolling(d, key, "_e", group_duration, "min", time=time))
    found = d.groupBy(*key, F.date_trunc(period, time).alias("period")).agg(F.coalesce(F.sum("_e"), F.lit(0)).cast("double").alias("n"))
    return found.withColumn("n", rolling(found, key, "n", smoothing, "mean", centred=True, time="period")) if smoothing else found


def metric_and_percentiles(df: DataFrame, key: list[str], value: str, kind: str, levels: list[float]) -> DataFrame:
    """A metric and exact percentiles side by side: value_kind, value_pLEVEL."""
    found = joined_back(metric(df, key, value, kind).withColumnRenamed(value, f"{value}_{kind}"), quantiles(df, key, value, [x / 100 for x in levels]), key)
    return found.select(*key, f"{value}_{kind}", *[F.col("p")[i].alias(f"{value}_p{x:g}") for i, x in enumerate(levels)])


def daily_quantile(df: DataFrame, key: list[str], value: str, kind: str, q: float, time: str = "time") -> DataFrame:
    """The quantile over time of daily extremes."""
    return quantiles(resample(df, key, value, "day", kind, time), key, value, [q]).select(*key, F.col("p")[0].alias(value))


def day_weighted_rolling(df: DataFrame, key: list[str], value: str, n: int, time: str = "time") -> Column:
    """A centred mean of n months by the days of the months; NULL unless all n are there."""
    w = by_time(key, time).rowsBetween(-(n // 2), (n - 1) // 2)
    days = days_in_month(time)
    return F.when(F.count(value).over(w) == n, F.sum(F.col(value) * days).over(w) / F.sum(days).over(w))
