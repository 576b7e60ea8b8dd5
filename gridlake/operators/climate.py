"""Series windows, combinations of simulations, warming levels and representative years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import by_time, joined_back, season
from . import aggregate


def anomaly(df: DataFrame, key: list[str], value: str, years: tuple[int, int], time: str = "time") -> DataFrame:
    """Values less the series' mean over the reference years."""
    return _less_mean(df, df.where(F.year(time).between(*years)), key, value)


def _less_mean(df: DataFrame, reference: DataFrame, key: list[str], value: str) -> DataFrame:
    """df less the means of reference: a partial aggregation joined back, so no series is held as a whole. Null keys match."""
    means = reference.groupBy(*key).agg(F.avg(value).alias("_mean"))
    return joined_back(df, means, key, "left").withColumn(value, F.col(value) - F.col("_mean")).select(*df.columns)


def without_season(df: DataFrame, key: list[str], value: str, time: str = "time") -> DataFrame:
    """Values less the series' mean of their month."""
    dated = df.withColumn("_month", F.month(time))
    return _less_mean(dated, dated, [*key, "_month"], value).drop("_month")


def within_season(df: DataFrame, key: list[str], value: str, n: int, time: str = "time") -> DataFrame:
    """Centred rolling means that run within each season's rows."""
    df = df.withColumn("season", season(time))
    return df.withColumn(value, aggregate.rolling(df, [*key, "season"], value, n, "mean", centred=True, time=time))


def effective_temperature(df: DataFrame, key: list[str], value: str, time: str = "time") -> DataFrame:
    """Half of a day's value, a quarter of the last, an eighth each of the two before; NULL on the first three."""
    w = by_time(key, time)
    v = lambda k: F.lag(value, k).over(w)
    return df.withColumn(value, 0.5 * F.col(value) + 0.25 * v(1) + 0.125 * v(2) + 0.125 * v(3))


def time_delta(df: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """Steps from the middle of each series, floor(-n / 2) first."""
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("time_delta", (F.row_number().over(by_time(key, time)) - 1 + F.floor(-n / 2)).cast("int"))


def hour_of_year(df: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """1 to 8760 by position."""
    return df.withColumn("hour", (F.row_number().over(by_time(key, time)) - 1) % 8760 + 1)


def first_crossing(df: DataFrame, key: list[str], value: str, levels: list[float], time: str = "time") -> DataFrame:
    """When each series first reaches each level; NULL if never."""
    level = F.explode(F.array(*[F.lit(float(x)) for x in levels]))
    return df.select("*", level.alias("level")).groupBy(*key, "level").agg(F.min(F.when(F.col(value) >= F.col("level"), F.col(time))).alias("at"))


def concat_sim(df: DataFrame, facets: list[str]) -> DataFrame:
    """sim: the facets, lower-cased, without blanks, joined by underscores."""
    return df.withColumn("sim", F.concat_ws("_", *[F.regexp_replace(F.lower(F.col(c)), " ", "") for c in facets]))


def concat_time(df: DataFrame, key: list[str], scenario: str, historical: str) -> DataFrame:
    """Each scenario with the historical rows of its model before its own; historical rows alone go."""
    past = df.where(F.col(scenario) == historical)
    future = df.where(F.col(scenario) != historical)
    models = future.select(*key, scenario).distinct()
    return future.unionByName(past.drop(scenario).join(models, key).select(*df.columns))


def merge_variables(frames: list[DataFrame], key: list[str], time: str = "time") -> DataFrame:
    """The variables of several frames side by side: every series and time that any of them has, NULL where one lacks it."""
    out = frames[0]
    for f in frames[1:]:
        if both := (set(f.columns) & set(out.columns)) - {*key, time}:
            raise ValueError(f"variables that come twice: {sorted(both)}")
        out = out.join(f, [*key, time], "full")
    return out


def concat_frames(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of several frames under each other, each with its label in a column; columns that one lacks are NULL."""
    out = None
    for label, f in frames.items():
        f = f.withColumn(name, F.lit(label))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def snapshot_mean(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The mean of each series over the window of each warming level; missing values count nothing."""
    return df.groupBy("warming_level", *key).agg(F.avg(value).alias(value))


def first_where(df: DataFrame, key: list[str], condition: Column, time: str = "time", else_first: bool = False) -> DataFrame:
    """(key, at): when a condition first holds; never is NULL, or the first time of the series."""
    at = F.min(F.when(condition, F.col(time)))
    return df.groupBy(*key).agg((F.coalesce(at, F.min(time)) if else_first else at).alias("at"))


def paired_difference(future: DataFrame, historic: DataFrame, key: list[str], value: str, step: str) -> DataFrame:
    """Future less historic by key and step; a key without one takes the mean of all historic keys at that step."""
    h = historic.dropDuplicates([*key, step]).withColumnRenamed(value, "then")
    mean = historic.groupBy(step).agg(F.avg(value).alias("mean"))
    both = future.join(h.select(*key, step, "then"), [*key, step], "left").join(mean, step, "left")
    return both.select(*key, step, (F.col(value) - F.coalesce("then", "mean")).alias(value))


def warming_slice(df: DataFrame, centres: DataFrame, key: list[str], window: int = 15, years: tuple[int, int] = (1950, 2100), time: str = "time") -> DataFrame:
    """For each level, the years [centre - window, centre + window - 1] of each series.

    centres: key columns, level and year; levels whose window is not wholly in
    `years` are left out, 29 February too. Steps are counted from the middle.
    """
    ok = centres.where((F.col("year") - window >= years[0]) & (F.col("year") + window - 1 <= years[1]))
    c = F.broadcast(ok.withColumnsRenamed({"year": "centre", "level": "warming_level"}))
    near = df.join(c, key).where(F.year(time).between(F.col("centre") - window, F.col("centre") + window - 1))
    return time_delta(near.where(~((F.month(time) == 2) & (F.dayofmonth(time) == 29))), [*key, "warming_level"], time)


def nearest_to_quantile(df: DataFrame, key: list[str], value: str, q: float, by: str = "year") -> DataFrame:
    """For each key, the actual value nearest to the quantile over `by`; of equals (to six places) that of the smallest `by`."""
    some = df.where(F.col(value).isNotNull())
    near = joined_back(some, some.groupBy(*key).agg(F.percentile(value, q).alias("_q")), key)
    order = F.struct(F.round(F.abs(F.col(value) - F.col("_q")), 6).alias("off"), F.col(by).alias("by"))
    rest = [c for c in df.columns if c not in key]
    return near.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*[F.col("_x")[c].alias(c) if c in rest else F.col(c) for c in df.columns])


def fs_statistic(df: DataFrame, key: list[str], value: str, bins: int = 1023, time: str = "time") -> DataFrame:
    """For each month and year the sum over bins of |share that year - share in all years|, divided by the days of the month.

    Shares are compared by bin number, each between its own extremes. Between
    the bins that occur a share stays what it was, so the sum runs over the
    stretches between them and no table of all bins is made.
    """
    df = df.where(F.col(value).isNotNull()).withColumns({"month": F.month(time), "year": F.year(time)})
    whole = aggregate.cdf(df, [*key, "month"], value, bins).select(*key, "month", "bin", F.col("prob").alias("all"))
    own = aggregate.cdf(df, [*key, "month", "year"], value, bins).select(*key, "month", "year", "bin", F.col("prob").alias("own"))
    years = own.select(*key, "month", "year").distinct()
    steps = own.withColumn("all", F.lit(None).cast("double")).unionByName(whole.join(years, [*key, "month"]).withColumn("own", F.lit(None).cast("double")))
    steps = steps.groupBy(*key, "month", "year", "bin").agg(F.max("own").alias("own"), F.max("all").alias("all"))
    w = Window.partitionBy(*key, "month", "year").orderBy("bin")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0.0))
    length = F.coalesce(F.lead("bin").over(w), F.lit(bins + 1)) - F.col("bin")
    days = F.element_at(F.array(*[F.lit(d) for d in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), F.col("month"))
    part = steps.select(*key, "month", "year", (F.abs(share("own") - share("all")) * length).alias("d"))
    return part.groupBy(*key, "month", "year").agg((F.sum("d") / F.first(days)).alias("fs"))


def top_months(fs: DataFrame, key: list[str]) -> DataFrame:
    """The year with the smallest statistic for each month; of equals the earliest."""
    w = Window.partitionBy(*key, "month").orderBy("fs", "year")
    return fs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
