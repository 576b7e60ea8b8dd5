"""Local time: zones with their gaps and repeats, and fixed offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_local(df: DataFrame, key: list[str], zone: str, reindex: bool = False, keep_common: bool = False, time: str = "time") -> DataFrame:
    """df with UTC hours as those of a zone.

    reindex makes the axis regular: of an hour that comes twice in autumn the
    first stays, the hour that spring skips comes with NULL values. keep_common,
    for calendars without leap days, puts hours shifted onto 29 February on the 28th.
    """
    kind = dict(df.dtypes)[time]
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(time).cast("timestamp_ntz"))
    d = df.withColumns({"_utc": F.col(time), time: local})
    if keep_common:
        d = d.withColumn(time, F.when((F.month(time) == 2) & (F.dayofmonth(time) == 29), F.col(time) - F.expr("INTERVAL 1 DAY")).otherwise(F.col(time)))
    if reindex:
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*key, time).orderBy("_utc"))).where("_r = 1").drop("_r")
        # an hour is missing after each step of two hours
        after = F.lead(time).over(Window.partitionBy(*key).orderBy(time))
        d = d.withColumn("_next", after)
        gap = (F.col("_next") == F.col(time) + F.expr("INTERVAL 2 HOUR")) & F.month(time).isin(3, 4)
        rest = [c for c in d.columns if c not in (*key, time, "_utc", "_next")]
        filled = d.where(gap).withColumns({time: F.col(time) + F.expr("INTERVAL 1 HOUR"), **{c: F.lit(None).cast(dict(d.dtypes)[c]) for c in rest}})
        d = d.unionByName(filled)
    return d.select(*df.columns).withColumn(time, F.col(time).cast(kind))


def fixed_offset(df: DataFrame, hours: float, time: str = "time") -> DataFrame:
    """df with its times later by a fixed number of hours, the standard time of a place."""
    return df.withColumn(time, F.timestamp_add("MINUTE", F.lit(round(hours * 60)), F.col(time)))


def gaps(df: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """(key, time, next): places in each series where more than an hour lies between steps."""
    after = F.lead(time).over(Window.partitionBy(*key).orderBy(time))
    return df.select(*key, time, after.alias("next")).where(F.col("next") > F.timestamp_add("HOUR", F.lit(1), F.col(time)))


def dense(df: DataFrame, key: list[str], axis: DataFrame, time: str = "time") -> DataFrame:
    """Each series over all times of an axis, NULL where it has none; the axis is small (years of steps)."""
    every = df.select(*key).distinct().join(axis.select(time).distinct())
    return every.join(df, [*key, time], "left").select(*df.columns)
