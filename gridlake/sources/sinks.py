"""Writers of results: partitioned Parquet, gzip CSV with clean headers, weather years."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(name: str) -> str:
    """A column name without parentheses, blanks and dashes as underscores."""
    return re.sub(r"[ -]", "_", re.sub(r"[()]", "", name))


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, units: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    """gzip CSV; a column's unit follows its name in the header."""
    units = units or {}
    df.toDF(*[clean(c) + (f"_{clean(units[c])}" if c in units else "") for c in df.columns]).write.mode(mode).csv(path, header=True, compression="gzip")


def year_8760(df: DataFrame, key: list[str], columns: list[str], year: int, time: str = "time") -> DataFrame:
    """Each series as the 8,760 hours of a common year: 29 February dropped, gaps filled forward."""
    from pyspark.sql import Window

    hours = df.sparkSession.range(8784).select(F.expr(f"timestampadd(HOUR, id, timestamp_ntz'{year}-01-01 00:00:00')").alias(time))
    hours = hours.where((F.year(time) == year) & ~((F.month(time) == 2) & (F.dayofmonth(time) == 29)))
    dense = df.select(*key).distinct().join(F.broadcast(hours))
    w = Window.partitionBy(*key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    filled = dense.join(df.dropDuplicates([*key, time]), [*key, time], "left")
    return filled.select(*key, time, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
