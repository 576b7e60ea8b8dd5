"""The cell frame: a long table of series, one row for each series and time.

A series is what shares its key columns (sim, scenario, cell or station). Values
are DOUBLE and missing values NULL, never NaN, so that aggregates skip them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Strings that mean a missing value in lookup files; "None" is a value (fixed values).
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]


def without_nan(df: DataFrame) -> DataFrame:
    """df with NaN as NULL in all its floating columns."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def joined_back(df: DataFrame, per_key: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of a table of one row a key; a NULL key is a key."""
    apart = per_key.withColumnsRenamed({k: f"_{k}" for k in key})
    return df.join(apart, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], how).drop(*[f"_{k}" for k in key])


def by_time(key: list[str], time: str = "time") -> WindowSpec:
    return Window.partitionBy(*key).orderBy(time)


def season(time: str = "time") -> Column:
    """DJF, MAM, JJA or SON; December belongs to the label's own year."""
    m = F.month(time)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def days_in_month(time: str = "time") -> Column:
    return F.dayofmonth(F.last_day(time))
