"""Representative years: typical and extreme meteorological years, standard-year profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weather
from . import aggregate, climate

#: Weights of daily statistics in the typical-year selection, in twentieths (fixed values).
TMY_WEIGHTS = {"t_max": 1, "t_min": 1, "t_mean": 2, "dew_max": 1, "dew_min": 1, "dew_mean": 2, "wind_max": 1, "wind_mean": 1, "global_irradiance": 5, "direct_irradiance": 5}
#: Years dimmed by a volcano (fixed values).
VOLCANIC_YEARS = (1991, 1992, 1993, 1994)


def drop_volcanic_years(df: DataFrame, time: str = "time") -> DataFrame:
    return df.where(~F.year(time).isin(*VOLCANIC_YEARS))


def weighted_fs(df: DataFrame, key: list[str], weights: dict[str, float], bins: int = 1023, time: str = "time") -> DataFrame:
    """(key, month, year, fs): the statistics of several value columns, weighted in twentieths and summed."""
    long = df.unpivot([*key, time], list(weights), "variable", "value")
    fs = climate.fs_statistic(long, [*key, "variable"], "value", bins, time)
    weight = F.create_map(*[F.lit(x) for n, w in weights.items() for x in (n, w / 20)])[F.col("variable")]
    return fs.groupBy(*key, "month", "year").agg(F.sum(F.col("fs") * weight).alias("fs"))


def skip_last_month(fs: DataFrame, key: list[str]) -> DataFrame:
    """Without the last month of the last year, which a shift to local time leaves incomplete."""
    last = F.max(F.struct("year", "month")).over(Window.partitionBy(*key))
    return fs.withColumn("_last", last).where((F.col("year") != F.col("_last.year")) | (F.col("month") != F.col("_last.month"))).drop("_last")


def assemble(df: DataFrame, top: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """The rows of each series in its chosen (month, year); the table of choices is a dozen rows a series."""
    dated = df.withColumns({"month": F.month(time), "year": F.year(time)})
    return dated.join(F.broadcast(top.select(*key, "month", "year")), [*key, "month", "year"])


def shock_months(df: DataFrame, key: list[str], value: str, extreme: str, bins: int = 1023, skip_last: bool = False, time: str = "time") -> DataFrame:
    """(key, month, year, anomaly): the year whose median lies farthest below (cold) or above (hot) the month's.

    Medians are edges of the distribution's equal bins, the first whose share is
    nearest to a half; the first year wins a tie.
    """
    if extreme not in ("hot", "cold"):
        raise ValueError(f"no such extreme: {extreme}")
    d = df.withColumns({"month": F.month(time), "year": F.year(time)})

    def median(by: list[str], name: str) -> DataFrame:
        c = aggregate.cdf(d, by, value, bins)
        # the distance to a half, then the smallest bin
        return c.groupBy(*by).agg(F.min_by("edge", F.struct(F.round(F.abs(F.col("prob") - 0.5), 9), "bin")).alias(name))

    own = median([*key, "month", "year"], "own").join(median([*key, "month"], "all"), [*key, "month"])
    own = own.withColumn("anomaly", F.col("own") - F.col("all"))
    if skip_last:
        own = skip_last_month(own, key)
    order = F.col("anomaly").asc() if extreme == "cold" else F.col("anomaly").desc()
    r = F.row_number().over(Window.partitionBy(*key, "month").orderBy(order, "year"))
    return own.withColumn("_r", r).where("_r = 1").select(*key, "month", "year", "anomaly")


def quantile_hours(df: DataFrame, key: list[str], value: str, q: float, time: str = "time") -> DataFrame:
    """(key, hour, year, value): for each hour of the year the actual value of the year nearest to the quantile over years.

    Hours are counted by position from the start of each series; years are runs
    of 8,760, an incomplete last one is left out.
    """
    w = Window.partitionBy(*key).orderBy(time)
    n = F.count("*").over(Window.partitionBy(*key))
    d = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": n}).where(F.col("_i") < F.floor(F.col("_n") / 8760) * 8760)
    d = d.select(*key, value, (F.col("_i") % 8760 + 1).alias("hour"), F.floor(F.col("_i") / 8760).alias("year"))
    return climate.nearest_to_quantile(d, [*key, "hour"], value, q).select(*key, "hour", "year", value)


def difference_profile(future: DataFrame, baseline: DataFrame, key: list[str], value: str, q: float = 0.5, time: str = "time") -> DataFrame:
    """(key, hour, value): the future profile less the baseline's of the same key; of all baselines where it has none."""
    return climate.paired_difference(quantile_hours(future, key, value, q, time), quantile_hours(baseline, key, value, q, time), key, value, "hour")


def smooth_joints(df: DataFrame, key: list[str], columns: list[str], hours: int = 12, time: str = "time", humidity: tuple[str, str, str, str] | None = None) -> DataFrame:
    """df with the hours around each start of a month refitted by a parabola that nearly keeps both ends.

    One series is one year of hours, so a call holds 8,760 rows. humidity names
    (relative humidity, pressure in Pa, temperature in degC, mixing ratio in g/kg):
    the first is then computed anew at the refitted hours.
    """
    x = np.arange(hours) - hours / 2 + 0.5
    certainty = np.ones(hours)
    certainty[[0, -1]] = 100.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable").reset_index(drop=True)
        month = pdf[time].dt.month.to_numpy()
        refitted = np.zeros(len(pdf), bool)
        for at in np.flatnonzero(np.diff(month)) + 1:
            a, b = at - hours // 2, at + hours // 2
            if a < 0 or b > len(pdf):
                continue
            refitted[a:b] = True
            for c in columns:
                y = pdf[c].to_numpy(float)[a:b]
                if np.isfinite(y).all():
                    pdf.loc[a : b - 1, c] = np.polyval(np.polyfit(x, y, 2, w=certainty), x)
        return pdf.assign(_refitted=refitted)

    from pyspark.sql.types import BooleanType, StructField, StructType

    out = df.groupBy(*key).applyInPandas(run, StructType([*df.schema.fields, StructField("_refitted", BooleanType())]))
    if humidity:
        rh, p, t, w = humidity
        out = out.withColumn(rh, F.when(F.col("_refitted"), weather.relative_humidity_mixing(F.col(p) / 100, F.col(t), F.col(w))).otherwise(F.col(rh)))
    return out.drop("_refitted")


#: Names of warming levels in file names (fixed values).
LEVEL_LABELS = {1.5: "near-future", 2.0: "mid-century", 2.5: "mid-late-century", 3.0: "late-century"}


def level_label(level: float) -> str:
    """The name of a warming level in file names."""
    return "present-day" if level < 1.5 else LEVEL_LABELS.get(float(level), f"warming-level-{level}")
