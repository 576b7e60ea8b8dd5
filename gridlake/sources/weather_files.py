"""Weather files of 8,760 hours: EPW with its eight header lines, TMY with two.

A file is one series; `lines` makes the rows of all files as one DataFrame and
`write` puts each series into its own folder, its lines in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The 35 fields of a data line: ours by name, the others by the code that marks them missing (fixed values).
EPW_FIELDS: list[tuple[str, str | None]] = [
    ("year", None), ("month", None), ("day", None), ("hour", None), ("minute", None),
    ("data_source", "?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9?9"),
    ("t_c", None), ("dew_c", None), ("rh", None), ("pressure_pa", None),
    ("extraterrestrial_horizontal", "9999"), ("extraterrestrial_direct", "9999"),
    ("longwave", None), ("global_horizontal", None), ("direct_normal", None), ("diffuse_horizontal", None),
    ("global_illuminance", "999900"), ("direct_illuminance", "999900"), ("diffuse_illuminance", "999900"), ("zenith_luminance", "9999"),
    ("wind_direction", None), ("wind_speed", None),
    ("total_sky_cover", "5"), ("opaque_sky_cover", "5"), ("visibility", "9999"), ("ceiling_height", "99999"),
    ("weather_observation", "9"), ("weather_codes", "999999999"), ("precipitable_water", "999"), ("aerosol_depth", "0.999"),
    ("snow_depth", "999"), ("days_since_snow", "99"), ("albedo", "999"), ("rain_depth", "999"), ("rain_rate", "99"),
]
VALUES = [n for n, code in EPW_FIELDS[5:] if code is None]
#: Columns of a TMY file and their titles (fixed values).
TMY_TITLES = {
    "t_c": "Air temperature at 2m (degC)", "dew_c": "Dew point temperature at 2m (degC)", "rh": "Relative humidity (0-100)", "global_horizontal": "Global horizontal irradiance (W/m2)",
    "direct_normal": "Direct normal irradiance (W/m2)", "diffuse_horizontal": "Diffuse horizontal irradiance (W/m2)", "longwave": "Downwelling longwave (W/m2)",
    "wind_speed": "Wind speed at 10m (m/s)", "wind_direction": "Wind direction at 10m (degrees)", "pressure_pa": "Surface pressure (Pa)",
}


@dataclass(frozen=True)
class Place:
    """Where a file's weather was, for its header."""

    name: str
    code: int
    lat: float
    lon: float
    state: str
    zone: float
    elevation_m: float
    years: tuple[int, int]


def epw_header(p: Place) -> list[str]:
    return [
        f"LOCATION,{p.name.upper()},{p.state},USA,Custom_{p.code},{p.code},{p.lat},{p.lon},{p.zone},{p.elevation_m}",
        "DESIGN CONDITIONS,0",
        "TYPICAL/EXTREME PERIODS,0",
        "GROUND TEMPERATURES,0",
        "HOLIDAYS/DAYLIGHT SAVINGS,No,0,0,0",
        "COMMENTS 1,representative year made from model output",
        f"COMMENTS 2,from the years {p.years[0]}-{p.years[1]}; ground temperatures are not provided",
        "DATA PERIODS,1,1,Data,Sunday,1/ 1,12/31",
    ]


def tmy_header(p: Place) -> list[str]:
    return [f"{p.code},'{p.name}',{p.state},{p.zone},{p.lat},{p.lon},{p.elevation_m},from the years {p.years[0]}-{p.years[1]}", ",".join(["time", *TMY_TITLES.values()])]


def lines(df: DataFrame, key: list[str], place: Place, kind: str = "epw", time: str = "time") -> DataFrame:
    """(key, n, value): the numbered lines of each series' file. Missing values are empty fields."""
    if kind == "epw":
        parts = {"year": F.year(time), "month": F.month(time), "day": F.dayofmonth(time), "hour": F.hour(time) + 1, "minute": F.minute(time)}
        fields = [F.lit(code) if code is not None else parts[n] if n in parts else F.col(n) for n, code in EPW_FIELDS]
        header = epw_header(place)
    elif kind == "tmy":
        fields, header = [F.date_format(time, "yyyy-MM-dd HH:mm:ss"), *[F.col(c) for c in TMY_TITLES]], tmy_header(place)
    else:
        raise ValueError(f"no such kind of file: {kind}")
    line = F.array_join(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), ",")
    body = df.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy(time)) + len(header) - 1).alias("n"), line.alias("value"))
    top = df.select(*key).distinct().select(*key, F.posexplode(F.array(*[F.lit(h) for h in header])).alias("n", "value"))
    return top.unionByName(body)


def write(df: DataFrame, key: list[str], place: Place, path: str, kind: str = "epw", mode: str = "errorifexists", time: str = "time") -> None:
    """One folder for each series with one text file of its lines in order."""
    rows = lines(df, key, place, kind, time)
    rows.repartition(*key).sortWithinPartitions(*key, "n").drop("n").write.mode(mode).partitionBy(*key).text(path)


def hours_8760(df: DataFrame, key: list[str], columns: list[str], time: str = "time") -> DataFrame:
    """Each series as 8,760 hours: repeated times keep the first, 29 February goes, one or two missing hours are filled from the one before.

    Series of any other length are left out; `problems` lists them. Where an hour
    is missing shows as a step of two hours within a month.
    """
    w = Window.partitionBy(*key)
    once = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key, time).orderBy(*columns))).where("_r = 1").drop("_r")
    d = once.where(~((F.month(time) == 2) & (F.dayofmonth(time) == 29))).withColumn("_n", F.count("*").over(w)).where("_n BETWEEN 8758 AND 8760")
    d = d.withColumn("_next", F.lead(time).over(w.orderBy(time)))
    gap = (F.col("_next") == F.timestamp_add("HOUR", F.lit(2), F.col(time))) & (F.col("_n") < 8760)
    kind = dict(df.dtypes)[time]
    filled = d.where(gap).withColumn(time, F.timestamp_add("HOUR", F.lit(1), F.col(time)).cast(kind))
    return d.unionByName(filled).withColumn("_n", F.count("*").over(w)).where("_n = 8760").select(*key, time, *columns)


def problems(df: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """(key, n): series whose number of distinct hours, 29 February apart, hours_8760 can't bring to 8,760."""
    ok = df.where(~((F.month(time) == 2) & (F.dayofmonth(time) == 29))).groupBy(*key).agg(F.count_distinct(time).alias("n"))
    return ok.where("n NOT BETWEEN 8758 AND 8760")


def real_years(df: DataFrame, first: int, time: str = "time") -> DataFrame:
    """df with the n-th dummy year after 2000 as the n-th year from `first` on; 29 February of a common year becomes the 28th."""
    return df.withColumn(time, F.add_months(time, 12 * (first - 2000)).cast(dict(df.dtypes)[time]) if dict(df.dtypes)[time] == "date" else F.col(time) + F.make_ym_interval(F.lit(first - 2000), F.lit(0)))
