"""Catalogs of datasets: search, options, and the readers of lookup and fact tables."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import NA_STRINGS


def merge(*catalogs: tuple[str, DataFrame]) -> DataFrame:
    """All assets of several catalogs, tagged with the catalog's name; missing columns are null."""
    out = None
    for name, df in catalogs:
        df = df.withColumn("catalog", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def search(catalog: DataFrame, **facets) -> DataFrame:
    """Assets that match every facet: a value by equality, a list by membership."""
    for name, value in facets.items():
        catalog = catalog.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return catalog


def options(catalog: DataFrame, key: str, **facets) -> DataFrame:
    """Sorted distinct values of a column; facets ignore case, a list matches as substrings or regular expressions."""
    for name, value in facets.items():
        low = F.lower(name)
        if isinstance(value, (list, tuple)):
            catalog = catalog.where(F.col(name).rlike("(?i)" + "|".join(value)))
        else:
            catalog = catalog.where(low == value.lower())
    return catalog.select(key).dropna().distinct().orderBy(key)


def closest(value: str, choices: list[str], cutoff: float = 0.59) -> list[str]:
    """Choices equal but for case; else those that hold the value; else similar ones."""
    low = value.lower()
    if same := [c for c in choices if c.lower() == low]:
        return same
    if within := [c for c in choices if low in c.lower()]:
        return within
    back = {c.lower(): c for c in choices}
    return [back[c] for c in difflib.get_close_matches(low, list(back), cutoff=cutoff)]


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A CSV lookup table as strings, the missing-value strings as NULL; 'None' stays."""
    df = spark.read.csv(path, header=True, nullValue="")
    return df.select(*[F.when(~F.col(c).isin(NA_STRINGS), F.col(c)).alias(c) for c in df.columns])


def require_all(catalog: DataFrame, by: list[str], facet: str, values: list[str]) -> DataFrame:
    """Assets with one of the values, of those groups (say, models) that have every one of them."""
    wanted = catalog.where(F.col(facet).isin(values))
    whole = wanted.groupBy(*by).agg(F.count_distinct(facet).alias("_n")).where(F.col("_n") == len(set(values))).select(*by)
    return wanted.join(whole, by, "left_semi")


def infer(catalog: DataFrame, tag: str, **facets) -> str | None:
    """The one tag whose assets hold any of the asked values, None if there are none or several."""
    hit = F.lit(False)
    for name, value in facets.items():
        if name in catalog.columns:
            hit = hit | F.col(name).isin(list(value) if isinstance(value, (list, tuple, set)) else [value])
    found = catalog.where(hit).select(tag).distinct().limit(2).collect()
    return found[0][0] if len(found) == 1 else None


def resolve(key: str, known: list[str]) -> str | None:
    """key, or the only known one close to it, else None."""
    if key in known:
        return key
    near = closest(key, known)
    return near[0] if len(near) == 1 else None


def read_stations(spark: SparkSession, path: str, x: str = "LON_X", y: str = "LAT_Y") -> DataFrame:
    """A CSV table of stations, its coordinates as lon and lat; rows without a place are left out."""
    df = read_lookup(spark, path)
    return df.withColumns({"lon": F.col(x).try_cast("double"), "lat": F.col(y).try_cast("double")}).where("lon IS NOT NULL AND lat IS NOT NULL")


class Catalogs:
    """Catalogs by name: tables of assets in CSV, JSON or Parquet, with a path for each asset."""

    def __init__(self, spark: SparkSession):
        self.spark, self._known = spark, {}

    def register(self, name: str, source: DataFrame | str) -> None:
        """A catalog under a name; a path is opened by its ending. A name taken is replaced."""
        if isinstance(source, str):
            kind = source.rstrip("/").rsplit(".", 1)[-1]
            source = read_lookup(self.spark, source) if kind == "csv" else self.spark.read.json(source) if kind == "json" else self.spark.read.parquet(source)
        self._known[name] = source

    def names(self) -> list[str]:
        return sorted(self._known)

    def open(self, name: str) -> DataFrame:
        """A catalog by its name, or by the only name close to it."""
        found = resolve(name, self.names())
        if found is None:
            raise KeyError(f"no catalog {name}; there are {self.names()}")
        return self._known[found]

    def whole(self) -> DataFrame:
        return merge(*self._known.items())

    def holding(self, **facets) -> list[str]:
        """Names of the catalogs that have assets for all facets."""
        fits = lambda df: set(facets) <= set(df.columns) and not search(df, **facets).isEmpty()
        return [n for n in self.names() if fits(self._known[n])]


def ranked(df: DataFrame, column: str, first: list[str]) -> DataFrame:
    """Distinct values with their rank: the named ones first, in that order, then the others by alphabet."""
    place = F.nullif(F.array_position(F.array(*[F.lit(x) for x in first]), F.col(column)), F.lit(0))
    w = Window.orderBy(F.coalesce(place, F.lit(len(first) + 1)), column)
    return df.select(column).dropna().distinct().withColumn("rank", F.row_number().over(w))


def first_options(df: DataFrame, by: list[str], column: str, n: int) -> DataFrame:
    """The first n options of a column for each group, by alphabet."""
    d = df.select(*by, column).where(F.col(column).isNotNull()).distinct()
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(column))).where(F.col("_r") <= n).drop("_r")


def variables(dictionary: DataFrame, timescale: str, method: str) -> DataFrame:
    """Variables that a screen would show: marked so, of that method, and offered at that timescale."""
    return dictionary.where((F.lower(F.col("show").cast("string")) == "true") & F.lower("timescale").contains(timescale.lower()) & (F.lower("method") == method.lower()))
