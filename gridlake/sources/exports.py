"""Names, sizes and rules of exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

FORMATS = ("parquet", "csv", "orc", "json")
METHODS = ("data", "raw", "calculate", "both", "skip_existing", "none")
#: Spreadsheet limits, rows and columns (fixed values).
SHEET = (1048576, 16384)
LARGE_BYTES = 5 << 30


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def unique(spark: SparkSession, path: str) -> str:
    """path, or path with the first _N that is free."""
    at, n = path, 0
    while exists(spark, at):
        n += 1
        at = f"{path}_{n}"
    return at


def safe(name: str) -> str:
    """A file name without its ending, checked to stay in its folder."""
    stem = name.split(".")[0] or "data"
    if ".." in name or re.search(r'[<>:"|?*\x00-\x1f]', name):
        raise ValueError(f"not a safe file name: {name}")
    return stem


def from_template(template: str, name: str, lat: float | None = None, lon: float | None = None) -> str:
    """The template with {name}, {lat} and {lon} filled in; places to six decimals at most."""
    text = lambda v: "" if v is None else f"{v:.6f}".rstrip("0").rstrip(".")
    return template.format(name=name, lat=text(lat), lon=text(lon))


def size_bytes(df: DataFrame, file_format: str) -> int:
    """Bytes of an export by the optimiser's estimate of the plan, never by running it; text counts twice."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess * (2 if file_format == "csv" else 1) + (100 << 20)


def readable(n: float) -> str:
    """Bytes in steps of 1,024."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def check(options: dict) -> dict:
    """Options of an export, completed; ValueError for a wrong one."""
    done = {"filename": "data", "file_format": "parquet", "export_method": "data", "separated": False, "location_based_naming": False, "filename_template": None, "fail_on_error": True} | options
    if unknown := set(done) - {"filename", "file_format", "mode", "export_method", "separated", "location_based_naming", "filename_template", "fail_on_error", "by", "units"}:
        raise ValueError(f"no such export options: {sorted(unknown)}")
    done["file_format"] = str(done["file_format"]).lower().lstrip(".")
    if done["file_format"] not in FORMATS or done["export_method"] not in METHODS:
        raise ValueError(f"formats are {FORMATS}, methods {METHODS}")
    if not all(isinstance(done[k], bool) for k in ("separated", "location_based_naming", "fail_on_error")):
        raise ValueError("separated, location_based_naming and fail_on_error are booleans")
    done["filename"] = safe(done["filename"])
    return done


def export(df: DataFrame, folder: str, **options) -> DataFrame:
    """Writes df under a free name in folder and passes it through.

    separated writes a folder for each point: partitions by lat and lon with
    location_based_naming, by point number without. skip_existing leaves what is
    there; none writes nothing; raw and calculate add their suffix.
    """
    o = check(options)
    method = o["export_method"]
    if method == "none":
        return df
    suffix = {"raw": "_raw", "calculate": "_calc"}.get(method, "")
    path = f"{folder.rstrip('/')}/{o['filename']}{suffix}"
    if exists(df.sparkSession, path):
        if method == "skip_existing":
            return df
        path = unique(df.sparkSession, path)
    by = list(o.get("by") or [])
    if o["separated"]:
        by += [c for c in (("lat", "lon") if o["location_based_naming"] else ("point",)) if c in df.columns]
    if o["file_format"] == "parquet":
        sinks.write_parquet(df, path, by or None)
    elif o["file_format"] == "csv":
        sinks.write_csv(df, path, o.get("units"))
    else:
        (df.write.partitionBy(*by) if by else df.write).format(o["file_format"]).save(path)
    return df


def summary(df: DataFrame, key: list[str], sim: str, value: str, sims: list[str]) -> DataFrame:
    """One column for each of the named simulations, a row for each key, in order."""
    return df.groupBy(*key).agg(*[F.first(F.when(F.col(sim) == s, F.col(value)), ignorenulls=True).alias(sinks.clean(s)) for s in sims]).orderBy(*key)
