"""Checks of a query's facets and of each step's options, before anything is read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import units
from ..operators import select
from ..sources import catalog, exports

#: What each kind of catalog must be asked, and the steps that it does not know (fixed values).
REQUIRED = {"cadcat": ("variable", "grid_label", "table_id"), "renewables": ("variable", "grid_label", "table_id"), "hdp": ("network_id",)}
DENIED = {"cadcat": (), "renewables": ("warming_level", "bias_adjust"), "hdp": ("warming_level", "concat", "bias_adjust", "clip")}
DEFAULTS = {"cadcat": ("filter_unadjusted_models", "drop_leap_days", "concat"), "renewables": ("drop_leap_days", "concat"), "hdp": ("concat",)}
#: One-to-one codes of the catalog (fixed values).
GRIDS = {"45 km": "d01", "9 km": "d02", "3 km": "d03"}
TABLES = {"hourly": "1hr", "daily": "day", "monthly": "mon"}
METHODS = {"Dynamical": "WRF", "Statistical": "LOCA2"}
FITS = ("gev", "genpareto", "gamma")
METRICS = ("min", "max", "mean", "median", "sum")


def facets(kind: str, asked: dict) -> None:
    """ValueError for a required facet that is missing."""
    if kind not in REQUIRED:
        raise ValueError(f"no such catalog: {kind}; close: {catalog.closest(kind, list(REQUIRED))}")
    if lack := [f for f in REQUIRED[kind] if not asked.get(f)]:
        raise ValueError(f"{kind} must be asked for {lack}")


def steps(kind: str, asked: dict) -> None:
    if bad := [s for s in asked if s in DENIED[kind]]:
        raise ValueError(f"{kind} has no steps {bad}")
    if "warming_level" in asked and "time_slice" in asked:
        raise ValueError("a warming level and a time slice exclude each other")


def expand(value: str | list[str], known: list[str]) -> list[str]:
    """All known ids that hold each of the asked ones; ValueError with close ones for none."""
    out: list[str] = []
    for v in [value] if isinstance(value, str) else value:
        hit = [k for k in known if v.strip().lower() in k.lower()]
        if not hit:
            raise ValueError(f"nothing matches {v}; close: {catalog.closest(v, known)}")
        out += [k for k in hit if k not in out]
    return out


def time_slice(start, end, seasons=None) -> None:
    a, b = select.bound(start, False), select.bound(end, True)
    if a > b:
        raise ValueError(f"{start} is after {end}")
    for s in seasons or []:
        if s not in ("DJF", "MAM", "JJA", "SON"):
            raise ValueError(f"no such season: {s}")
    if not all(1900 <= x.year <= 2200 for x in (a, b)):
        raise ValueError("years run from 1900 to 2200")


def convert_units(unit: str, to: str) -> None:
    a, b = (units.SPELLINGS.get(x, x) for x in (unit, to))
    if a != b and (a, b) not in units.PAIRS:
        raise ValueError(f"{unit} converts to {unit_options(unit)}")


def unit_options(unit: str) -> list[str]:
    """The unit and all that it converts to."""
    return [unit, *sorted(b for a, b in units.PAIRS if a == units.SPELLINGS.get(unit, unit))]


def box(lat, lon) -> None:
    for name, pair, most in (("lat", lat, 90), ("lon", lon, 180)):
        if len(pair) != 2 or pair[0] >= pair[1] or not all(-most <= v <= most for v in pair):
            raise ValueError(f"{name}: two rising values within {most} degrees")


def points(value) -> None:
    for p in value:
        if len(p) != 2 or not -90 <= p[0] <= 90 or not -180 <= p[1] <= 180:
            raise ValueError(f"not a (lat, lon) point: {p}")


def boundary(name: str, known: list[str]) -> str:
    """The known name equal to it but for case, else ValueError with at most ten that hold it or that it holds."""
    low = name.lower()
    for k in known:
        if k.lower() == low:
            return k
    raise ValueError(f"no such boundary: {name}; close: {[k for k in known if low in k.lower() or k.lower() in low][:10]}")


def stations(asked, table) -> list[str]:
    """IDs of stations by ID, by name, then by part of a name; ValueError for none or several.

    table: the small DataFrame (ID, station) of all stations.
    """
    out = []
    for a in [asked] if isinstance(asked, str) else asked:
        low = F.lit(a.lower())
        ranked = table.select("ID", F.when(F.lower("ID") == low, 1).when(F.lower("station") == low, 2).when(F.contains(F.lower("station"), low), 3).alias("r")).where("r IS NOT NULL")
        best = ranked.groupBy("r").agg(F.collect_set("ID").alias("ids")).orderBy("r").first()
        if best is None or len(best.ids) > 1:
            raise ValueError(f"{a}: {'no station' if best is None else f'one of {sorted(best.ids)}?'}")
        out.append(best.ids[0])
    return list(dict.fromkeys(out))


def warming_level(levels, window: int = 15) -> None:
    if not levels or not all(isinstance(x, (int, float)) and 0 < x <= 10 for x in levels):
        raise ValueError("warming levels are degrees above 0")
    if not 5 <= window <= 25:
        raise ValueError("the window is 5 to 25 years")


def metric(kind: str | None = None, percentiles=None, one_in_x: dict | None = None, thresholds: dict | None = None) -> None:
    if kind is not None and kind not in METRICS:
        raise ValueError(f"metrics are {METRICS}")
    if percentiles and not all(0 <= p <= 100 for p in percentiles):
        raise ValueError("percentiles lie in 0 to 100")
    if one_in_x is not None:
        if ("return_periods" in one_in_x) == ("return_values" in one_in_x):
            raise ValueError("one of return_periods and return_values")
        if one_in_x.get("distribution", "gev") not in FITS:
            raise ValueError(f"distributions are {FITS}")
        n, unit = one_in_x.get("event_duration", (1, "day"))
        if unit == "day" and n > 1:
            raise ValueError("an event of several days is a grouped_duration")
    if thresholds is not None and ("threshold_value" not in thresholds or thresholds.get("threshold_direction", "above") not in ("above", "below")):
        raise ValueError("thresholds have a threshold_value, and lie above or below")


def bias_adjust(window: int = 90, nquantiles: int = 20, kind: str = "+", end: str = "2014-08-31") -> None:
    if not 1 <= window <= 365 or not 1 <= nquantiles <= 100 or kind != "+":
        raise ValueError("window 1 to 365 days, nquantiles 1 to 100, kind +")
    if dt.date.fromisoformat(end) > dt.date(2014, 8, 31):
        raise ValueError("observations end on 2014-08-31")


def export(**options) -> None:
    exports.check(options)
