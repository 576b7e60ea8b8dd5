"""Derived variables by name, steps that users add, and checks of what a query asks for."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units, weather
from ..sources import catalog


@dataclass(frozen=True)
class Derived:
    """A column made of others; `keep` leaves its sources in the result."""

    name: str
    depends_on: tuple[str, ...]
    make: Callable[..., Column]
    units: str = ""
    description: str = ""
    keep: bool = False


class Registry:
    """Derived variables; they may depend on one another."""

    def __init__(self) -> None:
        self._known: dict[str, Derived] = {}

    def add(self, name: str, depends_on: list[str], make: Callable[..., Column], units: str = "", description: str = "", keep: bool = False) -> Derived:
        if not name or not isinstance(name, str):
            raise ValueError("a derived variable has a name")
        if isinstance(depends_on, str) or not depends_on or not all(isinstance(d, str) for d in depends_on):
            raise ValueError(f"{name}: depends_on is a list of column names")
        if not callable(make):
            raise ValueError(f"{name}: not callable")
        taken = inspect.signature(make).parameters.values()
        if not any(p.kind is p.VAR_POSITIONAL for p in taken) and len([p for p in taken if p.default is p.empty]) > len(depends_on):
            raise ValueError(f"{name}: the function takes more columns than it depends on")
        self._known[name] = d = Derived(name, tuple(depends_on), make, units, description, keep)
        return d

    def derived(self, name: str, depends_on: list[str], **more):
        """As add, as a decorator."""

        def put(f):
            self.add(name, depends_on, f, **more)
            return f

        return put

    def names(self) -> list[str]:
        return sorted(self._known)

    def info(self, name: str) -> Derived:
        if name not in self._known:
            raise KeyError(f"no derived variable {name}; close: {catalog.closest(name, self.names())}")
        return self._known[name]

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def missing(self, name: str, columns: list[str], _over: tuple[str, ...] = ()) -> list[str]:
        """Source columns that a variable lacks, those of the derived ones it depends on included."""
        if name in _over:
            raise ValueError(f"{name} depends on itself")
        out = []
        for d in self.info(name).depends_on:
            if d not in columns:
                out += self.missing(d, columns, (*_over, name)) if d in self else [d]
        return sorted(set(out))

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        """df with the variable; unchanged if it is there already. Its sources go, unless it keeps them."""
        if name in df.columns:
            return df
        if lack := self.missing(name, df.columns):
            raise ValueError(f"{name} lacks {lack}")
        given = df.columns
        return self._put(df, name).select(*[c for c in given if self.info(name).keep or c not in self.info(name).depends_on], name)

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        for d in self.info(name).depends_on:
            if d not in df.columns:
                df = self._put(df, d)
        return df.withColumn(name, self.info(name).make(*[F.col(d) for d in self.info(name).depends_on]))


BUILT_IN = Registry()
BUILT_IN.add("wind_speed_10m", ["u10", "v10"], weather.wind_speed, "m/s", "speed of the wind")
BUILT_IN.add("wind_direction_10m", ["u10", "v10"], weather.wind_direction, "degrees", "where the wind blows from")
BUILT_IN.add("relative_humidity_2m", ["t2", "q2", "psfc"], weather.relative_humidity, "[0 to 100]", "from specific humidity")
BUILT_IN.add("dew_point_2m", ["t2", "rh"], weather.dew_point, "K", "inverse Magnus formula")
BUILT_IN.add("specific_humidity_2m", ["t2", "rh", "psfc"], weather.specific_humidity, "kg/kg", "from relative humidity")
BUILT_IN.add("heat_index", ["t2", "rh"], lambda t, rh: units.convert(weather.heat_index_f(units.convert(t, "K", "degF"), rh), "degF", "K"), "K", "regression with adjustments")
BUILT_IN.add("wind_chill", ["t2", "u10", "v10"], lambda t, u, v: units.convert(weather.wind_chill_f(units.convert(t, "K", "degF"), weather.wind_speed(u, v) * 2.237), "degF", "K"), "K", "in cold and wind only")
BUILT_IN.add(
    "fosberg_fire_weather_index", ["t2", "q2", "psfc", "u10", "v10"],
    lambda t, q, p, u, v: weather.fosberg(units.convert(t, "K", "degF"), weather.relative_humidity(t, q, p), weather.wind_speed(u, v) * 2.23694), "[0 to 100]", "fire weather",
)
BUILT_IN.add("diurnal_temperature_range_loca", ["tasmax", "tasmin"], lambda a, b: a - b, "K", "maximum less minimum")
BUILT_IN.add("diurnal_temperature_range_wrf", ["t2max", "t2min"], lambda a, b: a - b, "K", "maximum less minimum")
BUILT_IN.add("HDD_wrf", ["t2"], lambda t: weather.degree_masks(t)[0], "", "1 on steps that need heating")
BUILT_IN.add("CDD_wrf", ["t2"], lambda t: weather.degree_masks(t)[1], "", "1 on steps that need cooling")
BUILT_IN.add("HDD_loca", ["tasmax", "tasmin"], lambda a, b: weather.degree_masks((a + b) / 2)[0], "", "1 on days that need heating")
BUILT_IN.add("CDD_loca", ["tasmax", "tasmin"], lambda a, b: weather.degree_masks((a + b) / 2)[1], "", "1 on days that need cooling")
