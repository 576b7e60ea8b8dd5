"""Unit conversions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

#: (from, to): value in the new unit. Factors are fixed values.
CONVERSIONS: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("K", "degC"): lambda v: v - 273.15,
    ("K", "degF"): lambda v: (v - 273.15) * 1.8 + 32,
    ("degC", "K"): lambda v: v + 273.15,
    ("degC", "degF"): lambda v: v * 1.8 + 32,
    ("degF", "degC"): lambda v: (v - 32) / 1.8,
    ("degF", "K"): lambda v: (v - 32) / 1.8 + 273.15,
    ("Pa", "hPa"): lambda v: v / 100,
    ("Pa", "mb"): lambda v: v / 100,
    ("Pa", "inHg"): lambda v: v * 0.000295300,
    ("hPa", "Pa"): lambda v: v * 100,
    ("hPa", "mb"): lambda v: v,
    ("hPa", "inHg"): lambda v: v * 0.0295300,
    ("m/s", "mph"): lambda v: v * 2.236936,
    ("m/s", "knots"): lambda v: v * 1.9438445,
    ("mm", "inches"): lambda v: v / 25.4,
    ("mm/d", "inches/d"): lambda v: v / 25.4,
    ("mm/h", "inches/h"): lambda v: v / 25.4,
    ("kg/kg", "g/kg"): lambda v: v * 1000,
    ("g/kg", "kg/kg"): lambda v: v / 1000,
    ("kg m-2 s-1", "mm/d"): lambda v: v * 86400,
    ("kg m-2 s-1", "inches/d"): lambda v: v * 86400 / 25.4,
    ("[0 to 100]", "fraction"): lambda v: v / 100,
    ("fraction", "[0 to 100]"): lambda v: v * 100,
}
#: Other spellings of units (fixed values).
SPELLINGS = {"m s-1": "m/s", "kg kg-1": "kg/kg", "g kg-1": "g/kg"}
#: Millimetres in the units of depth that a flux in kg m-2 s-1 makes in a step.
DEPTHS = {"mm": 1.0, "inches": 25.4}
#: All pairs that convert() knows, in the first of their spellings.
PAIRS = {*CONVERSIONS, *((a, "kg m-2 s-1") for a in ("mm", "mm/d", "mm/h")), *(("kg m-2 s-1", b) for b in DEPTHS)}


def convert(value: Column, unit: str, to: str, days: Column | None = None, compat: bool = False) -> Column:
    """value in another unit; the same unit is the identity, an unknown pair raises ValueError.

    days: of the month, for monthly depths and fluxes; a step is one day without
    it. compat divides from hPa to Pa, as older results hold it.
    """
    unit, to = SPELLINGS.get(unit, unit), SPELLINGS.get(to, to)
    if unit == to:
        return value
    if compat and (unit, to) == ("hPa", "Pa"):
        return value / 100
    if unit in ("mm", "mm/d", "mm/h") and to == "kg m-2 s-1":
        return value / 86400 if days is None else value / 86400 / days
    if (unit, to) in CONVERSIONS:
        return CONVERSIONS[unit, to](value)
    if unit == "kg m-2 s-1" and to in ("mm", "inches"):
        return (value if days is None else value * days) * 86400 / DEPTHS[to]
    raise ValueError(f"no conversion from {unit} to {to}")
