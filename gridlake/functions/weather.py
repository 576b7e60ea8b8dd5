"""Humidity, wind, heat and fire as column expressions; NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, low: float, high: float) -> Column:
    """v within bounds; greatest and least alone would turn NULL into a bound."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def relative_humidity(t_k: Column, q: Column, p_pa: Column) -> Column:
    """Per cent, from temperature, specific humidity (kg/kg) and pressure."""
    t = t_k - 273.15
    saturated = F.lit(611.2) * F.exp(17.67 * t / (t + 243.5))
    return clip(q * p_pa / (0.622 + 0.378 * q) / saturated * 100, 0.0, 100.0)


def dew_point(t_k: Column, rh: Column) -> Column:
    """Kelvin, by the inverse Magnus formula."""
    t = t_k - 273.15
    g = 17.27 * t / (237.7 + t) + F.log(rh / 100)
    return 237.7 * g / (17.27 - g) + 273.15


def specific_humidity(t_k: Column, rh: Column, p_pa: Column) -> Column:
    t = t_k - 273.15
    e = 611.2 * F.exp(17.67 * t / (t + 243.5)) * rh / 100
    return 0.622 * e / (p_pa - 0.378 * e)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees that the wind blows from, in [0, 360)."""
    return F.pmod(270 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def rotate(u: Column, v: Column, sine: Column, cosine: Column) -> tuple[Column, Column]:
    """Grid winds turned to earth winds."""
    return u * cosine - v * sine, v * cosine + u * sine


def heat_index_f(t: Column, rh: Column) -> Column:
    """Degrees F: the air temperature below 80 F; from there on the simple formula where that is below 80, else the regression with its two adjustments."""
    #: Coefficients of the published regression (fixed values).
    full = (
        -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t
        - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh
    )
    dry = (13 - rh) / 4 * F.sqrt((17 - F.abs(t - 95)) / 17)
    damp = (rh - 85) / 10 * (87 - t) / 5
    adjusted = F.when((rh < 13) & t.between(80, 112), full - dry).when((rh > 85) & t.between(80, 87), full + damp).otherwise(full)
    simple = 0.5 * (t + 61 + (t - 68) * 1.2 + rh * 0.094)
    return F.when(t < 80, t).when(simple < 80, simple).otherwise(adjusted)

def wind_chill_f(t: Column, mph: Column) -> Column:
    """Degrees F where it is at most 50 F and the wind over 3 mph; the air temperature elsewhere."""
    x = F.pow(mph, F.lit(0.16))
    return F.when((t <= 50) & (mph > 3), 35.74 + 0.6215 * t - 35.75 * x + 0.4275 * t * x).otherwise(t)


def fosberg(t_f: Column, rh: Column, mph: Column) -> Column:
    """The Fosberg fire weather index, 0 to 100."""
    moisture = (
        F.when(rh < 10, 0.03229 + 0.281073 * rh - 0.000578 * rh * t_f)
        .when(rh <= 50, 2.22749 + 0.160107 * rh - 0.01478 * t_f)
        .otherwise(21.0606 + 0.005565 * rh * rh - 0.00035 * rh * t_f - 0.483199 * rh)
    ) / 30
    damping = 1 - 2 * moisture + 1.5 * moisture * moisture - 0.5 * moisture * moisture * moisture
    return clip(damping * F.sqrt(1 + mph * mph) / 0.3002, 0.0, 100.0)


def degree_days(t: Column, heating: float, cooling: float) -> tuple[Column, Column]:
    """Degrees below the heating and above the cooling threshold."""
    some = t.isNotNull()
    return F.when(some, F.greatest(heating - t, F.lit(0.0))), F.when(some, F.greatest(t - cooling, F.lit(0.0)))


def sea_level_pressure(p_pa: Column, t_k: Column, q: Column, elevation_m: Column, lapse: float = 0.0065) -> Column:
    """Pa, by the hypsometric equation with the mean virtual temperature between the surface and the sea; q is a mixing ratio in kg/kg."""
    virtual = t_k * (1 + 1.609 * q) / (1 + q)
    mean = (2 * virtual + lapse * elevation_m) / 2
    return p_pa * F.exp(elevation_m * 9.81 / (287.04 * mean))


def relative_humidity_mixing(p_hpa: Column, t_c: Column, w: Column) -> Column:
    """Per cent, from a mixing ratio in g/kg, between 0.5 and 100; a missing value counts as 0.5."""
    e = 6.11 * F.pow(F.lit(10.0), 7.5 * t_c / (237.7 + t_c))
    rh = 100 * w / (621.97 * e / (p_hpa - e))
    return F.least(F.when(rh > 0.5, rh).otherwise(0.5), F.lit(100.0))


def vapour_pressure(t_k: Column) -> Column:
    """Saturation over water in kPa, by latent heat over the gas constant of vapour."""
    return 0.611 * F.exp(2500000 / 461 * (1 / 273 - 1 / t_k))


def dew_point_vapour(t_k: Column, rh: Column) -> Column:
    """Kelvin, by the Clausius-Clapeyron equation with rounded constants."""
    e = 0.611 * F.exp(5423 * (1 / 273 - 1 / t_k)) * rh / 100
    return 1 / (1 / 273 - 0.0001844 * F.log(e / 0.611))


def specific_humidity_dew(dew_k: Column, p_pa: Column) -> Column:
    """g/kg, from the dew point."""
    return 1000 * 0.622 * vapour_pressure(dew_k) / (p_pa / 1000)


def relative_humidity_specific(t_k: Column, q: Column, p_pa: Column, compat: bool = False) -> Column:
    """Per cent, from specific humidity in g/kg; compat gives the product that older results hold instead of the quotient."""
    e, part = 0.622 * vapour_pressure(t_k), q / 1000 * p_pa / 1000
    return part * e if compat else 100 * part / e


def wind_direction_north(u: Column, v: Column) -> Column:
    """As wind_direction, but measured from the reversed vector."""
    return F.pmod(90 - F.degrees(F.atan2(-v, -u)), F.lit(360.0))


def heat_index_simple_f(t: Column, rh: Column) -> Column:
    """Degrees F: the simple formula below 80, the regression with open ranges above, the air temperature under 40 F."""
    full = (
        -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t
        - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh
    )
    dry = full - (13 - rh) / 4 * F.sqrt((17 - F.abs(t - 95)) / 17)
    damp = full + (rh - 85) / 10 * (87 - t) / 5
    low = 0.5 * (t + 61 + (t - 68) * 1.2 + rh * 0.094)
    above = F.when((rh > 85) & (t > 80) & (t < 87), damp).when((rh < 13) & (t > 80) & (t < 112), dry).otherwise(full)
    return F.when(t < 40, t).when(low < 80, low).otherwise(above)


def degree_masks(t: Column, heating: float = 291.483, cooling: float = 291.483) -> tuple[Column, Column]:
    """1 where a step needs heating, or cooling, else 0."""
    return (t < heating).cast("int"), (t > cooling).cast("int")


def monthly_precipitation(flux: Column, time: Column, least: float = 0.1) -> Column:
    """mm in the month of a mean flux in kg m-2 s-1, not below `least`."""
    total = flux * 86400 * F.dayofmonth(F.last_day(time))
    return F.when(total.isNotNull(), F.greatest(total, F.lit(least)))


def date_of_year_day(year: Column, day: Column) -> Column:
    """The date of a day of the year, 1 being 1 January."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))
