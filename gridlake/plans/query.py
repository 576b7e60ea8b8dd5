"""The fluent query: facets, then steps that run in a fixed order whatever order they were named in."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..operators import aggregate, climate, clock, kernels, select
from ..sources import catalog, exports
from . import checks, registry

#: Priority of each step: a smaller one runs earlier.
PRIORITY = {
    "filter_unadjusted_models": 0, "drop_leap_days": 1, "derive": 3, "convert_units": 5, "warming_level": 10, "concat": 50, "bias_adjust": 60, "clip": 65, "local_time": 70,
    "time_slice": 150, "metric": 7500, "percentiles": 7500, "thresholds": 7500, "one_in_x": 7500, "update_attributes": 9998, "export": 9999,
}


@dataclass(frozen=True)
class Query:
    """An immutable description of what to read and what to do; `plan` builds one lazy DataFrame."""

    source: DataFrame
    value: str = "v"
    facets: dict = field(default_factory=dict)
    steps: dict = field(default_factory=dict)

    def where(self, **facets) -> Query:
        if unknown := set(facets) - set(self.source.columns):
            raise ValueError(f"no such facets: {sorted(unknown)}")
        return replace(self, facets=self.facets | facets)

    def step(self, name: str, **options) -> Query:
        if name not in PRIORITY:
            raise ValueError(f"no such step: {name}")
        return replace(self, steps=self.steps | {name: options})

    def check(self, kind: str) -> Query:
        """self, if the catalog of that kind allows its facets and steps."""
        checks.facets(kind, self.facets)
        checks.steps(kind, self.steps)
        return self

    def options(self, facet: str) -> DataFrame:
        """Sorted values that a facet has under the others."""
        rest = {k: v for k, v in self.facets.items() if k != facet}
        return catalog.search(self.source, **rest).select(facet).dropna().distinct().orderBy(facet)

    def save(self) -> str:
        """Facets and steps as text; steps that hold tables can't be saved."""
        return json.dumps({"value": self.value, "facets": self.facets, "steps": self.steps})

    def load(self, text: str) -> Query:
        """The saved query over this source."""
        asked = json.loads(text)
        q = replace(self, value=asked["value"], facets={}, steps={}).where(**asked["facets"])
        for name, options in asked["steps"].items():
            q = q.step(name, **options)
        return q

    def reset(self) -> Query:
        return replace(self, facets={}, steps={})

    def facet_names(self) -> list[str]:
        """Facets that may be asked for."""
        return [c for c in self.source.columns if c not in (self.value, "time")]

    def describe(self) -> dict:
        """What is asked for: facets, steps in the order they run, and the facets still open."""
        return {"facets": dict(self.facets), "steps": self.order(), "open": [c for c in self.facet_names() if c not in self.facets]}

    def order(self) -> list[str]:
        return sorted(self.steps, key=PRIORITY.__getitem__)

    def copy(self) -> Query:
        """A query that shares nothing changeable with this one."""
        return replace(self, facets=dict(self.facets), steps={k: dict(v) for k, v in self.steps.items()})

    def plan(self) -> DataFrame:
        """One lazy DataFrame; each step's options are checked first."""
        for name in self.order():
            for f in CHECKS.get(name, ()):
                f(**self.steps[name])
        df = catalog.search(self.source, **self.facets)
        for name in self.order():
            more = {"history": self.order()} if name == "update_attributes" else {}
            df = RUN[name](df, self.value, **self.steps[name], **more)
        return df


#: Checks of a step's options, by step: functions that raise ValueError.
CHECKS: dict[str, list[Callable[..., None]]] = {"time_slice": [checks.time_slice], "convert_units": [checks.convert_units]}


def register_check(name: str):
    """Adds a check f(**options) of a step's options, run before any plan with that step is made."""

    def put(f):
        if name not in PRIORITY:
            raise ValueError(f"no such step: {name}")
        CHECKS.setdefault(name, []).append(f)
        return f

    return put


def steps() -> list[tuple[str, int, int]]:
    """(step, priority, number of its checks) of all steps in the order they run."""
    return [(n, PRIORITY[n], len(CHECKS.get(n, ()))) for n in sorted(PRIORITY, key=PRIORITY.__getitem__)]


def register_step(name: str, priority: int):
    """Adds a step f(df, value, **options) -> DataFrame; a name taken raises ValueError."""

    def put(f):
        if name in RUN:
            raise ValueError(f"step taken: {name}")
        RUN[name], PRIORITY[name] = f, priority
        return f

    return put


def _clip(df: DataFrame, value: str, bridge: DataFrame | None = None, names: list[str] | None = None, lat=None, lon=None, separated: bool = False) -> DataFrame:
    if names is None:
        return select.clip_box(df, lat, lon)
    return (select.clip_separated if separated else select.clip_region)(df, bridge, names)


def _derive(df: DataFrame, value: str, name: str, known: registry.Registry = registry.BUILT_IN) -> DataFrame:
    return known.apply(df, name)


def _warming_level(df: DataFrame, value: str, centres: DataFrame, key: list[str], window: int = 15, years=(1950, 2100), months: list[int] | None = None) -> DataFrame:
    found = climate.warming_slice(df, centres, key, window, tuple(years))
    return found.where(F.month("time").isin(months)) if months else found


def _concat(df: DataFrame, value: str, dim: str, facets: list[str] | None = None, key: list[str] | None = None, scenario: str = "scenario", historical: str = "historical") -> DataFrame:
    if dim == "sim":
        return climate.concat_sim(df, facets)
    if dim != "time":
        raise ValueError(f"concat is along sim or time, not {dim}")
    return climate.concat_time(df, key, scenario, historical)


def _one_in_x(
    df: DataFrame, value: str, key: list[str], return_periods=None, return_values=None, extreme: str = "max", block: int = 1, event_duration: tuple[int, str] = (1, "day"),
    groupby: tuple[int, str] | None = None, grouped_duration: tuple[int, str] | None = None, how: str = "sustained", distribution: str = "gev", **more,
) -> DataFrame:
    """An event of hours rolls over its hours; groups are of days, and grouped_duration rolls over groups."""
    n, unit = event_duration
    if unit not in ("hour", "day") or (unit == "day" and n > 1) or any(g is not None and g[1] != "day" for g in (groupby, grouped_duration)):
        raise ValueError("events last hours or one day; groups, and what rolls over them, are of days")
    days = groupby[0] if groupby else 1 if grouped_duration else None
    blocks = aggregate.block_extremes(df, key, value, extreme, block, n, how, group_days=days, group_duration=grouped_duration[0] if grouped_duration else 1)
    at, measure = (return_periods, "value") if return_periods is not None else (return_values, "period")
    return kernels.one_in_x(blocks, key, value, at, measure, distribution, block=block, extreme=extreme, **more)


def _attributes(df: DataFrame, value: str, history: list[str], **attributes) -> DataFrame:
    """df whose value column carries its attributes: what is given, as text, and the steps that made it."""
    if value not in df.columns:
        return df
    known = dict(df.schema[value].metadata)
    return df.withMetadata(value, known | {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in attributes.items()} | {"history": ", ".join(history)})


def _export(df: DataFrame, value: str, folder: str, **options) -> DataFrame:
    return exports.export(df, folder, **options)


RUN: dict[str, Callable[..., DataFrame]] = {
    "filter_unadjusted_models": lambda df, value, columns, names: select.deny(df, columns, names),
    "drop_leap_days": lambda df, value: select.drop_leap_days(df),
    "derive": _derive,
    "convert_units": lambda df, value, unit, to: df.withColumn(value, units.convert(F.col(value), unit, to)),
    "warming_level": _warming_level,
    "concat": _concat,
    "bias_adjust": lambda df, value, key, observed, historical, target, **more: kernels.quantile_delta_by_day(df, key, observed, historical, target, **more),
    "clip": _clip,
    "local_time": lambda df, value, zone, key=(), reindex=False: clock.to_local(df, list(key), zone, reindex),
    "time_slice": lambda df, value, start, end, seasons=None: select.time_slice(df, start, end, seasons),
    "metric": lambda df, value, kind, key: aggregate.metric(df, key, value, kind),
    "percentiles": lambda df, value, levels, key: aggregate.percentiles(df, key, value, levels),
    "thresholds": lambda df, value, key, threshold_value, threshold_direction="above", duration=1, period="year": aggregate.exceedance(df, key, value, threshold_value, threshold_direction == "above", duration, period),
    "one_in_x": _one_in_x,
    "update_attributes": _attributes,
    "export": _export,
}
