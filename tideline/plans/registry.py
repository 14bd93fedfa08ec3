"""Named, versioned measures with typed parameters; unknown, missing and ill-typed ones are refused before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tideline.plans import measures


@dataclass(frozen=True)
class Parameter:
    """kind: number, whole, whole_or_empty, choice, or table; columns of a table are (name, kind)."""

    kind: str
    choices: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def problem(self, value: Any) -> str | None:
        whole = isinstance(value, int) and not isinstance(value, bool)
        good = {
            "number": whole or isinstance(value, float),
            "whole": whole,
            "whole_or_empty": whole or value is None,
            "choice": value in self.choices,
            "table": isinstance(value, DataFrame) and set(self.columns) <= set(value.columns),
        }[self.kind]
        return None if good else f"is no {self.kind}" + (f" of {', '.join(self.choices or self.columns)}" if self.choices or self.columns else "")


@dataclass(frozen=True)
class Measure:
    name: str
    version: int
    run: Callable[..., DataFrame]
    parameters: Mapping[str, Parameter]
    grain: str
    unit: str
    output: str = "rows"
    fixed: Mapping[str, Any] = field(default_factory=dict)


_WINDOW = {"from_minutes": Parameter("whole"), "until_minutes": Parameter("whole_or_empty")}
_KINDS = Parameter("table", columns=("kind", "preference"))
_KIND = Parameter("table", columns=("kind",))
_BURDEN = {"kinds": _KINDS, "bands": Parameter("table", columns=("from_days", "until_days", "threshold")), "direction": Parameter("choice", ("below", "above")), "stands_minutes": Parameter("whole"), **_WINDOW}
_FACTOR = Parameter("table", columns=("kind", "factor"))

MEASURES = {
    (m.name, m.version): m
    for m in (
        Measure("hypotension_burden", 1, measures.burden, _BURDEN, "episode", "minutes"),
        Measure("hypoxaemia_burden", 1, measures.burden, _BURDEN, "episode", "minutes"),
        Measure("hypothermia", 1, measures.cooling, {"threshold": Parameter("number"), "stands_minutes": Parameter("whole"), "recovery_minutes": Parameter("whole"), **_WINDOW}, "episode", "minutes"),
        Measure("minutes_beyond_threshold", 1, measures.burden, _BURDEN, "episode", "minutes"),
        Measure("extreme_in_window", 1, measures.extreme, {"kinds": _KIND, "direction": Parameter("choice", ("lowest", "highest")), **_WINDOW}, "episode", "the kind's own"),
        Measure("time_to_first_beyond_threshold", 1, measures.first_beyond, {"kinds": _KIND, "threshold": Parameter("number"), "direction": Parameter("choice", ("below", "above")), **_WINDOW}, "episode", "minutes"),
        Measure("count_of_events", 1, measures.events_counted, {"kinds": _KIND, **_WINDOW}, "episode", "events"),
        Measure("monitoring_completeness", 1, measures.completeness, {"kinds": _KIND, "expected_minutes": Parameter("whole"), **_WINDOW}, "episode", "minutes"),
        Measure("volatile_consumption", 1, measures.two_signal_integral, {"vapour": _FACTOR, "co2e": _FACTOR, "stands_minutes": Parameter("whole"), **_WINDOW}, "episode and agent", "millilitres"),
    )
}


def measure(name: str, version: int, subjects: DataFrame, episodes: DataFrame, readings: DataFrame, **given: Any) -> DataFrame:
    """Run a registered measure; every parameter must be given. Measures of events take them in place of readings."""
    if (name, version) not in MEASURES:
        raise ValueError(f"no measure {name} version {version}")
    m = MEASURES[name, version]
    problems = [f"{k} is missing" for k in m.parameters.keys() - given.keys()] + [f"{k} is unknown" for k in given.keys() - m.parameters.keys()]
    problems += [f"{k} {p}" for k, v in given.items() if k in m.parameters and (p := m.parameters[k].problem(v))]
    if problems:
        raise ValueError("; ".join(sorted(problems)))
    return m.run(subjects, episodes, readings, **m.fixed, **given)
