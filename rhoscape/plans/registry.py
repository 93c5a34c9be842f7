"""The descriptor registry: what each feature needs, its units, range and degenerate cases.

A descriptor is a function of a kernels.features.Density; user descriptors join with register(). The packed plan asks
for the descriptors of some domains only, and a Density makes only the fields that these need.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

INF = math.inf


@dataclass(frozen=True)
class Fallback:
    """A documented value for a degenerate case."""

    value: float
    case: str


@dataclass(frozen=True)
class Descriptor:
    name: str
    domain: str
    source: str
    requires: tuple[str, ...]
    units: str
    range: tuple[float, float]
    cases: dict[str, float] = field(default_factory=dict)
    formula: str = ""
    function: Callable | None = None
    intensive: bool = True


REGISTRY: dict[str, Descriptor] = {}
#: Functions of (Density) -> dict that add columns to the metadata of every row.
METADATA: list[Callable] = []
#: Named fields a descriptor can be defined on: functions of (Density) -> flat array.
FIELDS: dict[str, Callable] = {}


def register(name: str, domain: str, requires: str = "", units: str = "dimensionless", low: float = -INF, high: float = INF, cases: dict[str, float] | None = None, formula: str = "", source: str = "rho", intensive: bool = True):
    """Decorator that adds a descriptor; sizes must not matter, so extensive ones are refused."""
    if not intensive:
        raise ValueError(f"{name}: descriptors must be intensive")
    if name in REGISTRY:
        raise ValueError(f"descriptor {name!r} is registered already")

    def add(function: Callable) -> Callable:
        REGISTRY[name] = Descriptor(name, domain, source, tuple(r for r in requires.split(",") if r), units, (low, high), dict(cases or {}), formula or (function.__doc__ or "").strip(), function)
        return function

    return add


def metadata_hook(function: Callable) -> Callable:
    METADATA.append(function)
    return function


def register_field(name: str, function: Callable) -> None:
    FIELDS[name] = function


def selected(domains) -> list[Descriptor]:
    import rhoscape.plans.descriptors  # noqa: F401  (registers the built-in ones)

    return [d for d in REGISTRY.values() if d.domain in domains]


def descriptor_names(domains=None) -> list[str]:
    from rhoscape.options import Options

    return [d.name for d in selected(Options(domains=domains).domains if domains else Options().domains)]


CATALOGUE = "name string, domain string, field string, requires string, units string, range_min double, range_max double, intensive boolean, sentinel_cases string, formula string"


def catalogue(spark: SparkSession) -> DataFrame:
    """One row a descriptor."""
    from rhoscape.options import DOMAINS

    rows = [(d.name, d.domain, d.source, ",".join(d.requires), d.units, float(d.range[0]), float(d.range[1]), d.intensive, ";".join(f"{k}={v}" for k, v in d.cases.items()), d.formula) for d in selected(DOMAINS)]
    return spark.createDataFrame(rows, CATALOGUE)
