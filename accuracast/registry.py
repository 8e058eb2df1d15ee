"""Named features, metrics, models and predictors a user can extend.

A feature is either an aggregate column over the prepared rows of a series (one shared pass for all
of them) or a function from a panel to one row per series. Anything registered shows up in
``compute_features`` / ``forecast_panel`` / ``run_study`` under its name; a value that cannot be
computed is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    name: str
    build: Callable[[], Column] | None = None
    frame: Callable[..., DataFrame] | None = None
    groups: frozenset[str] = frozenset()
    static: bool = False
    default: bool = True


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable
    tags: dict = field(default_factory=dict)


FEATURES: dict[str, Feature] = {}
METRICS: dict[str, Entry] = {}
MODELS: dict[str, Entry] = {}
PREDICTORS: dict[str, Entry] = {}


def register_feature(name: str, groups=(), static: bool = False, default: bool = True):
    """Decorate a function that returns an aggregate column."""

    def add(fn):
        FEATURES[name] = Feature(name, build=fn, groups=frozenset(groups), static=static, default=default)
        return fn

    return add


def register_frame_feature(name: str, groups=(), static: bool = False, default: bool = True):
    """Decorate a function (panel, keys) → DataFrame(keys, value)."""

    def add(fn):
        FEATURES[name] = Feature(name, frame=fn, groups=frozenset(groups), static=static, default=default)
        return fn

    return add


def register_python_feature(name: str, fn: Callable[[pd.Series], float], groups=(), static: bool = False) -> None:
    """A plain ``Series → float`` function, run as a grouped aggregate; failures give NULL."""

    def safe(y: pd.Series) -> float:
        try:
            value = fn(y)
            return None if value is None else float(value)
        except Exception:
            return None

    safe.__annotations__ = {"y": pd.Series, "return": float}
    udf = F.pandas_udf(safe, "double")
    FEATURES[name] = Feature(name, build=lambda: udf("y"), groups=frozenset(groups), static=static, default=False)


def _adder(table: dict[str, Entry]):
    def register(name: str, **tags):
        def add(fn):
            table[name] = Entry(name, fn, tags)
            return fn

        return add

    return register


register_metric = _adder(METRICS)
register_model = _adder(MODELS)
register_predictor = _adder(PREDICTORS)
