"""Frequency aliases, season lengths and index steps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods per year by base alias.
PERIODS_PER_YEAR = {
    "W": 52, "D": 365, "B": 260, "H": 8760, "T": 525600, "S": 31536000,
    "M": 12, "MS": 12, "BM": 12, "BMS": 12, "CBM": 12, "CBMS": 12,
    "Q": 4, "QS": 4, "BQ": 4, "BQS": 4,
    "A": 1, "AS": 1, "Y": 1, "YS": 1, "BA": 1, "BAS": 1, "BY": 1, "BYS": 1,
}
# Season length by alias for forecasting models.
SEASON = {"A": 1, "AS": 1, "Y": 1, "YS": 1, "Q": 4, "QS": 4, "M": 12, "MS": 12, "W": 52, "D": 7, "B": 5, "H": 24, "T": 60, "MIN": 60, "S": 60}
# Spelled-out names of a step.
ALIAS_NAMES = {"MIN": "T", "MINUTE": "T", "MINUTES": "T", "HOUR": "H", "HOURS": "H"}
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]


def _lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def periods_per_year(alias: Column) -> Column:
    """Whole periods per year of an alias such as ``W-MON`` or ``2W``; NULL when unknown."""
    text = F.upper(F.trim(alias))
    text = F.coalesce(_lookup(ALIAS_NAMES, text), text)
    digits = F.regexp_extract(text, r"^(\d*)", 1)
    count = F.coalesce(F.when(digits != "", digits).cast("double"), F.lit(1.0))
    base = F.regexp_extract(text, r"^\d*([A-Z]+)", 1)
    known = _lookup(PERIODS_PER_YEAR, base)
    return F.when(known.isNotNull(), F.greatest(F.lit(1), F.bround(known / count, 0).cast("int")))


def season_length(alias: Column, default: int = 0) -> Column:
    text = F.upper(alias)
    return F.when(text.startswith("W"), F.lit(52)).otherwise(F.coalesce(_lookup(SEASON, text), F.lit(default)))
