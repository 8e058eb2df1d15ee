"""A way to keep costly expressions where they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column) -> Column:
    """``value``, computed once in its projection.

    The optimizer moves filters below projections, also those it infers for ``explode``, and repeats in
    them every expression they name, level by level. It leaves alone what it takes for non-deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
