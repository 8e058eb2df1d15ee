"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accuracast.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its twin."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fragment(name: str, body: str, *deps: str) -> None:
    """A named CTE other oracles build on."""
    FRAGMENTS[name] = (deps, body)


def sql(final: str, *deps: str, recursive: bool = False) -> str:
    """Assemble a statement from the CTEs it needs, each once and in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in FRAGMENTS[name][0]:
            visit(dep)
        ordered.append(name)

    for dep in deps:
        visit(dep)
    if not ordered:
        return final
    # a CTE that reads itself is recursive and cannot be materialized
    kind = lambda n: "" if re.search(rf"\bfrom {n}\b", FRAGMENTS[n][1]) else "materialized "
    ctes = ",\n".join(f"{n} as {kind(n)}({FRAGMENTS[n][1]})" for n in ordered)
    return f"with {'recursive ' if recursive else ''}{ctes}\n{final}"


def R(expr: str, places: int = 6) -> str:
    """Half-even rounding in the oracle dialect, without negative zero."""
    return f"(round_even({expr}, {places}) + 0.0e0)"


def _panel(name: str, select: str, step: str) -> None:
    fragment(f"{name}_sums", f"select series_id, date_trunc('{step}', ts) as ts, round_even(sum(y), 2) as y from ({select}) group by 1, 2")
    fragment(
        name,
        f"""select c.series_id, cast(row_number() over (partition by c.series_id order by c.ts) - 1 as bigint) as pos, c.ts, coalesce(s.y, 0e0) as y
        from (select series_id, unnest(generate_series(lo, hi, interval 1 {step})) as ts
              from (select distinct series_id from {name}_sums), (select min(ts) lo, max(ts) hi from {name}_sums)) c
        left join {name}_sums s on s.series_id = c.series_id and s.ts = c.ts""",
        f"{name}_sums",
    )


_ORDERS = "select {} as series_id, o_orderdate as ts, o_totalprice as y from orders join customer on o_custkey = c_custkey"
_panel("p5", _ORDERS.format("c_mktsegment"), "week")
_panel("p25", _ORDERS.format("cast(c_nationkey as varchar)"), "week")
_panel("p125", _ORDERS.format("concat(cast(c_nationkey as varchar), '-', c_mktsegment)"), "week")
_panel("pe", "select event_type as series_id, ts, value as y from events", "hour")
_panel("pl", "select concat(l_returnflag, l_linestatus) as series_id, l_shipdate as ts, l_quantity as y from lineitem", "week")
