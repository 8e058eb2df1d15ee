"""How filters act on each other: removals of every order of application, from the values of coalitions."""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.session import written

MAX_FILTERS = 6


def repeats_smaller(df: DataFrame, key: str = "series_id", content: str = "values", name: str = "repeated") -> DataFrame:
    """``df`` with the boolean column ``name``: the same ``content`` stands under a smaller ``key``.

    For series that are copies of others: ``content`` may be a text, a number or an array of values. NULL
    content equals NULL content, not the empty one. A row without a key repeats nothing and is not
    repeated; rows that share key and content are judged alike. A column called ``name`` is replaced.

    Scale: contents are compared by their SHA-256. The least key of each is found with a combine on the
    map side and joined back; a content of very many rows is a long side of that join, which Spark splits.
    """
    text = F.col(content).cast("string") if dict(df.dtypes)[content] in ("string", "binary") else F.to_json(F.struct(content))
    digest = F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), text), F.lit("")).cast("binary"), 256))
    mine, least = (x + "_" * max(map(len, df.columns)) for x in ("digest", "least"))  # longer than any name of df
    marked = df.withColumn(mine, digest)
    # written, so that both sides of the join are plain shuffles, which Spark splits where they are skewed
    found = marked.groupBy(mine).agg(F.min(key).alias(least), F.max(key).alias("hi")).where(F.col(least) < F.col("hi")).drop("hi")
    joined = marked.join(written(found, "least"), mine, "left")
    return joined.select(*[c for c in df.columns if c != name], F.coalesce(F.col(key) > F.col(least), F.lit(False)).alias(name))


def _steps(names: list[str], separator: str) -> list[dict]:
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": separator.join(names[j] for j in order), "step": step, "i": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    return rows


def potentials(removed: Column, n: int) -> Column:
    """Potentials of all coalitions of n filters in the removal game, times the least common multiple of 1..n.

    ``removed`` holds how many records each coalition removes, by the bits of its members. The potential
    of no filter is 0 and that of a coalition S is (removed[S] + the potentials of S without each of its
    members) / |S|; a smaller coalition has a smaller number, so one walk upwards finds them all. The
    factor makes every division exact.
    """
    scale = math.lcm(*range(1, n + 1))

    def grow(found: Column, s: Column) -> Column:
        total = F.get(removed, s) * F.lit(scale)
        for i in range(n):
            total = total + F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(found, s - F.lit(1 << i))).otherwise(F.lit(0))
        return F.concat(found, F.array(F.call_function("div", total, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n) - 1)), F.array(F.lit(0).cast("bigint")), grow)


def filter_audit(df: DataFrame, filters: dict[str, Column | str], part: str = "split", flags: dict[str, Column | str] | None = None, separator: str = ">") -> DataFrame:
    """What every order of ``filters`` removes at every step, for every ``part``.

    ``df`` holds one row per record, for example per series of a split with its features as columns;
    ``filters`` maps a name to the condition under which a record fails (at most six of them, since all
    orders are listed), ``flags`` maps a name to records whose loss is counted apart, for example series
    that are forecast well. Rows: ``part``, ``filter_order`` (names in order of application), ``step``,
    ``filter`` and, as bigint, ``kept`` (records left after the step), ``removed`` (here), ``redundant``
    (failing here, removed before), ``unique_fails`` (failing this filter only), ``<flag>_lost`` (removed
    here and flagged) and ``shapley`` (removals of this filter at any step, summed over all orders).

    A NULL condition does not fail and a NULL flag is not set; a NULL part is the part ''. Repeated rows
    count one by one. A part has its rows even if nothing fails in it; without records there is no part.
    Columns of ``df`` may have any name: those of the result come from ``df``'s part column alone.

    Method: the game in which a coalition of filters is worth the records it removes. Records collapse to
    counts per part and set of failed filters (2^n at most) before any shuffle; the worth of every
    coalition is a sum over these. Potentials are built up recursively; n! times a Shapley value is n!
    times the potential of all filters less that of all but the one. A step that follows the coalition S
    removes worth(S with its filter) - worth(S). Nothing is listed per record and order.
    """
    names, flags = list(filters), flags or {}
    n = len(names)
    if not 1 <= n <= MAX_FILTERS:
        raise ValueError(f"between 1 and {MAX_FILTERS} filters, got {n}")
    cond = lambda c: F.coalesce((F.expr(c) if isinstance(c, str) else c).cast("boolean"), F.lit(False))
    mask = sum((F.when(cond(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    one = lambda c: F.when(cond(c), 1).otherwise(0).cast("bigint")
    records = df.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("p"), mask.alias("m"), *[one(c).alias(f"f{k}") for k, c in enumerate(flags.values())])
    sums = ["n", *(f"f{k}" for k in range(len(flags)))]
    cells = records.groupBy("p", "m").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums[1:]])
    worth = lambda c: F.array(*[F.sum(F.when(F.col("m").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(F.lit(0).cast("bigint"))) for s in range(1 << n)])
    games = cells.groupBy("p").agg(F.sum("n").alias("all"), *[worth(c).alias(f"v_{c}") for c in sums])
    games = games.withColumn("potential", potentials(F.col("v_n"), n))
    steps = F.from_json(F.lit(json.dumps(_steps(names, separator))), "array<struct<filter_order:string,step:int,i:int,before:int,after:int>>")
    rows = games.withColumn("s", F.explode(steps))
    full, bit = (1 << n) - 1, F.call_function("shiftleft", F.lit(1), F.col("s.i"))
    gain = lambda v: F.get(v, F.col("s.after")) - F.get(v, F.col("s.before"))
    v = F.col("v_n")
    share = math.factorial(n) // math.lcm(*range(1, n + 1))
    return rows.select(
        F.col("p").alias(part), F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step"),
        F.get(F.array(*map(F.lit, names)), F.col("s.i")).alias("filter"),
        (F.col("all") - F.get(v, F.col("s.after"))).alias("kept"), gain(v).alias("removed"), (F.get(v, bit) - gain(v)).alias("redundant"),
        (F.get(v, F.lit(full)) - F.get(v, F.lit(full) - bit)).alias("unique_fails"),
        *[gain(F.col(f"v_f{k}")).alias(f"{name}_lost") for k, name in enumerate(flags)],
        ((F.get("potential", F.lit(full)) - F.get("potential", F.lit(full) - bit)) * F.lit(share)).alias("shapley"),
    )
