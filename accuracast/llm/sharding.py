"""Shards for the rows of a panel: a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places on the ring; the only size the per-place tables can have, whatever the data.
PLACES = 1 << 16
VIRTUAL_NODES = 64


def ring(spark, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``place int, arc int, owner int`` for all places: the virtual node at or after a place owns it.

    A virtual node stands on ``xxhash64(shard, replica)``, so a further shard only adds nodes. Two nodes
    on one place: the smaller shard keeps it.
    """
    nodes = (
        spark.range(shards * virtual_nodes, numPartitions=1)
        .select(F.expr(f"cast(id div {virtual_nodes} as int)").alias("owner"), F.expr(f"cast(id % {virtual_nodes} as int)").alias("replica"))
        .select("owner", _place(F.xxhash64("owner", "replica")).alias("place"))
        .groupBy("place").agg(F.min("owner").alias("owner"))
    )
    places = spark.range(PLACES, numPartitions=1).select(F.col("id").cast("int").alias("place"))
    # one row per place and one window over them, from the far end: a table of constant size
    onward = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.when(F.col("owner").isNotNull(), F.struct(F.col("place").alias("node"), "owner"))
    found = places.join(nodes, "place", "left").select("place", F.last(here, ignorenulls=True).over(onward).alias("n"))
    lowest = nodes.agg(F.min(F.struct(F.col("place").alias("node"), "owner")).alias("first"))
    n = F.coalesce("n", "first")  # behind the last node the ring begins again
    return found.join(F.broadcast(lowest), F.lit(True), "left").select("place", n["node"].alias("arc"), n["owner"].alias("owner"))


def _place(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 48).cast("int")


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows per shard. Without slack they add up to ``total`` and differ by at most one."""
    if slack > 0:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def flow(arcs: list[tuple[int, int, int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: (arc, first rank, end rank, shard, first slot).

    ``arcs`` holds (arc, owner, rows) in ring order, one entry per virtual node at most. Owners take
    their own rows first; what a full shard cannot take continues clockwise to the next shard with room.
    """
    left, used, pieces, over = list(caps), [0] * len(caps), [], []

    def put(arc: int, first: int, rows: int, shard: int) -> int:
        n = min(rows, left[shard])
        if n:
            pieces.append((arc, first, first + n, shard, used[shard]))
            left[shard] -= n
            used[shard] += n
        return n

    for i, (arc, owner, rows) in enumerate(arcs):
        n = put(arc, 0, rows, owner)
        if n < rows:
            over.append((i, n))
    for i, first in over:
        arc, _, rows = arcs[i]
        for step in range(1, len(arcs) + 1):
            if first == rows:
                break
            first += put(arc, first, rows - first, arcs[(i + step) % len(arcs)][1])
        for shard in range(len(caps)):  # a shard that owns no arc
            first += put(arc, first, rows - first, shard)
    return pieces


def ring_shards(records: DataFrame, key: str = "series_id", shards: int = 8, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, tie: tuple[str, ...] = ()) -> DataFrame:
    """``records`` with ``shard int`` and ``slot bigint`` (gapless from 0 within a shard).

    Works on any rows of the project (a panel, forecasts, features) and hashes ``key``, by default the
    series. A key's place on the ring names its arc; rows of an arc are ordered by hash, key and the
    ``tie`` columns, and the arc's owner takes them until it is full. With ``slack`` 0 shards differ by
    at most one row; with 0.05 none is over 105 % of the mean, and fewer rows move when ``shards`` changes.

    NULL keys are spread by the ``tie`` columns. Repeated rows each get a slot of their own. An empty
    table gives an empty table. Columns of the input that are named shard or slot are replaced.

    Scale: one count per place (a table of 65,536 rows at any input), one shuffle of the rows by place
    for their rank. No shard is ever gathered in one task.
    """
    spark = records.sparkSession
    rows = records.drop("shard", "slot")
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.lit("null"), *tie))
    rows = rows.withColumn("_hash", hashed).withColumn("_place", _place(F.col("_hash")))
    # places inside an arc, with the rows that stand before each
    places = rows.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("arc").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    owned = ring(spark, shards, virtual_nodes)
    starts = places.join(F.broadcast(owned), F.col("_place") == F.col("place")).select("_place", "_n", "arc", "owner", F.coalesce(before, F.lit(0)).alias("_before"))
    arcs = [(r.arc, r.owner, r.n) for r in starts.groupBy("arc", "owner").agg(F.sum("_n").alias("n")).orderBy("arc").collect()]  # shards x virtual_nodes rows at most
    pieces = flow(arcs, capacities(sum(a[2] for a in arcs), shards, slack))
    where = spark.createDataFrame(pieces or [(-1, 0, 0, 0, 0)], "arc int, _first bigint, _end bigint, shard int, _slot bigint")
    where = where.groupBy("arc").agg(F.collect_list(F.struct("_first", "_end", "shard", "_slot")).alias("_pieces"))  # at most one piece per shard
    starts = starts.join(where, "arc").select("_place", "_before", "_pieces")
    rank = F.row_number().over(Window.partitionBy("_place").orderBy("_hash", key, *tie)) - 1
    # bounded: one row per place that holds rows, PLACES at most
    ranked = rows.withColumn("_rank", rank).join(F.broadcast(starts), "_place").withColumn("_rank", F.col("_rank") + F.col("_before"))
    piece = F.filter("_pieces", lambda p: (p["_first"] <= F.col("_rank")) & (F.col("_rank") < p["_end"]))[0]
    return ranked.withColumn("_p", piece).select(
        *rows.columns[:-2], F.col("_p.shard").alias("shard"), (F.col("_p._slot") + F.col("_rank") - F.col("_p._first")).alias("slot")
    )
