"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node bigint, comp bigint``: the smallest node reachable, for every node of ``links (u, v)``.

    Labels only fall, so an unchanged sum ends the loop. A round takes the least label next door and
    then the label of that label, which halves the way; the rounds grow as the logarithm of the longest
    path. Labels of a round are checkpointed. Nothing but the sums reaches the driver.
    """
    both = checkpointed(links.select("u", "v").union(links.select("v", "u")).where("u != v").distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("comp")))
    total = lambda df: df.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
    last = total(labels)
    while last is not None:
        near = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"))
        labels = checkpointed(lower.join(labels.select(F.col("node").alias("to"), F.col("comp").alias("next")), "to").select("node", F.least("to", "next").alias("comp")))
        now = total(labels)
        if now == last:
            break
        last = now
    return labels
