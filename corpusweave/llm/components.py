"""Connected components of a graph given as a table of links.

Large and small stars in turn: every node links its larger neighbours, then its smaller ones, to the
least node it knows, until each component is one star. A round is joins and aggregates on narrow
rows, and its result is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import checkpointed


def _round(links: DataFrame) -> DataFrame:
    """One large and one small star over links ``(node, root)`` with ``node > root``."""
    both = links.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(
        links.select(F.col("root").alias("u"), F.col("node").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    upward = both.where("v > u").join(least, "u").where("v <> least")
    large = upward.select(F.col("v").alias("node"), F.col("least").alias("root")).distinct()
    lower = large.groupBy("node").agg(F.min("root").alias("least"))
    joined = large.join(lower, "node")
    ends = F.explode(F.array(F.col("node"), F.col("root"))).alias("node")
    return joined.select(ends, F.col("least").alias("root")).where("node <> root").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that is not a root itself.

    Links have no direction; repeated links, links of a node to itself and links with a null end
    change nothing. Nodes without links are not in the result.
    """
    proper = links.where(F.col(a) != F.col(b))
    stars = checkpointed(
        proper.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct()
    )
    seen = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return stars
        seen, stars = now, checkpointed(_round(stars))
