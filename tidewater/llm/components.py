"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.base import materialise


def connected(edges: DataFrame, label: str = "components", tasks: int | None = None) -> DataFrame:
    """``kind, node, root`` for edges ``kind, a, b``: the smallest node reachable within each kind.

    A node without edges isn't listed. Rounds go on until no edge changes; a
    node's neighbours are only ever aggregated or joined, never gathered.
    ``tasks`` write each round's edges at most.
    """
    now = materialise(edges.where("a <> b").select("kind", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label, tasks)
    state = _state(now)
    while state[0]:
        # Large star: larger neighbours go to the smallest node around.
        both = now.unionByName(now.select("kind", F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join reads two plain shuffles and Spark can split the edges of a hub.
        least = materialise(both.groupBy("kind", "a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{label}-least", tasks)
        large = both.join(least, ["kind", "a"]).where("b > a").select("kind", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("kind", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["kind", "a"])
        nearer = small.where("b <> m").select("kind", F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("kind", "a", F.col("m").alias("b"))
        now = materialise(nearer.unionByName(own).distinct(), label, tasks)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select("kind", F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select("kind", F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("kind", "a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
