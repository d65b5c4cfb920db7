"""Connected components as joins and minima; nothing is gathered on the driver but one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node reachable.

    Alternates the large-star and small-star steps until no link changes, O(log) rounds on long chains. Each round is
    written to the shared folder. Hot roots only meet in inner equi-joins, whose partitions adaptive execution can split,
    and in minima, which are pre-aggregated. Nulls and self-links are ignored; an empty table gives an empty result.
    """
    now = keep(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = keep(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
            "links",
        )
        # done when every node hangs on one root and no root hangs on another node
        forks = new.groupBy("a").count().where("count > 1").limit(1).count()
        chains = new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() if not forks else 1
        forget(now)
        now = new
        if not chains:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
