"""Connected components of links between long-valued nodes, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import drop, stored


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node that has a link to another; root is the component's smallest node.

    Rounds of large-star and small-star steps.  Each node's smallest neighbour
    comes from an aggregate with partial sums and meets the links in an
    equi-join, so a node with very many links is split like any skewed key and
    no neighbour list is ever built.  Each round is written to the shared
    folder; only two counters reach the driver.  Null ends and self links are
    left out; repeated links count once.
    """
    spark = links.sparkSession
    clean = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now, path = stored(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        middle, middle_path = stored(large, "links")
        # Every link now points down: v < u.  Small-star joins a node and its lower neighbours to the least of them.
        lowest = middle.groupBy("u").agg(F.min("v").alias("m"))
        small = middle.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new, new_path = stored(small, "links")
        # Done when no root has a root of its own and each node has one link: every component is then a star.
        roots = new.select(F.col("v").alias("u")).distinct()
        deep = new.join(roots, "u", "left_semi").limit(1).count()
        many = new.groupBy("u").count().filter("count > 1").limit(1).count()
        for old in (path, middle_path):
            drop(spark, old)
        now, path = new, new_path
        if not deep and not many:
            break
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
