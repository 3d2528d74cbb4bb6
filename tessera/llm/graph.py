"""Connected components of a table of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, saved, split_join

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(k, root) for each end of ``links`` (a, b): the least k that it is linked to, directly or not.

    Large-star and small-star rounds alternate until every component is a star around its least node. Each round sends a row
    for each link and joins on the node, links of nodes with very many staying where they are; it is
    saved, so that the plan doesn't grow, and the tables of the round before are deleted. Links to oneself are allowed; no links give no rows.
    """
    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    edges = links.where("a <> b")
    nodes = links.select(F.col("a").alias("k")).union(links.select(F.col("b").alias("k"))).distinct()
    done: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        # Large star: each node's larger neighbours are linked to its least neighbour or itself.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smaller = F.sum((F.col("b") < F.col("a")).cast("long"))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"), smaller.alias("s")), "least")
        if not least.where("s > 0 and c > 1").limit(1).count():  # stars: a node with a smaller neighbour has no other
            deleted(least)
            break
        large = split_join(both.where("b > a"), least.drop("s"), ["a"], "c").select(F.col("m").alias("a"), "b").where("a <> b")
        # Small star: each node's smaller neighbours and itself are linked to the least of them.
        large = saved(large, "large")  # links may repeat, but are no more than before
        small_of = saved(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("c")), "small")
        new = split_join(large, small_of, ["b"], "c").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        new = saved(new.select("e.a", "e.b").where("a <> b").distinct(), "links")
        for df in [*done, least, large, small_of]:
            deleted(df)
        done, edges = [new], new
    else:
        raise RuntimeError("links don't settle")
    roots = edges.select(F.col("b").alias("k"), F.col("a").alias("root"))
    return nodes.join(roots, "k", "left").select("k", F.coalesce("root", "k").alias("root"))
