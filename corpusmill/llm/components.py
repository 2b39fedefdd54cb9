"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusmill.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that stands in a link (a, b); root is the component's least node.

    Each round turns the links towards the least neighbour, once among larger
    neighbours and once among smaller ones; they form stars after about
    log(n) rounds. Minima are combined before the shuffle and joined back, so
    a node with very many links is not gathered in one task. Every round is
    written to the shared folder. No links give no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = saved(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        seen = Observation()
        sums = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        edges = saved(small.filter("u <> v").distinct().observe(seen, *sums), "stars")
        if seen.get == before:
            break
        before = seen.get
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
