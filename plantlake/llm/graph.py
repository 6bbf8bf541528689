"""Connected components by alternating stars; no part of the graph is held by one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from plantlake.llm.common import drop_table, once

# links up to which the smallest neighbours are sent to every task, 16 bytes each, and two tasks a core are enough
FEW_LINKS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in (a, b): the smallest node that links lead to.

    Large star: every node hands its larger neighbours to its smallest one; small star: its smaller neighbours and itself.
    Rounds go on until the large star no longer changes the links and every node has one smaller neighbour at most, which
    takes about the logarithm of the longest path. A node with very many neighbours is only ever summed up by a minimum,
    which partial aggregation spreads over all tasks, and a join, which splits hot keys; where links are few, the
    join needs no shuffle. Each round is written to the shared folder and the round before it is removed.
    """
    spark = links.sparkSession
    both = lambda d: d.select("a", "b").unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, state = _measured(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        few = state.get("n", 0) <= FEW_LINKS
        tight = lambda d: d.coalesce(2 * spark.sparkContext.defaultParallelism) if few else d
        sent = lambda d: F.broadcast(tight(d)) if few else d
        around = both(edges)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(sent(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, now = _measured(tight(large), "large")
        # links that the large star leaves alone lead to nodes without a smaller neighbour: stars, if each node has one link
        if now == state and large.groupBy("a").count().where("count > 1").isEmpty():
            drop_table(spark, large)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        # every link now leads from a larger to a smaller node
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(lowest), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after, state = _measured(tight(small.where("a <> b").distinct()), "links")
        drop_table(spark, edges)
        drop_table(spark, large)
        edges = after


def _measured(links: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """The links, written once, with their number and a digest of them; both are left out where there are none."""
    seen = Observation()
    digest = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")]
    kept = once(links.observe(seen, *digest), label)
    # an empty input may be planned away together with its measurement
    state = seen.get or {}
    return kept, state if state.get("n") else {}
