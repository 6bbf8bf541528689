"""Link graph of inventory files, entities and ids written in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantlake.functions.ids import ids_in_text, link_kind
from plantlake.joins import hot_keys, join_hot
from plantlake.session import settle


def file_edges(inventory: DataFrame) -> DataFrame:
    """(src, dst, kind): from each file to the ids it links."""
    named = inventory.select("file_path", F.explode("linked_ids").alias("name", "ids"))
    return named.select(
        F.col("file_path").alias("src"), F.explode("ids").alias("dst"), link_kind(F.col("name")).alias("kind")
    ).where(F.col("dst").isNotNull()).distinct()


def entity_edges(events: DataFrame, event_id: str, links: dict[str, str]) -> DataFrame:
    """(src, dst, kind): from each event to the ids in its link columns (column -> inventory name)."""
    cells = F.array(*[F.struct(F.col(c).alias("dst"), link_kind(F.lit(n)).alias("kind")) for c, n in links.items()])
    return events.select(F.col(event_id).alias("src"), F.inline(cells)).where(F.col("dst").isNotNull()).distinct()


def text_edges(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(src, dst): from each row to every entity id its text mentions."""
    return df.select(F.col(row_id).alias("src"), F.explode(ids_in_text(F.col(text))).alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, degree)."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )))
    return ends.groupBy("node").agg(
        F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), (F.sum("o") + F.sum("i")).alias("degree")
    )


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(node, distance) of every node within ``hops`` undirected steps of any seed.

    One join per hop over the newly reached nodes only; a node is visited once, whatever its degree. It ends early when
    a hop reaches nothing new.
    """
    if hops < 0:
        raise ValueError("hops must not be negative")
    both = settle(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    reached = settle(seeds.select("node").distinct().withColumn("distance", F.lit(0)), "reached")
    frontier, heavy = reached, (hot_keys(both, ["src"]),)
    for hop in range(1, hops + 1):
        stepped = join_hot(both, frontier.select(F.col("node").alias("src")), ["src"], "inner", measured=heavy)
        fresh = stepped.select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti")
        frontier = settle(fresh.withColumn("distance", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached
