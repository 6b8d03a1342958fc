"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import stored
from tidewell.session import work_folder


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that has a link (a, b).

    In each round every node moves to its smallest neighbour if that is
    smaller; links between the new places remain until there are none.  The
    rounds are few, and each is written to the shared folder.
    """
    folder = work_folder(links.sparkSession, "components")
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(edges, f"{folder}/edges-0")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        moved = both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to"))
        moves.append(stored(moved, f"{folder}/moves-{len(moves)}"))
        a, b = (moves[-1].select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        ends = edges.join(a, "a").join(b, "b").where("a_to <> b_to")
        ends = ends.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        edges = stored(ends, f"{folder}/edges-{len(moves)}")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = moves[0].withColumnRenamed("to", "component")
    for moved in moves[1:]:
        labels = _moved(labels, moved.withColumnsRenamed({"node": "component", "to": "next"}))
    return stored(labels, f"{folder}/labels")


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """Labels after components have moved to ``next``."""
    return labels.join(moves, "component", "left").select("node", F.coalesce("next", "component").alias("component"))


def with_links(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after further links (a, b); nodes without a label are their own component so far."""
    if labels is None:
        return components(links)
    a, b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}_at")) for x in "ab")
    at = links.join(a, "a", "left").join(b, "b", "left")
    at = at.select(F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b"))
    merged = components(at)
    moved = _moved(labels, merged.withColumnsRenamed({"component": "next"}).withColumnRenamed("node", "component"))
    fresh = merged.join(labels.select("node"), "node", "left_anti")
    return stored(moved.unionAll(fresh), work_folder(links.sparkSession, "labels"))
