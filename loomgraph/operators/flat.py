"""Parallel edges as one, for formats that know no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import edge_width, node_size
from ..schemas import Graph
from ..session import spread
from .views import degrees

PALETTE = ["#4C9BE8", "#E8734C", "#5CB85C", "#B26FD1", "#E8C34C", "#4CC9B0", "#D1596F", "#8C8C8C", "#7A9E3F", "#9B6B43"]


def flat_edges(edges: DataFrame) -> DataFrame:
    """One row for each source and target: relation types and evidence united and sorted, the highest confidence, support added up."""
    docs = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("support_documents", F.array().cast("array<string>"))))))
    first = F.min_by("evidence", "edge_key")
    # an empty evidence is left out where it is the first edge's alone
    rest = F.array_sort(F.collect_set("evidence"))
    blank_later = F.count_if((F.col("evidence") == "")) - F.when(first == "", 1).otherwise(0)
    e = spread(edges, "source", "target").groupBy("source", "target").agg(
        F.array_join(F.array_sort(F.collect_set(F.nullif("relation_type", F.lit("")))), "; ").alias("relation_type"), rest.alias("_e"), blank_later.alias("_b"), F.max("confidence").alias("confidence"),
        F.sum(F.greatest(F.lit(1), F.coalesce("support_count", F.lit(1)))).alias("support_count"), docs.alias("_d"),
    )
    evidence = F.when(F.col("_b") > 0, F.col("_e")).otherwise(F.filter("_e", lambda x: x != ""))
    return e.select("source", "target", "relation_type", F.array_join(evidence, " | ").alias("evidence"), "confidence", "support_count", F.array_join("_d", "; ").alias("support_documents"), F.size("_d").alias("support_doc_count"))


def flat_nodes(g: Graph, descriptions: DataFrame | None = None) -> DataFrame:
    """Nodes with label, size by degree, colour by type, and description."""
    n = g.nodes.join(degrees(g.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n = n.join(descriptions, "id", "left") if descriptions is not None else n.withColumn("description", F.lit(None).cast("string"))
    colour = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.pmod(F.hash("entity_type"), F.lit(len(PALETTE))) + 1).cast("int"))
    return n.select(
        "id", F.col("name").alias("label"), "entity_type", "confidence", F.array_join("source_documents", "; ").alias("source_documents"), F.to_json("attributes").alias("attributes"), "description",
        node_size(F.col("degree")).alias("size"), colour.alias("color"),
    )


def edge_look(edges: DataFrame) -> DataFrame:
    return edges.withColumn("width", edge_width(F.coalesce("support_count", F.lit(1))))
