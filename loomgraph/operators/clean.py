"""Cleaning operators; the build applies them in the order in which they stand here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relations import active_form, synonym
from ..schemas import DOCUMENT, FALLBACK_RELATION, MENTIONED_IN, Graph

#: Source types, target types, whether the relation has no direction.
Ends = tuple[list[str], list[str], bool]
TRANSITIVE = ("LOCATED_IN",)


def ends_in(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which both ends are among ``ids.id``."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def without_metadata(g: Graph) -> Graph:
    """DOCUMENT nodes (extracted ones too), MENTIONED_IN edges and edges that lose an end go."""
    nodes = g.nodes.where(F.col("entity_type") != DOCUMENT)
    return g.with_(nodes, ends_in(g.edges.where(F.col("relation_type") != MENTIONED_IN), nodes).select(*g.edges.columns))


def undirected(g: Graph) -> DataFrame:
    """(src, dst, edge_key): the graph without metadata, each edge both ways; parallel edges stay, a loop is there once."""
    e = without_metadata(g).edges
    return e.select(F.col("source").alias("src"), F.col("target").alias("dst"), "edge_key").union(e.where("source <> target").select("target", "source", "edge_key"))


def activated(edges: DataFrame) -> DataFrame:
    """Passive types rewritten to active ones with the ends swapped; keys stay as they were."""
    to = F.when((F.col("relation_type") != "") & (F.col("relation_type") != MENTIONED_IN), active_form(F.col("relation_type")))
    e = edges.withColumn("_to", to)
    flip = F.col("_to").isNotNull()
    return e.withColumns({
        "_s": F.when(flip, F.col("target")).otherwise(F.col("source")), "_t": F.when(flip, F.col("source")).otherwise(F.col("target")), "relation_type": F.coalesce("_to", "relation_type"),
    }).withColumns({"source": F.col("_s"), "target": F.col("_t")}).select(*edges.columns)


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target")


def transitively_reduced(edges: DataFrame, types: tuple[str, ...] = TRANSITIVE) -> DataFrame:
    """Of a transitive type, an edge from a to c goes where a leads to some b other than c, and b to c; all are judged before any goes."""
    out = edges
    for t in types:
        step = edges.where(F.col("relation_type") == t).select("source", "target").distinct()
        two = step.select("source", F.col("target").alias("mid")).join(step.select(F.col("source").alias("mid"), "target"), "mid").where("mid <> target").select("source", "target").distinct()
        redundant = two.join(step, ["source", "target"], "left_semi").withColumn("relation_type", F.lit(t))
        out = out.join(redundant, ["source", "target", "relation_type"], "left_anti").select(*edges.columns)
    return out


def pruned(g: Graph) -> Graph:
    """Entities that have only metadata edges, or none, go with those edges; documents stay."""
    real = g.edges.where(F.col("relation_type") != MENTIONED_IN)
    used = real.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    entities = g.nodes.where(F.col("entity_type") != DOCUMENT)
    nodes = entities.join(used, "id", "left_semi").unionByName(g.nodes.where(F.col("entity_type") == DOCUMENT))
    lone = entities.join(used, "id", "left_anti").select("id")
    edges = g.edges.join(lone.withColumnRenamed("id", "source"), "source", "left_anti").join(lone.withColumnRenamed("id", "target"), "target", "left_anti")
    return g.with_(nodes.select(*g.nodes.columns), edges.select(*g.edges.columns))


def normalized_types(edges: DataFrame, valid: list[str]) -> DataFrame:
    """Types that aren't ``valid`` become their synonym, else the fallback where there are valid types; a synonym isn't looked at again."""
    kind = F.col("relation_type")
    other = F.coalesce(synonym(kind), F.lit(FALLBACK_RELATION)) if valid else F.coalesce(synonym(kind), kind)
    known = kind.isin(*valid) if valid else F.lit(False)
    return edges.withColumn("relation_type", F.when((kind == "") | (kind == MENTIONED_IN) | known, kind).otherwise(other))


def directed(g: Graph, rules: dict[str, Ends]) -> Graph:
    """Edges turned round where only that fits the types their relation allows at its ends.

    ``rules``: relation type to (source types, target types, symmetric). Edges that fit neither way stay.
    """
    bound = {k: v for k, v in rules.items() if v[0] and v[1] and not v[2] and k != MENTIONED_IN}
    if not bound:
        return g
    spark = g.nodes.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, *v[:2]) for k, v in bound.items()], "relation_type string, _from array<string>, _to array<string>"))
    kinds = g.nodes.select("id", "entity_type")
    e = g.edges.join(table, "relation_type", "left").join(kinds.select(F.col("id").alias("source"), F.col("entity_type").alias("_se")), "source", "left").join(kinds.select(F.col("id").alias("target"), F.col("entity_type").alias("_te")), "target", "left")
    fits = F.array_contains("_from", F.col("_se")) & F.array_contains("_to", F.col("_te"))
    flip = F.coalesce(~fits & F.array_contains("_from", F.col("_te")) & F.array_contains("_to", F.col("_se")), F.lit(False))
    e = e.withColumns({"_s": F.when(flip, F.col("target")).otherwise(F.col("source")), "_t": F.when(flip, F.col("source")).otherwise(F.col("target"))})
    return g.with_(edges=e.withColumns({"source": F.col("_s"), "target": F.col("_t")}).select(*g.edges.columns))


def review_flags(g: Graph, threshold: float = 0.7, review_types: tuple[str, ...] = ()) -> DataFrame:
    """Edges to look at: of low confidence, or of a type that always is; with the names of both ends and the reasons."""
    low = F.when(F.col("confidence") < threshold, F.concat(F.lit("Low confidence ("), F.format_string("%.2f", F.col("confidence")), F.lit(f" < {threshold})")))
    kind = F.when(F.col("relation_type").isin(*review_types), F.concat(F.lit("Type '"), F.col("relation_type"), F.lit("' requires review"))) if review_types else F.lit(None).cast("string")
    e = g.edges.where(F.col("relation_type") != MENTIONED_IN).withColumn("flag_reason", F.concat_ws("; ", low, kind)).where("flag_reason <> ''")
    name = lambda end: g.nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_n"))
    e = e.join(name("source"), "source", "left").join(name("target"), "target", "left")
    return e.select(
        F.col("source").alias("source_id"), F.coalesce("source_n", "source").alias("source_name"), F.col("target").alias("target_id"), F.coalesce("target_n", "target").alias("target_name"),
        "relation_type", "confidence", "evidence", "source_document", F.lit("DRAFT").alias("status"), "flag_reason",
    )
