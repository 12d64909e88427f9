"""Read paths: degrees, neighbourhoods, filters, search and details of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import inverse_label, label
from ..functions.texts import aliases
from ..schemas import DOCUMENT, MENTIONED_IN, Graph
from ..session import checkpoint_folder
from .clean import ends_in, undirected, without_metadata


class NotFound(ValueError):
    """No entity of that id or name, or more than one of the name."""


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out; a loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def substantive_degrees(g: Graph) -> DataFrame:
    """(id, degree) of every node: edges that are neither metadata nor lead to or from a DOCUMENT; a loop counts once."""
    real = g.nodes.where(F.col("entity_type") != DOCUMENT).select("id")
    e = g.edges.where(F.col("relation_type") != MENTIONED_IN)
    out = e.join(real.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    into = e.where("source <> target").join(real.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    n = out.union(into).groupBy("id").agg(F.count("*").alias("degree"))
    return g.nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def type_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("entity_type").agg(F.count("*").alias("n"))


def relation_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count("*").alias("n"))


def document_summary(nodes: DataFrame) -> DataFrame:
    """(document, n) of the entities each document supports."""
    return nodes.where(F.col("entity_type") != DOCUMENT).select(F.explode(F.array_distinct("source_documents")).alias("document")).groupBy("document").agg(F.count("*").alias("n"))


def view_defaults(g: Graph) -> DataFrame:
    """One row for a viewer: the most documents of an entity, and the degree from which to show (1 under 100 real edges, else 2)."""
    most = g.nodes.agg(F.coalesce(F.max(F.size("source_documents")), F.lit(0)).alias("max_documents"))
    n = g.edges.agg(F.count_if(F.col("relation_type") != MENTIONED_IN).alias("edges"))
    return most.crossJoin(n).select("max_documents", F.when(F.col("edges") < 100, 1).otherwise(2).alias("min_degree"))


def within(g: Graph, nodes: DataFrame) -> Graph:
    return g.with_(nodes, ends_in(g.edges, nodes).select(*g.edges.columns))


def reached(pairs: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id) within ``depth`` hops of ``start.id`` over ``pairs(src, dst)``: one join a hop, and it ends where a hop finds nothing.

    From the second hop on, frontiers are checkpointed, so plans don't grow with the depth.
    """
    front = start.select("id").distinct()
    if depth > 1:
        checkpoint_folder(pairs.sparkSession)
        front = front.checkpoint()
    seen = front
    for hop in range(depth):
        front = front.join(pairs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        if depth > 1:
            front = front.checkpoint()
            if front.isEmpty():
                break
        seen = seen.union(front)
    return seen


def subgraph(g: Graph, entity_id: str, depth: int = 1) -> Graph:
    """What lies within ``depth`` hops of an entity, without metadata; nothing for a document or an unknown id."""
    pairs = undirected(g).select("src", "dst")
    start = g.nodes.where((F.col("id") == entity_id) & (F.col("entity_type") != DOCUMENT)).select("id")
    clean = without_metadata(g)
    ids = reached(pairs, start, depth)
    return within(clean, clean.nodes.join(ids, "id", "left_semi").select(*g.nodes.columns))


def ego(g: Graph, who: str, depth: int = 1) -> Graph:
    """The neighbourhood of an id, or of the one entity of that name whatever its case."""
    found = [r.id for r in g.nodes.where(F.col("id") == who).select("id").limit(1).collect()]
    if not found:
        found = [r.id for r in g.nodes.where(F.lower("name") == who.lower()).select("id").limit(2).collect()]
    if len(found) != 1:
        raise NotFound(f"{'no entity' if not found else 'more than one entity'} {who!r}")
    return subgraph(g, found[0], depth)


def of_document(g: Graph, document: str) -> Graph:
    kept = g.nodes.where(F.array_contains("source_documents", document))
    edges = g.edges.where((F.col("source_document") == document) | F.coalesce(F.array_contains("support_documents", document), F.lit(False)))
    return within(g.with_(edges=edges), kept)


def confident(g: Graph, least: float) -> Graph:
    enough = F.coalesce("confidence", F.lit(0.0)) >= least
    return within(g.with_(edges=g.edges.where(enough)), g.nodes.where(enough))


def top_hubs(g: Graph, n: int) -> DataFrame:
    return g.nodes.select("id").join(degrees(g.edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(n)


def around_hubs(g: Graph, n: int) -> Graph:
    """The ``n`` nodes of most edges and all their direct neighbours."""
    pairs = g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    ids = reached(pairs.union(pairs.select("dst", "src")), top_hubs(g, n), 1)
    return within(g, g.nodes.join(ids, "id", "left_semi").select(*g.nodes.columns))


def view(g: Graph, who: str | None = None, depth: int = 1, document: str | None = None, least: float = 0.0, top: int | None = None) -> Graph:
    """The filters in their fixed order: neighbourhood, document, confidence, hubs."""
    g = ego(g, who, depth) if who else g
    g = of_document(g, document) if document else g
    g = confident(g, least) if least > 0 else g
    return around_hubs(g, top) if top else g


def _named(q: str) -> Column:
    q = q.lower()
    return F.contains(F.lower("name"), F.lit(q)) | F.exists(aliases(F.col("attributes")), lambda a: F.contains(F.lower(a), F.lit(q)))


def search(g: Graph, q: str, entity_type: str | None = None) -> DataFrame:
    """Nodes whose name, or an alias, holds ``q`` whatever the case; documents too."""
    found = g.nodes.where(_named(q))
    return found.where(F.upper("entity_type") == entity_type.upper()) if entity_type else found


def candidates(g: Graph, q: str) -> DataFrame:
    """(id, name, entity_type, degree, rank): an exact id alone, else what the search finds but documents, best linked first."""
    exact = g.nodes.where(F.col("id") == q)
    found = exact if not exact.isEmpty() else search(g, q).where(F.col("entity_type") != DOCUMENT)
    ranked = found.select("id", "name", "entity_type").join(substantive_degrees(g), "id")
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))


def relations_of(g: Graph, entity_id: str, direction: str = "both") -> DataFrame:
    """Edges out of, into, or at an entity; a loop stands twice under ``both``."""
    out, into = g.edges.where(F.col("source") == entity_id), g.edges.where(F.col("target") == entity_id)
    if direction not in ("in", "out", "both"):
        raise ValueError("direction must be in, out or both")
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def connections(g: Graph, entity_id: str, relation: str | None = None) -> DataFrame:
    """(direction, neighbour, name, relations, support) of an entity: outgoing first, then by relation and name."""
    e = g.edges.where(F.col("relation_type") != MENTIONED_IN)
    e = e.where(F.col("relation_type") == relation) if relation else e
    kind = F.col("relation_type")
    out = e.where(F.col("source") == entity_id).select(F.lit(0).alias("d"), F.col("target").alias("neighbour"), label(kind).alias("r"), "support_count")
    into = e.where((F.col("target") == entity_id) & (F.col("source") != entity_id)).select(F.lit(1).alias("d"), F.col("source").alias("neighbour"), inverse_label(kind).alias("r"), "support_count")
    by = out.union(into).groupBy("d", "neighbour").agg(F.array_join(F.array_sort(F.collect_set("r")), "; ").alias("relations"), F.max("support_count").alias("support"))
    names = g.nodes.select(F.col("id").alias("neighbour"), "name")
    return by.join(names, "neighbour").orderBy("d", "relations", "name", "neighbour").select(F.when(F.col("d") == 0, "out").otherwise("in").alias("direction"), "neighbour", "name", "relations", "support")


def between(g: Graph, a: str, b: str) -> DataFrame:
    """The relation types from ``a`` to ``b``, or where there are none, from ``b`` to ``a``."""
    e = g.edges.where(F.col("relation_type") != MENTIONED_IN)
    out = e.where((F.col("source") == a) & (F.col("target") == b)).select(F.lit(0).alias("d"), "relation_type")
    into = e.where((F.col("source") == b) & (F.col("target") == a)).select(F.lit(1).alias("d"), "relation_type")
    first = F.min("d").over(Window.partitionBy(F.lit(1)))
    return out.union(into).distinct().withColumn("f", first).where("d = f").select(F.when(F.col("d") == 0, "out").otherwise("in").alias("direction"), "relation_type")


def top_neighbours(g: Graph, entity_id: str, n: int = 25) -> DataFrame:
    pairs = undirected(g).where(F.col("src") == entity_id).select(F.col("dst").alias("id")).distinct()
    return pairs.join(degrees(without_metadata(g).edges), "id").orderBy(F.desc("degree"), "id").limit(n)


def parallel_index(edges: DataFrame) -> DataFrame:
    """``edges`` with a running number among those of the same two ends, either way round."""
    w = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy("edge_key")
    return edges.withColumn("parallel", F.row_number().over(w) - 1)


def faceted(g: Graph, communities: DataFrame | None = None, entity_types: tuple[str, ...] = (), relation_types: tuple[str, ...] = (), labels: tuple[str, ...] = (), min_degree: int = 0, min_documents: int = 0, document: str | None = None) -> Graph:
    """A viewer's filters at once; a node stays where it passes all that are set."""
    n = g.nodes.where(F.col("entity_type").isin(*entity_types)) if entity_types else g.nodes
    n = n.where(F.size("source_documents") >= min_documents) if min_documents else n
    n = n.where(F.array_contains("source_documents", document)) if document else n
    if min_degree:
        n = n.join(degrees(g.edges).where(F.col("degree") >= min_degree), "id", "left_semi")
    if labels:
        n = n.join(communities.where(F.col("community").isin(*labels)).select(F.col("entity_id").alias("id")), "id", "left_semi")
    e = g.edges.where(F.col("relation_type").isin(*relation_types)) if relation_types else g.edges
    return within(g.with_(edges=e), n.select(*g.nodes.columns))


def highlighted(g: Graph, q: str) -> DataFrame:
    """(id, matched): nodes found by two or more letters, and their direct neighbours."""
    hits = (search(g, q) if len(q) >= 2 else g.nodes.limit(0)).select("id")
    pairs = g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    near = reached(pairs.union(pairs.select("dst", "src")), hits, 1)
    return near.join(hits.withColumn("m", F.lit(True)), "id", "left").select("id", F.coalesce("m", F.lit(False)).alias("matched"))
