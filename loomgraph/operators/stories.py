"""What a report tells of a graph: ranked entities, dated events, chains of relations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import label
from ..functions.texts import DATE_ATTRIBUTES, YEAR, date_in
from ..schemas import MENTIONED_IN, Graph
from .clean import without_metadata
from .views import degrees

OVERVIEW_ENTITIES = 50
OVERVIEW_RELATIONS = 150
DESCRIBED = 250
DESCRIBED_DEGREE = 3
CHAINS = 6


def named_relations(g: Graph) -> DataFrame:
    """Edges of the clean graph with both ends' names, the first of each source, target and type."""
    e = without_metadata(g).edges
    w = Window.partitionBy("source", "target", "relation_type").orderBy("edge_key")
    e = e.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    s, t = (g.nodes.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name")) for x in ("source", "target"))
    return e.join(s, "source", "left").join(t, "target", "left").withColumns({"source_name": F.coalesce("source_name", "source"), "target_name": F.coalesce("target_name", "target")})


def ranked(g: Graph) -> DataFrame:
    """Entities by degree in the clean graph."""
    clean = without_metadata(g)
    return clean.nodes.join(degrees(clean.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id")


def overview(g: Graph) -> tuple[DataFrame, DataFrame]:
    top = ranked(g).limit(OVERVIEW_ENTITIES)
    ids = top.select("id")
    touching = named_relations(g)
    hit = touching.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select("edge_key").union(touching.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("edge_key")).distinct()
    return top, touching.join(hit, "edge_key", "left_semi").orderBy(F.desc("confidence"), "edge_key").limit(OVERVIEW_RELATIONS)


def to_describe(g: Graph) -> DataFrame:
    return ranked(g).where(F.col("degree") >= DESCRIBED_DEGREE).limit(DESCRIBED)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def timeline(g: Graph) -> DataFrame:
    """(date, name, event): dated entities, then relations whose evidence has a date, the first of each date and name, by date as text."""
    clean = without_metadata(g)
    attrs = F.col("attributes")
    direct = F.coalesce(*[F.nullif(F.try_element_at(attrs, F.lit(k)), F.lit("")) for k in DATE_ATTRIBUTES])
    scanned = F.try_element_at(F.filter(F.map_values(attrs), lambda v: F.coalesce(v.rlike(YEAR), F.lit(False))), F.lit(1))
    date = F.coalesce(direct, F.when(F.col("entity_type") == "EVENT", scanned))
    event = F.when(direct.isNotNull(), F.concat_ws(": ", "entity_type", "name")).otherwise(F.col("name"))
    own = clean.nodes.select(date.alias("date"), "name", event.alias("event"), F.lit(0).alias("_k"), F.col("id").alias("_o")).where("date is not null")
    r = named_relations(g)
    told = F.concat_ws(" ", "source_name", label(F.col("relation_type")), "target_name")
    said = r.select(date_in(F.col("evidence")).alias("date"), F.col("source_name").alias("name"), told.alias("event"), F.lit(1).alias("_k"), F.col("edge_key").alias("_o")).where("date is not null")
    return first_by(own.union(said), ["date", "name"], ["_k", "_o"]).select("date", "name", "event").orderBy("date", "name")


def chain_paths(g: Graph, top: int = 10, longest: int = 4) -> DataFrame:
    """(path, score): shortest paths of 2 to ``longest`` edges between the best linked entities, the first by letter of equals.

    Paths run over the whole graph, documents too. A path grows by one edge a round and only to nodes that no
    shorter path from its start has reached; of those that reach a node, one stays.
    """
    hubs = ranked(g).limit(top).select("id").checkpoint()
    e = g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    pairs = e.union(e.select("dst", "src")).where("src <> dst").distinct()
    seen = hubs.select(F.col("id").alias("start"), F.col("id").alias("at"))
    front = hubs.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path"))
    found = None
    for hop in range(1, longest + 1):
        step = front.join(pairs, F.col("at") == F.col("src")).select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        front = step.join(seen, ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min("path").alias("path")).checkpoint()
        seen = seen.union(front.select("start", "at"))
        if hop > 1:
            hit = front.join(hubs.select(F.col("id").alias("at")), "at", "left_semi").where("start < at").select("path")
            found = hit if found is None else found.union(hit)
    inner = found.select("path", F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("id")).join(degrees(g.edges), "id").groupBy("path").agg(F.sum("degree").alias("score"))
    return inner.orderBy(F.desc("score"), "path")


def chains(g: Graph, top: int = 10, most: int = CHAINS) -> list[list[str]]:
    """At most ``most`` paths, greedily, no two of which share over half of their nodes. The candidates are those between ``top`` entities, so few."""
    kept: list[list[str]] = []
    for row in chain_paths(g, top).toLocalIterator():
        path = set(row.path)
        if all(len(path & set(k)) <= 0.5 * min(len(path), len(k)) for k in kept):
            kept.append(row.path)
            if len(kept) == most:
                break
    return kept


def entity_contexts(extractions: DataFrame) -> DataFrame:
    """(name_key, quotes) over all extractions."""
    e = extractions.select("document_id", F.posexplode("entities").alias("i", "e")).where(F.col("e.context") != "")
    q = e.select(F.trim(F.lower("e.name")).alias("name_key"), "document_id", "i", F.posexplode(F.split("e.context", r" \|\|\| ")).alias("j", "quote"))
    return q.groupBy("name_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("document_id", "i", "j", "quote"))), lambda x: x["quote"]).alias("quotes"))


def described(g: Graph) -> DataFrame:
    """(id, description) by a template, where no language model writes them."""
    r = named_relations(g)
    lines = r.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct(-F.col("confidence"), F.concat_ws(" ", label(F.col("relation_type")), "target_name").alias("s")))).alias("l"))
    facts = F.array_join(F.transform(F.slice("l", 1, 5), lambda x: x["s"]), "; ")
    e = to_describe(g).join(lines, "id", "left")
    kind = F.lower(F.replace("entity_type", F.lit("_"), F.lit(" ")))
    return e.select("id", F.concat(F.col("name"), F.lit(" ("), kind, F.lit(")"), F.when(facts != "", F.concat(F.lit(": "), facts)).otherwise(F.lit("")), F.lit(".")).alias("description"))


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def report(g: Graph, communities: DataFrame | None = None, descriptions: DataFrame | None = None) -> str:
    """A Markdown report: overview, chains, timeline, entity profiles by community (else by type). Its parts are of bounded size."""
    top, rel = overview(g)
    names = {r.id: r.name for r in top.collect()}
    out = ["# Report", "", "## Overview", ""]
    out += [f"- {r.source_name} {' '.join(r.relation_type.lower().split('_'))} {r.target_name}" for r in rel.collect()]
    paths = chains(g)
    if paths:
        ids = sorted({v for p in paths for v in p})
        names |= {r.id: r.name for r in g.nodes.where(F.col("id").isin(ids)).select("id", "name").collect()}
        out += ["", "## Key Connections", ""] + ["- " + " → ".join(names.get(v, v) for v in p) for p in paths]
    events = timeline(g).collect()
    if events:
        out += ["", "## Timeline", ""] + [f"- **{r.date}** {r.event}" for r in events]
    d = (described(g) if descriptions is None else descriptions).join(g.nodes.select("id", "name", "entity_type"), "id")
    by = F.col("entity_type")
    if communities is not None:
        d = d.join(communities.withColumnRenamed("entity_id", "id"), "id", "left")
        by = F.coalesce("community", "entity_type")
    out += ["", "## Entity Profiles"]
    last = None
    for r in d.select(by.alias("g"), "name", "description").orderBy("g", "name").collect():
        if r.g != last:
            out += ["", f"### {r.g}"]
            last = r.g
        out += ["", f"**{r.name}** {r.description}"]
    n, m = g.nodes.count(), g.edges.where(F.col("relation_type") != MENTIONED_IN).count()
    return "\n".join([*out, "", f"_{n} entities, {m} relations._", ""])
