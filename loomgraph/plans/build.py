"""Extractions to a graph: names united and resolved, mentions aggregated, edges cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import entity_id, name_key, relation_id
from ..functions.relations import active_form
from ..operators.aggregate import canonical_names, canonical_relations, merged_entities, near_names, parallel_relations, resolved_names
from ..operators.clean import activated, directed, normalized_types, pruned, transitively_reduced, without_loops
from ..schemas import DOCUMENT, EDGES, MENTIONED_IN, NODES, Graph, empty
from ..session import checkpoint_folder
from ..sources.domains import Domain

_SEQ = "struct<doc:string,phase:int,pos:int,part:int>"


def _seq(doc, phase: int, pos, part: int = 0):
    """Order of arrival: by file name, within a document itself, entities, their mentions, relations."""
    return F.struct(doc.alias("doc"), F.lit(phase).alias("phase"), pos.cast("int").alias("pos"), F.lit(part).alias("part")).cast(_SEQ)


def united_names(entities: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(entity_type, name, canonical) of variants: by normal form, then, of what is left of each, by near likeness."""
    exact = canonical_names(entities)
    if not fuzzy:
        return exact
    kept = entities.select("entity_type", "name").distinct().join(exact, ["entity_type", "name"], "left_anti")
    near = near_names(kept).select("entity_type", "name", F.col("kept").alias("canonical"))
    # what leads to a variant of its own leads on to that one's form
    step = near.select("entity_type", F.col("name").alias("canonical"), F.col("canonical").alias("_to"))
    both = exact.unionByName(near).join(step, ["entity_type", "canonical"], "left")
    return both.select("entity_type", "name", F.coalesce("_to", "canonical").alias("canonical"))


def build(extractions: DataFrame, domain: Domain | None = None, canonicalize: bool = True, mode: str = "product_complement", postprocess: bool = True, fuzzy: bool = True) -> Graph:
    """The graph of all extractions without an error.

    A relation's ends are names: they mean what was last registered under the name by then, whatever its type, so a
    name known only from a later document isn't resolved and the relation is left out.
    """
    spark = extractions.sparkSession
    checkpoint_folder(spark)  # stages are checkpointed: a plan of all of them at once would be too large to optimise
    ok = extractions.where("error is null or error = ''").withColumn("_doc", F.concat("document_id", F.lit(".json")))
    e = ok.select("document_id", "_doc", F.posexplode("entities").alias("pos", "e")).select("document_id", "_doc", "pos", "e.*").where("name is not null")
    e = e.join(united_names(e.select("entity_type", "name"), fuzzy), ["entity_type", "name"], "left").withColumn("shown", F.coalesce("canonical", "name")).withColumn("kind", F.col("entity_type"))
    closed = domain.closed() if domain else {}
    listed = [(*v, i) for i, v in enumerate((k, n, f) for k, (names, f) in closed.items() for n in names)]
    if listed:
        rows = spark.createDataFrame(listed, "t string, n string, f string, i int")
        vocabulary = rows.groupBy(name_key(F.col("n")).alias("_key")).agg(F.max_by(F.struct("t", "n"), "i").alias("_v"))
        fallback = spark.createDataFrame([(k, f) for k, (_, f) in closed.items()], "kind string, _fallback string")
        e = e.withColumn("_key", name_key(F.col("shown"))).join(F.broadcast(fallback.withColumn("_closed", F.lit(True))), "kind", "left").join(F.broadcast(vocabulary), "_key", "left")
        hit = F.col("_closed") & F.col("_v").isNotNull()
        e = e.withColumn("kind", F.when(hit, F.col("_v.t")).when(F.col("_closed"), F.coalesce("_fallback", "kind")).otherwise(F.col("kind"))).withColumn("shown", F.when(hit, F.col("_v.n")).otherwise(F.col("shown")))
    e = e.withColumn("id", entity_id(F.col("shown"), F.col("kind"))).withColumn("seq", _seq(F.col("_doc"), 1, F.col("pos"))).checkpoint()

    node = lambda df, seq: df.select("id", "entity_type", "name", "confidence", "source_documents", "attributes", "context", seq.alias("seq"))
    rows = node(e.select("id", F.col("kind").alias("entity_type"), F.col("shown").alias("name"), "confidence", F.array("document_id").alias("source_documents"), "attributes", "context", "seq"), F.col("seq"))
    docs = ok.select(F.concat(F.lit("doc:"), "document_id").alias("id"), F.lit(DOCUMENT).alias("entity_type"), F.col("document_id").alias("name"), F.lit(1.0).alias("confidence"), F.array("document_id").alias("source_documents"), F.create_map(F.lit("path"), F.coalesce("document_path", F.lit(""))).alias("attributes"), F.lit("").alias("context"), "_doc")
    rows = rows.unionByName(node(docs, _seq(F.col("_doc"), 0, F.lit(0))))
    registered = e.select(F.explode(F.array(F.struct(name_key(F.col("name")).alias("name_key"), F.lit(0).alias("part")), F.struct(name_key(F.col("shown")).alias("name_key"), F.lit(1).alias("part")))).alias("r"), "seq", "id")
    registered = registered.select("r.name_key", F.col("seq").withField("part", F.col("r.part")).alias("seq"), "id")
    if listed:
        made = rows.sparkSession.createDataFrame(listed, "kind string, shown string, f string, i int").withColumn("id", entity_id(F.col("shown"), F.col("kind")))
        first = _seq(F.lit(""), -1, F.col("i"))
        rows = rows.unionByName(node(made.select("id", F.col("kind").alias("entity_type"), F.col("shown").alias("name"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("source_documents"), F.create_map(F.lit("canonical"), F.lit("true")).alias("attributes"), F.lit("").alias("context"), "i"), first))
        registered = registered.unionByName(made.select(name_key(F.col("shown")).alias("name_key"), first.alias("seq"), "id"))
    nodes = merged_entities(rows).checkpoint()

    r = ok.select("document_id", "_doc", F.posexplode("relations").alias("pos", "r")).select("document_id", "pos", "r.*", _seq(F.col("_doc"), 3, F.col("pos")).alias("seq"))
    ends = r.select("document_id", "pos", "seq", F.explode(F.array(F.struct(F.lit("s").alias("end"), name_key(F.col("source_entity")).alias("name_key")), F.struct(F.lit("t").alias("end"), name_key(F.col("target_entity")).alias("name_key")))).alias("x"))
    got = resolved_names(registered, ends.select("x.name_key", "seq", "document_id", "pos", "x.end")).where("id is not null")
    got = got.groupBy("document_id", "pos").agg(F.max(F.when(F.col("end") == "s", F.col("id"))).alias("source"), F.max(F.when(F.col("end") == "t", F.col("id"))).alias("target")).where("source is not null and target is not null")
    r = r.join(got, ["document_id", "pos"])
    doc_node = F.concat(F.lit("doc:"), F.col("document_id"))
    kinds = ["source", "relation_type", "target", "confidence", "evidence", "source_document", "relation_id", "seq"]
    mentions = r.withColumn("source_document", F.col("document_id")).withColumn("relation_id", relation_id(F.col("source"), F.col("relation_type"), F.col("target"), F.col("document_id"))).select(*kinds)
    inn = e.select(F.col("id").alias("source"), F.lit(MENTIONED_IN).alias("relation_type"), doc_node.alias("target"), "confidence", F.lit("").alias("evidence"), F.col("document_id").alias("source_document"), F.concat_ws("|", "id", F.lit(MENTIONED_IN), doc_node).alias("relation_id"), F.col("seq").withField("phase", F.lit(2)).alias("seq"))
    mentions = mentions.unionByName(inn.select(*kinds))
    edges = canonical_relations(mentions, mode) if canonicalize else parallel_relations(mentions)
    g = Graph(nodes, edges.checkpoint())
    return postprocessed(g, domain) if postprocess else g


def postprocessed(g: Graph, domain: Domain | None = None) -> Graph:
    """Passive types, loops and redundant edges, lone entities, unknown types, wrong directions; the order matters."""
    valid = list(domain.relation_types) if domain else []
    if valid:
        made = g.edges.select("relation_type").distinct().select(active_form(F.col("relation_type")).alias("t")).where("t is not null").distinct()
        valid += [row.t for row in made.collect()]  # types are a vocabulary: few
    checkpoint_folder(g.nodes.sparkSession)
    g = pruned(g.with_(edges=transitively_reduced(without_loops(activated(g.edges))).checkpoint()))
    g = Graph(g.nodes.checkpoint(), g.edges.checkpoint())
    if valid:
        g = g.with_(edges=normalized_types(g.edges, valid))
        g = directed(g, domain.rules())
    return g


def nothing(spark) -> Graph:
    return Graph(empty(spark, NODES), empty(spark, EDGES))
