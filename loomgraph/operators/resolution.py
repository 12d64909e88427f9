"""Entity resolution: candidate batches, proposals and how decisions change the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_key, person_sort_key
from ..functions.texts import aliases
from ..schemas import DOCUMENT, PROPOSALS, Graph
from .aggregate import in_order, merged_attributes
from .views import degrees

BATCH = 100
OVERLAP = 20


def sort_key(name: Column, entity_type: Column) -> Column:
    """Persons sort by surname, other entities by name."""
    return F.when(F.upper(entity_type) == "PERSON", person_sort_key(name)).otherwise(F.lower(name))


def candidate_batches(nodes: DataFrame, size: int = BATCH, overlap: int = OVERLAP) -> DataFrame:
    """(entity_type, batch, position, id, name): entities of each type in order of name, in batches that overlap; a batch of one is dropped.

    Positions are running numbers of a range-sorted table of each type: rows are counted by bucket of the order
    first, so no task holds a whole type.
    """
    step = size - overlap
    e = nodes.where(F.col("entity_type") != DOCUMENT).select("entity_type", "id", "name", sort_key(F.col("name"), F.col("entity_type")).alias("k"))
    rn = numbered_within(e, "entity_type", ["k", "id"])
    rn = rn.withColumn("last", F.expr(f"greatest(0, cast(ceil((n - {size}) / {step}) as bigint))"))
    low = F.expr(f"greatest(0, cast(ceil((rn - {size - 1}) / {step}) as bigint))")
    high = F.expr(f"least(last, cast(floor(rn / {step}) as bigint))")
    out = rn.where("n >= 2").select("entity_type", F.explode(F.sequence(low, high)).alias("batch"), "rn", "id", "name", "n")
    at = F.col("rn") - F.col("batch") * step
    return out.where(F.least(F.col("n") - F.col("batch") * step, F.lit(size)) >= 2).select("entity_type", "batch", at.alias("position"), "id", "name")


def numbered_within(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with the row number ``rn`` (from 0) in each group and the group's size ``n``, from a range sort and counts of its partitions."""
    s = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_p", F.spark_partition_id())
    local = s.withColumn("_l", F.row_number().over(Window.partitionBy("_p", group).orderBy(*order)))
    counts = s.groupBy(group, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group).orderBy("_p")
    base = counts.select(group, "_p", (F.sum("_c").over(w) - F.col("_c")).alias("_b"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    return local.join(base, [group, "_p"]).withColumn("rn", F.col("_l") - 1 + F.col("_b")).drop("_p", "_l", "_b")


def clustered(vectors: DataFrame, size: int = BATCH, seed: int = 42) -> DataFrame:
    """(id, cluster) of (id, features array): one for fewer than 10 rows, else k-means with a cluster for each ``size`` rows, two at least."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if n < 10:
        return vectors.select("id", F.lit(0).alias("cluster"))
    v = vectors.select("id", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, n // size), seed=seed, predictionCol="cluster").fit(v)
    return model.transform(v).select("id", "cluster")


def deduplicated_proposals(proposals: DataFrame) -> DataFrame:
    """``proposals`` with ``seq``: one for each canonical entity, members united at their highest confidence; name and reason of the surest, the first of equals."""
    avg = F.expr("aggregate(members, 0D, (a, m) -> a + m.confidence) / greatest(1, size(members))")
    p = proposals.withColumn("_avg", avg)
    head = p.groupBy("canonical_id").agg(F.max_by(F.struct("canonical_name", "entity_type", "status", "reason"), F.struct(F.col("_avg"), -F.col("seq"))).alias("h"), F.min("seq").alias("seq"))
    m = p.select("canonical_id", "seq", F.posexplode("members").alias("i", "m"))
    one = m.groupBy("canonical_id", "m.id").agg(F.min_by("m.name", F.struct("seq", "i")).alias("name"), F.max("m.confidence").alias("confidence"), F.min(F.struct("seq", "i")).alias("o"))
    members = one.groupBy("canonical_id").agg(in_order(F.col("o"), F.struct("id", "name", "confidence")).alias("members"))
    return head.join(members, "canonical_id").select("canonical_id", "h.canonical_name", "h.entity_type", "h.status", "members", "h.reason", "seq")


def cross_type_duplicates(g: Graph) -> DataFrame:
    """Proposals for one name under two or more types: the best linked entity is canonical, the others are members."""
    e = g.nodes.where(F.col("entity_type") != DOCUMENT).withColumn("_k", name_key(F.col("name")))
    e = e.join(degrees(g.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("_k")
    e = e.withColumns({"_types": F.size(F.collect_set("entity_type").over(w)), "_r": F.row_number().over(w.orderBy(F.desc("degree"), "id"))}).where("_types > 1")
    member = F.struct("id", "name", F.lit(0.95).alias("confidence"))
    return e.groupBy("_k").agg(
        F.min_by("id", "_r").alias("canonical_id"), F.min_by("name", "_r").alias("canonical_name"), F.min_by("entity_type", "_r").alias("entity_type"), F.lit("DRAFT").alias("status"),
        in_order(F.col("_r"), F.when(F.col("_r") > 1, member)).alias("members"), F.lit("one name under several types").alias("reason"),
    ).withColumn("members", F.filter("members", lambda m: m.isNotNull())).drop("_k").to(g.nodes.sparkSession.createDataFrame([], PROPOSALS).schema)


def merge_map(proposals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(member, canonical) of confirmed proposals of which both are nodes; of a member named twice, the last proposal's."""
    m = proposals.where(F.col("status") == "CONFIRMED").select("seq", F.col("canonical_id").alias("canonical"), F.posexplode("members").alias("i", "m"))
    m = m.groupBy(F.col("m.id").alias("member")).agg(F.max_by("canonical", F.struct("seq", "i")).alias("canonical"), F.max(F.struct("seq", "i")).alias("seq")).where("member <> canonical")
    ids = nodes.select("id")
    return m.join(ids.withColumnRenamed("id", "member"), "member", "left_semi").join(ids.withColumnRenamed("id", "canonical"), "canonical", "left_semi").select("member", "canonical", "seq")


def merged(g: Graph, merges: DataFrame) -> Graph:
    """The graph after ``merges(member, canonical, seq)``: members' data joins their canonical node, edges are re-pointed one level, loops that arise go.

    Edges keep their keys and aren't aggregated again; an edge to a canonical node that is itself merged away goes with it.
    """
    m = g.nodes.join(merges.withColumnRenamed("member", "id"), "id")
    got = m.groupBy(F.col("canonical").alias("id")).agg(
        F.flatten(in_order(F.col("seq"), F.col("source_documents"))).alias("_docs"), F.max("confidence").alias("_conf"),
        merged_attributes(F.reverse(in_order(F.col("seq"), F.col("attributes")))).alias("_attrs"),
        F.flatten(in_order(F.col("seq"), F.concat(F.array("name"), aliases(F.col("attributes"))))).alias("_names"),
    )
    kept = g.nodes.join(merges.select(F.col("member").alias("id")), "id", "left_anti").join(got, "id", "left")
    plain = F.create_map().cast("map<string,string>")
    attrs = merged_attributes(F.array(F.coalesce("_attrs", plain), F.coalesce("attributes", plain)))
    names = F.filter(F.array_distinct(F.concat(aliases(F.col("attributes")), F.coalesce("_names", F.array().cast("array<string>")))), lambda a: (a != "") & (a != F.col("name")))
    attrs = F.when(F.col("_conf").isNull(), F.col("attributes")).when(F.size(names) > 0, merged_attributes(F.array(attrs, F.create_map(F.lit("aliases"), F.to_json(names))))).otherwise(attrs)
    nodes = kept.withColumns({
        "source_documents": F.array_distinct(F.concat("source_documents", F.coalesce("_docs", F.array().cast("array<string>")))), "confidence": F.greatest("confidence", F.coalesce("_conf", "confidence")), "attributes": attrs,
    }).select(*g.nodes.columns)
    s, t = merges.select(F.col("member").alias("source"), F.col("canonical").alias("_s")), merges.select(F.col("member").alias("target"), F.col("canonical").alias("_t"))
    e = g.edges.join(s, "source", "left").join(t, "target", "left")
    touched = F.col("_s").isNotNull() | F.col("_t").isNotNull()
    e = e.withColumn("_m", touched).withColumns({"source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target")}).where(~(F.col("_m") & (F.col("source") == F.col("target"))))
    gone = merges.select("member")
    e = e.join(gone.withColumnRenamed("member", "source"), "source", "left_anti").join(gone.withColumnRenamed("member", "target"), "target", "left_anti")
    return g.with_(nodes, e.select(*g.edges.columns))


def rejected(g: Graph, reviews: DataFrame) -> Graph:
    """Edges of rejected reviews go, whichever way round they stand."""
    r = reviews.where(F.col("status") == "REJECTED").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation_type")
    both = r.union(r.select("target", "source", "relation_type")).distinct()
    return g.with_(edges=g.edges.join(both, ["source", "target", "relation_type"], "left_anti").select(*g.edges.columns))


def auto_merges(proposals: DataFrame, approve: float) -> DataFrame:
    """Drafts of which every member reaches ``approve`` are confirmed; 1.0 turns it off."""
    sure = F.array_min(F.transform("members", lambda m: m["confidence"])) >= approve
    return proposals.withColumn("status", F.when((F.col("status") == "DRAFT") & sure & F.lit(approve < 1.0), "CONFIRMED").otherwise(F.col("status")))


def auto_reviews(reviews: DataFrame, approve: float = 1.0, reject: float = 0.0) -> DataFrame:
    """Drafts at or over ``approve`` are confirmed (1.0: off), then those at or under ``reject`` are rejected (0.0: off)."""
    draft = F.col("status") == "DRAFT"
    status = F.when(draft & F.lit(approve < 1.0) & (F.col("confidence") >= approve), "CONFIRMED").when(draft & F.lit(reject > 0) & (F.col("confidence") <= reject), "REJECTED")
    return reviews.withColumn("status", F.coalesce(status, F.col("status")))


def new_reviews(existing: DataFrame, more: DataFrame) -> DataFrame:
    """``existing`` and what of ``more`` isn't in it by source, target and type."""
    return existing.unionByName(more.join(existing, ["source_id", "target_id", "relation_type"], "left_anti").select(*existing.columns))
