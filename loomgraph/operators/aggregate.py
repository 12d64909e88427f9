"""Mentions to entities and relations: grouping with an explicit arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import canonical_key, dedup_key, name_key, relation_id
from ..functions.texts import clamped
from ..schemas import MENTION
from ..session import spread

MODES = ("product_complement", "mean", "max")


def combined(confidence: Column, mode: str = "product_complement") -> Column:
    """One confidence from those of all mentions; an unknown mode is a ValueError."""
    if mode == "product_complement":
        return 1 - F.product(1 - confidence)
    if mode == "mean":
        return F.avg(confidence)
    if mode == "max":
        return F.max(confidence)
    raise ValueError(f"confidence aggregation must be one of {', '.join(MODES)}, not {mode}")


def in_order(seq: Column, value: Column) -> Column:
    """Values by arrival; ``collect_list`` alone has no order after a shuffle. Values needn't be comparable."""
    pairs = F.collect_list(F.struct(seq.alias("seq"), value.alias("v")))
    return F.transform(F.array_sort(pairs, lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)), lambda x: x["v"])


def canonical_relations(mentions: DataFrame, mode: str = "product_complement") -> DataFrame:
    """Edges from mentions (source, relation_type, target, confidence, evidence, source_document, relation_id, seq).

    One edge for each source, type and target. The mention of the highest confidence gives evidence and document, the last
    of equals; blank documents don't count as support. Without a column ``relation_id`` it follows from ends, type and document.
    """
    keys = ["source", "relation_type", "target"]
    given = ["relation_id"] if "relation_id" in mentions.columns else []
    # few mentions share an edge: lists begun before the shuffle would only be sorted and spilled, so plain rows go, each once
    m = spread(mentions.select(*keys, F.struct("seq", clamped(F.col("confidence")).alias("confidence"), "evidence", "source_document", *given).alias("m")), "source", "target")
    grouped = m.groupBy(*keys).agg(combined(F.col("m.confidence"), mode).alias("confidence"), F.sort_array(F.collect_list("m")).alias("m"))
    rid = lambda x: x["relation_id"] if given else relation_id(F.col("source"), F.col("relation_type"), F.col("target"), x["source_document"])
    grouped = grouped.withColumns({
        "support_documents": F.array_distinct(F.transform(F.filter("m", lambda x: F.trim(x["source_document"]) != ""), lambda x: x["source_document"])),
        "best": F.array_max(F.transform("m", lambda x: F.struct(x["confidence"].alias("confidence"), x["seq"].alias("seq"), x["evidence"].alias("evidence"), x["source_document"].alias("source_document")))),
        "mentions": F.transform("m", lambda x: F.struct(x["source_document"].alias("source_document"), x["confidence"].alias("confidence"), x["evidence"].alias("evidence"), rid(x).alias("relation_id"))).cast(f"array<{MENTION}>"),
        "relation_id": rid(F.element_at("m", 1)),
    })
    key = canonical_key(F.col("source"), F.col("relation_type"), F.col("target"))
    return grouped.select(
        key.alias("edge_key"), "source", "target", "relation_type", "relation_id", key.alias("canonical_key"), "confidence", F.col("best.evidence").alias("evidence"),
        F.col("best.source_document").alias("source_document"), F.size("m").cast("int").alias("support_count"), "support_documents", F.size("support_documents").alias("support_doc_count"), "mentions",
    )


def parallel_relations(mentions: DataFrame) -> DataFrame:
    """An edge for each relation id, without support (canonicalisation off); the last mention of an id stands."""
    last = Window.partitionBy("relation_id").orderBy(F.desc("seq"))
    m = mentions.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return m.select(
        F.col("relation_id").alias("edge_key"), "source", "target", "relation_type", "relation_id", nothing("string", "canonical_key"), clamped(F.col("confidence")).alias("confidence"), "evidence",
        "source_document", nothing("int", "support_count"), nothing("array<string>", "support_documents"), nothing("int", "support_doc_count"), nothing(f"array<{MENTION}>", "mentions"),
    )


def refilled_support(edges: DataFrame) -> DataFrame:
    """Support rebuilt from the mentions, as after loading a file: product complement, and the first of equally good mentions.

    An edge without mentions is its own single mention.
    """
    own = F.array(F.struct("source_document", clamped(F.col("confidence")).alias("confidence"), "evidence", "relation_id").cast(MENTION))
    e = edges.withColumn("mentions", F.when(F.coalesce(F.size("mentions"), F.lit(0)) > 0, F.col("mentions")).otherwise(own))
    docs = F.array_distinct(F.filter(F.transform("mentions", lambda m: m["source_document"]), lambda d: d.isNotNull() & (F.trim(d) != "")))
    left = F.aggregate("mentions", F.lit(1.0), lambda acc, m: acc * (1 - clamped(m["confidence"])))
    best = F.aggregate("mentions", F.element_at("mentions", 1), lambda acc, m: F.when(clamped(m["confidence"]) > clamped(acc["confidence"]), m).otherwise(acc))
    e = e.withColumns({"support_documents": docs, "confidence": 1 - left, "_best": best, "support_count": F.size("mentions")})
    return e.withColumns({"support_doc_count": F.size("support_documents"), "evidence": F.col("_best.evidence"), "source_document": F.col("_best.source_document")}).drop("_best")


def merged_attributes(maps: Column) -> Column:
    """A list of maps as one; a later map's value replaces an earlier one's, unless it is null."""
    nothing = F.create_map().cast("map<string,string>")
    return F.aggregate(maps, nothing, lambda acc, m: F.map_zip_with(acc, F.coalesce(m, nothing), lambda k, a, b: F.coalesce(b, a)))


def merged_entities(rows: DataFrame) -> DataFrame:
    """Nodes from (id, entity_type, name, confidence, source_documents, attributes, context, seq).

    Type and name of the first arrival, highest confidence, documents in order of arrival, attributes last
    wins, the first context that isn't empty.
    """
    seq = F.col("seq")
    return rows.groupBy("id").agg(
        F.min_by("entity_type", "seq").alias("entity_type"), F.min_by("name", "seq").alias("name"), F.max("confidence").alias("confidence"),
        F.array_distinct(F.flatten(in_order(seq, F.col("source_documents")))).alias("source_documents"), merged_attributes(in_order(seq, F.col("attributes"))).alias("attributes"),
        F.coalesce(F.min_by("context", F.when(F.col("context") != "", seq)), F.lit("")).alias("context"),
    )


def deduplicated_mentions(mentions: DataFrame) -> DataFrame:
    """Entity mentions (document_id, seq, name, entity_type, attributes, confidence, context), one per document, type and name.

    The most confident stays, the first of equals, at the place of the first seen. Where two or more
    different contexts aren't blank, all of them, sorted, replace its own.
    """
    key = F.concat_ws(":", F.col("entity_type"), name_key(F.col("name")))
    order = F.struct(F.col("confidence"), -F.col("seq"))
    grouped = mentions.groupBy("document_id", key.alias("_key")).agg(
        F.max_by(F.struct("name", "entity_type", "attributes", "confidence", "context"), order).alias("w"), F.min("seq").alias("seq"),
        F.array_sort(F.collect_set(F.when(F.trim("context") != "", F.trim("context")))).alias("c"),
    )
    context = F.when(F.size("c") > 1, F.array_join("c", " ||| ")).otherwise(F.col("w.context"))
    return grouped.select("document_id", "seq", "w.name", "w.entity_type", "w.attributes", "w.confidence", context.alias("context"))


def canonical_names(names: DataFrame, key: Column | None = None) -> DataFrame:
    """(entity_type, name, canonical) of the names that are a variant of another: the most frequent, then longest, then first by letter.

    ``names`` has a row (entity_type, name) for each mention. Types of one mention are left alone.
    """
    norm = dedup_key(F.col("name")) if key is None else key
    counts = names.groupBy("entity_type", "name").agg(F.count("*").alias("n")).withColumn("norm", norm)
    best = counts.groupBy("entity_type", "norm").agg(F.min_by("name", F.struct(-F.col("n"), -F.length("name"), F.col("name"))).alias("canonical"))
    return counts.join(best, ["entity_type", "norm"]).where("name <> canonical").select("entity_type", "name", "canonical")


def near_names(names: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(entity_type, name, kept) of distinct names alike but for few edits, the earlier by letter kept.

    Alike: 1 - levenshtein / longer length reaches ``threshold`` (own measure in place of an embedding). Names are
    compared where they share type and one of the blocks into which the allowed edits can't reach all.
    """
    # the edits allowed follow the longer name; the longest that can be alike has length / threshold characters
    edits = "cast(floor((1 - {0}) * floor(length(norm) / {0})) as int)".format(threshold)
    n = names.select("entity_type", "name").distinct().withColumn("norm", dedup_key(F.col("name"))).where("norm <> ''")
    n = n.withColumn("k", F.expr(edits) + 1)
    piece = F.expr("transform(sequence(0, k - 1), i -> substring(norm, cast(i * length(norm) / k as int) + 1, cast((i + 1) * length(norm) / k as int) - cast(i * length(norm) / k as int)))")
    blocks = n.select("entity_type", "name", "norm", F.explode(piece).alias("block"))
    other = n.select("entity_type", F.col("name").alias("kept"), F.col("norm").alias("kept_norm"))
    # a block of one name is sought in the other as a substring, by its grams of the block's length
    grams = F.expr("transform(sequence(1, greatest(1, length(kept_norm) - size_ + 1)), i -> substring(kept_norm, i, size_))")
    sizes = blocks.select("entity_type", F.length("block").alias("size_")).distinct()
    spread = other.join(F.broadcast(sizes), "entity_type").select("entity_type", "kept", "kept_norm", F.explode(F.array_distinct(grams)).alias("block"))
    met = blocks.join(spread, ["entity_type", "block"]).where("norm > kept_norm").select("entity_type", "name", "norm", "kept", "kept_norm").distinct()
    longer = F.greatest(F.length("norm"), F.length("kept_norm"))
    close = met.where(1 - F.levenshtein("norm", "kept_norm") / longer >= threshold)
    return close.groupBy("entity_type", "name").agg(F.min("kept").alias("kept"))


def resolved_names(registrations: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (name_key, seq, …) with the id last registered under the name by then.

    ``registrations`` are (name_key, seq, id). Types don't count; a name registered only later resolves to null.
    Rows of one name meet in one task; a name as frequent as to fill one is a hot spot to be aware of.
    """
    extra = [c for c in probes.columns if c not in ("name_key", "seq")]
    r = registrations.select("name_key", "seq", "id", *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra], F.lit(False).alias("_probe"))
    p = probes.select("name_key", "seq", F.lit(None).cast("string").alias("id"), *extra, F.lit(True).alias("_probe"))
    w = Window.partitionBy("name_key").orderBy("seq", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(p).withColumn("id", F.last("id", ignorenulls=True).over(w)).where("_probe").drop("_probe")


def relation_mentions(source: str, kind: str, target: str, document: str) -> Column:
    return relation_id(F.col(source), F.col(kind), F.col(target), F.col(document))
