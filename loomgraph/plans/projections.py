"""The supplied relational tables viewed as a graph: entities, relation mentions with provenance, given communities."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import relation_id
from ..functions.texts import clamped
from ..operators.aggregate import canonical_relations
from ..schemas import Graph
from ..session import checkpoint_folder
from ..sources.tables import save_tables, tables

_STORED: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, parts, orders, nations and regions as ``NODES``."""

    def kind(name: str, entity: str, prefix: str, key: str, label: Column, confidence: Column, doc: Column, attributes: Column | None = None) -> DataFrame:
        attrs = F.create_map().cast("map<string,string>") if attributes is None else attributes
        return table(spark, sf_dir, name).select(
            _id(prefix, key).alias("id"), F.lit(entity).alias("entity_type"), label.alias("name"), clamped(confidence).alias("confidence"),
            F.array(doc).alias("source_documents"), attrs.alias("attributes"), F.lit("").alias("context"),
        )

    one = F.lit(1.0)
    parts = [
        kind("customer", "CUSTOMER", "customer", "c_custkey", F.col("c_name"), F.col("c_acctbal") / 10000, F.col("c_mktsegment")),
        kind("supplier", "SUPPLIER", "supplier", "s_suppkey", F.col("s_name"), F.col("s_acctbal") / 10000, F.lit("suppliers")),
        kind("part", "PART", "part", "p_partkey", F.col("p_name"), F.col("p_retailprice") / 2500, F.col("p_brand"), F.create_map(F.lit("aliases"), F.col("p_type"))),
        kind("orders", "ORDER", "order", "o_orderkey", _id("Order", "o_orderkey"), F.col("o_totalprice") / 500000, F.col("o_orderpriority")),
        kind("nation", "LOCATION", "nation", "n_nationkey", F.col("n_name"), one, F.lit("geography")),
        kind("region", "LOCATION", "region", "r_regionkey", F.col("r_name"), one, F.lit("geography")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def supply_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention ``supplier SUPPLIES part`` for each line item; the order is its document."""
    source, target, doc = _id("supplier", "l_suppkey"), _id("part", "l_partkey"), F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        source.alias("source"), F.lit("SUPPLIES").alias("relation_type"), target.alias("target"), (F.sqrt(F.col("l_discount") + 0.003) * 2.7).alias("confidence"), F.col("l_returnflag").alias("evidence"),
        doc.alias("source_document"), relation_id(source, F.lit("SUPPLIES"), target, doc).alias("relation_id"), F.struct("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey").alias("seq"),
    )


def _plain(df: DataFrame, source: Column, kind: str, target: Column, doc: Column, key: str, confidence: float = 0.9) -> DataFrame:
    nothing = F.lit(0).cast("long")
    return df.select(
        source.alias("source"), F.lit(kind).alias("relation_type"), target.alias("target"), F.lit(confidence).alias("confidence"), F.lit("").alias("evidence"), doc.alias("source_document"),
        relation_id(source, F.lit(kind), target, doc).alias("relation_id"), F.struct(F.col(key).cast("long").alias("l_orderkey"), nothing.alias("l_linenumber"), nothing.alias("l_partkey"), nothing.alias("l_suppkey")).alias("seq"),
    )


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return _plain(orders, _id("customer", "o_custkey"), "PLACED", _id("order", "o_orderkey"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), "o_orderkey")


def location_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOCATED_IN of customers and suppliers (nation), nations (region) and, redundantly, customers (region)."""
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    doc = F.lit("geography")
    by_region = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = _plain(customer, _id("customer", "c_custkey"), "LOCATED_IN", _id("nation", "c_nationkey"), doc, "c_custkey")
    for more in (
        _plain(supplier, _id("supplier", "s_suppkey"), "LOCATED_IN", _id("nation", "s_nationkey"), doc, "s_suppkey"),
        _plain(nation, _id("nation", "n_nationkey"), "LOCATED_IN", _id("region", "n_regionkey"), doc, "n_nationkey"),
        _plain(by_region, _id("customer", "c_custkey"), "LOCATED_IN", _id("region", "n_regionkey"), doc, "c_custkey"),
    ):
        out = out.unionByName(more)
    return out


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions; their ids follow from the rest, so they aren't carried through shuffles."""
    return supply_mentions(spark, sf_dir).unionByName(order_mentions(spark, sf_dir)).unionByName(location_mentions(spark, sf_dir)).drop("relation_id")


def saved(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the graph's tables: built once a session for each folder, as a user builds once and asks often."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{checkpoint_folder(spark).rstrip('/')}/loomgraph-graph-{uuid.uuid4().hex}"
        save_tables(Graph(nodes(spark, sf_dir), canonical_relations(mentions(spark, sf_dir))), path)
        _STORED[key] = path
    return _STORED[key]


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as stored tables."""
    return tables(spark, saved(spark, sf_dir))


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph with location edges alone."""
    return Graph(nodes(spark, sf_dir), canonical_relations(location_mentions(spark, sf_dir)))


def region_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, community): customers and suppliers by the region of their nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("community"))
    c = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(_id("customer", "c_custkey").alias("entity_id"), "community")
    s = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(_id("supplier", "s_suppkey").alias("entity_id"), "community")
    return c.union(s)
