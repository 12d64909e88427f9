"""Graph operators on graphs small enough to check by hand."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import aggregate, clean, communities, flat, resolution, stories, views
from loomgraph.plans.build import build
from loomgraph.schemas import EXTRACTIONS, NODES, PROPOSALS, REVIEWS, Graph
from loomgraph.sinks import exports
from loomgraph.sources import tables
from loomgraph.sources.domains import Domain, EntityType, RelationType

COLUMNS = "source string, relation_type string, target string, confidence double, evidence string, source_document string, relation_id string, seq int"


def mentions(spark, rows):
    return spark.createDataFrame([(*r, f"r{i}", i) for i, r in enumerate(rows)], COLUMNS)


def graph(spark, nodes, edges):
    """nodes: id -> (type, confidence, documents); edges: (source, type, target[, confidence, document])."""
    n = spark.createDataFrame([(i, k, i.title(), c, d, {}, "") for i, (k, c, d) in nodes.items()], NODES)
    return Graph(n, aggregate.canonical_relations(mentions(spark, [(e[0], e[1], e[2], e[3] if len(e) > 3 else 0.8, "", e[4] if len(e) > 4 else "doc1") for e in edges])))


def people(spark, edges, names="abcdef"):
    return graph(spark, {x: ("PERSON", 0.8, ["doc1"]) for x in names}, edges)


def kinds(edges):
    return sorted((r.source, r.relation_type, r.target) for r in edges.collect())


def test_support_and_confidence(spark):
    m = mentions(spark, [("a", "T", "b", 0.7, "x", "doc1"), ("a", "T", "b", 0.6, "y", "doc2"), ("a", "U", "b", 0.5, "p", "doc1"), ("a", "U", "b", 0.5, "q", " ")])
    got = {r.relation_type: r for r in aggregate.canonical_relations(m).collect()}
    assert round(got["T"].confidence, 6) == 0.88 and got["T"].support_count == 2 and got["T"].support_documents == ["doc1", "doc2"] and got["T"].evidence == "x"
    assert got["U"].support_doc_count == 1 and got["U"].evidence == "q"  # the last of equals
    again = {r.relation_type: r for r in aggregate.refilled_support(aggregate.canonical_relations(m, "mean")).collect()}
    assert again["U"].evidence == "p" and round(again["T"].confidence, 6) == 0.88  # the first of equals
    with pytest.raises(ValueError):
        aggregate.canonical_relations(m, "median")
    assert aggregate.parallel_relations(m).count() == 4


def test_cleaning(spark):
    e = people(spark, [("a", "LOCATED_IN", "b"), ("b", "LOCATED_IN", "c"), ("a", "LOCATED_IN", "c"), ("a", "EMPLOYED_BY", "b"), ("d", "X", "d")]).edges
    assert clean.transitively_reduced(e).count() == 4
    assert ("b", "EMPLOYS", "a") in kinds(clean.activated(e)) and clean.without_loops(e).count() == 4
    g = graph(spark, {"a": ("COMPANY", 1.0, []), "b": ("PERSON", 1.0, []), "lone": ("PERSON", 1.0, []), "doc:1": ("DOCUMENT", 1.0, [])}, [("a", "WORKS_FOR", "b"), ("lone", "MENTIONED_IN", "doc:1")])
    assert kinds(clean.directed(g, {"WORKS_FOR": (["PERSON"], ["COMPANY"], False)}).edges)[1] == ("b", "WORKS_FOR", "a") or ("b", "WORKS_FOR", "a") in kinds(clean.directed(g, {"WORKS_FOR": (["PERSON"], ["COMPANY"], False)}).edges)
    p = clean.pruned(g)
    assert sorted(r.id for r in p.nodes.collect()) == ["a", "b", "doc:1"] and p.edges.count() == 1
    assert clean.without_metadata(g).nodes.count() == 3
    assert sorted(r.id for r in communities.isolated(g).collect()) == ["lone"]
    flags = clean.review_flags(g, 0.9, ("WORKS_FOR",)).collect()
    assert len(flags) == 1 and "0.80" in flags[0].flag_reason and ";" in flags[0].flag_reason


def view_graph(spark):
    nodes = {"alice": ("PERSON", 0.9, ["doc1"]), "bob": ("PERSON", 0.8, ["doc1", "doc2"]), "carol": ("PERSON", 0.3, ["doc2"]), "dave": ("PERSON", 0.7, ["doc3"]), "acme": ("ORGANIZATION", 0.9, ["doc1"])}
    return graph(spark, nodes, [("alice", "KNOWS", "bob", 0.9), ("bob", "KNOWS", "carol", 0.8, "doc2"), ("carol", "KNOWS", "dave", 0.7, "doc3"), ("alice", "WORKS_FOR", "acme", 0.4)])


def test_views(spark):
    g = view_graph(spark)
    ids = lambda x: sorted(r.id for r in x.nodes.collect())
    assert ids(views.view(g, who="Alice", depth=2)) == ["acme", "alice", "bob", "carol"]
    assert ids(views.view(g, document="doc1")) == ["acme", "alice", "bob"] and views.view(g, document="doc1").edges.count() == 2
    c = views.view(g, least=0.7)
    assert ids(c) == ["acme", "alice", "bob", "dave"] and kinds(c.edges) == [("alice", "KNOWS", "bob")]
    assert ids(views.view(g, top=1)) == ["acme", "alice", "bob"]
    with pytest.raises(views.NotFound):
        views.ego(g, "nobody")
    assert views.subgraph(g, "zzz").nodes.count() == 0
    found = views.candidates(g, "a").orderBy("rank").collect()
    assert found[0].id == "alice" and found[0].degree == 2
    assert [r.neighbour for r in views.connections(g, "bob").collect()] == ["carol", "alice"]
    assert views.between(g, "bob", "alice").first().direction == "in"
    assert sorted(r.id for r in views.highlighted(g, "carol").collect()) == ["bob", "carol", "dave"]
    assert ids(views.faceted(g, min_degree=2)) == ["alice", "bob", "carol"]


def cliques(spark, n=10):
    ids = [f"{k}{i}" for k in "ab" for i in range(1, n + 1)]
    edges = [(x, "KNOWS", y) for x in ids for y in ids if x < y and x[0] == y[0]] + [("a1", "KNOWS", "b1")] + [(f"a{i}", "MENTIONED_IN", "doc:d") for i in range(1, n + 1)]
    return graph(spark, {i: ("PERSON", 0.9, ["d"]) for i in ids} | {"doc:d": ("DOCUMENT", 1.0, ["d"])}, edges)


def test_communities_of_two_cliques(spark):
    g = cliques(spark)
    c = communities.detected(g, 3).cache()
    groups = {r.community: set(r.members) for r in communities.grouped(c).collect()}
    assert sorted(map(len, groups.values())) == [10, 10] and all(len({m[0] for m in v}) == 1 for v in groups.values())
    assert {r.id: r.cross_edges for r in communities.bridges(g, c).collect()} == {"a1": 1, "b1": 1}
    (x,) = communities.community_connections(g, c).collect()
    assert (x.edges, x.entities) == (1, 2)
    t = communities.topology(g, c, "a1").first()
    assert t.is_bridge and len(t.others) == 1 and communities.topology(g, c, "a2").first().is_bridge is False
    assert all(r.internal_edges == 45 and r["size"] == 10 for r in communities.community_summary(g, c).collect())
    assert communities.detected(people(spark, [("a", "K", "b")], "ab")) is None


def test_batches_equal_a_loop(spark):
    for n in (1, 2, 99, 100, 101, 180, 181, 333):
        nodes = spark.createDataFrame([(f"p{i:04d}", "PLACE", f"Name {i:04d}", 1.0, [], {}, "") for i in range(n)], NODES)
        got = sorted((r.batch, r.position, r.id) for r in resolution.candidate_batches(nodes).collect())
        want, at, k = [], 0, 0
        while True:
            part = range(at, min(at + 100, n))
            if len(part) >= 2:
                want += [(k, i - at, f"p{i:04d}") for i in part]
            if at + 100 >= n:
                break
            at, k = at + 80, k + 1
        assert got == want


def test_merges_and_rejections(spark):
    g = people(spark, [("a", "KNOWS", "b"), ("b", "LIKES", "c"), ("c", "KNOWS", "d")], "abcd")
    p = spark.createDataFrame([("a", "A", "PERSON", "CONFIRMED", [("b", "B", 0.9), ("zzz", "Z", 0.9)], "", 0), ("c", "C", "PERSON", "DRAFT", [("d", "D", 0.95)], "", 1)], PROPOSALS + ", seq int")
    m = resolution.merge_map(p, g.nodes)
    out = resolution.merged(g, m)
    assert kinds(out.edges) == [("a", "LIKES", "c"), ("c", "KNOWS", "d")] and sorted(r.id for r in out.nodes.collect()) == ["a", "c", "d"]
    a = out.nodes.where("id = 'a'").first()
    assert json.loads(a.attributes["aliases"]) == ["B"]
    assert [r.status for r in resolution.auto_merges(p, 0.95).orderBy("seq").collect()] == ["CONFIRMED", "CONFIRMED"]
    r = spark.createDataFrame([("d", "D", "c", "C", "KNOWS", 0.2, "", "", "REJECTED", ""), ("a", "", "b", "", "KNOWS", 0.9, "", "", "DRAFT", "")], REVIEWS)
    assert kinds(resolution.rejected(g, r).edges) == [("a", "KNOWS", "b"), ("b", "LIKES", "c")]
    assert [x.status for x in resolution.auto_reviews(r, 0.85, 0.5).orderBy("source_id").collect()] == ["CONFIRMED", "REJECTED"]
    assert resolution.new_reviews(r, r).count() == 2
    two = spark.createDataFrame([("a", "A1", "P", "DRAFT", [("b", "B", 0.5), ("c", "C", 0.9)], "one", 0), ("a", "A2", "P", "DRAFT", [("b", "B", 0.8)], "two", 1)], PROPOSALS + ", seq int")
    (d,) = resolution.deduplicated_proposals(two).collect()
    assert [(x.id, x.confidence) for x in d.members] == [("b", 0.8), ("c", 0.9)] and d.reason == "two"


def extraction(doc, entities, relations, error=None):
    return (doc, f"/{doc}.txt", 1, [(n, k, a, c, x) for n, k, a, c, x in entities], relations, 0.0, "m", error, "general", 10000, "")


def test_build_resolves_names_as_of_then(spark):
    e = [
        extraction("d1", [("Alice Smith", "PERSON", {"role": "x"}, 0.9, "c1"), ("Acme Corp", "ORGANIZATION", {}, 0.8, "")], [("WORKS_FOR", "Alice Smith", "Acme Corp", 0.8, "ev"), ("KNOWS", "alice smith", "Late Comer", 0.8, "")]),
        extraction("d2", [("Alice Smiths", "PERSON", {"age": "3"}, 0.7, "c2"), ("Late Comer", "PERSON", {}, 0.7, ""), ("Acme Corp", "ORGANIZATION", {}, 0.9, "")], [("WORKS_FOR", "Alice Smith", "Acme Corp", 0.8, ""), ("OWNED_BY", "Acme Corp", "Late Comer", 0.6, "")]),
        extraction("d3", [("Ghost", "PERSON", {}, 0.7, "")], [], "failed"),
    ]
    g = build(spark.createDataFrame(e, EXTRACTIONS))
    edges = {(r.source, r.relation_type, r.target): r for r in g.edges.where("relation_type <> 'MENTIONED_IN'").collect()}
    assert set(edges) == {("person:alice_smiths", "WORKS_FOR", "organization:acme_corp"), ("person:late_comer", "OWNS", "organization:acme_corp")}
    assert round(edges["person:alice_smiths", "WORKS_FOR", "organization:acme_corp"].confidence, 6) == 0.96
    assert edges["person:late_comer", "OWNS", "organization:acme_corp"].edge_key.startswith("organization:acme_corp|OWNED_BY")
    n = {r.id: r for r in g.nodes.collect()}
    assert set(n) == {"person:alice_smiths", "person:late_comer", "organization:acme_corp", "doc:d1", "doc:d2"}
    assert n["person:alice_smiths"].attributes == {"role": "x", "age": "3"} and n["person:alice_smiths"].source_documents == ["d1", "d2"]
    d = Domain("x", entity_types={"PERSON": EntityType(canonical_names=["Late Comer"], canonical_fallback_type="OTHER")}, relation_types={"WORKS_FOR": RelationType(source_types=["ORGANIZATION"], target_types=["OTHER"])})
    closed = build(spark.createDataFrame(e, EXTRACTIONS), d)
    assert ("organization:acme_corp", "WORKS_FOR", "other:alice_smiths") in kinds(closed.edges)


def test_exports(spark, tmp_path):
    g = view_graph(spark)
    exports.export(g, "sqlite", str(tmp_path / "g.sqlite"))
    db = sqlite3.connect(tmp_path / "g.sqlite")
    assert db.execute("select count(*) from edges where support_count = 1").fetchone() == (4,) and db.execute("select count(*) from nodes").fetchone() == (5,)
    exports.export(g, "csv", str(tmp_path / "csv"))
    assert (tmp_path / "csv/relations.csv").read_text().count("\n") == 5
    back = tables.graph(spark, exports.export(g, "json", str(tmp_path / "g.json")))
    assert kinds(back.edges) == kinds(g.edges) and back.nodes.count() == 5 and back.edges.columns == g.edges.columns
    from xml.etree import ElementTree

    for fmt in ("graphml", "gexf"):
        root = ElementTree.parse(exports.export(g, fmt, str(tmp_path / f"g.{fmt}"))).getroot()
        assert sum(x.tag.endswith("}edge") for x in root.iter()) == 4
    assert "Alice" in open(exports.to_html(g, str(tmp_path / "g.html"))).read()
    with pytest.raises(ValueError):
        exports.export(g, "dot", str(tmp_path / "x"))


def test_stories(spark):
    g = graph(spark, {x: ("PERSON", 0.9, ["d"]) for x in "abcde"}, [("a", "K", "b"), ("b", "K", "c"), ("c", "K", "d"), ("d", "K", "e")])
    paths = {tuple(r.path) for r in stories.chain_paths(g).collect()}
    assert ("a", "b", "c") in paths and ("a", "b", "c", "d", "e") in paths and all(3 <= len(p) <= 5 for p in paths)
    dated = g.with_(edges=g.edges.withColumn("evidence", F.when(F.col("source") == "a", "met on 2020-01-02").otherwise("")), nodes=g.nodes.withColumn("attributes", F.when(F.col("id") == "e", F.create_map(F.lit("date"), F.lit("1999")))
        .otherwise(F.create_map().cast("map<string,string>"))))
    assert [(r.date, r.name) for r in stories.timeline(dated).collect()] == [("1999", "E"), ("2020-01-02", "A")]
    assert "## Overview" in stories.report(dated)


def test_near_names_where_the_longer_allows_more_edits(spark):
    names = spark.createDataFrame([("T", "acdefghijabcdefghij"), ("T", "abcdefghijabcdefghij")], "entity_type string, name string")
    assert [tuple(x) for x in aggregate.near_names(names).collect()] == [("T", "acdefghijabcdefghij", "abcdefghijabcdefghij")]


def test_rules_keep_the_whole_sentence():
    import json

    from loomgraph.sources.providers import Rules

    sentence = "There " + "and so on " * 40 + "Anna Smith met Robert Jones on 2024-05-06."
    found = json.loads(Rules().answer("x\nTEXT:\n" + sentence))
    assert found["relations"][0]["evidence"] == sentence and found["entities"][0]["context"] == sentence


def _modularity(pairs, label):
    total = len(pairs)
    degree, inside = {}, 0
    for a, b in pairs:
        degree[label[a]] = degree.get(label[a], 0) + 1
        inside += label[a] == label[b]
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def test_communities_of_cliques_stars_and_rings(spark):
    import random

    r = random.Random(3)
    edges = [(f"a{i}", f"a{j}") for i in range(8) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(9) for j in range(i)] + [("a0", "b0")]
    edges += [("hub", f"leaf{i:03d}") for i in range(300)] + [("leaf000", "b1")]
    groups = [[f"g{k}_{i}" for i in range(12)] for k in range(6)]
    edges += [tuple(r.sample(g, 2)) for g in groups for _ in range(40)] + [(groups[k][0], groups[k - 1][1]) for k in range(6)]
    pairs = [p for a, b in set(edges) for p in ((a, b), (b, a))]
    df = spark.createDataFrame(pairs, "src string, dst string")
    label = {x.id: x.raw for x in communities.raw_communities(df).collect()}
    assert {label[f"a{i}"] for i in range(8)} == {"a0"} and {label[f"b{i}"] for i in range(9)} == {"b0"}
    assert len({label[f"leaf{i:03d}"] for i in range(1, 300)}) == 1
    truth = {v: v[:2] if v[0] == "g" else v[0] for p in pairs for v in p}
    assert _modularity(pairs, label) > 0.9 * _modularity(pairs, truth)
    again = {x.id: x.raw for x in communities.raw_communities(df.repartition(3)).collect()}
    assert again == label


def test_mentions_are_shuffled_once_as_plain_rows(spark):
    rows = [("a", "KNOWS", "b", 0.5, "x", "d1"), ("a", "KNOWS", "b", 0.9, "y", " "), ("a", "KNOWS", "b", 0.9, "z", "d2"), ("b", "KNOWS", "a", 0.1, "w", "d1")]
    m = mentions(spark, rows)
    m = m.withColumn("relation_id", F.concat_ws("|", "source", "relation_type", "target", "source_document"))
    given, derived = (aggregate.canonical_relations(x) for x in (m, m.drop("relation_id")))
    assert sorted(map(repr, derived.collect())) == sorted(map(repr, given.collect()))
    e = {r.source: r for r in derived.collect()}["a"]
    assert (e.evidence, e.support_documents, e.support_count, e.relation_id) == ("z", ["d1", "d2"], 3, "a|KNOWS|b|d1")
    for df in (given, flat.flat_edges(spark.createDataFrame(given.collect(), given.schema))):
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
        shuffled = plan[plan.index("Exchange hashpartitioning") :]  # what is above the first shuffle is done after it
        assert "collect_" not in shuffled and plan.count("Exchange hashpartitioning") == 1


def test_crossing_edges_are_shuffled_by_their_ends_alone(spark):
    g = people(spark, [("a", "KNOWS", "b"), ("b", "KNOWS", "c"), ("c", "KNOWS", "d"), ("a", "MENTIONED_IN", "d"), ("a", "KNOWS", "d"), ("z", "KNOWS", "a")])
    c = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("z", "y")], "entity_id string, community string")
    assert {(r.id, r.community, *r.others, r.cross_edges) for r in communities.bridges(g, c).collect()} == {("b", "x", "y", 1), ("c", "y", "x", 1), ("a", "x", "y", 1), ("d", "y", "x", 1)}
    assert [tuple(r) for r in communities.community_connections(g, c).collect()] == [("x", "y", 2, 4)]
    assert communities._crossing(g, c).columns == ["src", "dst", "cu", "cv"]  # edge keys stay behind
