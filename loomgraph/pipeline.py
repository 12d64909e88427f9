"""The engine as a library: extract, build, resolve, apply, narrate, export, view, over one output folder."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import communities as com
from .operators import resolution, stories, views
from .operators.clean import review_flags
from .plans.build import build
from .plans.extract import extracted
from .schemas import Graph, empty
from .sinks import exports
from .sources import ingest, tables
from .sources.domains import Domain, bundled, found_domain, save
from .sources.providers import Provider, Rules, discover_domain

COMMUNITIES = "entity_id string, community string"


def checkpoints(spark: SparkSession, output: str) -> None:
    """The folder for checkpoints: what ``spark.checkpoint.dir`` names, else one under the output folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.path.join(output, "checkpoints"))


def run_extract(spark: SparkSession, doc_dir: str | DataFrame, output: str, domain: Domain | None = None, make: Callable[[], Provider] = Rules, chunk_size: int = 10_000, force: bool = False, extractor: str = "rich") -> DataFrame:
    """Extractions of new and changed documents are added to those that are fresh; returns all."""
    domain = domain or bundled()
    docs = ingest.documents(spark, doc_dir, extractor).where("error is null") if isinstance(doc_dir, str) else doc_dir
    if domain.schema_free:
        domain = found_domain(output) or domain
        if domain.schema_free and not isinstance(make(), Rules):
            domain = discover_domain([r.text for r in docs.select("text").limit(5).collect()], make())
            os.makedirs(output, exist_ok=True)
            save(domain, f"{output}/discovered_domain.yaml")
    folder = f"{output}/extractions"
    fresh = None
    if not force and os.path.isdir(folder):
        fresh = tables.stale(tables.extractions(spark, folder), make().model, domain.name, chunk_size).where("stale_reason is null").drop("stale_reason")
        docs = docs.join(fresh.select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti")
    new = extracted(docs, domain, make, chunk_size)
    tables.save_extractions(new if fresh is None else fresh.unionByName(new), f"{folder}.new")
    if os.path.isdir(folder):
        import shutil

        shutil.rmtree(folder)
    os.rename(f"{folder}.new", folder)
    return tables.extractions(spark, folder)


def run_build(spark: SparkSession, output: str, domain: Domain | None = None, review_threshold: float = 0.7, postprocess: bool = True) -> Graph:
    checkpoints(spark, output)
    if domain is None or domain.schema_free:
        domain = found_domain(output) or domain
    g = build(tables.extractions(spark, f"{output}/extractions"), domain, postprocess=postprocess)
    tables.save_tables(g, f"{output}/graph")
    g = tables.tables(spark, f"{output}/graph")
    found = com.detected(g)
    exports.save_communities(empty(spark, COMMUNITIES) if found is None else found, f"{output}/communities.json")
    path = f"{output}/relation_review.yaml"
    flags = review_flags(g, review_threshold, domain.review_types() if domain else ())
    tables.save_yaml(resolution.new_reviews(tables.reviews(spark, path), flags), "relations", path, review_threshold=review_threshold)  # decisions stay
    return g


def run_resolve(spark: SparkSession, output: str, judge: Callable[[list[dict]], list[dict]] | None = None) -> DataFrame:
    """Merge proposals to review: of ``judge`` on each batch of candidates, and names under several types. Earlier decisions stay."""
    g = tables.tables(spark, f"{output}/graph")
    made = resolution.cross_type_duplicates(g)
    if judge is not None:
        batches = resolution.candidate_batches(g.nodes)

        def run(pdf):
            import pandas as pd

            ids = dict(zip(pdf["id"], pdf["name"]))
            rows = []
            for p in judge(pdf.sort_values("position")[["id", "name"]].to_dict("records")):
                members = [m for m in p.get("members", []) if m in ids and m != p.get("canonical")]
                if p.get("canonical") in ids and members:
                    rows.append((p["canonical"], ids[p["canonical"]], pdf["entity_type"].iloc[0], "DRAFT", [{"id": m, "name": ids[m], "confidence": float(p.get("confidence", 0.5))} for m in members], str(p.get("reason", "")), int(pdf["batch"].iloc[0])))
            return pd.DataFrame(rows, columns=["canonical_id", "canonical_name", "entity_type", "status", "members", "reason", "seq"])

        from .schemas import PROPOSALS

        judged = batches.groupBy("entity_type", "batch").applyInPandas(run, PROPOSALS + ", seq int")
        made = resolution.deduplicated_proposals(judged).drop("seq").unionByName(made)
    path = f"{output}/merge_proposals.yaml"
    old = tables.proposals(spark, path).where("status <> 'DRAFT'").drop("seq")
    tables.save_yaml(old.unionByName(made.join(old, "canonical_id", "left_anti").select(*old.columns)), "proposals", path)
    return tables.proposals(spark, path)


def run_review(spark: SparkSession, output: str, approve: float = 1.0, reject: float = 0.0) -> None:
    """The automatic part of a review of both queues."""
    path = f"{output}/merge_proposals.yaml"
    if os.path.exists(path):
        tables.save_yaml(resolution.auto_merges(tables.proposals(spark, path), approve), "proposals", path)
    path = f"{output}/relation_review.yaml"
    if os.path.exists(path):
        tables.save_yaml(resolution.auto_reviews(tables.reviews(spark, path), approve, reject), "relations", path)


def run_apply_merges(spark: SparkSession, output: str) -> Graph:
    g = tables.tables(spark, f"{output}/graph")
    merges = resolution.merge_map(tables.proposals(spark, f"{output}/merge_proposals.yaml"), g.nodes)
    g = resolution.rejected(resolution.merged(g, merges), tables.reviews(spark, f"{output}/relation_review.yaml"))
    tables.save_tables(g, f"{output}/graph.new")
    import shutil

    shutil.rmtree(f"{output}/graph")
    os.rename(f"{output}/graph.new", f"{output}/graph")
    return tables.tables(spark, f"{output}/graph")


def run_narrate(spark: SparkSession, output: str, label: Callable[[list[str]], list[str]] | None = None, communities_only: bool = False) -> str:
    """``narrative.md``; ``label`` may name the communities from a line about each."""
    checkpoints(spark, output)
    g = tables.tables(spark, f"{output}/graph")
    c = tables.communities(spark, f"{output}/communities.json")
    if label is not None:
        rows = com.community_summary(g, c).orderBy("community").collect()
        said = label([f"{r.size} entities, among them {r.top}" for r in rows])
        names = {r.community: (said[i] if i < len(said) and said[i].strip() else f"Group {i + 1}") for i, r in enumerate(rows)}
        table = spark.createDataFrame(list(names.items()), "community string, _l string") if names else None
        if table is not None:
            c = c.join(F.broadcast(table), "community").select("entity_id", F.col("_l").alias("community"))
            exports.save_communities(c, f"{output}/communities.json.new")
            os.replace(f"{output}/communities.json.new", f"{output}/communities.json")
            c = tables.communities(spark, f"{output}/communities.json")
    if communities_only:
        return f"{output}/communities.json"
    d = stories.described(g)
    with open(f"{output}/entity_descriptions.json", "w", encoding="utf-8") as f:
        json.dump({r.id: r.description for r in d.collect()}, f, ensure_ascii=False)
    with open(f"{output}/narrative.md", "w", encoding="utf-8") as f:
        f.write(stories.report(g, None if c.isEmpty() else c, d))
    return f"{output}/narrative.md"


def descriptions(spark: SparkSession, output: str) -> DataFrame | None:
    path = f"{output}/entity_descriptions.json"
    if not os.path.exists(path):
        return None
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "description"))


def run_export(spark: SparkSession, output: str, fmt: str = "json", to: str | None = None) -> str:
    to = to or f"{output}/" + {"json": "graph.json", "csv": "csv", "sqlite": "graph.sqlite"}.get(fmt, f"graph.{fmt}")
    return exports.export(tables.tables(spark, f"{output}/graph"), fmt, to, descriptions(spark, output))


def run_view(spark: SparkSession, output: str, to: str | None = None, community: str | None = None, **filters) -> str:
    checkpoints(spark, output)
    g = views.view(tables.tables(spark, f"{output}/graph"), **filters)
    if community:
        g = views.faceted(g, tables.communities(spark, f"{output}/communities.json"), labels=(community,))
    return exports.to_html(g, to or f"{output}/graph.html")


def run_query(spark: SparkSession, output: str, who: str, depth: int = 1) -> dict:
    """The entity best meant by ``who``, others it may mean, its place among the communities and its neighbourhood."""
    checkpoints(spark, output)
    g = tables.tables(spark, f"{output}/graph")
    found = views.candidates(g, who).orderBy("rank").collect()
    if not found:
        raise views.NotFound(f"no entity {who!r}")
    me = found[0]
    place = com.topology(g, tables.communities(spark, f"{output}/communities.json"), me.id).collect()
    sub = views.subgraph(g, me.id, depth)
    rows = lambda df: [json.loads(r.j) for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    return {
        "match": me.asDict(), "other_matches": [r.asDict() for r in found[1:]], "topology": place[0].asDict() if place else None,
        "subgraph": {"nodes": rows(sub.nodes.drop("context")), "links": rows(sub.edges.select(*exports.EDGE_COLUMNS))},
    }


def run_info(spark: SparkSession, output: str) -> dict:
    e = tables.extractions(spark, f"{output}/extractions").agg(F.count("*").alias("documents"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("relations")).alias("relations"), F.sum("cost_usd").alias("cost_usd")).first()
    status = lambda df: {r.status: r.n for r in df.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return {
        "extractions": e.asDict(), "graph": exports.metadata(tables.tables(spark, f"{output}/graph")) if os.path.isdir(f"{output}/graph") else None,
        "merge_proposals": status(tables.proposals(spark, f"{output}/merge_proposals.yaml")), "relation_reviews": status(tables.reviews(spark, f"{output}/relation_review.yaml")),
    }


def run_pipeline(spark: SparkSession, doc_dir: str | DataFrame, output: str, domain: Domain | None = None, make: Callable[[], Provider] = Rules, include_narrative: bool = True) -> Graph:
    run_extract(spark, doc_dir, output, domain, make)
    g = run_build(spark, output, domain)
    if include_narrative:
        run_narrate(spark, output)
    return g
