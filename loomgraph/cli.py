"""The command line: ``python -m loomgraph.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import pipeline as P
from .operators import communities as com
from .operators import views
from .session import session
from .sources import config, tables
from .sources.domains import bundled, bundled_names, selected


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, domain: bool = False) -> None:
        c = sub.add_parser(name)
        c.add_argument("-o", "--output", default=None)
        c.add_argument("-v", "--verbose", action="store_true")
        if domain:
            c.add_argument("--domain", default=None, help="a domain file, or a bundled name")
            c.add_argument("-d", "--domain-name", default="schema-free")
        for flags, kw in args:
            c.add_argument(*flags, **kw)

    a = lambda *flags, **kw: (flags, kw)
    on = {"action": "store_true"}
    command("extract", a("folder"), a("--model", default=None), a("--chunk-size", type=int, default=None), a("-f", "--force", **on), a("--extractor", default=None), domain=True)
    command("build", a("--review-threshold", type=float, default=0.7), a("--no-postprocess", **on), domain=True)
    command("resolve", domain=True)
    command("apply-merges")
    command("review", a("--auto-approve", type=float, default=0.85), a("--auto-reject", type=float, default=0.5))
    command("search", a("query"), a("-t", "--type", default=None), a("-r", "--relations", **on), a("--json", **on))
    command("export", a("format", choices=["json", "csv", "sqlite", "graphml", "gexf"]), a("--to", default=None))
    command("view", a("--to", default=None), a("--top", type=int, default=None), a("--min-confidence", type=float, default=0.0), a("--source-doc", default=None), a("--neighborhood", default=None), a("--depth", type=int, default=1), a("--community", default=None))
    command("domains")
    command("narrate", a("--communities-only", **on), domain=True)
    command("init")
    command("info", a("--json", **on))
    command("topology", a("--pretty", **on))
    command("query", a("entity"), a("--depth", type=int, default=1), a("--pretty", **on))
    return p


def _say(x) -> None:
    print(json.dumps(x, indent=1, ensure_ascii=False, default=str))


def main(argv: list[str] | None = None, spark=None) -> int:
    """Runs one command; 1 where it can't be done."""
    o = _parser().parse_args(argv)
    try:
        return _run(o, spark)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(o: argparse.Namespace, spark) -> int:
    if o.command == "domains":
        _say({n: {"entity_types": list((d := bundled(n)).entity_types), "relation_types": list(d.relation_types)} for n in bundled_names()})
        return 0
    if o.command == "init":
        for name, text in (("loom.yaml", "domain: general\noutput: output\n"), (".env.example", "LOOM_MODEL=\n")):
            if not os.path.exists(name):
                with open(name, "w", encoding="utf-8") as f:
                    f.write(text)
        return 0
    c = config.load(output=o.output, domain=getattr(o, "domain", None), chunk_size=getattr(o, "chunk_size", None), model=getattr(o, "model", None), extractor=getattr(o, "extractor", None))
    domain = selected(c.domain, o.domain_name) if hasattr(o, "domain_name") else None
    if o.command not in ("extract",) and not os.path.isdir(f"{c.output}/{'extractions' if o.command in ('build', 'info') else 'graph'}"):
        raise ValueError(f"nothing to read in {c.output}; run extract and build first")
    spark = spark or session()
    out = c.output
    if o.command == "extract":
        config.check_key(c.model)
        _say({"documents": P.run_extract(spark, o.folder, out, domain, chunk_size=c.chunk_size, force=o.force, extractor=c.extractor).count()})
    elif o.command == "build":
        P.run_build(spark, out, domain, o.review_threshold, not o.no_postprocess)
        _say(P.run_info(spark, out)["graph"])
    elif o.command == "resolve":
        _say({"proposals": P.run_resolve(spark, out).count()})
    elif o.command == "apply-merges":
        P.run_apply_merges(spark, out)
        _say(P.run_info(spark, out)["graph"])
    elif o.command == "review":
        P.run_review(spark, out, o.auto_approve, o.auto_reject)
        _say(P.run_info(spark, out))
    elif o.command == "export":
        print(P.run_export(spark, out, o.format, o.to))
    elif o.command == "view":
        print(P.run_view(spark, out, o.to, o.community, who=o.neighborhood, depth=o.depth, document=o.source_doc, least=o.min_confidence, top=o.top))
    elif o.command == "narrate":
        print(P.run_narrate(spark, out, communities_only=o.communities_only))
    elif o.command == "info":
        _say(P.run_info(spark, out))
    elif o.command == "query":
        _say(P.run_query(spark, out, o.entity, o.depth))
    else:
        g = tables.tables(spark, f"{out}/graph")
        if o.command == "search":
            found = views.search(g, o.query, o.type).join(views.substantive_degrees(g), "id").orderBy("name", "id").select(*"id name entity_type confidence degree".split())
            rows = [r.asDict() for r in found.collect()]
            if o.relations:
                for r in rows:
                    r["relations"] = [x.asDict() for x in views.connections(g, r["id"]).limit(1000 if o.verbose else 10).collect()]
            _say(rows)
        else:
            k = tables.communities(spark, f"{out}/communities.json")
            _say({n: [r.asDict() for r in df.collect()] for n, df in (("communities", com.community_summary(g, k)), ("bridges", com.bridges(g, k)), ("connections", com.community_connections(g, k)), ("isolated", com.isolated(g).select("id", "name")))})
    return 0


if __name__ == "__main__":
    sys.exit(main())
