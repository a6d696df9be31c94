"""Command line over a JSON graph: discover, explain, compare and backtest, as text or JSON."""

from __future__ import annotations

import argparse
import json

from lacuna.functions.constants import TARGET_PRESETS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lacuna")
    p.add_argument("--graph", required=True, help="JSON file with concepts and edges")
    p.add_argument("--future", help="a second graph, of the years after a back-test's split")
    p.add_argument("--papers", help="Parquet of topic, paper, title: what a comparison mines")
    p.add_argument("--works", help="Parquet of work, title, text, year, cited: what texts as evidence are")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def verified(c):
        c.add_argument("--verify", action="store_true")
        c.add_argument("--evidence", choices=["auto", "counts", "texts"], default="auto", help="what links are held against")
        return c

    d = verified(sub.add_parser("discover"))
    d.add_argument("topic")
    d.add_argument("--max", type=int, default=8)
    d.add_argument("--target", choices=sorted(TARGET_PRESETS), default="any")
    d.add_argument("--types", help="Parquet or JSON lines of name, letters (array of tree letters): the categories that --target looks at")
    d.add_argument("--strict-types", action="store_true", help="no link rather than one of another category")
    d.add_argument("--novelty-mode", default="concept_lift")
    d.add_argument("--filter-profile", default="biomed")
    d.add_argument("--bridge-diversity", type=float, default=0.0, help="weight of unlike bridges in the score")
    d.add_argument("--no-semantic", action="store_true", help="word lists alone, no embeddings")
    d.add_argument("--embeddings", help="Parquet of name, vec: adds the semantic layer")
    e = verified(sub.add_parser("explain"))
    e.add_argument("a")
    e.add_argument("c")
    c = verified(sub.add_parser("compare"))
    c.add_argument("topic")
    c.add_argument("--max", type=int, default=6)
    b = sub.add_parser("backtest")
    b.add_argument("topic")
    b.add_argument("--year", type=int, required=True, help="the last year that --graph holds")
    b.add_argument("--k", type=int, default=10)
    b.add_argument("--threshold", type=int, default=3)
    return p


def provider(spark, args, graph):
    """The provider that --evidence asks for, or else the best that the files allow."""
    from lacuna.operators import agent, evidence

    available = {"counts": agent.counted(graph)}
    if args.works:
        available["texts"] = evidence.from_texts(spark.read.parquet(args.works))
    return evidence.choose_provider(available, None if args.evidence == "auto" else args.evidence)[1]


def types_of(spark, path: str | None):
    """(name, letters) of a file, or None."""
    if not path:
        return None
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema("name string, letters array<string>").json(path)


def table(rows: list[dict]) -> str:
    return "\n".join("  ".join(f"{k}={v}" for k, v in r.items()) for r in rows)


def main(argv=None) -> int:
    from dataclasses import replace

    from lacuna.operators import agent, backtest, mining, report
    from lacuna.operators.discovery import DiscoveryConfig
    from lacuna.operators.filters import make_filter
    from lacuna.operators.typing import resolve_target
    from lacuna.session import local_session
    from lacuna.sources.corpus import fixture, resolve

    args = parser().parse_args(argv)
    if args.command == "discover" and resolve_target(args.target) and not args.types:
        parser().error("--target needs --types, the categories of names")
    spark = local_session("lacuna", 2, 4, "2g")
    graph = fixture(spark, args.graph)
    wanted = [args.a, args.c] if args.command == "explain" else [args.topic]
    asked = spark.createDataFrame([(t,) for t in wanted], "topic string")
    found = {r.topic: r.cid for r in resolve(asked, graph.concepts).collect()}
    if args.command == "compare":
        topics = spark.createDataFrame([(args.topic, found.get(args.topic))], "topic string, a string")
        papers = spark.read.parquet(args.papers) if args.papers else None
        rows = mining.run_compare(graph, topics, papers, max_rows=args.max, verify=args.verify, provider=provider(spark, args, graph))
        rows, summary = [r.asDict() for r in rows.collect()], [r.asDict() for r in mining.compare_summary(rows).collect()]
        print(json.dumps({"topic": args.topic, "rows": rows, "summary": summary}, ensure_ascii=False) if args.json else table(rows + summary))
        return 0
    if len(found) < len(set(wanted)):
        print(f"No concept for {', '.join(t for t in wanted if t not in found)}.")
        return 1
    if args.command == "backtest":
        future = fixture(spark, args.future) if args.future else replace(graph, edges=graph.edges.where("false"), comentions=None)
        topic = spark.createDataFrame([(found[args.topic],)], "a string")
        links = backtest.run_backtest(graph, future, topic, k=args.k, emergence_threshold=args.threshold)
        summary = [r.asDict() | {"split_year": args.year} for r in backtest.backtest_summary(links).collect()]
        rows = [r.asDict() for r in links.where("chosen").select("c_name", "past_comentions", "future_comentions", "hit").collect()]
        print(json.dumps({"topic": args.topic, "summary": summary, "links": rows}, ensure_ascii=False) if args.json else table(summary + rows))
        return 0
    if args.command == "discover":
        layer = spark.read.parquet(args.embeddings) if args.embeddings and not args.no_semantic else None
        cfg = DiscoveryConfig(
            max_results=args.max, novelty_mode=args.novelty_mode, filter_profile=args.filter_profile, target_categories=resolve_target(args.target),
            bridge_diversity_weight=args.bridge_diversity, apply_diversity=args.bridge_diversity > 0, strict_types=args.strict_types, filters=make_filter(args.filter_profile, embeddings=layer) if layer else None,
        )
        topic = spark.createDataFrame([(found[args.topic],)], "a string")
        hyps = agent.run_discover(graph, topic, cfg, types_of(spark, args.types), verify=args.verify, provider=provider(spark, args, graph))
        bundle = report.report(args.topic, hyps, args.verify)
    else:
        pair = spark.createDataFrame([(found[args.a], found[args.c])], "a string, c string")
        bundle = report.report(f"{args.a} ↔ {args.c}", agent.run_explain(graph, pair, verify=args.verify, provider=provider(spark, args, graph)))
    print(report.to_json(bundle) if args.json else report.as_text(bundle))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
