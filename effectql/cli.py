"""Command line: ingest, effects, effects-show, search, card, stats, check, analyze."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ingest
from .catalog import Store
from .config import Config
from .operators.aggregates import metrics
from .plans.ast import Query, QueryError
from .plans.filters import parse_filters
from .plans.planner import plan
from .sources import readers
from .tools import ToolError, Tools


def stats(store: Store) -> dict[str, int]:
    one = lambda t, c=None: store.read(t).agg(F.count(F.lit(1)) if c is None else c)
    by = lambda c: F.count_if(F.col("card_category") == c)
    found = metrics(
        cards=one("card"), monsters=one("card", by("MONSTER")), spells=one("card", by("SPELL")), traps=one("card", by("TRAP")),
        archetypes=one("card_archetype", F.countDistinct("archetype")), names=one("card_name"), external_ids=one("external_id"), sources=one("raw_source"),
        raw_records=one("raw_card_record"),
    )
    return {r["metric"]: r["value"] for r in found.collect()}


def _query(args) -> Query:
    if args.query_file:
        query = Query.from_json(readers.query_file(args.query_file))
    elif args.nl:
        query = plan(args.nl).query
    else:
        query = parse_filters(args.filter or [])
    return query if args.limit is None else replace(query, limit=args.limit)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="effectql")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--source", choices=("cdb", "json", "texts"), required=True)
    a.add_argument("--path", required=True)
    sub.add_parser("effects")
    a = sub.add_parser("effects-show")
    a.add_argument("name")
    a = sub.add_parser("search")
    a.add_argument("--filter", action="append")
    a.add_argument("--nl")
    a.add_argument("--query-file")
    a.add_argument("--limit", type=int)
    a.add_argument("--no-effects", action="store_true")
    a.add_argument("--explain", action="store_true")
    a = sub.add_parser("card")
    a.add_argument("name")
    a.add_argument("--fuzzy", action="store_true")
    a.add_argument("--raw", action="store_true")
    sub.add_parser("stats")
    sub.add_parser("check")
    sub.add_parser("analyze")
    return p


def run(argv: list[str], spark: SparkSession, config: Config) -> object:
    """What a command prints."""
    args = parser().parse_args(argv)
    store = Store(spark, config.store)
    if args.command == "ingest":
        step = {"cdb": ingest.ingest_cdb, "json": ingest.ingest_json, "texts": ingest.apply_chinese}[args.source]
        return asdict(step(store, args.path))
    if args.command == "effects":
        return ingest.build_effects(store)
    if args.command == "stats":
        return stats(store)
    if args.command == "analyze":
        return store.analyze()
    if args.command == "check":
        return [r.asDict() for r in store.audit().collect()]
    tools = Tools(store)
    if args.command == "card":
        card = tools.get_card(args.name, exact=not args.fuzzy)
        if not args.raw:
            card.pop("raw_text")
        return card
    if args.command == "effects-show":
        card = tools.get_card(args.name)
        rows = store.read("effect_unit").where(F.col("card_id") == card["card_id"]).orderBy("unit_index").collect()
        return {"card": card["canonical_name"], "units": [r.asDict() for r in rows]}
    query = _query(args)
    if args.explain:
        tools.searcher.compiler.page(query).explain("formatted")
        return query.to_json()
    return tools.searcher.search(query, evidence=not args.no_effects)


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("effectql").getOrCreate()
    try:
        print(json.dumps(run(sys.argv[1:] if argv is None else argv, spark, Config.load()), ensure_ascii=False, indent=2, default=str))
        return 0
    except (QueryError, ToolError, readers.SourceError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
