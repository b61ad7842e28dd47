"""Command line: build, update, delete, search, evaluate, benchmark and inspect a catalog. `python -m rankmill.cli --help`."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import benchmark, config, engine, render
from .errors import ConfigurationError, summary
from .operators import rerankers
from .operators.maintenance import Catalog, IndexEvent
from .sources import products


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankmill", description="Batch hybrid product search: field-weighted BM25, vectors, rank fusion, reranking.")
    p.add_argument("--config", default="search.config.yaml", help="settings in YAML; a missing file sets nothing")
    p.add_argument("--store", default="catalog", help="folder of the catalog's snapshots")
    p.add_argument("--json", action="store_true", help="output for machines")
    commands = p.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="make the catalog anew from a JSON array of products")
    build.add_argument("--catalog", required=True)
    build.add_argument("--drop", action="store_true", help="use no stored embedding again")
    commands.add_parser("update", help="add or replace products of a JSON array").add_argument("--catalog", required=True)
    commands.add_parser("delete", help="remove a product").add_argument("--id", required=True)
    search = commands.add_parser("search", help="ask one query")
    search.add_argument("query")
    search.add_argument("--debug", action="store_true", help="show all stages")
    search.add_argument("--limit", type=int, default=None)
    evaluate = commands.add_parser("evaluate", help="metrics over labelled queries (JSON lines, or a JSON array of relevant ids)")
    evaluate.add_argument("--dataset", required=True)
    evaluate.add_argument("--reranker", default=None)
    evaluate.add_argument("--benchmark", action="store_true", help="compare rerankers on the same candidates")
    bench = commands.add_parser("benchmark", help="throughput over synthetic catalogs")
    bench.add_argument("--sizes", default=",".join(map(str, benchmark.SIZES)))
    bench.add_argument("--queries", type=int, default=200)
    commands.add_parser("inspect", help="state of the catalog and a sample document")
    return p


def _changed(event: IndexEvent, as_json: bool) -> str:
    if as_json:
        return json.dumps(vars(event))
    return f"{event.operation}: {event.upserted} upserted, {event.embedded} embedded, {event.reused} reused, {event.deleted} deleted (version {event.version})"


def _evaluated(spark: SparkSession, own: engine.Engine, args: argparse.Namespace) -> str:
    gold = products.read_graded(spark, args.dataset).select("query", "product_id", "label") if args.dataset.endswith((".jsonl", ".ndjson")) else products.read_binary(spark, args.dataset)
    if args.reranker and args.reranker not in own.rerankers:
        raise ConfigurationError(f"unknown reranker: {args.reranker}")
    if args.benchmark:
        texts = gold.select("query").distinct().select(F.col("query").alias("query_id"), F.col("query").alias("text"))
        _, report = own.search(texts, 20)
        if "candidates" not in report.frames:
            return "No candidates."
        names = [args.reranker] if args.reranker else ["noop", "overlap"]
        rows = rerankers.compare(report.frames["candidates"], gold.withColumnRenamed("query", "query_id"), {n: own.rerankers[n] for n in names}).drop("place").collect()
        table = [{"reranker": r["reranker"], **{k: v for k, v in r.asDict().items() if k != "reranker"}} for r in rows]
        return json.dumps(table) if args.json else render.markdown(table)
    if args.reranker:
        own.config = own.config.changed({"reranking": {"provider": args.reranker}})
    found = benchmark.evaluate(own, gold)
    return json.dumps(found) if args.json else "\n".join([f"Queries: {found['queries']}", *[f"{k}: {v:.3f}" for k, v in found.items() if k != "queries"]])


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    """What a command prints."""
    settings = config.load(args.config, {"logging": {"enabled": False}})
    dim = settings["embedding.dimensions"]
    if args.command == "benchmark":
        rows = benchmark.measure(spark, tuple(int(s) for s in args.sizes.split(",") if s.strip().isdigit()), args.queries)
        return json.dumps(rows) if args.json else render.markdown(rows)
    catalog = Catalog(spark, args.store, dim)
    if args.command == "build":
        return _changed(catalog.rebuild(products.read_json_catalog(spark, args.catalog), args.drop), args.json)
    if args.command == "update":
        return _changed(catalog.upsert(products.read_json_catalog(spark, args.catalog)), args.json)
    if args.command == "delete":
        return _changed(catalog.delete(spark.createDataFrame([(args.id,)], "product_id string")), args.json)
    own = engine.build_engine(spark, args.store, settings)
    if args.command == "search":
        rows, report = own.search_one(args.query, args.limit, use_cache=False)
        if args.json:
            return json.dumps({"results": [r.asDict(True) for r in rows], "timings": report.timings, "degradations": [vars(d) for d in report.degradations]}, ensure_ascii=False, default=str)
        return render.stages(args.query, rows, report, own) if args.debug else render.results(rows)
    if args.command == "evaluate":
        return _evaluated(spark, own, args)
    sample = next(catalog.iterate(), None)
    facts = {
        "store": args.store, "documents": catalog.count(), "embeddings": f"{catalog.count_embeddings()} (model: {catalog.model_version})", "index_version": catalog.version(),
        "reranker": settings["reranking.provider"], "normalizer": settings["normalization.provider"],
        "sample": None if sample is None else f"{sample['product_id']}: {sample['search_document']}",
    }
    return json.dumps(facts, ensure_ascii=False) if args.json else render.state(facts)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 with the failure's first lines on standard error."""
    args = parser().parse_args(argv)
    own = None
    try:
        config.load(args.config)
        if spark is None:
            own = spark = SparkSession.builder.appName("rankmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        print(run(args, spark))
        return 0
    except ConfigurationError as error:
        print(error, file=sys.stderr)
    except Exception as error:  # noqa: BLE001 - a command line says what failed instead of a traceback
        print(summary(error)["message"], file=sys.stderr)
    finally:
        if own is not None:
            own.stop()
    return 1


if __name__ == "__main__":
    sys.exit(main())
