"""Throughput over synthetic catalogs: documents indexed a second, and a batch of queries with the time of each stage."""

from __future__ import annotations

import itertools
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import load
from .engine import build_engine
from .operators import evaluation
from .operators.lineage import shared_folder
from .operators.maintenance import Catalog
from .sources import synthetic

#: The query texts, asked in turn.
TEXTS = ["tube 110 blanc", "T110B45", "raccord pvc 63", "câble rigide 2.5", "gaine icta 40 gris", "vanne papillon 50", "tube évacuation 4m", "Ø110", "coude 125", "joint caoutchouc noir", "tube assainissement 160", "chemin de câbles 20"]
SIZES = (1_000, 5_000, 10_000, 20_000, 50_000)


def measure(spark: SparkSession, sizes: tuple[int, ...] = SIZES, queries: int = 200) -> list[dict]:
    """One row a size: the index built and stored, then all queries as one batch; milliseconds a query of each stage, and the slowest."""
    out = []
    for size in sizes:
        root = shared_folder(spark, "bench")
        began = time.perf_counter()
        event = Catalog(spark, root, buckets=max(4, min(64, size // 2500))).rebuild(synthetic.catalog(spark, size))
        built = time.perf_counter() - began
        engine = build_engine(spark, root, load(overrides={"mode": "benchmark", "logging": {"enabled": False}}))
        asked = spark.createDataFrame([(f"{i:05}", text) for i, text in zip(range(queries), itertools.cycle(TEXTS))], "query_id string, text string")  # noqa: B905
        engine.documents.count(), engine.index.postings.count(), engine.vectors.count()
        found, report = engine.search(asked)
        ms = {stage: took / queries for stage, took in report.timings.items()}
        stages = [(str(size), stage, took) for stage, took in ms.items() if stage != "total"]
        slowest = evaluation.bottleneck(spark.createDataFrame(stages, "run string, stage string, ms double")).first()["bottleneck"]
        out.append({
            "catalog": size, "docs": event.upserted, "index_s": built, "docs_per_s": event.upserted / built,
            **{stage.replace(" ", "_") + "_ms": took for stage, took in ms.items()}, "queries_per_s": 1000 / ms["total"], "results": found.count(), "bottleneck": slowest,
        })
        for kept in (engine.documents, engine.index.postings, engine.vectors):
            kept.unpersist()
    return out


def evaluate(engine, gold) -> dict:
    """Recall at 1, 5, 10, 20, MRR and NDCG at 10 of the engine's results for gold(query, product_id, label), and milliseconds a query."""
    texts = gold.select("query").distinct().select(F.col("query").alias("query_id"), F.col("query").alias("text"))
    found, report = engine.search(texts, 20)
    ranked = found.select("query_id", "product_id", F.col("final_rank").alias("rank"))
    row = evaluation.summary(ranked, gold.withColumnRenamed("query", "query_id")).first().asDict()
    return {**row, "ms_per_query": report.timings.get("total", 0.0) / max(1, row["queries"])}
