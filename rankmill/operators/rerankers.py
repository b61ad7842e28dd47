"""Rerankers over frozen candidates: a comparison of several, and a chain that falls back to the next."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError
from . import evaluation, ranking
from .lineage import kept

#: (candidates with query text and document) -> the same with rerank_score.
Reranker = Callable[[DataFrame], DataFrame]


def fused_order(candidates: DataFrame) -> DataFrame:
    """Keeps the fused order."""
    return candidates.withColumn("rerank_score", F.col("rrf_score"))


def overlap(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rerank_score", F.round(ranking.overlap_score(F.col("text"), F.col("search_document")), 9))


def _tried(candidates: DataFrame, reranker: Reranker) -> DataFrame:
    """The reranker's result, computed now, so that its failures show here."""
    return kept(reranker(candidates))


def chain(candidates: DataFrame, rerankers: dict[str, Reranker]) -> tuple[DataFrame, str, list[str]]:
    """(result of the first reranker that works, its name, errors of those before); the fused order if none does.

    A plan that cannot be analyzed is the caller's mistake and raised.
    """
    errors = []
    for name, reranker in rerankers.items():
        try:
            return _tried(candidates, reranker), name, errors
        except AnalysisException:
            raise  # the plan is wrong, not the model
        except (PySparkException, Py4JJavaError, SearchError, RuntimeError, ValueError) as error:
            errors.append(f"{name}: {type(error).__name__}")
    return fused_order(candidates), "rrf", errors


def compare(candidates: DataFrame, gold: DataFrame, rerankers: dict[str, Reranker], n: int = ranking.DEFAULT_LIMIT) -> DataFrame:
    """One row a reranker, hybrid-only first: recall, MRR and NDCG over the same candidates, and whether it failed (then in fused order)."""
    frozen = kept(candidates)
    out = None
    for k, (name, reranker) in enumerate({"hybrid-only": fused_order, **rerankers}.items()):
        scored, used, errors = chain(frozen, {name: reranker})
        ranked = ranking.limit(ranking.reranker_first(scored), n).select("query_id", "product_id", F.col("final_rank").alias("rank"))
        row = evaluation.summary(ranked, gold, ks=(n,)).withColumns({"place": F.lit(k), "reranker": F.lit(name), "failed": F.lit(bool(errors))})
        out = row if out is None else out.unionByName(row)
    return out.orderBy("place")
