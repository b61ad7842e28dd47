"""Hooks for models that rank: scores by batches, answers read leniently, candidates without a score kept."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ModelUnavailableError
from . import ranking

#: (query, [(product_id, text)]) -> {product_id: score}: one call a batch of one query's candidates.
ScoreBatch = Callable[[str, list[tuple[str, str]]], dict[str, float]]
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def first_number(answer: Column) -> Column:
    """The first number of a model's answer, between 0 and 1; a comma counts as a point, no number as 0."""
    found = F.regexp_extract(F.replace(F.coalesce(answer, F.lit("")), F.lit(","), F.lit(".")), f"({_NUMBER})", 1)
    return ranking.clamp(F.when(found == "", F.lit(0.0)).otherwise(found.cast("double")))


def object_in(answer: str | None) -> dict | None:
    """The JSON object between the first opening and the last closing brace of an answer; None if there is none."""
    found = re.search(r"\{.*\}", answer or "", re.DOTALL)
    try:
        value = json.loads(found.group(0)) if found else None
    except json.JSONDecodeError:
        return None
    return value if isinstance(value, dict) else None


def with_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates(query_id, product_id, …) -> adds rerank_score of scores(query_id, product_id, score); a missing score is 0.

    Of several scores of a candidate the largest counts. What is no number counts as 0, and all are brought between 0 and 1.
    """
    best = scores.groupBy("query_id", "product_id").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("__s"))
    return candidates.join(best, ["query_id", "product_id"], "left").withColumn("rerank_score", ranking.clamp(F.col("__s"))).drop("__s")


def model_reranker(score_batch: ScoreBatch, batch: int = 8, max_text: int = 512) -> Callable[[DataFrame], DataFrame]:
    """A reranker that asks a model: a query's candidates in batches, texts cut to max_text characters.

    Rows of a query are neighbours in one task (a query has few candidates); a batch never mixes queries. An exception of the
    model fails the task, so a chain goes on to its next reranker.
    """

    def rerank(candidates: DataFrame) -> DataFrame:
        asked = candidates.select("query_id", "product_id", F.substring("text", 1, max_text).alias("text"), F.substring("search_document", 1, max_text).alias("document"), "rrf_rank")
        kind = dict(asked.dtypes)["query_id"]

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("rrf_rank")
            found: dict[str, float] = {}
            for low in range(0, len(frame), batch):
                part = frame.iloc[low : low + batch]
                found |= score_batch(part["text"].iloc[0], list(zip(part["product_id"], part["document"], strict=True)))
            own = [(p, float(s)) for p, s in found.items()]
            ids = pd.Series([p for p, _ in own], dtype=object)
            return pd.DataFrame({"query_id": pd.Series([frame["query_id"].iloc[0]] * len(own), dtype=object), "product_id": ids, "score": pd.Series([s for _, s in own], dtype=float)})

        scores = asked.groupBy("query_id").applyInPandas(run, f"query_id {kind}, product_id string, score double")
        return with_scores(candidates, scores)

    return rerank


def unavailable(provider: str, remediation: str) -> Callable[[DataFrame], DataFrame]:
    """The reranker of a provider that no model was given for: it fails at once."""

    def rerank(candidates: DataFrame) -> DataFrame:
        raise ModelUnavailableError(f"no model was given for the reranker {provider}", provider, remediation)

    return rerank

