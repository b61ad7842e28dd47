"""Fusion, reranking and final ranking of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, FUSED, CANDIDATES, DEFAULT_LIMIT, MAX_LIMIT = 60, 50, 50, 10, 100
POLICY_WEIGHTS = {"bm25": 0.2, "vector": 0.2, "rrf": 0.2, "rerank": 0.4}


def rank_hits(hits: DataFrame) -> DataFrame:
    """hits(query_id, source, product_id, score) -> adds rank; a product twice in a source counts once, at its best."""
    best = hits.groupBy("query_id", "source", "product_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "product_id")
    return best.withColumn("rank", F.row_number().over(order))


def fuse(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, top_k: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion: (query_id, product_id, rrf_score, rrf_rank, bm25_rank, bm25_score, vector_rank, vector_score)."""
    w = weights or {"bm25": 1.0, "vector": 1.0}
    share = F.lit(0.0)
    for source, weight in w.items():
        share = F.when(F.col("source") == source, F.lit(float(weight)) / (k + F.col("rank"))).otherwise(share)
    own = [F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{s}_{c}") for s in ("bm25", "vector") for c in ("rank", "score")]
    summed = ranked.groupBy("query_id", "product_id").agg(F.round(F.sum(share), 12).alias("rrf_score"), *own)
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "product_id")
    return summed.withColumn("rrf_rank", F.row_number().over(order)).where(F.col("rrf_rank") <= top_k)


def capped(fused: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The first n fused hits of each query: the candidates of a reranker."""
    return fused.where(F.col("rrf_rank") <= n)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has, less for long texts, between 0 and 1."""
    wanted = F.filter(F.array_distinct(F.split(F.lower(query), r"\s+")), lambda t: t != "")
    words = F.filter(F.split(F.lower(text), "[^a-zà-ÿ0-9]+"), lambda t: t != "")
    share = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, words)) / F.size(wanted)).otherwise(0.0)
    return clamp(share * 0.85 / (1 + F.size(words) * 0.02) + 0.05)


def clamp(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def min_max(c: str) -> Column:
    """Share of the query's span of c; missing scores count as 0, and a span of 0 gives 0."""
    w = Window.partitionBy("query_id")
    x = F.coalesce(F.col(c), F.lit(0.0))
    span = F.max(x).over(w) - F.min(x).over(w)
    return F.when(span > 0, (x - F.min(x).over(w)) / span).otherwise(0.0)


def reranker_first(scored: DataFrame) -> DataFrame:
    """(… rerank_score …) -> adds final_score and final_rank by reranker, then fused score, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("rrf_score"), "product_id")
    return scored.withColumn("final_score", F.col("rerank_score")).withColumn("final_rank", F.row_number().over(order))


def weighted(scored: DataFrame, weights: dict[str, float] = POLICY_WEIGHTS) -> DataFrame:
    """Adds final_score, the weighted sum of the min-max shares of the four scores, and final_rank."""
    total = sum((F.lit(w) * min_max(f"{c}_score") for c, w in weights.items()), F.lit(0.0))
    out = scored.withColumn("final_score", F.round(total, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "product_id")
    return out.withColumn("final_rank", F.row_number().over(order))


def limit(ranked: DataFrame, n: int = DEFAULT_LIMIT) -> DataFrame:
    return ranked.where(F.col("final_rank") <= max(1, min(n, MAX_LIMIT)))


def hydrate(fused: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their documents, candidates whose document is missing)."""
    joined = fused.join(documents.withColumn("__there", F.lit(True)), "product_id", "left")
    return joined.where("__there").drop("__there"), joined.where("__there is null").select(*fused.columns)
