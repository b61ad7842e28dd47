"""Hybrid batch search: lexical and vector hits, fusion, reranking, final ranking, as one plan for all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents, lexical, normalizer, ranking, rerankers, vector
from ..operators.lineage import kept


def plain_queries(queries: DataFrame) -> DataFrame:
    """(query_id, text) -> adds tokens, the distinct analyzed terms, and no codes. Texts beyond 512 characters are cut."""
    return normalizer.tokenize(queries)


def normalized_queries(queries: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, text) -> (query_id, text, tokens, codes) by the query normalizer, spelt by the words of the products. Computed once."""
    words = lexical.vocabulary(lexical.build_index(documents.build(products)).term_stats).select("term")
    found = normalizer.normalize(queries, words).where("not is_empty")
    return kept(found.select("query_id", F.col("normalized").alias("text"), "tokens", "codes"))


def candidates(queries: DataFrame, products: DataFrame, dim: int = vector.DIMENSIONS, min_score: float = vector.MIN_SCORE, weights: dict[str, float] | None = None) -> DataFrame:
    """Fused hits of plain or normalized queries(query_id, text, tokens, codes) over products."""
    docs = kept(documents.build(products).select("product_id", "fields", "search_document"))
    index = lexical.build_index(docs)
    lex = lexical.search(queries, index).select("query_id", F.lit("bm25").alias("source"), "product_id", "score")
    vectors = vector.hash_embed(docs.select(F.col("product_id").alias("id"), F.col("search_document").alias("text")), dim)
    wanted = vector.hash_embed(queries.select(F.col("query_id").alias("id"), "text"), dim).withColumnRenamed("id", "query_id")
    near = vector.retrieve(wanted, vectors, min_score=min_score).select("query_id", F.lit("vector").alias("source"), F.col("id").alias("product_id"), "score")
    return ranking.fuse(ranking.rank_hits(lex.unionByName(near)), weights)


def reranker_input(queries: DataFrame, products: DataFrame, dim: int = vector.DIMENSIONS) -> DataFrame:
    """The fused candidates with their query's text and their document."""
    found, _ = ranking.hydrate(ranking.capped(candidates(queries, products, dim)), documents.build(products).select("product_id", "search_document"))
    return found.join(queries.select("query_id", "text"), "query_id")


def hybrid_search(queries: DataFrame, products: DataFrame, policy: str = "reranker_first", n: int = ranking.DEFAULT_LIMIT, dim: int = vector.DIMENSIONS) -> DataFrame:
    """(query_id, product_id, final_rank, final_score, and the scores behind it): at most n a query. policy fused: no reranker."""
    rerank = rerankers.fused_order if policy == "fused" else rerankers.overlap
    scored = rerank(reranker_input(queries, products, dim))
    ordered = ranking.weighted(scored) if policy == "weighted" else ranking.reranker_first(scored)
    cols = ["query_id", "product_id", "final_rank", "final_score", "rrf_score", "rrf_rank", "bm25_rank", "bm25_score", "vector_rank", "vector_score", "rerank_score"]
    return ranking.limit(ordered, n).select(*cols)
