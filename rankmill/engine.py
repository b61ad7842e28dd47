"""The search engine over a catalog: settings, stages that may fail on their own, fallbacks, cache and log."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .cache import ResultCache, cache_key
from .config import Config, load
from .errors import SearchError, summary
from .operators import documents, lexical, models, normalizer, ranking, rerankers, vector
from .operators.lineage import kept
from .operators.maintenance import Catalog, live
from .sources import logs

#: What a stage may fail with; a plan that cannot be analyzed is a mistake of the caller's and raised.
FAILURES = (PySparkException, Py4JJavaError, SearchError, RuntimeError, ValueError)
#: Hits of each list that a debug report shows.
SHOWN = 20


def request_id() -> str:
    """16 hexadecimal digits, new at each call."""
    return uuid.uuid4().hex[:16]


@dataclass(frozen=True)
class Degradation:
    """A stage that failed or left something out, and what was done instead."""

    stage: str
    message: str
    error: str | None = None


@dataclass
class Report:
    """What a search did besides its results: kept stage results, milliseconds of each stage, degradations."""

    search_id: str
    frames: dict[str, DataFrame] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)
    degradations: list[Degradation] = field(default_factory=list)
    reranker: str = "noop"
    cached: bool = False


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname.lower(), "message": record.getMessage(), **getattr(record, "fields", {})}, ensure_ascii=False)


class _Pretty(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        shown = " ".join(f"{k}={v}" for k, v in getattr(record, "fields", {}).items())
        return f"{self.formatTime(record)} {record.levelname.lower():5} {record.getMessage()} {shown}".rstrip()


def logger_of(config: Config) -> logging.Logger:
    """The engine's logger as the settings have it: JSON lines or plain ones, silent if logging is off."""
    log = logging.getLogger("rankmill.engine")
    log.handlers.clear()
    log.propagate = False
    handler: logging.Handler = logging.StreamHandler() if config["logging.enabled"] else logging.NullHandler()
    handler.setFormatter(_Pretty() if config["logging.pretty"] else _JsonLines())
    log.addHandler(handler)
    log.setLevel({"warn": "WARNING"}.get(config["logging.level"], config["logging.level"].upper()))
    return log


class Engine:
    """Batch searches over a catalog's stored index.

    normalize, lexical_search, vector_search and the rerankers are hooks: each takes and gives DataFrames and is run for its own, so
    that one that fails costs its part and not the search. models: rerankers by provider, of which the settings choose.
    """

    def __init__(
        self, spark: SparkSession, catalog: Catalog, config: Config | None = None, given: dict[str, rerankers.Reranker] | None = None,
        normalize: Callable[[DataFrame, lexical.Index], DataFrame] | None = None, lexical_search: Callable[[DataFrame], DataFrame] | None = None,
        vector_search: Callable[[DataFrame], DataFrame] | None = None, log_path: str | None = None,
    ):
        self.spark, self.catalog, self.config, self.log_path = spark, catalog, config or load(), log_path
        self.cache = ResultCache(self.config["cache.max_entries"], self.config["cache.ttl_ms"])
        self.log = logger_of(self.config)
        self._normalize, self._lexical, self._vector = normalize or self._by_settings, lexical_search or self._bm25, vector_search or self._near
        help_ = "pass the engine a model_reranker() of that name"
        self.rerankers = {"noop": rerankers.fused_order, "overlap": rerankers.overlap, **{p: models.unavailable(p, help_) for p in ("von", "cross-encoder")}, **(given or {})}
        self.reload()

    def reload(self) -> int:
        """Turns to the newest snapshot and forgets results; gives its number."""
        self.version, self.index, self.documents = self.catalog.version(), self.catalog.index(), self.catalog.documents()
        stored = self.catalog.embeddings()
        self.vectors = None if stored is None else live(stored, self.documents, self.catalog.model_version).select(F.col("product_id").alias("id"), "vector")
        if self.config["documents.preload"] and self.documents is not None:
            self.documents = self.documents.persist()
            self.index.postings = self.index.postings.persist()
            self.vectors = self.vectors.persist()
        self.cache.clear()
        return self.version

    # ---- stages

    def _by_settings(self, queries: DataFrame, index: lexical.Index) -> DataFrame:
        c = self.config
        if not c["normalization.enabled"] or c["normalization.provider"] == "none":
            return normalizer.tokenize(queries)
        typo = c["normalization.typo.enabled"]
        words = lexical.vocabulary(index.term_stats).select("term") if typo else None
        found = normalizer.normalize(queries, words)
        return found.select("query_id", F.col("normalized").alias("text"), "tokens", "codes", "corrections", "attribute_values")

    def _bm25(self, queries: DataFrame) -> DataFrame:
        c = self.config
        w, b = c["retrieval.bm25.field_weights"], c["retrieval.bm25.boosts"]
        scoring = lexical.Scoring(c["retrieval.bm25.k1"], c["retrieval.bm25.b"], tuple(float(w[f]) for f in documents.FIELDS), float(b["exact_code"]), float(b["code_prefix"]), float(b["numeric_attribute"]))
        return lexical.search(queries, self.index, c["retrieval.bm25.top_k"], scoring).select("query_id", "product_id", "score")

    def _near(self, queries: DataFrame) -> DataFrame:
        c = self.config
        texts = queries.select(F.col("query_id").alias("id"), "text")
        if self.catalog.embedder is None:
            asked = vector.hash_embed(texts, self.catalog.dimensions)
        else:
            asked = vector.embed(texts, self.catalog.embedder, self.catalog.dimensions, c["embedding.batch_size"])
        metric = c["retrieval.vector.metric"].replace("-", "_")
        hits = vector.retrieve(asked.withColumnRenamed("id", "query_id"), self.vectors, c["retrieval.vector.top_k"], c["retrieval.vector.min_score"], metric)
        return hits.select("query_id", F.col("id").alias("product_id"), "score")

    def _try(self, report: Report, stage: str, name: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        """The stage's result, computed now, or None and a degradation."""
        began = time.perf_counter()
        try:
            return kept(make())
        except AnalysisException:
            raise
        except FAILURES as error:
            told = summary(error)
            report.degradations.append(Degradation(stage, f"{name} failed: {told['message']}", told["name"]))
            self.log.error("%s failed", name, extra={"fields": {"search_id": report.search_id, "error": told["message"]}})
            return None
        finally:
            report.timings[name] = round((time.perf_counter() - began) * 1000, 1)

    def search(self, queries: DataFrame, limit: int | None = None) -> tuple[DataFrame, Report]:
        """(query_id, product_id, final_rank, final_score and the scores behind it) of queries(query_id, text), and a report.

        Null, empty and blank texts have no results; ids must differ. final_score, rrf_score and rerank_score have 6 digits.
        """
        c, report = self.config, Report(request_id())
        began = time.perf_counter()
        n = max(1, min(limit if limit is not None else c["search.default_limit"], c["search.max_limit"]))
        if self.index is None:
            return self._none(), report
        longest = c["search.max_query_length"]
        cut = queries.select("query_id", F.substring("text", 1, longest).alias("text"), (F.length("text") > longest).alias("cut"))
        asked = kept(cut)
        if (over := asked.where("cut").count()) > 0:
            report.degradations.append(Degradation("normalization", f"{over} queries truncated to {longest} characters"))
        asked = asked.drop("cut")
        normal = self._try(report, "normalization", "normalizer", lambda: self._normalize(asked, self.index))
        if normal is None:
            normal = kept(normalizer.tokenize(asked))
        wanted = normal.where(F.trim("text") != "")
        lists = {}
        for source, name, make in (("bm25", "bm25 retriever", self._lexical), ("vector", "vector retriever", self._vector)):
            if c[f"retrieval.{source}.enabled"]:
                found = self._try(report, "retrieval", name, lambda make=make: make(wanted))
                if found is not None:
                    lists[source] = found.select("query_id", F.lit(source).alias("source"), "product_id", "score")
        if not lists:
            return self._none(), report
        hits = list(lists.values())
        hits = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
        begin_fusion = time.perf_counter()
        fused = kept(ranking.fuse(ranking.rank_hits(hits), c["fusion.weights"], c["fusion.k"], c["fusion.top_k"]))
        report.timings["fusion"] = round((time.perf_counter() - begin_fusion) * 1000, 1)
        near = ranking.capped(fused, min(c["reranking.candidate_limit"], c["fusion.top_k"]))
        found, missing = ranking.hydrate(near, self.documents)
        for row in missing.select("product_id").distinct().limit(SHOWN).collect():
            report.degradations.append(Degradation("store", f"document {row['product_id']} is not stored and was left out"))
        candidates = kept(found.join(wanted.select("query_id", "text"), "query_id"))
        scored = self._rerank(candidates, report)
        ordered = ranking.weighted(scored, {("rerank" if k == "reranker" else k): w for k, w in c["ranking.weights"].items()}) if c["ranking.policy"] == "weighted" else ranking.reranker_first(scored)
        results = kept(ranking.limit(ordered, n).withColumns({s: F.round(s, 6) for s in ("final_score", "rrf_score", "rerank_score")}).drop("text", "fields"))
        report.timings["total"] = round((time.perf_counter() - began) * 1000, 1)
        report.frames = {"queries": normal, **lists, "fused": near, "candidates": candidates, "scored": scored}
        self.log.info("search complete", extra={"fields": {"search_id": report.search_id, **report.timings, "degradations": len(report.degradations)}})
        if c["logging.events.enabled"] and self.log_path:
            self._record(asked, normal, results, report)
        return results, report

    def _rerank(self, candidates: DataFrame, report: Report) -> DataFrame:
        c = self.config
        began = time.perf_counter()
        if not c["reranking.enabled"] or c["reranking.provider"] == "noop":
            return rerankers.fused_order(candidates)
        names = list(dict.fromkeys([c["reranking.provider"], *c["reranking.fallback"]]))
        scored, report.reranker, errors = rerankers.chain(candidates, {name: self.rerankers[name] for name in names})
        for told in errors:
            report.degradations.append(Degradation("reranking", f"{told}; {report.reranker} was used instead", told.split(": ")[1]))
            self.log.error("reranker failed", extra={"fields": {"search_id": report.search_id, "error": told, "used": report.reranker}})
        report.timings["reranker"] = round((time.perf_counter() - began) * 1000, 1)
        return scored

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "query_id string, product_id string, final_rank int, final_score double")

    def _record(self, asked: DataFrame, normal: DataFrame, results: DataFrame, report: Report) -> None:
        """Appends the searches to the log; a log that cannot be written does not fail them."""
        listed = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "product_id"))), lambda x: x["product_id"]).alias("result_product_ids"))
        rows = asked.join(normal.select("query_id", F.col("text").alias("normalized_query")), "query_id", "left").join(listed, "query_id", "left")
        rows = rows.select(
            F.concat(F.lit(report.search_id + "-"), F.col("query_id").cast("string")).alias("search_id"), F.col("text").alias("query"), "normalized_query",
            "result_product_ids", F.lit(report.timings["total"]).alias("latency_ms"),
        )
        try:
            logs.append_searches(rows, self.log_path)
        except FAILURES as error:
            self.log.warning("search log not written", extra={"fields": {"error": summary(error)["message"]}})

    # ---- one query

    def search_one(self, text: str | None, limit: int | None = None, use_cache: bool = True) -> tuple[list[Row], Report]:
        """Results of one text, best first. They are cached under all that decides them, unless a stage failed."""
        c = self.config
        n = max(1, min(limit if limit is not None else c["search.default_limit"], c["search.max_limit"]))
        if not isinstance(text, str) or not text.strip():
            kind = "" if isinstance(text, str) else f" ({type(text).__name__})"
            return [], Report(request_id(), degradations=[Degradation("normalization", f"no text was asked{kind}")] if kind else [])
        key = cache_key(text, n, normalizer.VERSION, self.version, self.catalog.model_version, c["reranking.provider"], c.fingerprint())
        use_cache = use_cache and c["cache.enabled"]
        if use_cache and (known := self.cache.get(key)) is not None:
            return known, Report(request_id(), cached=True)
        found, report = self.search(self.spark.createDataFrame([("1", text)], "query_id string, text string"), n)
        rows = found.orderBy("final_rank").collect()  # at most max_limit rows
        if use_cache and not report.degradations:
            self.cache.put(key, rows)
        return rows, report


def build_engine(spark: SparkSession, root: str, config: Config | None = None, embedder: vector.Embedder | None = None, **hooks) -> Engine:
    """An engine over the catalog in a folder, with the embedder that the settings name."""
    config = config or load()
    name, dim = config["embedding.provider"], config["embedding.dimensions"]
    if name == "mock" and embedder is None:
        embedder = lambda texts: [vector.mock_vector(t, dim) for t in texts]
    if name == "transformers" and embedder is None:
        from .errors import ModelUnavailableError

        raise ModelUnavailableError("the provider transformers needs an embedder", name, "pass build_engine() one")
    version = None if name == "hashing" else f"mock-d{dim}" if name == "mock" else config["embedding.model_version"]
    return Engine(spark, Catalog(spark, root, dim, embedder if name != "hashing" else None, version), config, **hooks)
