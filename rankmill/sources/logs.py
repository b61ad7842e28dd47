"""Search logs, behaviour events, evaluation queries and settings, appended to Parquet tables.

An append writes its own files and touches no others, so writers do not meet. A log is read with one row a search id, the earliest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import nth

SEARCH_LOG = "search_id string, query string, normalized_query string, result_product_ids array<string>, selected_product_id string, latency_ms int, created_at timestamp"
EVENTS = "search_id string, event_type string, query string, product_id string, position int, payload string, created_at timestamp"
EVALUATION = "id long, query string, relevant_product_ids array<string>, notes string, created_at timestamp"
SETTINGS = "key string, value string, at timestamp"


def _append(rows: DataFrame, schema: str, path: str) -> None:
    have = dict(rows.dtypes)
    fields = [tuple(part.split(" ", 1)) for part in schema.split(", ")]
    value = lambda c, t: (F.col(c) if c in have else F.current_timestamp() if t == "timestamp" else F.lit(None)).cast(t).alias(c)
    rows.select(*[value(c, t) for c, t in fields]).write.mode("append").parquet(path)


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_searches(rows: DataFrame, path: str) -> None:
    """Adds searches; latency is rounded to whole milliseconds."""
    _append(rows.withColumn("latency_ms", F.round("latency_ms").cast("int")), SEARCH_LOG, path)


def searches(spark: SparkSession, path: str) -> DataFrame:
    """One row a search id: the one logged first; of equal times, the smallest."""
    rows = _read(spark, SEARCH_LOG, path)
    others = F.struct(*[c for c in rows.columns if c != "search_id"])
    first = rows.groupBy("search_id").agg(F.min(F.struct("created_at", others.alias("row"))).alias("m"))
    return first.select("search_id", "m.row.*")


def append_events(rows: DataFrame, path: str) -> None:
    _append(rows, EVENTS, path)


def events(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, EVENTS, path)


def save_evaluation_queries(rows: DataFrame, path: str) -> None:
    """rows: id, query, relevant_product_ids, and notes if there are any."""
    _append(rows, EVALUATION, path)


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, EVALUATION, path).orderBy("id")


def put_setting(spark: SparkSession, path: str, key: str, value) -> None:
    _append(spark.createDataFrame([(key, json.dumps(value, sort_keys=True))], "key string, value string").withColumn("at", F.current_timestamp()), SETTINGS, path)


def setting(spark: SparkSession, path: str, key: str):
    """The value put last, or None."""
    row = _read(spark, SETTINGS, path).where(F.col("key") == key).agg(F.max_by("value", "at").alias("v")).first()
    return None if row is None or row.v is None else json.loads(row.v)


def health(rows: DataFrame, since: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Searches, p50 and p90 of their latency (discrete percentiles), of logged searches after a time; by other columns, or over all."""
    recent = rows if since is None else rows.where(F.col("created_at") > since)
    keys = by or ["__all"]
    recent = recent if by else recent.withColumn("__all", F.lit(0))
    counts = recent.groupBy(*keys).agg(F.count("*").alias("searches"))
    places = nth(recent, "latency_ms", keys, {"p50": 0.5, "p90": 0.9}, discrete=True)
    return counts.join(places, keys, "left").drop("__all")


def top_queries(rows: DataFrame, since: Column | None = None, n: int = 25) -> DataFrame:
    """(query, searches): the most frequent queries of logged searches after a time, ties by query."""
    recent = rows if since is None else rows.where(F.col("created_at") > since)
    return recent.groupBy("query").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "query").limit(n)
