"""Retrieval metrics over results(query_id, product_id, rank) and gold(query_id, product_id, label), and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import kept


def per_query(results: DataFrame, gold: DataFrame, k: int = 10, threshold: float = 1.0) -> DataFrame:
    """(query_id, recall, mrr, ndcg) at k for each query of gold; queries without a result score 0."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("label"), "product_id")
    gain = lambda c: F.pow(F.lit(2.0), F.col(c)) - 1
    best = gold.where("label > 0").withColumn("place", F.row_number().over(ideal)).where(F.col("place") <= k)
    best = best.groupBy("query_id").agg(F.sum(gain("label") / F.log2(F.col("place") + 1)).alias("idcg"))
    totals = gold.groupBy("query_id").agg(F.count_if(F.col("label") >= threshold).alias("relevant"))
    hits = results.where(F.col("rank") <= k).join(gold, ["query_id", "product_id"]).groupBy("query_id").agg(
        F.count_if(F.col("label") >= threshold).alias("found"), F.min(F.when(F.col("label") >= threshold, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("label") > 0, gain("label") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    joined = totals.join(hits, "query_id", "left").join(best, "query_id", "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0)
    return joined.select(
        "query_id", share("found", "relevant").cast("double").alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).cast("double").alias("mrr"),
        share("dcg", "idcg").cast("double").alias("ndcg"),
    )


def summary(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20), threshold: float = 1.0) -> DataFrame:
    """One row: recall at each k, mrr at 10, ndcg at 10, queries."""
    row = None
    for k in ks:
        m = per_query(results, gold, k, threshold)
        cols = [F.avg("recall").alias(f"recall_at_{k}")]
        if k == 10:
            cols += [F.avg("mrr").alias("mrr_at_10"), F.avg("ndcg").alias("ndcg_at_10"), F.count("*").alias("queries")]
        one = m.agg(*cols)
        row = one if row is None else row.join(F.broadcast(one), F.lit(True))  # one row each
    return row


def coverage(results: DataFrame, gold: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Share of gold's queries with a relevant candidate."""
    found = results.join(gold.where(F.col("label") >= threshold), ["query_id", "product_id"], "left_semi").select("query_id").distinct()
    every = gold.select("query_id").distinct().join(found.withColumn("hit", F.lit(1.0)), "query_id", "left")
    return every.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 3).alias("coverage"))


#: Ranges of values that a group's samples are counted in before any are ordered, and groups up to which their edges are broadcast.
RANGES, GROUPS = 256, 20_000


def nth(samples: DataFrame, value: str, by: list[str], shares: dict[str, float], discrete: bool = False) -> DataFrame:
    """Percentiles without interpolation: the value at place floor(share * n), from 0, at most the last, in rising order.

    discrete: at place ceil(share * n) - 1 instead, as percentile_disc has it. Samples are counted in RANGES ranges of about equal
    numbers a group first; only the ranges that hold a wanted place are ordered, by counts of equal values, so that no task
    orders a whole group.
    """
    full = samples.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    cuts = F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], 4 * RANGES)
    edges = kept(full.groupBy(*by).agg(F.array_distinct(cuts).alias("__cuts"), F.count("*").alias("__n")))
    named = edges.withColumnsRenamed({c: f"__by_{c}" for c in by})
    few = edges.limit(GROUPS + 1).count() <= GROUPS
    counts = full.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    on = F.lit(True)
    for c in by:
        on = on & counts[c].eqNullSafe(named[f"__by_{c}"])
    ranged = counts.join(F.broadcast(named) if few else named, on).drop(*[f"__by_{c}" for c in by])
    ranged = ranged.withColumn("__r", F.size(F.filter("__cuts", lambda x: x < F.col("__v")))).drop("__cuts")
    sums = ranged.groupBy(*by, "__n", "__r").agg(F.sum("__c").alias("__s"))
    ahead = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__s").over(ahead), F.lit(0)))
    place = (lambda p: F.greatest(F.ceil(F.lit(p) * F.col("__n")) - 1, F.lit(0))) if discrete else (lambda p: F.least(F.col("__n") - 1, F.floor(F.lit(p) * F.col("__n"))))
    wanted = F.lit(False)
    for p in shares.values():
        wanted = wanted | ((F.col("__ahead") <= place(p)) & (place(p) < F.col("__ahead") + F.col("__s")))
    sums = sums.where(wanted).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__r").alias("__range"), "__ahead")
    on = F.col("__r") == F.col("__range")
    for c in by:
        on = on & ranged[c].eqNullSafe(sums[f"__by_{c}"])
    inside = ranged.join(sums, on).drop("__range", *[f"__by_{c}" for c in by])
    within = Window.partitionBy(*by, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = inside.withColumn("__u", F.col("__ahead") + F.sum("__c").over(within))
    # The first value whose running count passes the place; ranges before it are not there, those after it hold larger values.
    held = lambda p: (F.col("__u") > place(p)) & (F.col("__u") - F.col("__c") <= place(p))
    return upto.groupBy(*by).agg(*[F.min(F.when(held(p), F.col("__v"))).alias(name) for name, p in shares.items()])


def latency_summary(samples: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50, p90, p99, mean, min, max, and queries a second of a latency in milliseconds."""
    mean: Column = F.avg(value)
    simple = samples.groupBy(*by).agg(mean.alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.when(mean > 0, 1000 / mean).otherwise(0.0).alias("qps"))
    return simple.join(nth(samples, value, by, {"p50": 0.5, "p90": 0.9, "p99": 0.99}), by)


def bottleneck(stages: DataFrame) -> DataFrame:
    """(run, stage, ms) samples -> (run, bottleneck, mean_ms): the stage with the largest mean of each run, ties by name."""
    means = stages.groupBy("run", "stage").agg(F.avg("ms").alias("mean_ms"))
    best = means.groupBy("run").agg(F.min_by(F.struct("stage", "mean_ms"), F.struct(-F.col("mean_ms"), F.col("stage"))).alias("b"))
    return best.select("run", F.col("b.stage").alias("bottleneck"), F.col("b.mean_ms").alias("mean_ms"))
