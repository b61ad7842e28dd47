"""Mixing sources to target weights by Pareto order sampling over whole copies.

Each source gets a target of words. A source whose target is c times its own words gives floor(c) certain copies of each
document; the rest is a sample without repeats in which document i has inclusion probability p_i. Documents are ranked by
random odds over inclusion odds, u / (1 - u) divided by p / (1 - p), and taken in that order until the source's missing words
are reached, so the sample's size in words is fixed. Probabilities are unequal: longer documents are likelier within the bounds
that keep the expected words at the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, checkpoint_dir, pack, unpack

#: Weights of the sources in order, repeating; and the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
SEED = "mix-1"
#: Documents with this many words are midway between the least and the most likely.
MIDDLE = 256
#: Bins of the order statistic in which words are counted before any document is ranked.
BINS = 1 << 14
#: Sources up to which what is known of each is broadcast; with more, only the rows of at most so many large ones meet it so.
MANY = 20_000


def unit_random(key: Column) -> Column:
    """A number between 0 and 1, exclusive, from a hash of the key: the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds `__n`, each source's number in the order of code points, from 0, null last: ranges of sources are numbered on their own."""
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("__part").count().collect()  # one row a partition
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["__part"]):
        before[r["__part"]] = total
        total += r["count"]
    ahead = sizes.sparkSession.createDataFrame(list(before.items()), "__part int, __ahead long")
    own = Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())
    return ranged.join(F.broadcast(ahead), "__part").withColumn("__n", F.col("__ahead") + F.row_number().over(own) - 1).drop("__part", "__ahead")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) rows -> adds weight and target.

    The targets share the sum of all sizes by weight; none is above most times its source's size, and what that takes away
    is shared among the others by weight. The share per weight starts as if no source were at its limit and rises as those it
    would take beyond their limits are set to them, until no further source is: sums over all sources, at most as many rounds as
    sources that reach their limit one by one, a few in practice. Sources may be many: no task holds all of them.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__n") % len(weights)).cast("int") + 1).cast("double")
    w = _numbered(sizes).withColumn("weight", weight).withColumn("limit", (F.col("source_size") * most).cast("double")).drop("__n").checkpoint()
    total = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0]
    share, held = 0.0, -1
    while True:
        full = F.col("limit") <= F.lit(share) * F.col("weight") if held >= 0 else F.lit(False)
        # Whole numbers are summed as decimals, so that the order of a sum does not show.
        n, taken, free = w.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("limit").cast("decimal(38,0)"))), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(~full, F.col("weight").cast("decimal(38,0)"))), F.lit(0)).cast("double"),
        ).first()
        if n == held or not free:
            break
        share, held = (total - taken) / free, n
    limited = F.col("limit") <= F.lit(share) * F.col("weight")
    return w.select("source", "source_size", "weight", F.when(limited | F.lit(not free), F.col("limit")).otherwise(F.lit(share) * F.col("weight")).alias("target"))


def _with(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their source, for sources that have any. facts: `__source`, `__share` of all words, and others; kept already.

    Up to MANY sources are broadcast. With more, those with over 1 in MANY of the words are: no shuffle gathers the rows of a large
    source in one task.
    """
    if facts.limit(MANY + 1).count() <= MANY:
        return rows.join(F.broadcast(facts), rows["source"].eqNullSafe(facts["__source"])).drop("__source", "__share")
    large = F.broadcast(facts.where(F.col("__share") > 1 / MANY))  # fewer than MANY rows
    small = facts.where(F.col("__share") <= 1 / MANY)
    rest = rows.join(large, rows["source"].eqNullSafe(large["__source"]), "left_anti")
    near = rows.join(large, rows["source"].eqNullSafe(large["__source"])).drop("__source", "__share")
    return near.unionByName(rest.join(small, rest["source"].eqNullSafe(small["__source"])).drop("__source", "__share"))


def _odds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns, the order statistic `odds` (null where a document is not drawn for) and its bin."""
    row = _with(rows, plan)
    part = F.when(F.col("source_size") > 0, F.col("missing") / F.col("source_size")).otherwise(0.0)
    row = row.withColumn("part", part)
    # p = f + f (1 - f) z with z between -1 and 1 and a size-weighted mean of 0: between 0 and 1, and right in expectation.
    row = row.withColumn("p", F.col("part") * (1 + (1 - F.col("part")) * (_preference() - F.col("mean")) / 1000.0))
    row = row.withColumn("u", unit_random(F.col("id")))
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    return row.withColumn("odds", odds).withColumn("bin", F.floor(F.col("odds") / (1 + F.col("odds")) * BINS).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, counted_rows: DataFrame | None = None) -> DataFrame:
    """docs with columns id, source, size, and any others -> adds source_size, target, copies (long).

    counted_rows: the same rows' id, source and size where they are at hand, to save a pass. Rows of size 0 are never taken,
    and a source of size 0 has target 0. A null source is one source, last in order. Repeated rows count and are ranked like
    any others; of rows alike in all of id and size it doesn't matter which is taken. An empty table gives an empty one. Other
    columns may have any name; one named like an added one is replaced.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    slim = counted_rows if counted_rows is not None else docs.select("id", "source", "size").checkpoint()
    sizes = slim.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") * _preference()).cast("decimal(38,0)")).cast("double").alias("leaning")
    )
    sizes = sizes.checkpoint()
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0] or 1.0
    named = sizes.select(F.col("source").alias("__source"), "leaning")
    planned = targets(sizes.select("source", "source_size"), weights, most)
    planned = planned.join(named, planned["source"].eqNullSafe(named["__source"])).select(
        "__source", (F.col("source_size") / F.lit(total)).alias("__share"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("certain"),
        F.when(F.col("source_size") > 0, F.col("leaning") / F.col("source_size")).otherwise(0.0).alias("mean"),
    )
    plan = planned.withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))).checkpoint()
    # Words of each (source, bin) first: where a source's missing words are reached, one bin's documents are ranked.
    counted = _odds(slim, plan).where("odds is not null").groupBy("source", "missing", "bin").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows a source
    edges = counted.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    crossed = edges.where(F.col("before") + F.col("words") > F.col("missing")).groupBy("source").agg(F.min(F.struct("bin", "before")).alias("cut"))
    cuts = crossed.select(F.col("source").alias("__cut_source"), F.col("cut.bin").alias("cut"), F.col("cut.before").alias("before"))
    plan = plan.join(cuts, plan["__source"].eqNullSafe(cuts["__cut_source"]), "left").drop("__cut_source").checkpoint()
    packed, _ = pack(docs, {"id": F.col("id"), "source": F.col("source"), "size": F.col("size")})
    drawn = _odds(packed, plan)
    edge = F.coalesce(F.col("odds").isNotNull() & (F.col("bin") == F.col("cut")), F.lit(False))
    order = Window.partitionBy("source").orderBy("odds", "id", "size").rowsBetween(Window.unboundedPreceding, -1)  # one bin a source
    ranked = drawn.where(edge).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # A document that straddles the target is taken if that comes nearer to it.
    chosen = ranked.withColumn("extra", (F.col("ahead") + F.col("size") / 2 <= F.col("missing")).cast("long")).drop("ahead")
    # No cut: all that is drawn for together stays below what is missing, and goes in.
    inside = F.col("odds").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    both = drawn.where(~edge).withColumn("extra", inside.cast("long")).unionByName(chosen)
    copies = F.when(F.col("size") > 0, F.col("certain") + F.col("extra")).otherwise(0).cast("long")
    return unpack(both.withColumn("copies", copies), docs, ["source_size", "target", "copies"])


def _preference() -> Column:
    """0 to 1000, rising with a document's size: whole numbers, so that sums don't depend on their order."""
    return F.floor(F.lit(1000) * F.col("size") / (F.col("size") + MIDDLE))


def word_count(text: Column) -> Column:
    return F.size(ascii_words(text)).cast("long")


def mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of documents.

    Null and blank texts have size 0 and are never taken; null ids are drawn for as one id. See mix() for null sources, ties,
    repeated rows and empty tables. Other columns take no part.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    checkpoint_dir(docs.sparkSession)
    rows = rows.checkpoint()  # words are counted once; three narrow columns
    mixed = mix(rows, counted_rows=rows)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def sampled(docs: DataFrame) -> DataFrame:
    """The rows of documents, each as often as the mix takes it; blank texts never.

    Columns of any name and type pass through as they are. An empty table gives an empty one.
    """
    packed, _ = pack(docs, {"id": F.col("doc_id"), "source": F.col("source").cast("string"), "size": word_count(F.col("text"))})
    taken = mix(packed).where("copies > 0")
    repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unpack(repeated, docs)


MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
e AS (SELECT *, floor(1000 * size / (size + {MIDDLE}.0)) AS pref FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * pref)::DOUBLE AS leaning FROM e GROUP BY source),
n AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
        ({MOST} * source_size)::DOUBLE AS lim FROM s),
r AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM n),
f AS (SELECT share AS final FROM r WHERE share <= lim / weight ORDER BY lim / weight LIMIT 1),
t AS (SELECT *, coalesce(least(lim, (SELECT final FROM f) * weight), lim) AS target FROM r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS certain,
        CASE WHEN source_size > 0 THEN leaning / source_size ELSE 0.0 END AS mean FROM t),
q AS (SELECT *, greatest(0.0, target - certain * source_size) AS missing FROM p),
g AS (SELECT e.doc_id, e.source, e.size, q.source_size, q.target, q.certain, q.missing, e.pref, q.mean,
        CASE WHEN q.source_size > 0 THEN q.missing / q.source_size ELSE 0.0 END AS part,
        (('0x' || substr(md5('{SEED}:' || coalesce(e.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)} AS u
      FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source),
h AS (SELECT *, part * (1 + (1 - part) * (pref - mean) / 1000.0) AS p FROM g),
o AS (SELECT *, CASE WHEN p > 0 AND p < 1 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM h),
c AS (SELECT *, coalesce(sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * CASE WHEN size > 0 THEN certain + CASE WHEN odds IS NOT NULL AND ahead + size / 2.0 <= missing THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS taken
FROM c
"""
