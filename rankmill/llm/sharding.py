"""Sharding by extendible hashing.

A shard owns the documents whose hash begins with its bits. The directory starts with one empty prefix; a shard over the byte
limit splits on its next bit, and only such shards do, until every shard fits. Sizes are summed once by the first CELL_BITS
bits of the hash, each cell's sum is added to every prefix of the cell, and a document's shard is its shortest prefix whose
documents fit. Cells that are themselves over the limit go on, alone, with the next bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, pack, text_or_empty, unpack

#: Bytes of a shard, hash bits looked at a round, and hash bits in all (hexadecimal digits of MD5).
LIMIT, CELL_BITS, HASH_BITS = 16 << 20, 12, 60


def _bits(key: Column) -> Column:
    """The first HASH_BITS bits of an id's hash, as binary digits; null is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def directory(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with columns id and bytes -> (deep, cell, shard, depth, shard_bytes, shard_rows): the directory, kept in the checkpoint folder.

    A document whose hash begins with cell belongs to shard, a prefix of cell. Cells have CELL_BITS bits; those that are over the
    limit alone have CELL_BITS more, and so on; deep is a cell's length.
    """
    checkpoint_dir(docs.sparkSession)
    slim = docs.select(_bits(F.col("id")).alias("__bits"), F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("__size"))
    found = None
    open_cells = None
    for deep in range(CELL_BITS, HASH_BITS + 1, CELL_BITS):
        start = deep - CELL_BITS
        rows = slim if open_cells is None else slim.join(open_cells, F.substring(slim["__bits"], 1, start) == open_cells["above"], "left_semi")
        cells = rows.groupBy(F.substring("__bits", 1, deep).alias("cell")).agg(F.sum("__size").alias("size"), F.count("*").alias("rows"))
        cells = cells.checkpoint()
        steps = cells.select("cell", "size", "rows", F.explode(F.sequence(F.lit(start), F.lit(deep))).alias("depth"))
        sums = steps.groupBy(F.expr("substring(cell, 1, depth)").alias("prefix"), "depth").agg(F.sum("size").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        good = sums.where((F.col("shard_bytes") <= limit) | ((F.col("depth") == HASH_BITS) if deep == HASH_BITS else F.lit(False)))
        # The shortest fitting prefix of each cell; prefixes below it fit too and are no shards of their own.
        on = [F.expr("substring(cell, 1, depth)") == F.col("prefix"), F.col("depth") == F.col("d")]
        best = steps.select("cell", "depth").join(good.withColumnRenamed("depth", "d"), on).groupBy("cell").agg(
            F.min(F.struct("d", "prefix", "shard_bytes", "shard_rows")).alias("best")
        )
        own = best.select(
            F.lit(deep).alias("deep"), "cell", F.col("best.prefix").alias("shard"), F.col("best.d").alias("depth"),
            F.col("best.shard_bytes").alias("shard_bytes"), F.col("best.shard_rows").alias("shard_rows"),
        )
        own = own.checkpoint()
        found = own if found is None else found.unionByName(own)
        open_cells = cells.join(own, "cell", "left_anti").select(F.col("cell").alias("above")).checkpoint()
        if deep == HASH_BITS or open_cells.isEmpty():
            break
    return found


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with columns id and bytes, and any others -> adds shard, depth, shard_bytes, shard_rows, oversize.

    shard is the prefix in binary digits, empty while everything fits one shard. A document larger than the limit, and
    documents with equal ids that are larger together, cannot be parted by any number of bits: their shard ends at
    HASH_BITS bits with oversize true. Null ids are one id; null bytes count as 0. Rows are never parted from the ids' hash,
    so reruns and repeated rows agree. An empty table gives an empty one. Other columns may have any name; one named like an
    added one is replaced.
    """
    cells = directory(docs, limit)
    levels = [r["deep"] for r in cells.select("deep").distinct().collect()]  # at most HASH_BITS / CELL_BITS
    packed, _ = pack(docs, {"__bits": _bits(F.col("id"))})
    out = None
    for level in sorted(levels) or [CELL_BITS]:
        part = cells.where(F.col("deep") == level).drop("deep")
        joined = packed.withColumn("__cell", F.substring("__bits", 1, level)).join(part, F.col("__cell") == F.col("cell"))
        out = joined if out is None else out.unionByName(joined)
    return unpack(out.withColumn("oversize", F.col("shard_bytes") > limit), docs, ["shard", "depth", "shard_bytes", "shard_rows", "oversize"])


def sharding(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, shard_rows, oversize for each row of documents, sized by its text's UTF-8 bytes.

    Null texts have 0 bytes; see shards() for null and repeated ids and empty tables. Other columns take no part.
    """
    checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("id"), F.octet_length(text_or_empty(F.col("text"))).cast("long").alias("bytes"))
    placed = shards(rows.checkpoint())
    return placed.select(
        F.col("id").alias("doc_id"), F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", "oversize"
    )


SHARDING_SQL = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), {HASH_BITS}, '0') AS bits FROM documents),
p AS (SELECT depth, substr(bits, 1, depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM d, (SELECT unnest(range(0, {HASH_BITS + 1})) AS depth) GROUP BY 1, 2),
b AS (SELECT d.doc_id, d.n_bytes, min(p.depth) AS depth, d.bits FROM d JOIN p ON p.prefix = substr(d.bits, 1, p.depth)
  WHERE p.shard_bytes <= {LIMIT} OR p.depth = {HASH_BITS} GROUP BY d.doc_id, d.n_bytes, d.bits)
SELECT b.doc_id, b.n_bytes, p.prefix AS shard, b.depth::INTEGER AS depth, p.shard_bytes, p.shard_rows, p.shard_bytes > {LIMIT} AS oversize
FROM b JOIN p ON p.depth = b.depth AND p.prefix = substr(b.bits, 1, b.depth)
"""
