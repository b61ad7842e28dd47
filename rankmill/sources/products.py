"""Product sources: JSON catalogs, table views, validation; and graded or binary relevance sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRODUCT = "product_id string, code string, name string, attributes map<string,string>, brand string, category string, subcategory string"


def clean(raw: DataFrame, quarantine: bool = False) -> DataFrame:
    """Products with absent values for empty ones; rows without an id go, or with quarantine are all that is returned."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    bad = blank("product_id").isNull()
    if quarantine:
        return raw.where(bad)
    return raw.where(~bad).select(
        "product_id", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce(F.map_filter("attributes", lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>")).alias("attributes"),
        *[blank(c).alias(c) for c in ("brand", "category", "subcategory")],
    )


def read_json_catalog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A JSON array of products with the key id or product_id.

    Attributes that are text, numbers or truth values count, as text; null and nested ones go. strict: an entry without a
    non-empty textual id, or with attributes that are no object, fails the read; else it goes, and quarantined() shows it.
    """
    raw = _raw_catalog(spark, path)
    if strict:
        told = F.concat(F.lit("catalog entry without an id or with malformed attributes: "), F.to_json(F.struct(*raw.columns)))
        raw = raw.where(F.when(_malformed(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))
    else:
        raw = raw.where(~_malformed())
    textual = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(F.col(c), "$", "string"))
    values = F.coalesce(F.try_variant_get(F.col("attributes"), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    plain = F.map_filter(values, lambda _, v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(OBJECT|ARRAY|VOID)"))
    fields = [F.coalesce(textual("id"), textual("product_id")).alias("product_id"), *[textual(c).alias(c) for c in ("code", "name", "brand", "category", "subcategory")]]
    return clean(raw.select(*fields, F.transform_values(plain, lambda _, v: v.cast("string")).alias("attributes")))


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """(entry): the JSON of the entries that a catalog's reader refuses."""
    raw = _raw_catalog(spark, path)
    return raw.where(_malformed()).select(F.to_json(F.struct(*raw.columns)).alias("entry"))


def _raw_catalog(spark: SparkSession, path: str) -> DataFrame:
    keys = ("id", "product_id", "code", "name", "attributes", "brand", "category", "subcategory")
    return spark.read.schema(", ".join(f"{k} variant" for k in keys)).option("multiLine", True).json(path)


def _malformed() -> Column:
    def blank(c: str) -> Column:
        return F.coalesce((F.schema_of_variant(c) != "STRING") | (F.try_variant_get(F.col(c), "$", "string") == ""), F.lit(True))

    return (blank("id") & blank("product_id")) | F.coalesce(~F.schema_of_variant("attributes").rlike("^(OBJECT|VOID)"), F.lit(False))


#: Ids that a database is asked for by name.
FETCH = 1000


def read_jdbc(spark: SparkSession, url: str, table: str = "products", ids: DataFrame | None = None, options: dict[str, str] | None = None, parts: int = 16, attributes: str = "CAST(attributes AS VARCHAR(65535))") -> DataFrame:
    """Products of a database table with columns id, code, name, attributes, brand, category, subcategory.

    attributes: SQL that gives the JSON text of the attributes. The table is read in parts by ranges of ids, found in a first pass
    over the ids alone, so that no query pages through it. ids: only these product_ids; up to FETCH of them go into the
    database's own query, more are joined here.
    """
    columns = f"id, code, name, {attributes} AS attributes, brand, category, subcategory"
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    some = None if ids is None else [r["product_id"] for r in ids.select("product_id").distinct().limit(FETCH + 1).collect()]
    if some is not None and len(some) <= FETCH:
        asked = f"id IN ({', '.join(map(_quoted, some))})" if some else "1 = 0"
        raw = reader.option("query", f"SELECT {columns} FROM {table} WHERE {asked}").load()
    else:
        every = reader.option("query", f"SELECT id FROM {table}").load().toDF("id")
        cuts = every.repartitionByRange(parts, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("edge"))
        edges = sorted(r["edge"] for r in cuts.collect())[1:]  # one row a part
        ranges = [" AND ".join([*([f"id >= {_quoted(low)}"] if low else []), *([f"id < {_quoted(high)}"] if high else [])]) or "1 = 1" for low, high in zip([None, *edges], [*edges, None], strict=True)]
        raw = spark.read.jdbc(url, f"(SELECT {columns} FROM {table}) t", predicates=ranges, properties=options or {})
        raw = raw if ids is None else raw.toDF(*[c.lower() for c in raw.columns]).join(ids.select(F.col("product_id").alias("id")).distinct(), "id", "left_semi")
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    return clean(raw.withColumnRenamed("id", "product_id").withColumn("attributes", F.from_json(F.col("attributes").cast("string"), "map<string,string>")))


def _quoted(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, if its files make fewer: text analysis is worth a shuffle of a small table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fetch(products: DataFrame, ids: DataFrame) -> DataFrame:
    """The products whose product_id is among the ids."""
    return products.join(ids.select("product_id").distinct(), "product_id", "left_semi")


def from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product view of the table part."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    code = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lit("D"), F.col("p_size"), F.upper(F.substring("p_name", 1, 2)), F.col("p_partkey"))
    return part.select(
        F.format_string("P%06d", "p_partkey").alias("product_id"), code.alias("code"), F.col("p_name").alias("name"),
        F.create_map(F.lit("color"), first, F.lit("diameter"), F.concat(F.col("p_size").cast("string"), F.lit(" mm"))).alias("attributes"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("subcategory"),
    )


def read_graded(spark: SparkSession, path: str) -> DataFrame:
    """(query, product_id, label, query_order) of JSON lines; blank and # lines go, the last label of a pair holds.

    Lines are in the order of their file's name, their block's place in it, and the line's place in the block.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("n"))
    lines = lines.where(~F.trim("value").rlike("^(#|$)"))
    row = F.from_json("value", "query string, productId string, product_id string, label double")
    found = lines.select("n", row.alias("r")).select("n", "r.query", F.coalesce("r.productId", "r.product_id").alias("product_id"), "r.label")
    last = found.groupBy("query", "product_id").agg(F.max_by("label", "n").alias("label"))
    return last.join(found.groupBy("query").agg(F.min("n").alias("query_order")), "query")


def write_template(queries: DataFrame, path: str) -> None:
    """One JSON line a query (column query), for labels to be filled in: {"query", "productId": "", "label": 0}."""
    queries.select("query", F.lit("").alias("productId"), F.lit(0).alias("label")).write.mode("overwrite").json(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(query, product_id, label 1.0) of a JSON array of {query, relevantProductIds}."""
    rows = spark.read.schema("query string, relevantProductIds array<string>").option("multiLine", True).json(path)
    return rows.select("query", F.explode("relevantProductIds").alias("product_id"), F.lit(1.0).alias("label")).distinct()


def gold_from_rules(products: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(query, product_id, label): rules are (query, SQL predicate over products, label); the largest label of a pair holds."""
    parts = [products.where(rule).select(F.lit(q).alias("query"), "product_id", F.lit(float(label)).alias("label")) for q, rule, label in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query", "product_id").agg(F.max("label").alias("label"))


def merge(current: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: changed rows replace or join the current ones; of changed rows with one key the last by all columns holds."""
    order = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in changed.columns if c != key and not dict(changed.dtypes)[c].startswith("map")] or [F.col(key)])
    last = changed.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return current.join(last.select(key), key, "left_anti").unionByName(last)
