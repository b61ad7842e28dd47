"""Incremental maintenance on versioned Parquet snapshots, and the merge operators behind it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..sources.products import PRODUCT, merge
from . import documents, lexical, vector
from .lineage import kept


def stale(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored documents that the source no longer has."""
    return stored.join(seen.select("product_id").distinct(), "product_id", "left_anti")


def embedding_plan(docs: DataFrame, embeddings: DataFrame, model_version: str) -> DataFrame:
    """docs -> adds reuse: an embedding of this model and of this document's hash is stored."""
    meta = embeddings.select("product_id", F.col("model_version").alias("__m"), F.col("document_hash").alias("__h"))
    same = (F.col("__m") == model_version) & (F.col("__h") == F.col("document_hash"))
    return docs.join(meta, "product_id", "left").withColumn("reuse", F.coalesce(same, F.lit(False))).drop("__m", "__h")


def live(embeddings: DataFrame, docs: DataFrame, model_version: str | None = None) -> DataFrame:
    """Embeddings of documents that are there, and of one model if it is named: what a search may look at."""
    own = embeddings if model_version is None else embeddings.where(F.col("model_version") == model_version)
    return own.join(docs.select("product_id"), "product_id", "left_semi")


@dataclass(frozen=True)
class IndexEvent:
    """What a change of the catalog did."""

    operation: str
    version: int
    upserted: int = 0
    deleted: int = 0
    embedded: int = 0
    reused: int = 0


#: Parts that products are dealt to by a hash of their id; a change rewrites the parts that it touches.
BUCKETS = 16
#: Stored tables.
SCHEMAS = {
    "documents": PRODUCT + ", search_document string, builder_version string, document_hash string, fields array<string>",
    "embeddings": "product_id string, vector array<double>, model_version string, document_hash string",
    "postings": "term string, product_id string, " + ", ".join(f"{c}_{k} int" for c in ("tf", "len") for k in range(5)),
}


def bucket_of(product_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(product_id), F.lit(buckets)).cast("int")


class Catalog:
    """Documents, embeddings and the lexical index as snapshots `v1`, `v2`, …; the newest complete one is current.

    Products are dealt to buckets by a hash of their id. A snapshot writes the buckets that its change touches, documents, embeddings
    and postings, and a manifest that says for each bucket which snapshot holds it; document frequencies are carried on by what the
    touched buckets had and have. A snapshot counts once its `done` folder is there, so readers never see half of it. Its
    folder is claimed before it is written: of two writers the second gets a StoreError, and release() frees what a writer that
    died has claimed. Paths go through Spark's file systems only.
    """

    def __init__(self, spark: SparkSession, root: str, dimensions: int = vector.DIMENSIONS, embedder: vector.Embedder | None = None, model_version: str | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.dimensions, self.embedder, self.buckets = spark, root.rstrip("/"), dimensions, embedder, buckets
        self.model_version = model_version or f"hashing-d{dimensions}-v1"
        if (old := self.embeddings()) is not None:
            other = old.where((F.col("model_version") == self.model_version) & (F.size("vector") != dimensions)).first()
            if other is not None:
                raise StoreError(f"stored vectors of {self.model_version} have {len(other['vector'])} dimensions, not {dimensions}")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The current snapshot's number; 0 without one."""
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{self.root}/{n}/done"))], default=0)

    def _claim(self, v: int) -> None:
        fs, path = self._fs()
        try:
            fs.create(path(f"{self.root}/v{v}/claim"), False).close()
        except Py4JJavaError as taken:
            raise StoreError(f"snapshot v{v} is being written by another, or was left by one that died: see release()") from taken

    def release(self) -> None:
        """Removes the snapshot after the current one, which a writer claimed and did not finish."""
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/v{self.version() + 1}"), True)

    def _manifest(self) -> dict[int, int]:
        """bucket -> snapshot that holds it."""
        v = self.version()
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.root}/v{v}/manifest").collect()} if v else {}  # one row a bucket

    def _table(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """A table of the current snapshot, of some buckets or all."""
        held = {b: v for b, v in self._manifest().items() if buckets is None or b in buckets}
        if not held:
            return None
        paths = [f"{self.root}/v{v}/{name}/bucket={b}" for b, v in sorted(held.items())]
        fs, path = self._fs()
        there = [p for p in paths if fs.exists(path(p))]  # a bucket may be empty
        return self.spark.read.schema(SCHEMAS[name]).parquet(*there) if there else self.spark.createDataFrame([], SCHEMAS[name])

    def documents(self) -> DataFrame | None:
        return self._table("documents")

    def embeddings(self) -> DataFrame | None:
        return self._table("embeddings")

    def get(self, ids: DataFrame) -> DataFrame | None:
        """The documents of some ids (product_id)."""
        docs = self.documents()
        return None if docs is None else docs.join(ids.select("product_id").distinct(), "product_id", "left_semi")

    def iterate(self) -> Iterator[Row]:
        """Documents one by one in the order of their ids."""
        docs = self.documents()
        return iter(()) if docs is None else docs.orderBy("product_id").toLocalIterator()

    def count(self) -> int:
        docs = self.documents()
        return 0 if docs is None else docs.count()

    def count_embeddings(self, model_version: str | None = None) -> int:
        """Vectors of a model, this catalog's if none is named."""
        stored = self.embeddings()
        return 0 if stored is None else stored.where(F.col("model_version") == (model_version or self.model_version)).count()

    def index(self) -> lexical.Index | None:
        """The current snapshot's lexical index, as it is stored."""
        v = self.version()
        if not v:
            return None
        read = self.spark.read
        return lexical.Index(self._table("postings"), read.parquet(f"{self.root}/v{v}/stats"), read.parquet(f"{self.root}/v{v}/corpus"), lexical.codes_of(self.documents()))

    def _embedded(self, texts: DataFrame) -> DataFrame:
        return vector.hash_embed(texts, self.dimensions) if self.embedder is None else vector.embed(texts, self.embedder, self.dimensions)

    def _write(self, table: DataFrame, path: str, order: str) -> None:
        """One file a bucket, sorted, so that readers of some rows skip most of it."""
        parts = table.withColumn("bucket", bucket_of(F.col("product_id"), self.buckets)).repartition(self.buckets, "bucket")
        parts.sortWithinPartitions("bucket", order).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _read(self, at: str, name: str) -> DataFrame:
        """What _write() has written, buckets aside."""
        return self.spark.read.schema(SCHEMAS[name] + ", bucket int").parquet(f"{at}/{name}").drop("bucket")

    def _publish(self, operation: str, touched: DataFrame, buckets: set[int], removed: int, upserted: int, reuse: bool = True) -> IndexEvent:
        """Writes the next snapshot. touched: all documents that the buckets hold from now on."""
        base = self.version()
        v = base + 1
        self._claim(v)
        manifest = {**self._manifest(), **dict.fromkeys(buckets, v)}
        at = f"{self.root}/v{v}"
        self._write(touched, f"{at}/documents", "product_id")
        docs = self._read(at, "documents")
        old = self._table("embeddings", buckets) if reuse else None
        old = self.spark.createDataFrame([], SCHEMAS["embeddings"]) if old is None else old
        plan = kept(embedding_plan(docs, old, self.model_version).select("product_id", "document_hash", "search_document", "reuse"))
        fresh = self._embedded(plan.where("not reuse").select(F.col("product_id").alias("id"), F.col("search_document").alias("text")))
        made = fresh.withColumnRenamed("id", "product_id").join(docs.select("product_id", "document_hash"), "product_id")
        made = made.select("product_id", "vector", F.lit(self.model_version).alias("model_version"), "document_hash")
        same = old.join(plan.where("reuse").select("product_id"), "product_id", "left_semi")
        self._write(vector.checked(made, self.dimensions).unionByName(same), f"{at}/embeddings", "product_id")
        self._write(lexical.postings_of(docs), f"{at}/postings", "term")
        self._statistics(at, base, buckets, docs)
        rows = [(b, w) for b, w in sorted(manifest.items())]
        self.spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")
        counts = {r["reuse"]: r["count"] for r in plan.groupBy("reuse").count().collect()}
        self.spark.range(1).write.mode("overwrite").parquet(f"{at}/done")
        return IndexEvent(operation, v, upserted, removed, counts.get(False, 0), counts.get(True, 0))

    def _statistics(self, at: str, base: int, buckets: set[int], docs: DataFrame) -> None:
        """Document frequencies and field sums: those of the snapshot before, less what the buckets had, and what they have."""
        new = self._read(at, "postings")
        change = lexical.stats_of(new)
        sums = _field_sums(docs, new)
        if base and (had := self._table("postings", buckets)) is not None:
            change = change.unionByName(lexical.stats_of(had).withColumn("df", -F.col("df")))
            sums = sums.unionByName(_field_sums(self._table("documents", buckets), had).select(*[(-F.col(c)).alias(c) for c in sums.columns]))
        if base:
            change = change.unionByName(self.spark.read.parquet(f"{self.root}/v{base}/stats"))
            sums = sums.unionByName(self.spark.read.parquet(f"{self.root}/v{base}/corpus").select(*sums.columns))
        stats = change.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        stats.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/stats")
        total = sums.agg(*[F.sum(c).alias(c) for c in sums.columns])
        means = [F.when(F.col(f"docs_{k}") > 0, F.col(f"sum_{k}") / F.col(f"docs_{k}")).otherwise(0.0).alias(f"avg_{k}") for k in range(5)]
        total.select("*", *means).write.mode("overwrite").parquet(f"{at}/corpus")

    def _touched(self, ids: DataFrame) -> set[int]:
        return {r["b"] for r in ids.select(bucket_of(F.col("product_id"), self.buckets).alias("b")).distinct().collect()}  # at most as many as buckets

    def _built(self, products: DataFrame) -> DataFrame:
        names = [part.split(" ", 1)[0] for part in SCHEMAS["documents"].split(", ")]
        return kept(documents.build(products).dropDuplicates(["product_id"]).select(*names))

    def upsert(self, products: DataFrame) -> IndexEvent:
        """Adds or replaces products; embeddings are made only where the document's hash changed. Of rows with one id one counts."""
        new = self._built(products)
        buckets = self._touched(new)
        current = self._table("documents", buckets)
        docs = new if current is None else merge(current, new, "product_id")
        return self._publish("upsert", docs, buckets, 0, new.count())

    def delete(self, ids: DataFrame) -> IndexEvent:
        """Removes products, their embeddings and postings; counts those that were there."""
        current = self.documents()
        if current is None:
            return IndexEvent("delete", 0)
        gone = kept(current.select("product_id").join(ids.select("product_id").distinct(), "product_id", "left_semi"))
        buckets = self._touched(gone)
        if not buckets:
            return IndexEvent("delete", self.version())
        left = self._table("documents", buckets).join(gone, "product_id", "left_anti")
        return self._publish("delete", left, buckets, gone.count(), 0)

    def delete_embeddings(self, ids: DataFrame) -> IndexEvent:
        """Removes the vectors of some products, which stay; the next change of their buckets makes new ones."""
        stored = self.embeddings()
        if stored is None:
            return IndexEvent("delete_embeddings", self.version())
        gone = kept(stored.select("product_id").join(ids.select("product_id").distinct(), "product_id", "left_semi"))
        buckets = self._touched(gone)
        if not buckets:
            return IndexEvent("delete_embeddings", self.version())
        base = self.version()
        self._claim(base + 1)
        at = f"{self.root}/v{base + 1}"
        for name, order in (("documents", "product_id"), ("postings", "term")):
            self._write(self._table(name, buckets), f"{at}/{name}", order)
        self._write(self._table("embeddings", buckets).join(gone, "product_id", "left_anti"), f"{at}/embeddings", "product_id")
        for name in ("stats", "corpus"):
            self.spark.read.parquet(f"{self.root}/v{base}/{name}").write.mode("overwrite").parquet(f"{at}/{name}")
        rows = sorted({**self._manifest(), **dict.fromkeys(buckets, base + 1)}.items())
        self.spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")
        self.spark.range(1).write.mode("overwrite").parquet(f"{at}/done")
        return IndexEvent("delete_embeddings", base + 1, deleted=gone.count())

    def rebuild(self, products: DataFrame, drop_first: bool = False) -> IndexEvent:
        """The catalog becomes exactly these products. drop_first: no stored embedding is used again."""
        new = self._built(products)
        current = self.documents()
        removed = 0 if current is None else stale(current, new).count()
        return self._publish("rebuild", new, set(range(self.buckets)) | set(self._manifest()), removed, new.count(), reuse=not drop_first)


def _field_sums(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents, and for each field the documents that have it and their terms in all."""
    lengths = postings.groupBy("product_id").agg(*[F.first(f"len_{k}").alias(f"len_{k}") for k in range(5)])
    parts = [F.count_if(F.col(f"len_{k}") > 0).cast("long").alias(f"docs_{k}") for k in range(5)]
    parts += [F.coalesce(F.sum(f"len_{k}"), F.lit(0)).cast("long").alias(f"sum_{k}") for k in range(5)]
    return docs.agg(F.count("*").cast("long").alias("n")).join(F.broadcast(lengths.agg(*parts)), F.lit(True))  # one row each
