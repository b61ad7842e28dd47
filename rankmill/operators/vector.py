"""Vector retrieval: hashed text embeddings and exact top-k by matrix products."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyze
from ..functions.vectors import cosine, feature_index, feature_sign, is_finite, trigrams
from .lineage import dealt

DIMENSIONS, TOP_K, MIN_SCORE, TRIGRAM_WEIGHT, VARIANT_TF = 384, 50, 0.15, 0.3, 0.5
#: Bytes of query vectors that go to the executors at a time; the vectors are scanned once for each such block.
QUERY_BYTES = 64 << 20
#: Scores that a task computes at a time.
TILE = 1 << 22


def hash_features(texts: DataFrame, dim: int = DIMENSIONS) -> DataFrame:
    """texts(id, text) -> (id, feature, weight, idx, sign): terms by sublinear frequency, letter trigrams; `e:empty` where neither is.

    Texts are dealt by id before they are taken apart, and all features of a text are one array: nothing is shuffled after that.
    """
    t = dealt(texts.select("id", "text"), "id").select("id", analyze(F.col("text")).alias("terms"))
    one = lambda name, n: F.struct(name.alias("feature"), n.alias("n"))
    terms = F.transform("terms", lambda x: one(F.concat(F.lit("t:"), x["term"]), F.when(x["is_variant"], VARIANT_TF).otherwise(1.0)))
    grams = F.transform(trigrams(F.transform("terms", lambda x: x["term"])), lambda g: one(F.concat(F.lit("g:"), g), F.lit(1.0)))
    every = F.when(F.size("terms") == 0, F.concat(F.array(one(F.lit("e:empty"), F.lit(1.0))), grams)).otherwise(F.concat(terms, grams))
    summed = t.select("id", F.explode(every).alias("f")).groupBy("id", "f.feature").agg(F.sum("f.n").alias("n"))
    weight = F.when(F.col("feature").startswith("t:"), 1 + F.log("n")).when(F.col("feature").startswith("g:"), F.col("n") * TRIGRAM_WEIGHT).otherwise(F.lit(1.0))
    found = summed.select("id", "feature", weight.alias("weight"))
    return found.withColumns({"idx": feature_index(F.col("feature"), dim), "sign": feature_sign(F.col("feature"))})


def hash_embed(texts: DataFrame, dim: int = DIMENSIONS) -> DataFrame:
    """texts(id, text) -> (id, vector): unit vectors of the hashed features, as array<double> of dim numbers."""
    sums = hash_features(texts, dim).groupBy("id", "idx").agg(F.sum(F.col("sign") * F.col("weight")).alias("v"))
    rows = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("n") > 0, F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("n")).otherwise(0.0))
    return rows.select("id", at.alias("vector"))


def _query_blocks(queries: DataFrame, metric: str) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of about QUERY_BYTES of query vectors by their length: (ids, matrix). Only one block is on the driver at a time."""
    found: dict[int, tuple[list, list]] = {}
    size = 0
    for row in queries.toLocalIterator(prefetchPartitions=False):
        v = np.asarray(row["vector"], np.float64)
        ids, rows = found.setdefault(len(v), ([], []))
        ids.append(row["query_id"])
        rows.append(v)
        size += v.nbytes + 64
        if size >= QUERY_BYTES:
            yield {n: (np.array(i), _unit(np.stack(m), metric)) for n, (i, m) in found.items()}
            found, size = {}, 0
    yield {n: (np.array(i), _unit(np.stack(m), metric)) for n, (i, m) in found.items()}


class _Best:
    """The k best (score, id) of each query so far, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0)] * queries, [np.zeros(0, object)] * queries
        self.floor = np.full(queries, -np.inf)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (queries from first on, ids)."""
        for q in np.flatnonzero(scores.max(1) >= self.floor[first : first + len(scores)]) + first:
            fine = scores[q - first] >= self.floor[q]
            s, i = np.concatenate((self.scores[q], scores[q - first][fine])), np.concatenate((self.ids[q], ids[fine]))
            if len(s) > self.k:
                edge = np.partition(s, len(s) - self.k)[len(s) - self.k]
                over = np.flatnonzero(s > edge)
                even = np.flatnonzero(s == edge)
                even = even[np.argsort(i[even], kind="stable")[: self.k - len(over)]]
                both = np.concatenate((over, even))
                s, i = s[both], i[both]
                self.floor[q] = edge
            self.scores[q], self.ids[q] = s, i


def top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, metric: str = "cosine", digits: int = 9) -> DataFrame:
    """queries(query_id, vector) against vectors(id, vector) -> (query_id, id, score, rank), best first, ties by id; exact.

    Vectors of another length than the query's are skipped, as null ones are; a zero vector has cosine 0. Queries go to the
    executors in blocks of QUERY_BYTES; the vectors are read once a block, batch by batch as matrix products, and each task gives
    its own k best of each query.
    """
    kind = dict(vectors.dtypes)["id"]
    qkind = dict(queries.dtypes)["query_id"]
    spark = queries.sparkSession
    out = None
    for block in _query_blocks(queries.where("vector is not null").select("query_id", "vector"), metric):
        shared = spark.sparkContext.broadcast(block)  # about QUERY_BYTES

        def local(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best = {n: _Best(len(ids), k) for n, (ids, _) in shared.value.items()}
            for frame in frames:
                size = frame["vector"].map(len)
                for n, (ids, matrix) in shared.value.items():
                    own = frame[size == n]
                    if not len(own):
                        continue
                    names = own["id"].to_numpy(dtype=object)
                    given = _unit(np.stack(own["vector"].to_list()).astype(np.float64), metric).T
                    step = max(1, TILE // len(own))
                    for low in range(0, len(ids), step):
                        best[n].add(low, np.round(matrix[low : low + step] @ given, digits), names)
            for n, (ids, _) in shared.value.items():
                for low in range(0, len(ids), 1000):
                    some = range(low, min(low + 1000, len(ids)))
                    yield pd.DataFrame({
                        "query_id": np.repeat(ids[low : low + 1000], [len(best[n].ids[q]) for q in some]),
                        "id": np.concatenate([best[n].ids[q] for q in some]), "score": np.concatenate([best[n].scores[q] for q in some]),
                    })

        part = vectors.where("vector is not null").select("id", "vector").mapInPandas(local, f"query_id {qkind}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def retrieve(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE, metric: str = "cosine") -> DataFrame:
    """top_k, then only scores of min_score or more."""
    return top_k(queries, vectors, k, metric).where(F.col("score") >= min_score)


def checked(vectors: DataFrame, dim: int) -> DataFrame:
    """The same rows; fails where a vector has another length or a value that is not finite."""
    fine = (F.size("vector") == dim) & is_finite(F.col("vector"))
    return vectors.withColumn("vector", F.when(fine, F.col("vector")).otherwise(F.raise_error(F.lit("vector of wrong length or with a value that is not finite"))))


#: Texts -> vectors: a hook for embedders. Takes a list of texts, gives as many vectors.
Embedder = Callable[[list[str]], list[list[float]]]


def embed(texts: DataFrame, embedder: Embedder, dim: int, batch: int = 64) -> DataFrame:
    """texts(id, text) -> (id, vector) by a model's hook, in batches; null texts are empty. Vectors of another length are refused."""
    kind = dict(texts.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), batch):
                part = frame.iloc[low : low + batch]
                yield pd.DataFrame({"id": part["id"], "vector": [list(map(float, v)) for v in embedder(part["text"].fillna("").to_list())]})

    return checked(texts.select("id", "text").mapInPandas(run, f"id {kind}, vector array<double>"), dim)


def mock_vector(text: str, dim: int = 8, fixtures: dict[str, list[float]] | None = None) -> list[float]:
    """A stand-in for tests: a unit vector drawn from a generator that the text's UTF-16 units seed, or the text's own fixture.

    The generator is xorshift with shifts of 13, 17 and 5 bits over 32.
    """
    if fixtures and text in fixtures:
        return list(fixtures[text])
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    state = reduce(lambda seed, unit: (seed * 31 + int(unit)) % 2**32, units, 0) or 1
    values = []
    for _ in range(dim):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        values.append((state % 2000 - 1000) / 1000)
    size = math.sqrt(sum(x * x for x in values)) or 1.0
    return [x / size for x in values]


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, tables: int = 8, bits: int = 6, seed: int = 7) -> DataFrame:
    """top_k by cosine among vectors that share a sign pattern of bits random planes with the query in one of so many tables.

    An index for many vectors: candidates meet on (table, pattern) by a join, and are scored exactly. What no table brings near is
    missed; recall against top_k says how much. Patterns of one bit less are asked too, one flipped at a time.
    """
    first = vectors.where("vector is not null").select(F.size("vector").alias("n")).first()
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, bits, first["n"] if first else 1)).round(4)
    weights = (1 << np.arange(bits)).astype(np.int64)

    def patterns(rows: DataFrame, flips: bool) -> DataFrame:
        kind = dict(rows.dtypes)["id"]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                m = np.stack(frame["vector"].to_list()).astype(np.float64)
                code = (np.einsum("tbn,rn->rtb", planes, m) > 0).astype(np.int64) @ weights
                every = [code] + [code ^ w for w in weights] * flips
                cells = np.concatenate([c + (np.arange(tables) << bits) for c in every], axis=1)
                yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(), cells.shape[1]), "cell": cells.ravel()})

        return rows.where("vector is not null").select("id", "vector").mapInPandas(run, f"id {kind}, cell long")

    asked = patterns(queries.withColumnRenamed("query_id", "id"), True).withColumnRenamed("id", "query_id")
    near = asked.join(patterns(vectors, False), "cell").select("query_id", "id").distinct()
    scored = near.join(queries.select("query_id", F.col("vector").alias("__q")), "query_id").join(vectors.select("id", "vector"), "id")
    scored = scored.select("query_id", "id", F.round(cosine(F.col("__q"), F.col("vector")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
