"""Field-weighted BM25 over an inverted index held in DataFrames, with product-code and numeric signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyze, analyze_code, canonical_code
from .lineage import dealt, kept

K1, B, TOP_K = 1.2, 0.75, 50
#: By field: code, name, attributes, brand, category.
WEIGHTS = (4.0, 2.0, 1.5, 1.0, 1.0)
EXACT, PREFIX, NUMERIC = 25.0, 8.0, 2.0
NUMERIC_TERM = r"^[0-9]+(\.[0-9]+)?(x[0-9]+(\.[0-9]+)?)?$"
#: Ranks are given on scores rounded to so many digits, so that the order of a sum cannot change them.
RANK_DIGITS = 9
#: Query terms up to which they are broadcast, and the parts that each term's postings are dealt to beyond that.
BROADCAST_TERMS, TERM_PARTS = 200_000, 32
#: Codes given to a normalizer at most.
CODES_LIMIT = 50_000


@dataclass(frozen=True)
class Scoring:
    """What decides a lexical score; weights by field as in WEIGHTS."""

    k1: float = K1
    b: float = B
    weights: tuple[float, ...] = WEIGHTS
    exact: float = EXACT
    prefix: float = PREFIX
    numeric: float = NUMERIC


@dataclass
class Index:
    """postings(term, product_id, tf_0..tf_4, len_0..len_4), term_stats(term, df), corpus(n, avg_0..avg_4), codes(canonical_code, product_id)."""

    postings: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    codes: DataFrame


def occurrences(docs: DataFrame) -> DataFrame:
    """(product_id, field, pos, term, kind, is_variant) of built search documents."""
    lists = F.array(analyze_code(F.col("fields")[0]), *[analyze(F.col("fields")[k], stopwords=True) for k in range(1, 5)])
    by_field = docs.select("product_id", F.posexplode(lists).alias("field", "terms"))
    return by_field.select("product_id", "field", F.posexplode("terms").alias("pos", "t")).select("product_id", "field", "pos", "t.*")


def term_frequencies(found: DataFrame) -> DataFrame:
    """(product_id, field, term, tf): real occurrences, and one more where the first occurrence is a variant."""
    real, lead = F.count_if(~F.col("is_variant")), F.min_by("is_variant", "pos").cast("int")
    return found.groupBy("product_id", "field", "term").agg((real + lead).cast("int").alias("tf"))


def field_lengths(found: DataFrame) -> DataFrame:
    return found.groupBy("product_id", "field").agg(F.count("*").alias("length"))


def average_lengths(lengths: DataFrame) -> DataFrame:
    """(field, avg_length) over the documents that have the field."""
    return lengths.groupBy("field").agg(F.avg("length").alias("avg_length"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.select("term", "product_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def postings_of(docs: DataFrame) -> DataFrame:
    """(term, product_id, tf_0..tf_4, len_0..len_4): everything of a document is summed by (document, term), then by document beside it."""
    found = occurrences(dealt(docs.select("product_id", "fields"), "product_id"))
    tf = term_frequencies(found)
    wide = tf.groupBy("product_id", "term").agg(*[F.sum(F.when(F.col("field") == k, F.col("tf")).otherwise(0)).cast("int").alias(f"tf_{k}") for k in range(5)])
    lengths = found.groupBy("product_id").agg(*[F.count_if(F.col("field") == k).cast("int").alias(f"len_{k}") for k in range(5)])
    return wide.join(lengths, "product_id").select("term", "product_id", *[f"{c}_{k}" for c in ("tf", "len") for k in range(5)])


def stats_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents, and each field's mean length over the documents that have it."""
    lengths = postings.groupBy("product_id").agg(*[F.first(f"len_{k}").alias(f"len_{k}") for k in range(5)])
    means = lengths.agg(*[F.coalesce(F.avg(F.when(F.col(f"len_{k}") > 0, F.col(f"len_{k}"))), F.lit(0.0)).alias(f"avg_{k}") for k in range(5)])
    return docs.agg(F.count("*").alias("n")).join(F.broadcast(means), F.lit(True))  # one row each


def codes_of(docs: DataFrame) -> DataFrame:
    return docs.select(canonical_code(F.col("fields")[0]).alias("canonical_code"), "product_id").where("canonical_code <> ''")


def build_index(docs: DataFrame) -> Index:
    """The index of built search documents. Postings are computed once and kept: statistics and searches read them again and again."""
    postings = kept(postings_of(docs))
    return Index(postings, stats_of(postings), kept(corpus_of(docs, postings)), codes_of(docs))


def vocabulary(term_stats: DataFrame, limit: int = 10_000) -> DataFrame:
    """Terms of three characters or more, with a letter, in two documents or more; the most frequent ones."""
    kept = term_stats.where((F.col("df") >= 2) & (F.length("term") >= 3) & F.col("term").rlike("[a-z]"))
    return kept.orderBy(F.desc("df"), "term").limit(limit)


def code_list(index: Index, limit: int = CODES_LIMIT) -> DataFrame:
    """(canonical_code): distinct codes in order, at most limit."""
    return index.codes.select("canonical_code").distinct().orderBy("canonical_code").limit(limit)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, is_numeric) of queries(query_id, tokens)."""
    token = queries.select("query_id", F.explode("tokens").alias("token"))
    mixed = F.col("token").rlike("[a-z]") & F.col("token").rlike("[0-9]")
    terms = F.concat(analyze(F.col("token"), stopwords=True), F.when(mixed, analyze_code(F.col("token"))).otherwise(F.array().cast("array<struct<term:string,kind:string,is_variant:boolean>>")))
    found = token.select("query_id", F.explode(terms).alias("t")).select("query_id", F.col("t.term").alias("term")).distinct()
    return found.withColumn("is_numeric", F.col("term").rlike(NUMERIC_TERM))


def query_codes(queries: DataFrame) -> DataFrame:
    """(query_id, code): the queries' codes, and their tokens of four characters or more with a letter and a digit."""
    shaped = F.filter("tokens", lambda t: (F.length(t) >= 4) & t.rlike("[a-z]") & t.rlike("[0-9]"))
    codes = F.array_union(F.transform("codes", canonical_code), F.transform(shaped, canonical_code))
    return queries.select("query_id", F.explode(codes).alias("code")).distinct()


def exact_codes(codes: DataFrame, index: Index) -> DataFrame:
    """(query_id, code, product_id) of equal canonical codes."""
    return codes.join(index.codes, F.col("code") == F.col("canonical_code")).select("query_id", "code", "product_id")


def prefix_codes(codes: DataFrame, index: Index) -> DataFrame:
    """(query_id, product_id) where one code begins with the other; only for codes of four characters or more without an exact hit.

    Codes of four characters or more meet on their first four; shorter ones on being that beginning of the query's code.
    """
    rest = codes.join(index.codes, F.col("code") == F.col("canonical_code"), "left_anti").where(F.length("code") >= 4)
    long = index.codes.where(F.length("canonical_code") >= 4).withColumn("head", F.substring("canonical_code", 1, 4))
    a = rest.withColumn("head", F.substring("code", 1, 4)).join(long, "head")
    a = a.where(F.col("canonical_code").startswith(F.col("code")) | F.col("code").startswith(F.col("canonical_code")))
    heads = rest.withColumn("head", F.explode(F.array(*[F.substring("code", 1, n) for n in (1, 2, 3)])))
    b = heads.join(index.codes.where(F.length("canonical_code") < 4), F.col("head") == F.col("canonical_code"))
    return a.select("query_id", "product_id").unionByName(b.select("query_id", "product_id")).distinct()


def matching(terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, is_numeric, df, and a posting) of the queries' terms.

    Terms meet their document frequencies first: few rows, and terms that no document has go. Up to BROADCAST_TERMS of them are
    broadcast, so that postings are filtered where they are and not shuffled. Beyond that each term's postings are dealt to
    TERM_PARTS parts by product, so that a term that every document has is no task of its own.
    """
    known = kept(terms.join(index.term_stats, "term"))
    if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return index.postings.join(F.broadcast(known), "term")
    part = F.pmod(F.xxhash64("product_id"), F.lit(TERM_PARTS)).cast("int")
    dealt = known.withColumn("__part", F.explode(F.array(*[F.lit(k) for k in range(TERM_PARTS)])))
    return index.postings.withColumn("__part", part).join(dealt, ["term", "__part"]).drop("__part")


def score_terms(terms: DataFrame, index: Index, scoring: Scoring = Scoring()) -> DataFrame:  # noqa: B008
    """(query_id, product_id, bm25f, numeric): sums over the query's terms."""
    rows = matching(terms, index).join(F.broadcast(index.corpus), F.lit(True))  # corpus: one row
    weighted = F.lit(0.0)
    for k, w in enumerate(scoring.weights):
        n = F.when(F.col(f"avg_{k}") > 0, 1 - scoring.b + scoring.b * F.col(f"len_{k}") / F.col(f"avg_{k}")).otherwise(1.0)
        weighted = weighted + F.when(F.col(f"tf_{k}") > 0, w * F.col(f"tf_{k}") / n).otherwise(0.0)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = rows.withColumn("w", weighted).withColumn("idf", idf)
    return rows.groupBy("query_id", "product_id").agg(
        F.sum(F.col("idf") * (F.col("w") * (scoring.k1 + 1)) / (F.col("w") + scoring.k1)).alias("bm25f"),
        F.sum(F.when(F.col("is_numeric") & (F.col("tf_2") > 0), scoring.numeric).otherwise(0.0)).alias("numeric"),
    )


def search(queries: DataFrame, index: Index, top_k: int = TOP_K, scoring: Scoring = Scoring()) -> DataFrame:  # noqa: B008
    """queries(query_id, tokens, codes) -> (query_id, product_id, score, rank and the four parts of the score), top_k a query."""
    codes = query_codes(queries)
    lex = score_terms(query_terms(queries), index, scoring).withColumns({"exact": F.lit(0.0), "prefix": F.lit(0.0)})
    boosts = exact_codes(codes, index).select("query_id", "product_id", F.lit(scoring.exact).alias("exact"), F.lit(0.0).alias("prefix"))
    boosts = boosts.unionByName(prefix_codes(codes, index).select("query_id", "product_id", F.lit(0.0).alias("exact"), F.lit(scoring.prefix).alias("prefix")))
    both = lex.unionByName(boosts.select("query_id", "product_id", F.lit(0.0).alias("bm25f"), F.lit(0.0).alias("numeric"), "exact", "prefix"))
    summed = both.groupBy("query_id", "product_id").agg(F.sum("bm25f").alias("bm25f"), F.sum("numeric").alias("numeric"), F.max("exact").alias("exact"), F.max("prefix").alias("prefix"))
    scored = summed.withColumn("score", F.round(F.col("bm25f") + F.col("numeric") + F.col("exact") + F.col("prefix"), RANK_DIGITS)).where("score > 1e-9")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "product_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
