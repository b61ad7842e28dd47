"""Quality rules: repetition and length rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and pairs of neighbouring words are hashed to BUCKETS buckets. Counts over the trusted texts and over all texts give two
multinomials, the trusted one smoothed towards the raw one; a text's score is the mean over its n-grams of log P(trusted) - log P(raw). Texts whose score is
below THRESHOLD are rejected: a fixed number, so every document's verdict is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, checkpoint_dir, text_or_empty

BUCKETS, PRIOR, THRESHOLD = 10_000, 10_000.0, -0.12
#: The fit's documented bound: trusted texts that are counted.
TRUSTED = 20_000
#: Base rules: fewest words, largest percentage of words in repeated windows, words of a window.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"


def buckets(words: Column) -> Column:
    """Bucket numbers (from 0) of a text's words and neighbouring pairs. words: a column, not an expression, as each pair reads it."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))
    pairs = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(F.get(words, i), w), F.lit(BUCKETS))
    )
    return F.concat(single, pairs)


def _repeated(pairs: Column) -> Column:
    """Words in windows whose hash occurs twice or more, from (hash, place) pairs in order of hash and place."""
    at = lambda i: F.get(pairs, i)
    twice = F.filter(
        F.transform(pairs, lambda x, i: F.when((F.get(pairs, i - 1)["h"] == x["h"]) | (at(i + 1)["h"] == x["h"]), x["p"])), lambda x: x.isNotNull()
    )
    return twice


def with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a window of WINDOW words found twice or more in the text.

    Texts whose windows all differ are known by the number of distinct hashes. For the others the windows' hashes are sorted
    with their places, and equal neighbours are repeated; in order of place, a repeated window adds the words that the one
    before it didn't cover.
    """
    w = F.col(words)
    n = F.size(w) - (WINDOW - 1)
    hashes = F.when(n > 0, F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])))
    df = df.withColumn("__h", hashes)
    differ = F.size(F.array_distinct("__h")) == F.size("__h")
    zipped = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    df = df.withColumn("__z", F.when(F.col("__h").isNotNull() & ~differ, F.sort_array(zipped))).drop("__h")
    df = df.withColumn("__p", F.when(F.col("__z").isNotNull(), F.sort_array(_repeated(F.col("__z"))))).drop("__z")
    p = F.col("__p")
    covered = F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"],
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and `__words`, the array of words."""
    source = text_or_empty(F.col(text_col))
    df = docs.withColumn("__words", ascii_words(F.col(text_col)))
    lines = F.filter(F.split(source, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__lines", lines)
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(source, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__lines")
    df = with_repeats(df, "__words", "n_repeat_words")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ratio): log P(bucket | trusted) - log P(bucket | raw); at most BUCKETS rows.

    Raw counts are those of all texts; the trusted ones, those of at most TRUSTED texts, chosen by a hash of their ids. Counts
    meet in partial sums of at most BUCKETS rows a task. Without a trusted text every ratio is 0.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    ids = F.broadcast(ids.orderBy(F.xxhash64("__id"), "__id").limit(TRUSTED))  # bounded; texts are not shuffled for it
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(ids.withColumn("__good", F.lit(1)), "__id", "left")
    split = found.select(F.coalesce("__good", F.lit(0)).alias("good"), ascii_words(F.col("__t")).alias("__words"))
    grams = split.select("good", F.explode(buckets(F.col("__words"))).alias("bucket"))
    checkpoint_dir(docs.sparkSession)
    counts = grams.groupBy("bucket").agg(F.sum("good").alias("good"), F.count("*").alias("raw")).checkpoint()  # at most BUCKETS rows
    sums = counts.agg(F.sum("good").alias("all_good"), F.sum("raw").alias("all_raw"))
    # The trusted multinomial is smoothed by PRIOR n-grams dealt like the raw ones: with few trusted texts ratios near 0.
    raw = F.col("raw") / F.col("all_raw")
    own = (F.col("good") + PRIOR * raw) / (F.col("all_good") + PRIOR)
    return counts.join(F.broadcast(sums), F.lit(True)).select("bucket", F.log(own / raw).alias("ratio"))  # sums: one row


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for each row of docs.

    trusted names the trusted texts' ids; null and repeated ones count once or not at all. score is null for texts without a
    word, which fail the base rules. kept: passes the base rules and scores at least THRESHOLD. Null texts are empty; repeated
    rows get equal results; other columns take no part; an empty table gives an empty one.
    """
    found = {r["bucket"]: r["ratio"] for r in log_ratios(docs, trusted, id_col, text_col).collect()}  # at most BUCKETS rows
    # One constant array for all rows: folded when the plan is made, and never a column of a row.
    weights = F.split(F.lit(",".join(repr(found.get(b, 0.0)) for b in range(BUCKETS))), ",").cast("array<double>")
    df = with_base(docs.select(F.col(id_col), F.col(text_col)), text_col)
    df = df.withColumn("__b", buckets(F.col("__words")))
    total = F.aggregate("__b", F.lit(0.0), lambda acc, b: acc + F.get(weights, b.cast("int")))
    df = df.withColumn("score", F.when(F.size("__b") > 0, F.round(total / F.size("__b"), 9)))
    kept = ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= THRESHOLD)
    return df.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality() over documents; documents labelled of quality 1 are the trusted texts. See there for the edge cases."""
    return quality(docs, labels.where("quality = 1").select("doc_id"))
