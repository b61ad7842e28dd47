"""Query normalization as one projection: tokens, codes, attributes, corrections and their provenance.

Every rule looks at a token and its neighbours only, so that a query is an array of classified tokens and each result an
expression over it. Only spelling meets another table: distinct unknown words meet the vocabulary on deletion keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.distance import MAX_EDITS, deletions, osa
from ..functions.text import analyze, canonical_code, fold, fold_text, is_code_shaped
from .lineage import kept

MAX_QUERY_LENGTH = 512
MIN_TYPO_LENGTH = 4
VERSION = "1.0.0-fr"
#: Corrections up to which they are broadcast.
BROADCAST_WORDS = 200_000

_NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
NUMBER = f"^{_NUMBER}$"
PAIR = f"(?i)^({_NUMBER})x({_NUMBER})$"
DIAMETER = f"(?iu)^(?:ø|dn|dia|diam|d)({_NUMBER})(mm|cm|dm|m)?$"
MEASURE = f"(?i)^({_NUMBER})(mm|cm|dm|m|kg|g|l|cl|ml)$"

ATTRIBUTE = "struct<name:string,value:string,unit:string,raw:string,provenance:string,rule:string,replaces:boolean>"
CORRECTION = "struct<from:string,to:string,kind:string,rule:string>"
MARK = "struct<token:string,provenance:string,weak:boolean>"


def _map(words: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _some(kind: str, *items: Column) -> Column:
    """The items that are not null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull()).cast(f"array<{kind}>")


def guard(text: Column) -> Column:
    """The text a query is read from: nothing for null, and its first 512 characters."""
    return F.substring(F.coalesce(text, F.lit("")), 1, MAX_QUERY_LENGTH)


def presplit(text: Column) -> Column:
    """Tokens: runs of letters, digits, inner hyphens and decimal points; a decimal comma becomes a point."""
    clean = F.regexp_replace(F.translate(text, "²³¹  ", "231  "), r"([0-9])[,.]([0-9])", "$1\u0001$2")
    parts = F.split(clean, "[^\\p{L}\\p{N}\u0001-]+")
    tokens = F.transform(parts, lambda t: F.regexp_replace(F.translate(t, "\u0001", "."), "^-+|-+$", ""))
    return F.filter(tokens, lambda t: t != "")


def _classify(raw: Column) -> Column:
    """array<struct> of tokens with their class and what the rules need from up to three tokens before."""
    opens = lambda t, after: t.rlike("^[A-Z]{1,4}$") & F.coalesce(after.rlike("^[0-9]{2,}$"), F.lit(False))
    keyword = _map({**L.KEYWORDS, **{short: L.KEYWORDS[fold_text(full)] for short, full in L.ABBREVIATIONS.items() if fold_text(full) in L.KEYWORDS}})
    number = lambda t: F.replace(t, F.lit(","), F.lit("."))

    def at(i: Column) -> Column:
        return F.get(raw, i)

    def kind(t: Column, i: Column) -> Column:
        before = F.coalesce(at(i - 1), F.lit(""))
        found = F.when((i > 0) & opens(before, t), "joined").when(opens(t, at(i + 1)), "join").when(t.rlike(PAIR), "pair").when(t.rlike(DIAMETER), "diameter")
        found = found.when(t.rlike(MEASURE), "measure").when(t.rlike(NUMBER), "number").when(is_code_shaped(t), "code")
        return found.when((i > 0) & fold(t).isin(list(L.UNITS)), "unit").otherwise("word")

    def context(i: Column) -> Column:
        """The dimension that one of the two tokens before place i names."""
        return F.coalesce(F.try_element_at(keyword, fold(F.coalesce(at(i - 1), F.lit("")))), F.try_element_at(keyword, fold(F.coalesce(at(i - 2), F.lit("")))))

    def describe(t: Column, i: Column) -> Column:
        before = F.coalesce(at(i - 1), F.lit(""))
        f = fold(t)
        return F.struct(
            t.alias("raw"), f.alias("fold"), i.alias("i"), kind(t, i).alias("kind"), at(i + 1).alias("next"), context(i).alias("context"),
            fold(before).alias("before"), context(i - 1).alias("context_before"),
            F.when((i > 0) & before.rlike(DIAMETER) & ~before.rlike(PAIR), number(F.regexp_extract(before, DIAMETER, 1))).alias("diameter_before"),
            F.coalesce(fold(F.try_element_at(_map(L.ABBREVIATIONS), f)), f).alias("word"), F.try_element_at(_map(L.ABBREVIATIONS), f).alias("expansion"),
        )

    return F.transform(raw, describe)


def read_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, text) -> (query_id, text, truncated, raw, toks): the guarded text and its classified tokens."""
    read = queries.select("query_id", guard(F.col("text")).alias("text"), (F.coalesce(F.length("text"), F.lit(0)) > MAX_QUERY_LENGTH).alias("truncated"))
    return read.withColumn("raw", presplit(F.col("text"))).withColumn("toks", _classify(F.col("raw")))


def vocabulary_of(words: DataFrame | None, spark) -> DataFrame:
    """(word): the words of the lexicon and those of the catalogue (column term)."""
    own = {*L.WORDS, *L.COLORS, *L.MATERIALS, *[w for group in L.SYNONYMS for w in group]}
    base = spark.createDataFrame([(w,) for w in sorted(own)], "word string")
    return base if words is None else base.unionByName(words.select(F.col("term").alias("word"))).distinct()


def closest_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, closest, distance, ties) for words (word) beyond the vocabulary (word) with a neighbour within two edits.

    ties counts the neighbours at that distance; closest is the first of them in order.
    """
    unknown = words.distinct().join(vocabulary, "word", "left_anti")
    left = unknown.withColumn("key", F.explode(deletions(F.col("word"))))
    right = vocabulary.select(F.col("word").alias("near"), F.explode(deletions(F.col("word"))).alias("key"))
    pairs = left.join(right, "key").select("word", "near").distinct()
    pairs = pairs.where((F.abs(F.length("word") - F.length("near")) <= MAX_EDITS) & (F.levenshtein("word", "near", 2 * MAX_EDITS) >= 0))
    pairs = pairs.withColumn("distance", osa(F.col("word"), F.col("near"))).where(F.col("distance") <= MAX_EDITS)
    by_distance = pairs.groupBy("word", "distance").agg(F.min("near").alias("closest"), F.count("*").alias("ties"))
    best = by_distance.groupBy("word").agg(F.min_by(F.struct("closest", "distance", "ties"), "distance").alias("b"))
    return best.select("word", "b.*")


def corrections_of(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, fixes map<word, struct<to, distance>>, unknown array<word>) of the queries with words beyond the vocabulary."""
    words = tokens.select("query_id", F.explode(F.array_distinct(F.transform(F.filter("toks", lambda t: t["kind"] == "word"), lambda t: t["word"]))).alias("word"))
    words = words.where(F.length("word") >= MIN_TYPO_LENGTH).join(vocabulary, "word", "left_anti")
    best = closest_words(words.select("word"), vocabulary).where("ties = 1").select("word", F.struct(F.col("closest").alias("to"), "distance").alias("fix"))
    best = kept(best)  # counted, then joined
    few = best.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    found = words.join(F.broadcast(best) if few else best, "word", "left")
    entry = F.when(F.col("fix").isNotNull(), F.struct("word", "fix"))
    return found.groupBy("query_id").agg(F.map_from_entries(F.collect_list(entry)).alias("fixes"), F.collect_list(F.when(F.col("fix").isNull(), F.col("word"))).alias("unknown"))


def _millimetres(value: Column, unit: Column) -> Column:
    scaled = F.format_string("%.3f", F.round(value.cast("double") * F.try_element_at(_map({u: float(k) for u, k in L.UNITS.items()}), unit), 3))
    return F.regexp_replace(scaled, r"\.?0+$", "")


def _dimension(name: Column, value: Column, unit: Column, raw: Column, rule: Column, replaces: bool = False) -> Column:
    """An attribute; lengths in other units than millimetres are converted and marked inferred."""
    converts = F.coalesce((unit != "mm") & unit.isin(list(L.UNITS)), F.lit(False))
    return F.struct(
        name.alias("name"), F.when(converts, _millimetres(value, unit)).otherwise(value).alias("value"), F.when(converts, F.lit("mm")).otherwise(unit).alias("unit"),
        raw.alias("raw"), F.when(converts, F.lit("inferred")).otherwise(F.lit("observed")).alias("provenance"),
        F.when(converts, F.concat(rule, F.lit(":unit-convert"))).otherwise(rule).alias("rule"), F.lit(replaces).alias("replaces"),
    )


def _attributes(t: Column, fix: Column) -> Column:
    """Attributes a token gives, in the order of their rules."""
    text = lambda s: F.lit(s)
    none = F.lit(None).cast("string")
    group = lambda pattern, k: F.nullif(F.replace(F.regexp_extract(t["raw"], pattern, k), F.lit(","), F.lit(".")), F.lit(""))
    named = t["context"].isNotNull()
    diameter = _dimension(text("diameter"), group(DIAMETER, 1), F.lower(group(DIAMETER, 2)), t["raw"], text("diameter:symbol"))
    measure = _dimension(t["context"], group(MEASURE, 1), F.lower(group(MEASURE, 2)), t["raw"], F.concat(t["context"], text(":keyword-unit")))
    number = _dimension(t["context"], F.replace(t["fold"], F.lit(","), F.lit(".")), none, t["raw"], F.concat(t["context"], text(":keyword")))
    after_sign = _dimension(text("diameter"), t["diameter_before"], t["fold"], t["before"], text("diameter:symbol-unit"), True)
    after_number = _dimension(t["context_before"], t["before"], t["fold"], t["before"], F.concat(t["context_before"], text(":keyword-unit")), True)

    def known(word: Column, raw: Column, suffix: str) -> list[Column]:
        out = []
        for name, words in (("color", L.COLORS), ("material", L.MATERIALS)):
            value = F.try_element_at(_map(words), word)
            found = F.struct(
                text(name).alias("name"), value.alias("value"), none.alias("unit"), raw.alias("raw"), text("inferred").alias("provenance"),
                text(f"{name}:vocabulary{suffix}").alias("rule"), F.lit(False).alias("replaces"),
            )
            out.append(F.when(value.isNotNull(), found))
        return out

    one = lambda c: F.array(c).cast(f"array<{ATTRIBUTE}>")
    words = _some(ATTRIBUTE, *known(t["word"], t["raw"], ""), *known(F.coalesce(fix["to"], F.lit("")), t["word"], "-after-typo"))
    return (
        F.when(t["kind"] == "diameter", one(diameter)).when((t["kind"] == "measure") & named, one(measure)).when((t["kind"] == "number") & named, one(number))
        .when((t["kind"] == "unit") & t["diameter_before"].isNotNull(), one(after_sign))
        .when((t["kind"] == "unit") & t["before"].rlike(NUMBER) & t["context_before"].isNotNull(), one(after_number))
        .when(t["kind"] == "word", words).otherwise(_none(ATTRIBUTE))
    )


def _synonyms(word: Column) -> Column:
    others = {w: [v for v in group if v != w] for group in L.SYNONYMS for w in group}
    table = F.create_map(*[x for w, vs in others.items() for x in (F.lit(w), F.array(*[F.lit(v) for v in vs]))])
    return F.coalesce(F.try_element_at(table, word), _none("string"))


def _emitted(t: Column, fix: Column) -> Column:
    """Tokens that a token gives, in order."""
    part = lambda pattern, k: F.replace(F.regexp_extract(t["raw"], pattern, k), F.lit(","), F.lit("."))
    pair = F.array(F.concat(part(PAIR, 1), F.lit("x"), part(PAIR, 2)), part(PAIR, 1), part(PAIR, 2))
    word = F.concat(F.array(t["word"]), _synonyms(t["word"]), F.filter(F.array(fix["to"]), lambda x: x.isNotNull()))
    return (
        F.when(t["kind"] == "joined", _none("string")).when(t["kind"] == "join", F.array(t["fold"], fold(t["next"]))).when(t["kind"] == "pair", pair)
        .when(t["kind"] == "measure", F.array(part(MEASURE, 1), F.lower(part(MEASURE, 2)))).when(t["kind"] == "word", word).otherwise(F.array(t["fold"]))
    )


def _marks(t: Column, fix: Column, unknown: Column) -> Column:
    """Provenances a token gives; weak ones hold only where no other does."""
    mark = lambda token, provenance, weak=False: F.struct(token.alias("token"), F.lit(provenance).alias("provenance"), F.lit(weak).alias("weak"))
    seen = F.transform(F.slice(_emitted(t, fix), F.lit(1), F.when(t["kind"].isin("join", "pair"), 1).otherwise(2)), lambda x: mark(x, "observed"))
    word = F.concat(
        _some(MARK, F.when(t["expansion"].isNotNull(), mark(t["word"], "normalized")), mark(t["word"], "observed", True)),
        F.transform(_synonyms(t["word"]), lambda x: mark(x, "inferred", True)),
        _some(MARK, F.when(fix["to"].isNotNull(), mark(fix["to"], "normalized")), F.when(F.array_contains(unknown, t["word"]), mark(t["word"], "unknown"))),
    )
    return F.when(t["kind"] == "word", word).otherwise(seen.cast(f"array<{MARK}>"))


def _corrections(t: Column, fix: Column, given: Column) -> Column:
    """Corrections a token gives; given are the tokens of those before it."""
    change = lambda a, b, kind, rule: F.struct(a.alias("from"), b.alias("to"), F.lit(kind).alias("kind"), rule.alias("rule"))
    join = change(F.concat_ws(" ", t["raw"], t["next"]), canonical_code(F.concat(t["raw"], F.coalesce(t["next"], F.lit("")))), "abbreviation", F.lit("code:join"))
    new = F.filter(_synonyms(t["word"]), lambda x: ~F.array_contains(given, x))
    word = F.concat(
        _some(CORRECTION, F.when(t["expansion"].isNotNull(), change(t["fold"], t["expansion"], "abbreviation", F.lit("abbreviation:map")))),
        F.transform(new, lambda x: change(t["word"], x, "synonym", F.lit("synonym:group"))).cast(f"array<{CORRECTION}>"),
        _some(CORRECTION, F.when(fix["to"].isNotNull(), change(t["word"], fix["to"], "typo", F.concat(F.lit("typo:damerau-"), fix["distance"].cast("string"))))),
    )
    return F.when(t["kind"] == "join", F.array(join).cast(f"array<{CORRECTION}>")).when(t["kind"] == "word", word).otherwise(_none(CORRECTION))


def normalize(queries: DataFrame, catalogue_words: DataFrame | None = None) -> DataFrame:
    """queries(query_id, text) -> one row a query, with the catalogue's words (term) among the right spellings.

    text is cut to 512 characters (notes says so), null is empty; normalized, tokens, codes; attributes by name; attribute_values;
    provenance of tokens; corrections; is_empty; normalizer_version. Ids must differ.
    """
    tokens = read_tokens(queries)
    fixes = corrections_of(tokens, vocabulary_of(catalogue_words, queries.sparkSession))
    rows = tokens.join(fixes, "query_id", "left")
    fix = lambda t: F.when(t["kind"] == "word", F.try_element_at(F.col("fixes"), t["word"]))
    unknown = F.coalesce("unknown", _none("string"))
    rows = rows.withColumn("given", F.transform("toks", lambda t: _emitted(t, fix(t))))
    joined = F.transform(F.filter("toks", lambda t: t["kind"].isin("join", "code")), lambda t: canonical_code(F.when(t["kind"] == "join", F.concat(t["raw"], t["next"])).otherwise(t["raw"])))
    rows = rows.withColumns({
        "codes": joined,
        "found": F.flatten(F.transform("toks", lambda t: _attributes(t, fix(t)))),
        "marks": F.flatten(F.transform("toks", lambda t: _marks(t, fix(t), unknown))),
        "corrections": F.flatten(F.transform("toks", lambda t: _corrections(t, fix(t), F.flatten(F.slice("given", F.lit(1), t["i"]))))),
    })

    def attribute(name: Column) -> Column:
        own = F.filter("found", lambda a: a["name"] == name)
        late = F.filter(own, lambda a: a["replaces"])
        best = F.coalesce(F.get(late, F.size(late) - 1), F.get(own, F.lit(0)))
        return F.struct(name.alias("key"), F.struct(*[best[c].alias(c) for c in ("value", "unit", "raw", "provenance", "rule")]).alias("value"))

    def provenance(token: Column) -> Column:
        own = F.filter("marks", lambda m: m["token"] == token)
        firm = F.filter(own, lambda m: ~m["weak"])
        return F.struct(token.alias("key"), F.coalesce(F.get(firm, F.size(firm) - 1), F.get(own, F.lit(0)))["provenance"].alias("value"))

    spelled = F.transform("toks", lambda t: F.when(is_code_shaped(t["raw"]), t["raw"]).otherwise(F.coalesce(_respelled(t), F.lower(t["raw"]))))
    rows = rows.withColumns({
        "tokens": F.array_distinct(F.concat(F.flatten("given"), F.transform("codes", lambda c: F.lower(c)))),
        "attributes": F.map_from_entries(F.transform(F.array_distinct(F.transform("found", lambda a: a["name"])), attribute)),
        "provenance": F.map_from_entries(F.transform(F.array_distinct(F.transform("marks", lambda m: m["token"])), provenance)),
        "normalized": F.array_join(spelled, " "),
    })
    values = F.transform_values("attributes", lambda _, a: F.concat_ws(" ", a["value"], a["unit"]))
    notes = F.when(F.col("truncated"), F.array(F.lit(f"query truncated to {MAX_QUERY_LENGTH} characters"))).otherwise(_none("string"))
    return rows.select(
        "query_id", "text", "normalized", "tokens", "codes", "attributes", values.alias("attribute_values"), "provenance", "corrections",
        (F.col("normalized") == "").alias("is_empty"), notes.alias("notes"), F.lit(VERSION).alias("normalizer_version"),
    )


def _respelled(t: Column) -> Column:
    """What replaces a token in the normalized text: its spelling's correction, or an abbreviation that some place read as a word."""
    as_word = F.exists("toks", lambda o: (o["kind"] == "word") & (o["fold"] == t["fold"]))
    return F.when(as_word, F.coalesce(F.try_element_at(F.col("fixes"), t["fold"])["to"], t["expansion"]))


def tokenize(queries: DataFrame, whole: bool = False) -> DataFrame:
    """The plain normalizer: (query_id, text, tokens, codes) with the distinct analyzed terms and no codes; whole: texts of any length, without the guard."""
    text = F.coalesce("text", F.lit("")) if whole else guard(F.col("text"))
    return queries.select("query_id", text.alias("text"), F.array_distinct(F.transform(analyze(text), lambda t: t["term"])).alias("tokens"), _none("string").alias("codes"))


def scripted(queries: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """A stand-in for tests: whole trimmed texts replaced by a table, lower-cased and split at blanks; no codes."""
    own = F.trim(F.coalesce("text", F.lit("")))
    text = F.coalesce(F.try_element_at(_map(replacements), own), own) if replacements else own
    return queries.select("query_id", text.alias("text"), F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "").alias("tokens"), _none("string").alias("codes"))


def refine(normalized: DataFrame, suggest, max_chars: int = 256) -> DataFrame:
    """A model's hook: suggest maps (query_id, text) to (query_id, suggestion, extra map<string,string>).

    Texts under 3 or over max_chars characters are not sent, and a query without an answer stays as it is. 256 characters of a
    suggestion replace the normalized text; known attributes that the rules did not find are added, cut to 32 characters. Tokens stay.
    """
    sent = normalized.select("query_id", F.trim("text").alias("text")).where(F.length("text").between(3, max_chars))
    rows = normalized.join(suggest(sent), "query_id", "left")
    cut = F.transform_values(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda _, v: F.substring(F.trim(v), 1, 32))
    new = F.map_filter(cut, lambda k, v: k.isin(L.ATTRIBUTES) & (v != "") & ~F.map_contains_key("attribute_values", k))
    text = F.substring("suggestion", 1, 256)
    changed = F.when((text != F.col("normalized")) & (text != ""), F.array(F.struct(F.col("normalized"), text, F.lit("typo"), F.lit("tinyllm:cleanup"))).cast(f"array<{CORRECTION}>")).otherwise(_none(CORRECTION))
    return rows.withColumns({
        "normalized": F.coalesce(text, "normalized"), "attribute_values": F.map_concat("attribute_values", new),
        "corrections": F.concat("corrections", changed),
    }).drop("suggestion", "extra")
