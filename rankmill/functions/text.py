"""Text analysis as Catalyst expressions: folding, codes, tokens, terms."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decompose into no base letter, and what they fold to. Fixed values.
SPECIAL = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss"}
#: Dropped from word fields. Fixed values.
STOPWORDS = ["le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "pour", "avec", "au", "aux", "a", "d", "l", "dun", "dune", "sur", "dans", "par", "ou"]

NUMBER, DIMENSION, ATTACHED = r"^[0-9]+(\.[0-9]+)?$", r"^([0-9]+(?:\.[0-9]+)?)x([0-9]+(?:\.[0-9]+)?)$", r"^([0-9]+(?:\.[0-9]+)?)([a-z°²³µμ]+)$"
TOKEN = r"[0-9]+(?:[.,][0-9]+)?(?:x[0-9]+(?:[.,][0-9]+)?)*|[\p{L}\p{N}]+"
TERM = "struct<term:string,kind:string,is_variant:boolean>"


def _accents() -> tuple[str, str]:
    """Accented lower-case letters of the Latin blocks and their base letters, from the Unicode decomposition."""
    pairs = []
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(base) > 1 and all(0x300 <= ord(c) <= 0x36F for c in base[1:]):
            pairs.append((letter, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
FOLDED = str.maketrans(ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Lower case without accents or combining marks."""
    out = F.lower(text)
    for letter, plain in SPECIAL.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(F.translate(out, ACCENTED, PLAIN), "[\\u0300-\\u036F]", "")


def fold_text(text: str) -> str:
    """The same for one Python string, for any script."""
    for letter, plain in SPECIAL.items():
        text = text.replace(letter, plain).replace(letter.upper(), plain)
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)


def fold_token(token: str) -> str:
    """fold for one Python string."""
    out = token.lower()
    if out.isascii():
        return out
    for letter, plain in SPECIAL.items():
        out = out.replace(letter, plain)
    return "".join(c for c in out.translate(FOLDED) if not 0x300 <= ord(c) <= 0x36F)


def canonical_code(code: Column) -> Column:
    return F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")


def is_code_shaped(token: Column) -> Column:
    """Letters, digits and hyphens, of each of the first two at least one, four characters besides hyphens."""
    t = F.upper(token)
    return t.rlike("^[A-Z0-9-]+$") & t.rlike("[A-Z]") & t.rlike("[0-9]") & (F.length(F.replace(t, F.lit("-"), F.lit(""))) >= 4)


def preprocess(text: Column) -> Column:
    """Compatibility forms, diameter signs, glued dimensions and decimal commas in one spelling."""
    out = F.translate(text, "²³¹  ", "231  ")
    out = F.regexp_replace(out, r"[⌀Øø]\s*(?=[0-9])", "dia ")
    out = F.regexp_replace(out, r"(?i)(?<![A-Za-z0-9_])DN\s*(?=[0-9])", "dia ")
    out = F.regexp_replace(out, r"(?<![A-Za-z0-9_])D\s?(?=[0-9])", "dia ")
    out = F.regexp_replace(out, r"([0-9]+)(?:,([0-9]+))\s*[xX×*/]\s*(?=[0-9])", "$1.$2x")
    out = F.regexp_replace(out, r"([0-9]+(?:\.[0-9]+)?)\s*[xX×*/]\s*(?=[0-9])", "$1x")
    return F.regexp_replace(out, r"([0-9]),(?=[0-9])", "$1.")


def depluralize(word: Column) -> Column:
    """The word without a final s or x if it has four letters or more; else null."""
    return F.when((F.length(word) >= 4) & word.rlike("[sx]$"), F.substring(word, F.lit(1), F.length(word) - 1))


def _term(term: Column, kind: str, variant: bool = False) -> Column:
    return F.struct(term.alias("term"), F.lit(kind).alias("kind"), F.lit(variant).alias("is_variant"))


def tokens(text: Column) -> Column:
    """Array of a text's tokens as they are, before folding."""
    return F.regexp_extract_all(preprocess(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_terms(token: str) -> list[tuple[str, bool]]:
    """What analyze(stopwords=True) makes of one of the tokens, in Python: (term, is_variant) in order."""
    t = fold_token(token)
    if not t:
        return []
    if t[0] in "0123456789":  # as the three patterns begin
        if m := re.search(DIMENSION, t):
            return [(t, False), (m[1], False), (m[2], False)]
        if re.search(NUMBER, t):
            return [(t, False)]
        if m := re.search(ATTACHED, t):
            return [(m[1], False), (m[2], False)]
    words = [(t, False), (t[:-1], True)] if len(t) >= 4 and t[-1] in "sx" else [(t, False)]
    return [w for w in words if w[0] not in STOPWORDS]


def analyze(text: Column, stopwords: bool = False) -> Column:
    """array<struct<term, kind, is_variant>> of a text, in order; stopwords: drop those from words."""

    def of(t: Column) -> Column:
        pair = F.array(_term(t, "dimension"), _term(F.regexp_extract(t, DIMENSION, 1), "number"), _term(F.regexp_extract(t, DIMENSION, 2), "number"))
        attached = F.array(_term(F.regexp_extract(t, ATTACHED, 1), "number"), _term(F.regexp_extract(t, ATTACHED, 2), "unit"))
        words = F.when(depluralize(t).isNotNull(), F.array(_term(t, "word"), _term(depluralize(t), "word", True))).otherwise(F.array(_term(t, "word")))
        return F.when(t.rlike(DIMENSION), pair).when(t.rlike(NUMBER), F.array(_term(t, "number"))).when(t.rlike(ATTACHED), attached).otherwise(words)

    terms = F.flatten(F.transform(F.filter(F.transform(tokens(text), fold), lambda t: t != ""), of))
    return F.filter(terms, lambda t: (t["kind"] != "word") | ~t["term"].isin(STOPWORDS)) if stopwords else terms


def analyze_code(code: Column) -> Column:
    """The code in canonical form, then its runs of letters and of digits and its folded spelling as variants."""
    own = F.lower(canonical_code(F.coalesce(code, F.lit(""))))
    parts = F.filter(F.split(own, "(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])"), lambda x: x != "")
    raw = fold(F.coalesce(code, F.lit("")))
    nothing = F.array().cast(f"array<{TERM}>")
    first = F.when(own != "", F.concat(F.array(_term(own, "code")), F.transform(parts, lambda p: _term(p, "code", True)))).otherwise(nothing)
    return F.concat(first, F.when((raw != own) & (raw != ""), F.array(_term(raw, "code", True))).otherwise(nothing))
