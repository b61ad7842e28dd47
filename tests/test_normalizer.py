"""Query normalization: rules on single queries, edit distance against a plain table, near words against all pairs."""

import itertools
import random

import pytest

from rankmill.functions.distance import osa
from rankmill.operators import normalizer as N


@pytest.fixture(scope="module")
def norm(spark):
    def run(*texts, words=()):
        queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
        more = spark.createDataFrame([(w,) for w in words], "term string") if words else None
        rows = N.normalize(queries, more).orderBy("query_id").collect()
        assert len(rows) == len(texts)
        return rows if len(texts) > 1 else rows[0]

    return run


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_equals_the_plain_table(spark):
    rnd = random.Random(3)
    words = ["", "a", "ca", "abc", "tube", "tuyau"] + ["".join(rnd.choices("abc", k=rnd.randint(1, 7))) for _ in range(40)]
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", osa(N.F.col("a"), N.F.col("b")).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in rows] == [(a, b, plain_osa(a, b)) for a, b in pairs]


def test_closest_words_equal_all_pairs(spark):
    rnd = random.Random(5)
    make = lambda n: sorted({"".join(rnd.choices("abcd", k=rnd.randint(4, 8))) for _ in range(n)})
    vocab, words = make(60), make(200)
    found = {r.word: (r.closest, r.distance, r.ties) for r in N.closest_words(*[spark.createDataFrame([(w,) for w in ws], "word string") for ws in (words, vocab)]).collect()}
    wanted = {}
    for w in set(words) - set(vocab):
        near = sorted((plain_osa(w, v), v) for v in vocab if plain_osa(w, v) <= 2)
        if near:
            wanted[w] = (near[0][1], near[0][0], sum(d == near[0][0] for d, _ in near))
    assert found == wanted and len(wanted) > 50


def test_spelling(norm):
    a, b, c, d = norm("tube 110 blnc", "tube blan", "tube evacuaton pvc", "racord pvc 110")
    assert [x.normalized for x in (a, b, c, d)] == ["tube 110 blanc", "tube blanc", "tube evacuation pvc", "raccord pvc 110"]
    assert a.attributes["color"].rule == "color:vocabulary-after-typo" and a.attribute_values == {"color": "blanc"}
    assert ("blnc", "blanc", "typo", "typo:damerau-1") in [tuple(x) for x in a.corrections]
    assert a.tokens == ["tube", "tuyau", "110", "blnc", "blanc"] and "material" not in a.attributes
    assert norm("plombri", words=["plombrie"]).normalized == "plombrie"
    assert norm("tubz blant", words=["tuba", "blanb"]).corrections == []


def test_diameters_and_units(norm):
    for row in norm("tube Ø110", "tube DN110", "tube D110", "tube dia110", "tube diam 110", "tube dia 110"):
        assert row.attribute_values == {"diameter": "110"} and row.attributes["diameter"].provenance == "observed", row.text
    mm, cm, m, sep, key = norm("tube Ø110 mm", "tube Ø11cm", "tube Ø0.11m", "tube Ø11 cm", "longueur 2,5 m")
    assert [x.attribute_values["diameter"] for x in (mm, cm, m, sep)] == ["110 mm"] * 4
    assert cm.attributes["diameter"].provenance == "inferred" and cm.attributes["diameter"].rule == "diameter:symbol:unit-convert"
    assert mm.attributes["diameter"].rule == "diameter:symbol-unit" and key.attribute_values == {"length": "2500 mm"}
    bare, glued, kept = norm("tube 110", "tube 110mm", "tube pvc 110 blanc 4m")
    assert bare.attributes == {} and glued.attributes == {} and {"110", "mm"} <= set(glued.tokens)
    assert kept.attribute_values == {"material": "PVC", "color": "blanc"} and kept.normalized == "tube pvc 110 blanc 4m"


def test_pairs_synonyms_and_codes(norm):
    one, two, syn, acc = norm("goulotte 110x45", "goulotte 45X110", "tube assainissement", "Tube Évacuation PVC")
    assert one.tokens == ["goulotte", "110x45", "110", "45"] and two.tokens == ["goulotte", "45x110", "45", "110"]
    assert "evacuation" in syn.tokens and syn.provenance["evacuation"] == "inferred" and "assainissement" in acc.tokens
    assert acc.normalized == "tube évacuation pvc"
    a, b, c, d, e, joined = norm("T110B45", "t110b45", "T-110-B45", "ABC 123", "tube 110", "DN 110 mm")
    assert [x.codes for x in (a, b, c, d, e)] == [["T110B45"]] * 3 + [["ABC123"], []]
    assert a.corrections == [] and a.normalized == "T110B45" and d.tokens == ["abc", "123", "abc123"]
    assert joined.codes == ["DN110"] and joined.attribute_values == {"diameter": "110 mm"}


def test_empty_long_and_odd_queries(norm, spark):
    empty, blank, null, odd, long = norm("", "   ", None, "  tube   - PVC/PPR,  Ø110 : 2,5 kg ", "tube " * 500)
    assert empty.is_empty and blank.is_empty and null.is_empty and null.tokens == []
    assert odd.attribute_values == {"material": "PVC", "diameter": "110"} and {"2.5", "kg"} <= set(odd.tokens)
    assert long.notes == ["query truncated to 512 characters"] and long.tokens == ["tube", "tuyau", "tu"]  # 102 whole words and two letters
    p = norm("tube blnc xyzzyq diam").provenance
    assert (p["tube"], p["blnc"], p["blanc"], p["xyzzyq"], p["diametre"]) == ("observed", "observed", "normalized", "unknown", "normalized")
    assert N.normalize(spark.createDataFrame([], "query_id int, text string")).count() == 0


def test_refinement_and_script(norm, spark):
    base = N.normalize(spark.createDataFrame([(1, "tube 110 blanc"), (2, "ab")], "query_id int, text string"))
    answer = lambda q: q.select("query_id", N.F.lit("tube x").alias("suggestion"), N.F.expr("map('material', ' PVC ', 'color', 'noir', 'shape', 'x')").alias("extra"))
    one, two = N.refine(base, answer).orderBy("query_id").collect()
    assert one.normalized == "tube x" and one.attribute_values == {"color": "blanc", "material": "PVC"} and one.corrections[-1].rule == "tinyllm:cleanup"
    assert one.tokens == ["tube", "tuyau", "110", "blanc"] and two.normalized == "ab" and two.corrections == []
    row = N.scripted(spark.createDataFrame([(1, " tbe 110 ")], "query_id int, text string"), {"tbe 110": "Tube 110"}).first()
    assert row.text == "Tube 110" and row.tokens == ["tube", "110"]
