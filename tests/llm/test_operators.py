"""Operators of the corpus subpackage on small tables, against brute force."""

import collections
import datetime
import functools
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

from rankmill.llm import chat, language_id, licenses, media, mixing, quality, sentencepiece, sharding, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string"
LONG = "alpha beta gamma delta " * 30_000
EDGE = [(1, None, None, None, None, None, "x"), (2, "", "en", "s", 0, 1, None), (3, " \n\t ", "en", "s", 3, 1, None), (None, "word", None, None, 4, 1, None),
        (4, "Æ ø ß \U0001f600 <|im_start|> #*$", "fr", "s", 1, 1, None), (5, "same text", "en", "t", 9, 1, None), (5, "same text", "en", "t", 9, 1, None), (6, LONG, "en", "t", 1, 1, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


# ---- quality


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p + k for places in seen.values() if len(places) > 1 for p in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_base_rules(spark, edge, empty):
    texts = ["a b c a b c", "a a a a a", "one two three four one two three", "x\nx\n \ny\nx", "a|b <c> 100%", "p q r s p q r s p q"]
    docs = edge.unionByName(spark.createDataFrame([(10 + i, t, "en", "s", 0, 0, "") for i, t in enumerate(texts)], DOCS))
    rows = quality.quality_rules(docs, labels(spark, [(6, 1, 0)])).collect()
    assert len(rows) == len(EDGE) + len(texts)
    text_of = {r[0]: r[1] for r in EDGE} | {10 + i: t for i, t in enumerate(texts)}
    for r in rows:
        n = brute_quality(text_of[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
    assert quality.quality_rules(empty, labels(spark)).count() == 0


def test_quality_ratio_rejects_what_trusted_texts_lack(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(f"w{(i + k) % 80}" for i in range(80)) for k in rng.integers(0, 80, 30)]
    junk = [" ".join(f"z{rng.integers(1e6)}" for _ in range(80)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + junk)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.quality_rules(docs, labels(spark, [(i, 1, 0) for i in range(20)])).collect()}
    assert all(rows[i].kept for i in range(30)) and not any(rows[i].kept for i in range(30, 40))


def test_quality_score_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "PRIOR", 50.0)
    rng = np.random.default_rng(8)
    vocab = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(rng.choice(vocab[: 20 if i < 6 else 60], int(rng.integers(0, 90)))) for i in range(20)} | {20: None, 21: "é  é\té"}
    trusted = [0, 1, 2, 3, 4, 5, 20, 99]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    # Hashes of the words and pairs, as numbers of one list, so that the counts below are the test's own.
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    grams = {i: [(w,) for w in ws] + list(itertools.pairwise(ws)) for i, ws in words.items()}
    distinct = sorted({g for gs in grams.values() for g in gs})
    rows = spark.createDataFrame([(k, g[0], g[1] if len(g) > 1 else None) for k, g in enumerate(distinct)], "k int, a string, b string")
    number = {r.k: r.h for r in rows.selectExpr("k", f"pmod(if(b is null, xxhash64(a), xxhash64(a, b)), {quality.BUCKETS}) AS h").collect()}
    bucket = {g: number[k] for k, g in enumerate(distinct)}
    raw, good = collections.Counter(), collections.Counter()
    for i, gs in grams.items():
        raw.update(bucket[g] for g in gs)
        good.update(bucket[g] for g in gs if i in trusted)
    n_raw, n_good = sum(raw.values()), sum(good.values())
    ratio = {b: math.log((good[b] + 50.0 * c / n_raw) / (n_good + 50.0) / (c / n_raw)) for b, c in raw.items()}
    for r in quality.quality_rules(docs, labels(spark, [(i, 1, 0) for i in trusted] + [(7, 0, 0)])).collect():
        want = sum(ratio[bucket[g]] for g in grams[r.doc_id]) / len(grams[r.doc_id]) if grams[r.doc_id] else None
        assert r.score == (None if want is None else pytest.approx(want, abs=1e-8))
        assert r.kept == (not r.base_failed and (want or 0.0) >= quality.THRESHOLD)


def test_quality_plan_has_no_wide_row_and_one_count_of_the_corpus(spark):
    docs = spark.createDataFrame([(i, "a b c " * 30) for i in range(8)], "doc_id long, text string")
    plan = quality.quality_rules(docs, labels(spark, [(1, 1, 0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "__w#" not in plan


# ---- language


def brute_code_length(training, text):
    """PPM by its definition, over dictionaries: bits of a text under the texts of one language."""
    seen = collections.defaultdict(collections.Counter)
    for t in training:
        t = b"\xff" * language_id.ORDER + t
        for i in range(language_id.ORDER, len(t)):
            for k in range(language_id.ORDER + 1):
                seen[t[i - k : i]][t[i]] += 1

    def probability(context, byte):
        below = lambda b: probability(context[1:], b) if context else 1 / 256
        if context not in seen:
            return below(byte)
        own = seen[context]
        left = 1 - sum(map(below, own))
        if byte in own:
            return own[byte] / (sum(own.values()) + (len(own) if left > 1e-12 else 0))
        return len(own) / (sum(own.values()) + len(own)) * below(byte) / left

    t = b"\xff" * language_id.ORDER + text
    return sum(-math.log2(probability(t[i - language_id.ORDER : i], t[i])) for i in range(language_id.ORDER, len(t)))


def test_code_lengths_against_brute_force():
    sample = [("a", b"abracadabra abracadabra"), ("b", b"hello world hello"), ("b", "h\u00e9llo \u00e0 tous".encode()), ("c", b"zz"), ("d", "\u3053\u3093\u306b\u3061\u306f".encode())]
    texts = [b"abra hello zz", b"", "\u3053\u3053 \xe9".encode(), b"\x00\xfe zzz", b"abracadabra", b"zzzzzzzz"]
    model = language_id.train(sample)
    want = [[brute_code_length([t for x, t in sample if x == lang], text) for lang in "abcd"] for text in texts]
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5) and not model.code_lengths([b""]).any()
    assert language_id.train([]).code_lengths([b"x"]).shape == (1, 0)
    big = model.code_lengths([b"x" * 10, texts[0] * 100_000, texts[0]])
    assert np.isfinite(big).all() and np.allclose(big[2], want[0], rtol=1e-5)


def test_letters_are_category_l():
    assert [language_id.has_letter(t.encode()) for t in ("\u00bd \u00b2 \u2167 12 _", "a", "\u00aa", "\u3042")] == [False, True, True, True]
    assert not language_id.has_letter(b"\xff\xfe 1")


def test_language_samples(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 50)
    rows = [(i, "long text " * 400, "long") for i in range(300)] + [(1000 + i, f"short {i}", "short") for i in range(40)]
    rows += [(5000, "the same", "one")] * 400 + [(6000 + i, f"text {i}", f"l{i:03}") for i in range(90)] + [(9000, "x", None), (None, "y", "none"), (9001, None, "null"), (9002, " \n", "blank")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = language_id.training_sample(docs, language_id.F.lit(True), "doc_id", "text", "lang", texts=60)
    count = collections.Counter(lang for lang, _ in got)
    assert count["long"] == 60 and count["short"] == 40 and count["one"] == 1 and all(count[f"l{i:03}"] == 1 for i in range(90))
    assert not {"none", "null", "blank"} & count.keys() and max(len(t) for _, t in got) <= 50
    assert got == language_id.training_sample(docs.repartition(2), language_id.F.lit(True), "doc_id", "text", "lang", texts=60)
    assert len(language_id.train(got).languages) == 93


def test_language_id(spark, edge, empty):
    en, fr = "the cat sat on the mat and the dog ran ", "le chat est sur la table et le chien court "
    rows = [(i, (en if i % 2 else fr) * 5, "en" if i % 2 else "fr", "s", 0, 0, "") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(edge)
    got = language_id.language_id(docs).collect()
    for r in got:
        if r.doc_id and r.doc_id >= 100:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "fr") and 0.5 < r.score <= 1
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (1, 2, 3):
            assert r.lang_pred == "und" and r.score == 0
    assert len(got) == docs.count()
    assert {r.doc_id for r in language_id.accepted(docs).collect()} >= set(range(100, 160))
    assert language_id.accepted(docs).columns == docs.columns
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.language_id(edge.withColumn("lang", edge["lang"].substr(9, 1).cast("string")).limit(3)).collect()} <= {"und", ""}


# ---- sharding


def test_sharding_against_brute_force(spark, empty):
    rng = np.random.default_rng(2)
    rows = [(i, int(b)) for i, b in enumerate(rng.integers(0, 100, 300))] + [(7, 90), (7, 90), (None, 5), (500, 1000)]
    got = sharding.shards(spark.createDataFrame(rows, "id long, bytes long"), limit=400).collect()
    bits = {i: bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        for d in range(61):
            inside = [(i, b) for i, b in rows if bits[i][:d] == bits[r.id][:d]]
            if sum(b for _, b in inside) <= 400 or d == 60:
                break
        assert (r.shard, r.depth, r.shard_bytes, r.shard_rows) == (bits[r.id][:d], d, sum(b for _, b in inside), len(inside))
        assert r.oversize == (r.shard_bytes > 400)
    assert sharding.sharding(empty).count() == 0
    cells = sharding.directory(spark.createDataFrame(rows, "id long, bytes long"), limit=400).collect()
    assert {(c.shard, c.shard_bytes) for c in cells} == {(r.shard, r.shard_bytes) for r in got} and all(c.cell.startswith(c.shard) for c in cells)


# ---- toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    words = ["idiot", "moron", "scum", "clown", "vile", "crud"]
    sample = [(f"{i:04}", int(i % 3 == 0), " ".join(rng.choice(words, rng.integers(1, 6))) + " plain words" if i % 3 == 0 or rng.random() < 0.1 else "plain words only here") for i in range(600)]
    model = toxicity.train(sample, {1: 200, 0: 400})
    assert {t[:3] for t in model.terms} <= {w[:3] for w in words} and len(model.terms) >= 5
    vectors = [model.vector(t) for _, _, t in sorted(sample)]
    for text in ("idiot clown", "scum scum moron vile", "crud"):
        q = model.vector(text)
        found, cosine = model.nearest(q)
        every = sorted((-round(sum(v.get(k, 0) * x for k, x in q.items()), 12), e) for e, v in enumerate(vectors))
        want = [(e, -s) for s, e in every if s < 0][: toxicity.K]
        assert [e for e, _ in want] == list(found) and np.allclose([s for _, s in want], cosine)
    assert model.score(model.vector("you idiot"))[0] > 0.5 > model.score(model.vector("plain words"))[0]


def test_toxicity(spark, edge, empty):
    rows = [(100 + i, ("what an idiot and a moron " if i % 4 == 0 else "what a fine and a good day ") * 3, "en", "s", 0, 0, "") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(edge)
    marks = labels(spark, [(100 + i, 1, int(i % 4 == 0)) for i in range(200)])
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int((r.doc_id or 0) >= 100 and r.doc_id % 4 == 0)
    assert toxicity.accepted(docs, marks).count() == 150 + len(EDGE)
    assert toxicity.toxicity(empty, labels(spark)).count() == 0
    assert {r.score for r in toxicity.toxicity(edge, labels(spark)).collect()} == {0.0}


def test_a_small_sample_has_terms():
    clean = [(f"{i:03}", 0, f"plain words about day number {i}") for i in range(40)]
    insults = ["idiot", "moron", "scum", "clown", "vile"]
    toxic = [(f"9{i:02}", 1, f"{insults[i % 5]} {insults[(i + 1) % 5]}") for i in range(5)]
    model = toxicity.train(clean + toxic, {0: 40, 1: 5})
    assert model.score(model.vector("what a moron, such scum"))[0] > 0.5 > model.score(model.vector("plain words about a day"))[0]


def test_every_term_of_an_example_takes_part():
    sample = [(f"{i:03}", 0, f"plain words about day number {chr(97 + i % 26)}q{chr(97 + i // 26)}") for i in range(60)]
    sample += [(f"8{i:02}", 1, "what an idiot") for i in range(20)] + [("999", 1, "zorbly quandle frimp")]
    model = toxicity.train(sample, {0: 60, 1: 21})
    score, found = model.score(model.vector("zorbly quandle frimp"))
    assert model.ids[found[0]] == "999" and score > 0.5
    assert len(model.score(model.vector("plain day"))[1]) > 0


def test_vectors_and_cosines_against_brute_force(monkeypatch):
    """TF-IDF written out over dictionaries, for whole words and the model's telling terms."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.default_rng(9)
    sample = [(f"{i:03}", int(i % 4 == 0), " ".join([*rng.choice([f"w{'abcdefghij'[k]}" for k in range(10)], 6), *(["Idiot", "idiots"][i % 2 : i % 2 + 1] if i % 4 == 0 else [])])) for i in range(200)]
    model = toxicity.train(sample, {1: 50, 0: 150})

    def vector(text):
        raw = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            raw.update({t for t in (w, *[t for t in model.terms if t.endswith("*") and w.startswith(t[:-1])])} & model.vocabulary.keys())
        idf = {t: (math.log((1 + len(sample)) / (1 + held[t])) + 1) * (toxicity.TELLING if t in model.terms else 1) for t in raw}
        out = {t: (1 + math.log(n)) * idf[t] for t, n in raw.items()}
        size = math.sqrt(sum(x * x for x in out.values()))
        return {t: x / size for t, x in out.items()}

    held = collections.Counter()
    for _, _, text in sample:
        ws = set(re.findall(r"[^\W\d_]+", text.lower()))
        held.update({t for t in model.vocabulary if t in ws or (t.endswith("*") and any(w.startswith(t[:-1]) for w in ws))})
    vectors = [vector(t) for _, _, t in sorted(sample)]
    for text in ("wa wb idiots", "Idiot wc wc", "wj", "never seen"):
        q = vector(text)
        cosine = sorted((-round(sum(x * v.get(t, 0) for t, x in q.items()), 9), e) for e, v in enumerate(vectors))
        want = [(e, -c) for c, e in cosine if c < 0][: toxicity.K]
        found, score = model.nearest(model.arrays(text))
        assert np.allclose(score, [c for _, c in want]) and {e for e, c in want if c > want[-1][1] + 1e-9} <= set(found.tolist())


def test_labels_without_documents_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 30, 0: 40})
    marks = labels(spark, [(i, 1, i % 2) for i in range(4000)])
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3900, 4000)] + [(3901, "another"), (3903, "x" * 70_000)], "doc_id long, text string")
    sample, totals = toxicity.training_sample(docs, marks, toxicity.F.lit(True), "doc_id", "text", "toxic")
    assert totals == {0: 50, 1: 50} and collections.Counter(y for _, y, _ in sample) == {1: 30, 0: 40}
    assert all(text in (f"text {i}", "another") for i, _, text in sample)


def test_idf_counts_the_corpus(spark):
    docs = spark.createDataFrame([(i, "idiot words" if i % 2 else "words") for i in range(10)] + [(99, None)], DOCS.split(", lang")[0]).repartition(3)
    n, held = toxicity.document_counts(docs, {"idiot": 0, "words": 1, "never": 2, "idi*": 3}, "text")
    assert n == 11 and list(held) == [5, 10, 0, 5]


def test_terms_of_a_run_of_texts_against_brute_force():
    """A run's texts are cut at once, and each distinct word is looked up once, however many texts hold it."""

    class Counted(dict):
        looked_up = 0

        def get(self, *args):
            self.looked_up += 1
            return super().get(*args)

    texts = ["", "Idiot idiots IDIOTIC scum", "1 ½ ² _a_b c1d - x\u00a0y", "ΟΔΟΣ οδος İstanbul Ⅷ ß ǅ", "é e\u0301 漢字 \U0001f600 \U00010400z", "\x00\x7fidi idio", "scumscum " * 500, " ", "a"]
    every = [re.findall(r"[^\W\d_]+", t.lower()) for t in texts]
    own = sorted({w for ws in every for w in ws[1:]} | {"idi*", "idiot*", "scum*"})
    model = toxicity.ToxicityModel({}, Counted({t: k for k, t in enumerate(own)}), np.ones(len(own)), np.zeros(0), np.zeros(0), [])
    want = collections.Counter((i, model.vocabulary[t]) for i, ws in enumerate(every) for w in ws for t in {w, *[w[:k] + "*" for k in (3, 4, 5)]} if t in model.vocabulary)
    for times in (1, 3):
        model.vocabulary.looked_up = 0
        text, place, n = model.terms_in(texts * times)
        assert {(i, k): x for i, k, x in zip(text.tolist(), place.tolist(), n.tolist(), strict=True)} == {(i + len(texts) * j, k): x for (i, k), x in want.items() for j in range(times)}
        assert model.vocabulary.looked_up == len({w for ws in every for w in ws})
    for t, (keys, weights) in zip(texts, model.vectors(texts), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(model.arrays(t), (keys, weights), strict=True))
    assert [len(x) for x in model.terms_in([])] == [0, 0, 0] and model.vectors([]) == []


# ---- pieces


def test_n_best_against_all_segmentations():
    v = sentencepiece.pieces()
    assert not v.whole

    def every(s):
        out = []

        def go(i, score):
            if i == len(s):
                out.append(score)
            for k in range(1, min(v.longest, len(s) - i) + 1):
                if s[i : i + k] in v.ids:
                    go(i + k, score + v.ids[s[i : i + k]][1])
            if i < len(s) and s[i] not in v.ids:
                go(i + 1, score + sentencepiece.BYTES_SCORE)

        go(0, 0.0)
        return sorted(out, reverse=True)[: sentencepiece.N_BEST]

    for s in ["", "a", "ab cd", "hello, it", "▁x é", "  two\n", "the the a", "日本\U0001f600", "².5²"]:
        ids, scores, edits = v.encode(s)
        assert scores == every(" " + s) and v.decode(ids) == s and edits[0] == []
        for score, changed in zip(scores, edits, strict=True):
            parts = [np.frombuffer(v.best(p)[2], np.int32) for p in v.parts(s)]
            for k, other in changed:
                parts[k] = other
            assert v.decode(np.concatenate(parts)) == s


def test_parts_solved_at_once_equal_single_passes(monkeypatch):
    """A run's parts are solved at once, none by a forward pass of its own but those spelled in bytes and the long ones."""
    rng = np.random.default_rng(5)
    v = sentencepiece.Pieces(sentencepiece.Path(sentencepiece.DEFAULT_MODEL).read_bytes())
    alphabets = [["the", "a", " ", "ing", "e", "on", "er"], ["-", "=", " ", ".", "...", "1"], list("aé漢 \U0001f600½\udc80xÅ▁"), list("ab")]
    parts = [p for letters in alphabets for n in range(1, 70) for p in ("".join(rng.choice(letters, n)), "".join(rng.choice(letters, n)) * 2)]
    want = {p: v.best(p) for p in parts}
    assert dict(zip(parts, v.solve(parts), strict=True)) == want and v.solve([]) == []
    for few in (["a"], ["漢\udc80"], [" " * 65], ["a", " " * 65, "\udc80", "bb"]):
        assert v.solve(few) == [v.best(p) for p in few]

    texts = ["".join(rng.choice(alphabets[k % 2], 400)) for k in range(40)] + ["", "odd \udc80 " + "y" * 70]
    alone = [v.encode(t) for t in texts]
    want_of = functools.cache(v.best)
    passes: list[str] = []
    single = sentencepiece.Pieces.forward
    for remember, block in ((60_000, 1 << 16), (50, 100)):
        monkeypatch.setattr(sentencepiece, "REMEMBER", remember)
        monkeypatch.setattr(sentencepiece, "SOLVED_AT_ONCE", block)
        w = sentencepiece.Pieces(sentencepiece.Path(sentencepiece.DEFAULT_MODEL).read_bytes())
        for run in (texts[:20], texts, texts[::-1]):
            monkeypatch.setattr(sentencepiece.Pieces, "forward", lambda self, part: passes.append(part) or single(self, part))
            w.numbered(run)
            monkeypatch.setattr(sentencepiece.Pieces, "forward", single)
            assert all("\udc80" in p or len(p) > sentencepiece.LONG for p in passes)
            assert all(len(p) <= sentencepiece.LONG for p in w.known)
            for t, got in zip(run, w.encode_run(run), strict=True):
                ids, scores, edits = alone[texts.index(t)]
                assert np.array_equal(got[0], ids) and got[1] == scores
                assert [[(k, x.tolist()) for k, x in e] for e in got[2]] == [[(k, x.tolist()) for k, x in e] for e in edits]
                assert got[1][0] == sum(want_of(p)[0] for p in v.parts(t)) and got[0].tobytes() == b"".join(want_of(p)[2] for p in v.parts(t))


def test_repeated_characters_do_not_stall():
    v = sentencepiece.pieces()
    for text in ("-" * 231, "-" * 407, "=" * 1603, "\u65e5" * 5000, "-" * 100_000, "x" * 20_000):
        start = time.time()
        ids, scores, edits = v.encode(text)
        assert v.decode(ids) == text and scores == sorted(scores, reverse=True) and time.time() - start < 20

    def every(part, n):
        best = [[0.0]]
        for at in range(1, len(part) + 1):
            best.append(sorted((x + score for start, score, _ in v.edges(part, at) for x in best[start]), reverse=True)[:n])
        return best[-1]

    for part in (" " + "-" * 60, "=" * 41, "----==--==", "...!!!...!!!"):
        found = v.n_best(part, 6)
        assert [s for s, _ in found] == every(part, 6) and len({ids for _, ids in found}) == 6
        assert all(b"".join(v.text[i] for i in ids).decode() == part for _, ids in found)


def test_bytes_that_are_no_utf8_come_back():
    v = sentencepiece.pieces()
    raw = b"a\xff\xfe \xed\xa0\x80 b"
    text = raw.decode("utf-8", "surrogateescape")
    assert v.decode(v.encode(text)[0]).encode("utf-8", "surrogateescape") == raw


def test_sentencepiece_round_trip(spark, edge, empty):
    rows = sentencepiece.sentencepiece_nbest(edge).collect()
    assert len(rows) == len(EDGE) and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)
    back = sentencepiece.decode_column(sentencepiece.sentencepiece_nbest(edge.where("doc_id = 4"))).first()
    assert back.decoded == EDGE[4][1]
    assert sentencepiece.sentencepiece_nbest(empty).count() == 0


# ---- licenses


def test_license_scan_against_brute_force(spark, edge, empty):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    texts = ["Released under the MIT License. under the mit license under the mit license", "Apache License, Version 2.0; CC BY-NC", f"x\n{gpl}\nLicensed under the Apache License, Version 2.0.",
             "this work licensed under general public license version", "gnu public general", "UNDER THE MIT\nLICENSE", "under thé mit license"]
    docs = spark.createDataFrame([(50 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    text_of = {50 + i: t for i, t in enumerate(texts)} | {r[0]: r[1] for r in EDGE}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for k, text in text_of.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = word.findall(low)
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split(" ")
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += found
            base |= {label} if found else set()
        rows = licenses.templates()
        blocks = []
        for t, label, wanted, need, reach in rows:
            for start in range(len(words)):
                part = len(set(words[start : start + reach]) & set(wanted))
                if part >= need:
                    blocks.append((t, label, start, part / len(wanted)))
        r = got[k]
        assert {b.label for b in r.blocks} == {b[1] for b in blocks} and r.score == pytest.approx(1.0 if places else max([b[3] for b in blocks], default=0.0))
        assert {(b.label, b.start, round(b.share, 9)) for b in r.blocks} <= {(label, start, round(share, 9)) for _, label, start, share in blocks}
        assert base <= set(r.labels.split(",")) - {""} <= base | {b[1] for b in blocks} and (not blocks or r.labels)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(base)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
    assert licenses.license_scan(empty).count() == 0


def test_license_templates_across_line_ends(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and\n * associated documentation files"
    far = "redistribution and use in source and binary forms\n" + "other " * 30 + "\nwith or without modification are permitted"
    rows = [(1, bsd), (2, "word " * 37 + "\n" + mit), (3, far), (4, "x\n" + bsd.replace("\n# ", " ") + "\ny")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["bsd", "mit", "", "bsd"] and [got[i].score for i in (1, 2, 3)] == [1.0, 1.0, 0.0]
    assert [(b.label, b.start) for b in got[4].blocks] == [("bsd", 0)]


def test_licenses_that_quote_each_other(spark):
    texts = ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
             "this program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License"]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["lgpl", "cc-by-nc", "gpl"] and {b.label for b in rows[0].blocks} >= {"lgpl", "gpl"}


# ---- media


def test_media_columns(spark, edge, empty):
    rows = media.media_columns(edge, keep_media=True).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        text = (next(e[1] for e in EDGE if e[0] == r.doc_id) or "").encode()
        payload = text + b"\xff" * (-len(text) % 576 or (576 if not text else 0))
        assert media.read(r.media) == payload and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text), len(payload), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert len(r.hashes) == len(r.times) and r.times == sorted(r.times)
    same = [r for r in rows if r.doc_id == 5]
    assert same[0] == same[1] and media.media_columns(empty).count() == 0


def test_peaks_find_a_tone():
    t = np.arange(576 * 8)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8)
    assert (media.landmarks(tone)[:, 0] == 40).all()


# ---- mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return full | {s: weight[s] * share for s in free}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]
        free -= over
    return full


@pytest.mark.parametrize("shape", [(5, 40, 60), (1, 300, 2), (9, 30, 500)])
def test_mixing(spark, shape):
    n, each, most = shape
    rng = np.random.default_rng(n)
    rows = [(k * 1000 + i, " ".join(["w"] * int(rng.integers(0, most))), None if k == n - 1 else f"s{k}") for k in range(n) for i in range(each // (k + 1) + 1)]
    rows += rows[:3]
    got = mixing.mixing(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    source_of = {r[0]: r[2] for r in rows}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if source_of[r.doc_id] == s]
        assert {r.source_size for r in own} == {sizes[s]} and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-6
        assert all(r.taken in {k * r.size for k in range(4)} for r in own)


@pytest.mark.parametrize("many", [2, 20_000])
def test_mixing_of_many_sources_is_the_same(spark, monkeypatch, many):
    monkeypatch.setattr(mixing, "MANY", many)
    rows = [(k * 1000 + i, " ".join(["w"] * (i % 9)), f"s{k:02}" if k else None) for k in range(12) for i in range(30 if k != 3 else 200)]
    got = mixing.mixing(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    source_of = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and all(r.target == pytest.approx(want[source_of[r.doc_id]]) for r in got)
    taken = hashlib.md5(repr(sorted((r.doc_id, r.taken) for r in got)).encode()).hexdigest()
    assert taken == TAKEN.setdefault("many", taken)


TAKEN: dict[str, str] = {}


def test_mixing_edges(spark, edge, empty):
    assert mixing.mixing(empty).count() == 0 and mixing.sampled(empty).count() == 0
    got = mixing.sampled(edge)
    assert got.columns == edge.columns and {r.doc_id for r in got.collect()} <= {4, 5, 6, None}


# ---- near-duplicates


def test_triples_cover_every_four_positions():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in itertools.combinations(range(8), 4))


def test_quads_cover_every_four_positions():
    assert len(simhash.QUADS) == 70 and all(len(q) == 4 for q in simhash.QUADS)


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        simhash.components(chain, max_rounds=1)
    assert {r.root for r in simhash.components(chain).collect()} == {0}


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(edge):
    for _, text, *_ in EDGE:
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text if text is not LONG else LONG[:0] or text)


@pytest.mark.parametrize(("block", "positions"), [(4, simhash.TRIPLES), (1024, simhash.TRIPLES), (1024, simhash.QUADS)])
def test_components_against_brute_force(spark, monkeypatch, block, positions):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    prints = []
    for seed in rng.integers(0, 2**63, 30, dtype=np.uint64):
        x = int(seed)
        for _ in range(int(rng.integers(1, 25))):
            prints.append(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 7))):
                x ^= 1 << int(b)
    prints = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    want = {p: p for p in prints}

    def find(p):
        while want[p] != p:
            p = want[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and find(a) != find(b):
            lo, hi = sorted((find(a), find(b)))
            want[hi] = lo
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes, positions=positions)).distinct().collect()}
    assert {p: found.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_near_duplicates(spark, edge, empty):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    near = base.copy()
    near[200] = "changed"
    other = [f"v{i}" for i in rng.integers(0, 5000, 400)]
    rows = [(30, " ".join(base)), (20, " ".join(near)), (25, " ".join(base).upper()), (40, " ".join(other)), (41, " ".join(other))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0, "") for i, t in rows], DOCS).unionByName(edge)
    got = {}
    for r in simhash.simhash_near_dedup(docs).collect():
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint)
        got.setdefault(r.doc_id, r)
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    linked = (prints[20] ^ prints[30]).bit_count() <= 4
    assert got[30].component_id == got[25].component_id == (20 if linked else 25) and got[41].component_id == 40
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1 and got[1].fingerprint == "0" * 16
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == sorted({r.component_id for r in got.values() if r.component_id})
    assert simhash.simhash_near_dedup(empty).count() == 0


def test_one_of_each_component_with_null_and_repeated_ids(spark):
    texts = ["one two three four five", "red green blue black white", "sun moon star sky cloud", "cat dog cow hen fox"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (None, texts[2]), (7, texts[3]), (9, texts[3])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3])])


@pytest.mark.parametrize("hot", [1, 10_000])
def test_hot_keys_are_joined_apart(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rows = [(i, f"text number {i // 4} of a few words that are not so many as to be long") for i in range(60)] + [(None, " "), (70, None), (71, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_near_dedup(docs).collect()}
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    assert len(got) == 63 and got[None] == got[70] == got[71]
    for i, j in itertools.combinations([i for i in got if i is not None], 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            assert got[i] == got[j]


# ---- columns of any name


NAMES = ["a.b", "x`y", "id", "size", "odds", "bin", "p", "part", "certain", "missing", "before", "cut", "mean", "cell", "depth", "row", "__fp", "__lang", "score", "copies", "__c0"]


def test_extra_columns_of_any_name_pass_through(spark, empty):
    import corpus_pipeline

    rows = [(i, f"some english words about the number {i} and the day, and then some more words to fill a line of text number {i * i}", "en", f"s{i % 2}", *[i * 10 + k for k in range(len(NAMES))]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in NAMES))
    want = {r[0]: r[4:] for r in rows}
    marks = labels(spark, [(i, 1, 0) for i in range(30)])
    for stage in (language_id.accepted, lambda d: toxicity.accepted(d, marks), simhash.one_of_each, mixing.sampled):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = out.collect()
        assert found and all(tuple(r)[4:] == want[r[0]] for r in found)
    extra = [n for n in NAMES if n not in ("id", "size")]
    sized = docs.select("doc_id", "source", *[f"`{n.replace('`', '``')}`" for n in extra]).withColumnRenamed("doc_id", "id")
    mixed = mixing.mix(sized.withColumn("size", sized["id"] + 1))
    assert [c for c in mixed.columns if c not in ("source_size", "target", "copies")] == ["id", "source", *[n for n in extra if n != "copies"], "size"]
    assert {r["odds"] for r in mixed.select("odds").collect()} <= {v[4] for v in want.values()}
    placed = sharding.shards(sized.withColumn("bytes", sized["id"]))
    assert {r["depth"] for r in placed.select("depth").distinct().collect()} == {0} and {r["cell"] for r in placed.select("cell").collect()} == {v[13] for v in want.values()}
    assert corpus_pipeline.mix_sources(spark, empty, "").count() == 0 and corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0


# ---- chat


@pytest.mark.parametrize("block", [2, 256])
def test_rotation_against_direct_rendering(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = np.random.default_rng(6)
    turns = [(c, t, str(rng.choice(["ann", "bob", "<|cy"])), f"hi <|im_end|> {rng.integers(99)} é") for c in range(4) for t in range(9)]
    turns += [(5, 0, None, None), (5, 0, None, None), (None, 1, "x", "y"), (6, None, "solo", "")]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for conv in {t[0] for t in turns}:
        rows = sorted(((t, r or "unknown", (x or "")) for c, t, r, x in turns if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for me in {r[1] for r in rows}:
            mine = sorted((r for r in got if r.conv_id == conv and r.perspective == me), key=lambda r: r.part)
            assert [r.part for r in mine] == list(range(len(rows)))
            text = "".join(r.rendered for r in mine)
            for r, (t, who, said) in zip(mine, rows, strict=True):
                safe = lambda s: s.replace("<|", chat.PLAIN)
                head = "<|im_start|>assistant\n" if who == me else f"<|im_start|>user name={safe(who)}\n"
                assert text[r.start : r.end] == r.rendered == head + safe(said) + "<|im_end|>\n" and r.turn == t
                assert text[r.mask_start : r.mask_end] == (safe(said) + "<|im_end|>\n" if who == me else "")
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    vocab = [f"mot{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocab, 80)) + (" idiot moron idiot" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(100)]
    rows += [(200, rows[1][1], "en", "s1", 0), (201, "123 456", "en", "s1", 0), (202, None, None, None, None)]
    day = datetime.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(*r, day) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ts timestamp")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1, int(i % 5 == 0)) for i in range(100)]).write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path)).checkpoint()
        ids = {r.doc_id for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "language_id":
            assert ids == set(range(100)) | {200}
        if name == "toxicity":
            assert ids == {i for i in range(100) if i % 5} | {200}
        if name == "simhash_near_dedup":
            assert 200 not in ids and ids == {i for i in range(100) if i % 5}
        at = out
    assert all(r.round_trip for r in at.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
