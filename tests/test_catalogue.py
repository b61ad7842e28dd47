"""Every catalogue query against its SQL oracle, and the plans and functions behind them."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window

from rankmill.errors import StoreError
from rankmill.functions import text as T
from rankmill.operators import documents, evaluation, lexical, maintenance, ranking, vector
from rankmill.plans import catalogue, pipeline
from rankmill.sources import products as S

SF = "/root/testdata/sf0.001"
PRODUCT = "product_id string, code string, name string, attributes map<string,string>, brand string, category string, subcategory string"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("part", "documents", "embeddings", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_oracle(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert rounded(df.select(*cols).collect()) == rounded([[r[names.index(c)] for c in cols] for r in found.fetchall()])


def test_hydrating_keys_beyond_six_digits_equals_its_oracle(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet").limit(6).drop("p_partkey").withColumn("n", T.F.row_number().over(Window.orderBy("p_name")))
    keys = T.F.element_at(T.F.array(*[T.F.lit(k).cast("long") for k in (3, 6, 100_000, 500_000, 500_004, 1_000_000)]), T.F.col("n"))
    part.select(keys.alias("p_partkey"), "*").drop("n").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLES["hydrate_left_join"]).fetchall()
    got = catalogue.QUERIES["hydrate_left_join"](spark, str(tmp_path)).select("product_id", "name").collect()
    assert rounded(got) == rounded(want) and [i for i, _ in rounded(want)] == ["P000006", "P100000", "P100000"]


def test_vector_searches_ask_every_fiftieth_vector(spark):
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()]
    for name in ("cosine_topk", "inner_product_topk", "recall_at_k"):
        rows = catalogue.QUERIES[name](spark, SF).select("query_id").distinct().collect()
        assert sorted(r.query_id for r in rows) == sorted(ids) and max(ids) > 10


def analyzed(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(T.analyze(T.F.col("t")).alias("x")).first()
    return [(t.term, t.kind, t.is_variant) for t in row.x]


def test_terms(spark):
    assert analyzed(spark, "Tubes PVC 110 x 45") == [("tubes", "word", False), ("tube", "word", True), ("pvc", "word", False), ("110x45", "dimension", False), ("110", "number", False), ("45", "number", False)]
    assert [t for t, *_ in analyzed(spark, "Ø110 évacuation 2,5 mm")] == ["dia", "110", "evacuation", "2.5", "mm"]
    assert analyzed(spark, "") == [] and analyzed(spark, None) == []
    codes = spark.createDataFrame([("T-110-B45",)], "c string").select(T.analyze_code(T.F.col("c")).alias("x")).first().x
    assert [t.term for t in codes] == ["t110b45", "t", "110", "b", "45", "t-110-b45"]


def test_order_decides_term_frequency(spark):
    docs = documents.build(spark.createDataFrame([("a", "", "tubes tube", {}, None, None, None), ("b", "", "tube tubes", {}, None, None, None)], PRODUCT))
    tf = {(r.product_id, r.term): r.tf for r in lexical.term_frequencies(lexical.occurrences(docs)).collect()}
    assert tf["a", "tube"] == 2 and tf["b", "tube"] == 1


def test_search_document_and_guards(spark):
    p = spark.createDataFrame([("P1", "T1", " Tube ", {"color": "blanc", "wall_depth": "2", "x": " "}, "B", "C", "D"), ("", "x", "x", {}, None, None, None)], PRODUCT)
    rows = documents.build(p).collect()
    assert len(rows) == 1 and rows[0].search_document == "T1 | Tube | couleur blanc | wall depth 2 | B | C | D" and len(rows[0].document_hash) == 64
    assert S.clean(p, quarantine=True).count() == 1


def test_codes_meet_by_prefix_in_both_directions(spark):
    docs = documents.build(spark.createDataFrame([("a", "AB12CD", "x", {}, None, None, None), ("b", "AB1", "x", {}, None, None, None), ("c", "ZZ99", "x", {}, None, None, None)], PRODUCT))
    q = spark.createDataFrame([(1, ["x"], ["AB12"]), (2, ["x"], ["ab-12-cd"]), (3, ["x"], ["ZZ9"])], "query_id int, tokens array<string>, codes array<string>")
    index = lexical.build_index(docs)
    assert sorted((r.query_id, r.product_id) for r in lexical.prefix_codes(lexical.query_codes(q), index).collect()) == [(1, "a"), (1, "b")]
    assert [(r.query_id, r.product_id) for r in lexical.exact_codes(lexical.query_codes(q), index).collect()] == [(2, "a")]
    best = lexical.search(q, index).where("rank = 1").orderBy("query_id").collect()
    assert best[1].product_id == "a" and best[1].exact == 25.0


def test_metrics_by_hand(spark):
    results = spark.createDataFrame([(1, "A", 1), (1, "X", 2), (1, "B", 3)], "query_id int, product_id string, rank int")
    gold = spark.createDataFrame([(1, "A", 3.0), (1, "B", 1.0), (1, "C", 4.0), (2, "Z", 1.0)], "query_id int, product_id string, label double")
    m = {r.query_id: r for r in evaluation.per_query(results, gold).collect()}
    assert m[1].recall == pytest.approx(2 / 3) and m[1].mrr == 1.0 and (m[2].recall, m[2].mrr, m[2].ndcg) == (0, 0, 0)
    lat = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40, 100)], "g string, v double")
    assert evaluation.latency_summary(lat, "v", ["g"]).first().p50 == 30


def test_fusion_counts_a_product_once_per_source(spark):
    hits = spark.createDataFrame([(1, "bm25", "A", 2.0), (1, "bm25", "A", 1.0), (1, "bm25", "B", 1.5), (1, "vector", "B", 0.9)], "query_id int, source string, product_id string, score double")
    f = ranking.fuse(ranking.rank_hits(hits)).orderBy("rrf_rank").collect()
    assert [r.product_id for r in f] == ["B", "A"] and f[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)


@pytest.mark.parametrize(("name", "weights"), [("rrf_fusion", (1.0, 1.0)), ("weighted_rrf", (2.0, 0.5))])
def test_fusion_of_lexical_and_vector_hits_against_brute_force(spark, name, weights):
    docs = documents.build(S.from_part(spark, SF))
    texts = catalogue._texts(spark)
    lex = {(r.query_id, r.product_id): r.rank for r in lexical.search(texts, lexical.build_index(docs)).collect()}
    embedded = [(r.id, r.vector) for r in vector.hash_embed(docs.selectExpr("product_id AS id", "search_document AS text")).collect()]
    near = {}
    for q in vector.hash_embed(texts.selectExpr("query_id AS id", "text")).collect():
        cosine = [(-round(sum(a * b for a, b in zip(q.vector, v)), 9), i) for i, v in embedded]
        near |= {(q.id, i): k for k, (s, i) in enumerate(sorted(cosine)[: vector.TOP_K], 1) if s <= -vector.MIN_SCORE}
    assert near
    want = {k: sum(w / (60 + ranks[k]) for w, ranks in zip(weights, (lex, near)) if k in ranks) for k in lex.keys() | near.keys()}
    rows = catalogue.QUERIES[name](spark, SF).collect()
    for q in {q for q, _ in want}:
        best = sorted((-round(x, 12), i) for (k, i), x in want.items() if k == q)[: ranking.FUSED]
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rrf_rank)
        assert [r.product_id for r in got] == [i for _, i in best]
        assert [(r.bm25_rank, r.vector_rank) for r in got] == [(lex.get((q, i)), near.get((q, i))) for _, i in best]


def test_vector_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [(r.id, r.rank) for r in vector.top_k(q, v, 10).orderBy("rank").collect()] == [(1, 1), (5, 2), (2, 3)]
    with pytest.raises(Exception, match="not finite"):
        vector.checked(spark.createDataFrame([(1, [float("inf"), 0.0])], "id int, vector array<double>"), 2).collect()
    assert abs(sum(x * x for x in vector.hash_embed(spark.createDataFrame([(1, "")], "id int, text string"), 16).first().vector) - 1) < 1e-9


@pytest.mark.parametrize("size", [1 << 9, 64 << 20])
def test_vector_blocks_and_ties_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(vector, "QUERY_BYTES", size)
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(200)] + [("short", [1.0])]
    q = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(30)]
    got = vector.top_k(spark.createDataFrame(q, "query_id int, vector array<double>"), spark.createDataFrame(rows, "id string, vector array<double>").repartition(5), 7, "inner_product").collect()
    for i, v in q:
        want = sorted((-sum(a * b for a, b in zip(v, w)), n) for n, w in rows if len(w) == 4)[:7]
        assert [(r.score, r.id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [(-s, n) for s, n in want]


def test_approximate_search_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(T.F.col("vec_id").alias("id"), T.F.col("embedding").alias("vector"))
    q = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in vector.top_k(q, e, 10).collect()}
    near = {(r.query_id, r.id) for r in vector.approximate_top_k(q, e, 10, tables=16, bits=5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_many_query_terms_are_dealt_to_parts(spark, monkeypatch):
    index = lexical.build_index(documents.build(S.from_part(spark, SF)))
    texts = catalogue._texts(spark)
    shown = lambda: sorted((r.query_id, r["rank"], r.product_id, r.score) for r in lexical.search(texts, index).collect())
    few = shown()
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert shown() == few


def test_index_is_one_scan_and_postings_are_not_shuffled(spark):
    index = lexical.build_index(documents.build(S.from_part(spark, SF)))
    plan = lexical.matching(lexical.query_terms(catalogue._texts(spark)), index)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("groups", [0, 20_000])
def test_percentiles_against_sorting(spark, monkeypatch, groups):
    monkeypatch.setattr(evaluation, "GROUPS", groups)
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, values in {"a": rng.integers(0, 9, 700), "b": rng.normal(0, 1e6, 900), "c": [5], None: [3, 1, 2, 2], "d": [7] * 50 + [1e12]}.items() for v in values] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for discrete in (False, True):
        for r in evaluation.nth(df, "v", ["g"], shares, discrete).collect():
            own = sorted(v for g, v in rows if g == r.g and v is not None)
            for name, p in shares.items():
                at = max(0, math.ceil(p * len(own)) - 1) if discrete else min(len(own) - 1, math.floor(p * len(own)))
                assert r[name] == own[at]


def test_snapshots(spark, tmp_path):
    row = lambda i, name: (f"P{i}", "", name, {}, None, None, None)
    c = maintenance.Catalog(spark, str(tmp_path / "catalog"), 16, buckets=4)
    assert (c.version(), c.count(), c.index(), list(c.iterate())) == (0, 0, None, [])
    e = c.rebuild(spark.createDataFrame([row(i, "tube") for i in range(5)], PRODUCT))
    assert (e.version, e.upserted, e.embedded) == (1, 5, 5)
    e = c.upsert(spark.createDataFrame([row(0, "tube"), row(1, "vanne"), row(9, "joint"), row(9, "joint")], PRODUCT))
    assert (e.version, e.upserted, e.embedded) == (2, 3, 2) and c.documents().count() == 6 and c.count_embeddings() == 6 and c.count_embeddings("other") == 0
    assert [r.product_id for r in c.iterate()] == ["P0", "P1", "P2", "P3", "P4", "P9"]
    ids = spark.createDataFrame([("P0",), ("P77",)], "product_id string")
    assert [r.product_id for r in c.get(ids).collect()] == ["P0"]
    e = c.delete(ids)
    assert (e.deleted, c.documents().count(), c.embeddings().count()) == (1, 5, 5)
    assert {r.term: r.df for r in c.index().term_stats.collect()} == {"tube": 3, "vanne": 1, "joint": 1} and c.index().corpus.first().n == 5
    e = c.delete_embeddings(spark.createDataFrame([("P9",)], "product_id string"))
    assert (e.deleted, c.count(), c.embeddings().count()) == (1, 5, 4)
    c.delete(c.documents().select("product_id"))
    assert c.count() == 0 and c.index().term_stats.count() == 0 and c.index().postings.count() == 0
    c.upsert(spark.createDataFrame([row(3, "coude")], PRODUCT))
    assert c.count() == 1 and c.index().corpus.first().avg_1 == 1.0


def test_two_writers_and_a_dead_one(spark, tmp_path):
    row = ("P1", "", "tube", {}, None, None, None)
    c = maintenance.Catalog(spark, str(tmp_path / "catalog"), 16, buckets=2)
    c.rebuild(spark.createDataFrame([row], PRODUCT))
    c._claim(2)
    with pytest.raises(StoreError, match="another"):
        c.upsert(spark.createDataFrame([row], PRODUCT))
    assert c.version() == 1 and c.count() == 1
    c.release()
    assert c.upsert(spark.createDataFrame([row], PRODUCT)).version == 2
    with pytest.raises(StoreError, match="dimensions"):
        maintenance.Catalog(spark, str(tmp_path / "catalog"), 8, model_version="hashing-d16-v1")


def test_hybrid_plan_has_no_nested_loop_over_documents(spark):
    plan = pipeline.candidates(catalogue._texts(spark), S.from_part(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
