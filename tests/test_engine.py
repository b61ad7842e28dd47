"""Settings, the engine's isolation of failures, cache, model hooks, sources and the command line."""

import json
import logging

import pytest

from rankmill import cache, cli, config, engine, errors, render
from rankmill.operators import maintenance, models, ranking, rerankers, vector
from rankmill.sources import logs, synthetic
from rankmill.sources import products as S

QUIET = {"logging": {"enabled": False}}
DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store") / "catalog")
    maintenance.Catalog(spark, root, buckets=2).rebuild(synthetic.fixture(spark))
    return root


# ---- settings


def test_defaults_presets_file_and_overrides(tmp_path):
    path = tmp_path / "settings.yaml"
    path.write_text("mode: production\nretrieval:\n  bm25:\n    top_k: 7\n    stopwords: [x]\ncache:\n  enabled: false\n")
    c = config.load(str(path), {"retrieval": {"bm25": {"k1": 2.0}}})
    assert (c["retrieval.bm25.top_k"], c["retrieval.bm25.k1"], c["retrieval.bm25.b"], c["retrieval.bm25.stopwords"]) == (7, 2.0, 0.75, ["x"])
    assert not c["logging.pretty"] and not c["cache.enabled"] and config.load()["cache.enabled"]
    assert config.load(str(tmp_path / "none.yaml")).values == config.load().values
    for text in ("- a\n", "a: [\n"):
        path.write_text(text)
        with pytest.raises(errors.ConfigurationError):
            config.load(str(path))
    with pytest.raises(errors.ConfigurationError, match="not found"):
        config.load(str(tmp_path / "none.yaml"), required=True)


def test_all_problems_are_told_at_once():
    wrong = {
        "mode": "fast", "search": {"default_limit": 20, "max_limit": 5}, "retrieval": {"bm25": {"enabled": False, "b": 2, "boosts": {"exact_code": -1}}, "vector": {"enabled": False, "metric": "l2"}},
        "reranking": {"provider": "von", "fallback": []}, "ranking": {"policy": "weighted", "weights": {"bm25": 0, "vector": 0, "rrf": 0, "reranker": 0}},
        "embedding": {"dimensions": 4, "provider": "transformers"}, "normalization": {"typo": {"max_edit_distance": 3}}, "cache": {"ttl_ms": 5}, "database": {"host": None},
    }
    with pytest.raises(errors.ConfigurationError) as caught:
        config.load(overrides=wrong)
    paths = {p.split(":")[0] for p in caught.value.problems}
    assert paths == {"mode", "search.max_limit", "retrieval", "retrieval.bm25.b", "retrieval.bm25.boosts.exact_code", "retrieval.vector.metric", "reranking.fallback", "ranking.weights", "embedding.dimensions", "embedding.model", "normalization.typo.max_edit_distance", "cache.ttl_ms", "database"}
    assert all(p in str(caught.value) for p in caught.value.problems) and caught.value.code == "CONFIGURATION_ERROR"


def test_fingerprint_follows_what_decides_results():
    base = config.load()
    assert base.fingerprint() == config.load(overrides={"cache": {"max_entries": 9}, "logging": {"level": "debug"}}).fingerprint()
    assert base.fingerprint() != base.changed({"fusion": {"k": 10}}).fingerprint() and len(base.fingerprint()) == 16


# ---- cache


def test_cache_forgets_the_oldest_and_the_old():
    now = [0.0]
    c = cache.ResultCache(2, 1000, lambda: now[0])
    c.put("a", [1]), c.put("b", [2])
    assert c.get("a") == [1]
    c.put("c", [3])
    assert c.get("b") is None and c.get("a") == [1]
    now[0] = 1.5
    assert c.get("a") is None and len(c.entries) == 1
    keys = {cache.cache_key(*args) for args in (("q", 1, "n", 1, "m", "r", "f"), ("q", 2, "n", 1, "m", "r", "f"), ("q", 1, "n", 2, "m", "r", "f"))}
    assert len(keys) == 3 and all(len(k) == 32 for k in keys)
    assert len(engine.request_id()) == 16 and engine.request_id() != engine.request_id()


# ---- engine


def test_search_cache_and_reload(spark, tmp_path):
    root = str(tmp_path / "catalog")
    catalog = maintenance.Catalog(spark, root, buckets=2)
    catalog.rebuild(synthetic.fixture(spark))
    e = engine.build_engine(spark, root, config.load(overrides=QUIET))
    rows, report = e.search_one("tube 110 blnc", 3)
    assert [r.product_id for r in rows][:2] == ["P000001", "P000081"] and len(rows) == 3 and not report.degradations
    assert rows[0].final_score == round(rows[0].final_score, 6) and {"normalizer", "bm25 retriever", "vector retriever", "total"} <= report.timings.keys()
    assert e.search_one("tube 110 blnc", 3)[1].cached and not e.search_one("tube 110 blnc", 2)[1].cached
    catalog.delete(spark.createDataFrame([("P000001",)], "product_id string"))
    assert e.reload() == 2
    again, fresh = e.search_one("tube 110 blnc", 3)
    assert not fresh.cached and again[0].product_id == "P000081"
    shown = render.stages("tube 110 blnc", *e.search_one("tube 110 blnc", 3, use_cache=False), e)
    assert all(part in shown for part in ("QUERY", "blnc -> blanc (typo)", "RETRIEVAL", "TIMINGS", "index_version: 2")) and "P000081" in shown
    assert render.results(again).startswith("1. Tube") and render.results([]) == "No results."


@pytest.mark.parametrize("text", [None, "", "   ", 5])
def test_no_text_has_no_results(spark, store, text):
    rows, report = engine.build_engine(spark, store, config.load(overrides=QUIET)).search_one(text)
    assert rows == [] and len(report.degradations) == (not isinstance(text, str))


def test_failing_parts_cost_their_part_only(spark, store, tmp_path):
    def down(*_):
        raise RuntimeError("is down")

    def late(queries):
        return queries.select("query_id", models.F.lit("P000001").alias("product_id"), models.F.raise_error(models.F.lit("late")).cast("double").alias("score"))

    settings = config.load(overrides={**QUIET, "reranking": {"provider": "von", "fallback": ["overlap"]}})
    log = str(tmp_path / "log")
    settings = settings.changed({"logging": {"events": {"enabled": True}}})
    texts = spark.createDataFrame([("1", "tube 110 blanc"), ("2", None), ("3", "x" * 600)], "query_id string, text string")
    e = engine.build_engine(spark, store, settings, normalize=down, vector_search=late, log_path=log)
    found, report = e.search(texts)
    assert {d.stage for d in report.degradations} == {"normalization", "retrieval", "reranking"} and report.reranker == "overlap"
    rows = found.where("query_id = '1'").collect()
    assert rows and all(r.vector_rank is None and r.bm25_rank is not None for r in rows) and found.where("query_id = '2'").count() == 0
    logged = {r.query: r for r in logs.searches(spark, log).collect()}
    assert len(logged) == 3 and logged["tube 110 blanc"].result_product_ids == [r.product_id for r in sorted(rows, key=lambda r: r.final_rank)]
    assert any("truncated" in d.message for d in report.degradations)
    both = engine.build_engine(spark, store, config.load(overrides=QUIET), lexical_search=down, vector_search=down)
    assert both.search(texts)[0].count() == 0
    with pytest.raises(Exception, match="nothing_such"):
        engine.build_engine(spark, store, config.load(overrides=QUIET), lexical_search=lambda q: q.select("nothing_such")).search(texts)


def test_settings_reach_the_stages(spark, store):
    one = {"retrieval": {"vector": {"enabled": False}, "bm25": {"top_k": 4}}, "search": {"max_limit": 3, "default_limit": 3}, "normalization": {"enabled": False}}
    rows, _ = engine.build_engine(spark, store, config.load(overrides={**QUIET, **one})).search_one("tube 110", 50)
    assert len(rows) == 3 and all(r.vector_rank is None for r in rows)
    rows, _ = engine.build_engine(spark, store, config.load(overrides={**QUIET, "reranking": {"candidate_limit": 2}})).search_one("tube 110", 50)
    assert len(rows) == 2
    both = {"ranking": {"policy": "weighted", "weights": {"bm25": 1.0, "vector": 0.0, "rrf": 0.0, "reranker": 0.0}}}
    rows, _ = engine.build_engine(spark, store, config.load(overrides={**QUIET, **both})).search_one("tube 110", 50)
    assert rows[0].final_score == 1.0 and rows[0].bm25_rank == 1 and all(0 <= r.final_score <= 1 for r in rows)


def test_missing_documents_are_left_out(spark, store):
    ghost = lambda q: q.select("query_id", models.F.explode(models.F.array(models.F.lit("P000002"), models.F.lit("GHOST"))).alias("product_id"), models.F.lit(1.0).alias("score"))
    rows, report = engine.build_engine(spark, store, config.load(overrides=QUIET), lexical_search=ghost, vector_search=ghost).search_one("tube")
    assert [r.product_id for r in rows] == ["P000002"] and [d.stage for d in report.degradations] == ["store"]


def test_logger_speaks_json_or_plainly(capsys):
    for pretty, level in ((False, "warn"), (True, "error")):
        log = engine.logger_of(config.load(overrides={"logging": {"pretty": pretty, "level": level}}))
        log.info("no"), log.error("told", extra={"fields": {"n": 1}})
        said = capsys.readouterr().err.strip()
        assert (json.loads(said)["n"] == 1 if not pretty else said.endswith("told n=1")) and "no" not in said.split("told")[0].split()
    assert isinstance(engine.logger_of(config.load(overrides=QUIET)).handlers[0], logging.NullHandler)


# ---- model hooks


def test_model_reranker_batches_and_missing_scores(spark):
    rows = [(q, f"P{i}", f"text {q}", "d" * 600, i + 1, 1.0 / (i + 1)) for q in ("a", "b") for i in range(5)]
    c = spark.createDataFrame(rows, "query_id string, product_id string, text string, search_document string, rrf_rank int, rrf_score double")

    def score(query, documents):
        assert len(documents) <= 2 and all(len(t) == 512 for _, t in documents)
        return {p: {"P0": 7.0, "P1": float("nan"), "P2": 0.4}[p] for p, _ in documents if p in ("P0", "P1", "P2") and query == "text a"}

    got = {(r.query_id, r.product_id): r.rerank_score for r in models.model_reranker(score, batch=2)(c).collect()}
    assert len(got) == 10 and (got["a", "P0"], got["a", "P1"], got["a", "P2"], got["a", "P3"], got["b", "P0"]) == (1.0, 0.0, 0.4, 0.0, 0.0)

    def fails(query, documents):
        raise ValueError("no model")

    scored, used, told = rerankers.chain(c, {"von": models.model_reranker(fails), "cross-encoder": models.unavailable("cross-encoder", "x"), "noop": rerankers.fused_order})
    assert used == "noop" and len(told) == 2 and scored.where("rerank_score = rrf_score").count() == 10
    assert ranking.capped(c, 2).count() == 4


def test_answers_of_models(spark):
    answers = ["score: 0.7 of 1", "0,25", "-3", "12", "none", None, "1e"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", models.first_number(models.F.col("a")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [0.7, 0.25, 0.0, 1.0, 0.0, 0.0, 1.0]
    assert models.object_in('so {"a": {"b": 1}} it is') == {"a": {"b": 1}} and models.object_in("{no}") is None and models.object_in("[1]") is None and models.object_in(None) is None


def test_embedder_hook_and_mock(spark, tmp_path):
    v = vector.mock_vector("tube", 8)
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == vector.mock_vector("tube", 8) != vector.mock_vector("tubes", 8)
    assert vector.mock_vector("x", 2, {"x": [0.0, 1.0]}) == [0.0, 1.0]
    texts = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(7)], "id long, text string")
    got = {r.id: r.vector for r in vector.embed(texts, lambda ts: [vector.mock_vector(t) for t in ts], 8, batch=2).collect()}
    assert len(got) == 7 and got[3] == vector.mock_vector("text 3") and got[0] == vector.mock_vector("")
    with pytest.raises(Exception, match="wrong length"):
        vector.embed(texts, lambda ts: [[1.0] for _ in ts], 8).collect()
    settings = config.load(overrides={**QUIET, "embedding": {"provider": "mock", "dimensions": 8}, "retrieval": {"vector": {"min_score": -1}}})
    root = str(tmp_path / "catalog")
    engine.build_engine(spark, root, settings).catalog.rebuild(synthetic.catalog(spark, 20))
    rows, report = engine.build_engine(spark, root, settings).search_one("tube")
    assert rows and not report.degradations and any(r.vector_rank for r in rows)
    with pytest.raises(errors.ModelUnavailableError):
        engine.build_engine(spark, root, config.load(overrides={**QUIET, "embedding": {"provider": "transformers", "model": "m"}}))


def test_error_summary():
    assert errors.summary(errors.StoreError("a\nb")) == {"name": "StoreError", "message": "a", "code": "STORE_ERROR"}
    assert errors.summary(ValueError("x"))["code"] is None and errors.ModelInferenceError("m", "von").provider == "von"


# ---- sources


def test_json_catalog_is_read_strictly(spark, tmp_path):
    good = [{"id": "a", "code": "C1", "attributes": {"x": 1, "y": "t", "z": None, "q": {"k": 1}, "l": [1], "b": True}, "brand": ""}, {"product_id": "b", "name": 5}]
    bad = [{"id": 3}, {"id": ""}, {"id": "c", "attributes": [1]}, {"name": "n"}]
    path = str(tmp_path / "catalog.json")
    (tmp_path / "catalog.json").write_text(json.dumps(good + bad))
    rows = {r.product_id: r for r in S.read_json_catalog(spark, path, strict=False).collect()}
    assert rows.keys() == {"a", "b"} and rows["a"].attributes == {"x": "1", "y": "t", "b": "true"} and (rows["a"].brand, rows["b"].name) == (None, "")
    assert S.quarantined(spark, path).count() == 4
    with pytest.raises(Exception, match="malformed"):
        S.read_json_catalog(spark, path).collect()


def test_jdbc_source(spark):
    rows = [(f"p{i:03}", f"C{i}", "tube", json.dumps({"color": "blanc"}), "b", "", "x") for i in range(50)] + [("o'x", "", "n", "", "", "", "")]
    types = ", ".join(f"{c} VARCHAR(200)" for c in ("ID", "CODE", "NAME", "ATTRIBUTES", "BRAND", "CATEGORY", "SUBCATEGORY"))
    url = "jdbc:derby:memory:shop;create=true"
    spark.createDataFrame(rows, types.replace("VARCHAR(200)", "string")).write.mode("overwrite").option("createTableColumnTypes", types).jdbc(url, "products", properties=DERBY)
    every = S.read_jdbc(spark, url, options=DERBY, parts=4, attributes="attributes")
    found = {r.product_id: r for r in every.collect()}
    assert len(found) == 51 and every.rdd.getNumPartitions() == 4 and found["p003"].attributes == {"color": "blanc"} and found["o'x"].brand is None
    ids = spark.createDataFrame([("o'x",), ("p001",), ("zz",)], "product_id string")
    assert {r.product_id for r in S.read_jdbc(spark, url, ids=ids, options=DERBY, attributes="attributes").collect()} == {"o'x", "p001"}
    none = S.read_jdbc(spark, url, ids=ids.where("false"), options=DERBY, attributes="attributes")
    assert none.count() == 0


def test_gold_template(spark, tmp_path):
    S.write_template(spark.createDataFrame([("a",), ("b",)], "query string").coalesce(1), str(tmp_path / "gold"))
    rows = S.read_graded(spark, str(tmp_path / "gold")).collect()
    assert {(r.query, r.product_id, r.label) for r in rows} == {("a", "", 0.0), ("b", "", 0.0)}


# ---- command line


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "code": "T110", "name": "Tube", "attributes": {"diameter": "110 mm"}}, {"id": "b", "code": "V1", "name": "Vanne"}]))
    (tmp_path / "gold.jsonl").write_text('{"query": "tube 110", "productId": "a", "label": 4}\n')
    base = ["--store", str(tmp_path / "store"), "--config", str(tmp_path / "none.yaml")]

    def said(*args):
        assert cli.main([*base, *args], spark) == 0
        return capsys.readouterr().out

    assert "documents:        0" in said("inspect") and "No results" in said("search", "tube")
    assert "2 upserted" in said("build", "--catalog", str(tmp_path / "c.json"))
    assert "T110" in said("search", "tube 110") and "TIMINGS" in said("search", "tube 110", "--debug")
    assert "recall_at_10: 1.000" in said("evaluate", "--dataset", str(tmp_path / "gold.jsonl"))
    assert "hybrid-only" in said("evaluate", "--dataset", str(tmp_path / "gold.jsonl"), "--benchmark")
    assert "1 deleted" in said("delete", "--id", "a") and "1 upserted" not in said("update", "--catalog", str(tmp_path / "c.json"))
    assert json.loads(said("--json", "inspect"))["documents"] == 2
    (tmp_path / "bad.yaml").write_text("reranking:\n  provider: magic\n")
    assert cli.main(["--config", str(tmp_path / "bad.yaml"), "inspect"], spark) == 1 and "reranking.provider" in capsys.readouterr().err
    assert cli.main([*base, "evaluate", "--dataset", str(tmp_path / "gold.jsonl"), "--reranker", "magic"], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    told = capsys.readouterr().out
    assert all(c in told for c in ("build", "update", "delete", "search", "evaluate", "benchmark", "inspect"))


def test_benchmark_row(spark):
    from rankmill import benchmark

    row = benchmark.measure(spark, (300,), 20)[0]
    assert row["docs"] == 300 and row["results"] > 0 and row["bottleneck"] in ("normalizer", "bm25 retriever", "vector retriever", "fusion")
    assert render.markdown([row]).splitlines()[2].startswith("| 300 |")
