"""The synthetic catalog against a sequential generator, its labels, the search quality on them, logs and rerankers."""

from pyspark.sql import functions as F

from rankmill.operators import rerankers
from rankmill.plans import catalogue
from rankmill.sources import logs, synthetic


def sequential(seed, count):
    """Mulberry32 number by number."""
    out, a, m = [], seed, 0xFFFFFFFF
    for _ in range(count):
        a = (a + 0x6D2B79F5) & m
        t = ((a ^ a >> 15) * (a | 1)) & m
        t ^= (t + ((t ^ t >> 7) * (t | 61) & m)) & m
        out.append((t ^ t >> 14) / 4294967296)
    return out


def test_numbers_and_catalog_equal_the_sequential_generator(spark):
    for seed in (7, 42, 0xFFFFFFF0):
        assert [r.x for r in spark.range(1, 500).select(synthetic.draw(seed, F.col("id")).alias("x")).collect()] == sequential(seed, 499)
    numbers = iter(sequential(7, 2000))
    rows = synthetic.fixture(spark).orderBy("product_id").collect()
    for k, row in enumerate(rows):
        family = synthetic.FAMILIES[k % 8]
        pick = lambda values: values[int(next(numbers) * len(values))]
        assert (row.name, row.attributes["color"], row.brand) == (pick(family[2]), pick(family[3]), pick(synthetic.BRANDS))
        for name, values, unit in zip(("diameter", "length", "section", "power", "material"), family[4:9], (" mm", " m", "", "", "")):
            assert row.attributes.get(name) == (f"{pick(values)}{unit}" if values else None)
    assert len(rows) == 200 and len({r.code for r in rows}) == 200
    assert (rows[0].product_id, rows[0].code, rows[0].name, rows[0].brand) == ("P000001", "TD110L4BL0", "Tube PVC évacuation", "AquaLine")


def test_gold_labels(spark):
    labels = synthetic.gold(synthetic.fixture(spark))
    assert {r.label: r["count"] for r in labels.groupBy("label").count().collect()} == {4.0: 60, 3.0: 8, 2.0: 50, 1.0: 25}
    assert labels.select("query").distinct().count() == 28


def test_quality_gate(spark):
    row = catalogue.QUERIES["catalog_quality"](spark, "").first()
    found = [round(row[c], 3) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "recall_at_20", "mrr_at_10", "ndcg_at_10")]
    assert row.queries == 28 and found == [0.409, 0.829, 0.928, 0.959, 1.0, 0.985]


def test_rerankers_over_frozen_candidates(spark):
    rows = [(q, f"P{k}", 1 / (60 + k), text, document) for q, text in ((1, "tube blanc"), (2, "coude")) for k, document in enumerate(["vanne", "tube gris", "tube blanc", "coude"])]
    candidates = spark.createDataFrame(rows, "query_id int, product_id string, rrf_score double, text string, search_document string")
    wanted = spark.createDataFrame([(1, "P2", 4.0), (2, "P3", 4.0)], "query_id int, product_id string, label double")

    def broken(c):
        return c.withColumn("rerank_score", F.raise_error(F.lit("down")).cast("double"))

    rows = rerankers.compare(candidates, wanted, {"overlap": rerankers.overlap, "broken": broken}).collect()
    assert [(r.reranker, r.failed) for r in rows] == [("hybrid-only", False), ("overlap", False), ("broken", True)]
    assert [r.mrr_at_10 for r in rows] == [(1 / 3 + 1 / 4) / 2, 1.0, (1 / 3 + 1 / 4) / 2] and rows[0].queries == 2
    _, used, errors = rerankers.chain(candidates, {"broken": broken, "overlap": rerankers.overlap})
    assert used == "overlap" and len(errors) == 1 and rerankers.chain(candidates, {"broken": broken})[1] == "rrf"


def test_logs(spark, tmp_path):
    at = str(tmp_path / "searches")
    rows = spark.createDataFrame([("a", "tube", 1.6, "2026-01-01 00:00:00"), ("a", "tube", 9.2, "2026-01-02 00:00:00"), ("b", "vis", None, "2026-01-01 00:00:00")], "search_id string, query string, latency_ms double, created_at string")
    for _ in range(2):
        logs.append_searches(rows, at)
    assert sorted((r.search_id, r.latency_ms) for r in logs.searches(spark, at).collect()) == [("a", 2), ("b", None)]
    logs.append_events(spark.createDataFrame([("a", "click", "P1", 2)], "search_id string, event_type string, product_id string, position int"), str(tmp_path / "events"))
    assert logs.events(spark, str(tmp_path / "events")).first().payload is None
    for i in (2, 1):
        logs.save_evaluation_queries(spark.createDataFrame([(i, f"q{i}", ["P1"])], "id long, query string, relevant_product_ids array<string>"), str(tmp_path / "eval"))
    assert [r.query for r in logs.evaluation_queries(spark, str(tmp_path / "eval")).collect()] == ["q1", "q2"]
    for value in ({"k": 60}, {"k": 61}):
        logs.put_setting(spark, str(tmp_path / "settings"), "fusion", value)
    assert logs.setting(spark, str(tmp_path / "settings"), "fusion") == {"k": 61} and logs.setting(spark, str(tmp_path / "settings"), "none") is None
