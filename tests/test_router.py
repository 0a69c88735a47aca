from __future__ import annotations

import json
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyrank.functions import vectors
from tallyrank.operators import agent, bm25, dense, evaluate, prompt, scoring
from tallyrank.plans.engine import Router

TOOLS = [
    {"name": "search_restaurants", "description": "Find restaurants by cuisine", "server": "food", "parameters": {"type": "object", "properties": {"cuisine": {"type": "string"}}, "required": ["cuisine"]}},
    {"name": "search_products", "description": "Find grocery products by name", "server": "shop", "parameters": {"name": {"type": "string"}}},
    {"name": "book_table", "description": "Reserve a table at a restaurant", "server": "dine", "parameters": {"type": "object", "properties": {"seat": {"enum": ["in", "out"]}, "tags": {"type": "array", "items": {"type": "string"}}}}, "examples": ["book a table for two"]},
]


@pytest.fixture(scope="module")
def router(spark):
    return Router.from_items(spark, TOOLS, hybrid=True)


def test_route_finds_the_tool(router):
    row = router.route(router.queries("book a table for two people"), score_floor=0.1).first()
    assert row["has_match"] and router.rows[row["candidates"][0]["item_id"]]["name"] == "book_table"


def test_blank_and_foreign_queries(router):
    rows = router.route(router.queries(" ", "zzz qqq xxx")).orderBy("query_id").collect()
    assert [r["mode"] for r in rows] == ["no_candidates", "no_confident_match"]
    with pytest.raises(TypeError):
        router.queries(None)


def test_server_filter(router):
    row = router.retrieve(router.queries("find products"), server="food").first()
    assert [router.rows[c["item_id"]]["server"] for c in row["candidates"]] == ["food"] and row["candidates"][0]["rank"] == 1


def test_prompt_and_agent(router):
    routed = router.route(router.queries("book a table"), score_floor=0.1)
    text = router.prompts(routed).first()
    assert "seat: enum(in|out), tags: array<string>" in text["prompt"] and text["prompt_tokens"] > 0
    assert len(json.loads(router.all_items_prompt())) == 3
    done = router.agent(router.queries("find restaurants", ""), score_floor=0.1).orderBy("query_id").collect()
    assert (done[0]["stage"], done[0]["tool"], done[0]["arguments"]) == ("execute", "search_restaurants", {"cuisine": "<cuisine>"})
    assert done[1]["stage"] == "refuse"
    assert router.agent(router.queries("find restaurants"), lambda c: F.lit(99).cast("long"), score_floor=0.1).first()["stage"] == "reject"
    assert router.agent(router.queries("find restaurants"), lambda c: F.lit(None).cast("long"), score_floor=0.1).first()["stage"] == "decline"


def test_no_match_prompt(router):
    assert router.prompts(router.route(router.queries("zzz"))).first()["prompt"] == prompt.NO_MATCH


def test_explain(router):
    rows = router.explain(router.route(router.queries("book a table"), score_floor=0.1)).orderBy("rank").collect()
    assert rows[0]["hits_name"] == ["book", "table"] and rows[0]["reason"].startswith("Ranked #1 with a")
    assert router.explain(router.route(router.queries("zzz"))).first()["rank"] == 0


def test_dataset_and_benchmark(router):
    rows = router.dataset(12).cache()
    assert {r["category"] for r in rows.select("category").distinct().collect()} == {"clean", "ambiguous", "typo", "adversarial"}
    out = {(r["baseline"], r["category"]): r for r in router.benchmark(rows).collect()}
    assert out["hybrid", None]["top_1_accuracy"] > out["all_tools", None]["top_1_accuracy"]
    assert out["all_tools", None]["avg_tools_in_context"] == 3
    text = evaluate.render_summary([r.asDict() for r in out.values()])
    assert "| hybrid |" in text
    sweep = [r.asDict() for r in router.calibrate(rows).collect()]
    assert len(sweep) == len(evaluate.GAP_GRID) and "(shipped)" in evaluate.render_calibration(sweep, [])
    with pytest.raises(ValueError):
        router.outcomes(rows, baselines=("nope",))


def test_stream(spark, router, tmp_path):
    from tallyrank.streaming.score import route_stream

    router.queries("book a table", "find products").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, query string").parquet(str(tmp_path / "in"))
    query = route_stream(router, stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_dense_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    m = np.random.default_rng(1).normal(size=(40, 16))
    m[7] = m[6]
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    table = spark.createDataFrame([*rows, (50, None), (51, [1.0]), (52, [float("nan")] * 16), (None, [1.0] * 16)], "vec_id long, embedding array<double>")
    got = dense.top_k_vectors(table, table.where("vec_id < 8 OR vec_id >= 50"), 5).orderBy("query_id", "rank").collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert {r["query_id"] for r in got} == set(range(8))
    for q in range(8):
        s = np.clip(unit @ unit[q], 0, 1)
        want = [i for i in np.lexsort((np.arange(40), -np.round(s, 9))) if i != q][:5]
        assert [r["vec_id"] for r in got if r["query_id"] == q] == want
    assert dense.top_k_vectors(table.limit(0), table, 5).count() == 0


def test_vector_table(spark):
    store = dense.VectorTable(spark, 4)
    basis = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "vec_id long, embedding array<double>")
    store.add(basis)
    assert len(store) == 4 and 3 in store and 9 not in store and {r[0] for r in store.ids().collect()} == {0, 1, 2, 3}
    assert [r["vec_id"] for r in store.search(basis.where("vec_id = 2"), 1).collect()] == [2]
    for wrong in (basis, spark.createDataFrame([(8, [1.0])], basis.schema), spark.createDataFrame([(8, [float("nan")] * 4)], basis.schema)):
        with pytest.raises(ValueError):
            store.add(wrong)
    store.reset()
    assert len(store) == 0


def test_best_places_and_min_max():
    rng = np.random.default_rng(2)
    keys = np.round(rng.random((50, 300)), 2)
    want = np.array([sorted(range(300), key=lambda i, row=row: (-row[i], i))[:7] for row in keys])
    assert (vectors.best_places(keys, 7) == want).all()
    assert scoring.min_max(np.array([[1.0, 2, 3], [5, 5, 5], [0, 0, 0]])).tolist() == [[0, 0.5, 1], [1, 1, 1], [0, 0, 0]]


def test_scoring_is_linear_in_items(spark):
    """Four times the items take clearly less than sixteen times as long."""
    queries = spark.createDataFrame([(i, f"find item number {i} of kind {i % 7}") for i in range(2000)], "query_id long, query string").repartition(1).cache()
    queries.count()

    def seconds(n):
        index = scoring.ItemIndex(list(range(n)), [f"item {i} of kind {i % 7} and make {i % 11}" for i in range(n)])
        scoring.retrieve(queries, index, 5, True).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        scoring.retrieve(queries, index, 5, True).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    assert seconds(800) < 8 * max(0.25, seconds(200))


class Letters:
    """An embedder of letter counts, not normalised."""

    dim = 26

    def embed(self, text):
        return np.bincount([ord(c) - 97 for c in (text or "").lower() if "a" <= c <= "z"], minlength=26).astype(float)


def test_embedder_is_exchangeable(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    router = Router.from_items(spark, TOOLS, embedder=Letters())
    row = router.retrieve(router.queries("zzz table at a book")).first()
    a, b = Letters().embed("zzz table at a book"), Letters().embed(router.index.texts[row["candidates"][0]["item_id"]])
    assert row["candidates"][0]["score"] == pytest.approx(a @ b / np.sqrt(a @ a * (b @ b)))
    assert vectors.HashEmbedder(8).embed_batch([]).shape == (0, 8)
    with pytest.raises(TypeError):
        vectors.HashEmbedder().embed_batch(["x", None])


def test_bm25_gives_items_of_score_zero(spark):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["red apple", "green apple", "blue sky", "", "grey stone"])], "item_id long, text string")
    queries = spark.createDataFrame([(1, "an apple a day"), (2, "nothing here"), (3, " "), (4, None), (5, "blue apple")], "query_id long, query string")
    got = bm25.top_k(items, queries, 4).orderBy("query_id", "rank").collect()
    found = {q: [(r["item_id"], r["bm25"] > 0) for r in got if r["query_id"] == q] for q in range(1, 6)}
    assert found[1] == [(0, True), (1, True), (2, False), (3, False)] and found[2] == [(0, False), (1, False), (2, False), (3, False)]
    assert found[3] == found[4] == [] and found[5] == [(2, True), (0, True), (1, True), (3, False)]
    assert all([r["rank"] for r in got if r["query_id"] == q] == [1, 2, 3, 4] for q in (1, 2, 5))


def test_all_tools_are_in_manifest_order(spark, router):
    rows = spark.createDataFrame([("q", t["name"], "clean") for t in TOOLS], "query string, correct_item string, category string")
    out = router.outcomes(rows, baselines=("all_tools",)).collect()
    assert {router.rows[r["gold"]]["name"]: r["rank"] for r in out} == {t["name"]: i for i, t in enumerate(TOOLS, 1)}


def test_agent_chooser():
    assert callable(agent.top_ranked)
