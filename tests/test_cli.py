from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyrank.__main__ import main
from tallyrank.operators import prompt
from tallyrank.plans.engine import Router
from tallyrank.sources import manifest

TOOLS = {"server": "dine", "tools": [
    {"name": "book_table", "description": "Reserve a table at a restaurant", "inputSchema": {"seats": {"type": "integer"}}},
    {"name": "find_menu", "description": "Show dishes that a kitchen serves"},
]}


@pytest.fixture
def path(tmp_path):
    at = tmp_path / "m.json"
    at.write_text(json.dumps(TOOLS))
    return str(at)


def test_commands(spark, path, tmp_path, capsys):
    def told(*args):
        code = main([args[0], "--manifest", path, *args[1:]])
        return code, capsys.readouterr().out

    assert told("route", "book a table at a restaurant")[1].startswith("Ranked #1 with a")
    code, out = told("route", "--json", "--score-floor", "0", "--gap-threshold", "1", "book a table at a restaurant")
    assert code == 0 and [x["item"] for x in json.loads(out)["items"]] == ["dine.book_table", "dine.find_menu"]
    assert len(json.loads(told("route", "--json", "--score-floor", "0", "--gap-threshold", "1", "-k", "1", "book a table")[1])["items"]) == 1
    assert json.loads(told("route", "--json", "--no-gate", "zzz")[1])["mode"] == "disabled"
    assert told("route", "--server", "elsewhere", "book a table")[0] == 2
    assert told("route", "zzz")[0] == 2 and told("route", "--gap-threshold", "7", "zzz")[0] == 1
    code, out = told("prompt", "zzz")
    assert code == 2 and prompt.NO_MATCH in out
    assert '"seats"' in told("prompt", "--style", "json", "--score-floor", "0.1", "book a table")[1]
    code, out = told("agent", "--json", "reserve a table at a restaurant")
    done = json.loads(out)
    assert code == 0 and done["stage"] == "execute" and [s["step"] for s in done["steps"]] == ["route", "prompt", "choose", "execute"]
    assert done["tokens_saved"] == done["all_tokens"] - done["prompt_tokens"] > 0
    code, out = told("agent", "--server", "elsewhere", "reserve a table at a restaurant")
    assert code == 2 and "refuse: nothing was routed" in out
    assert json.loads(told("stats")[1])["items"] == 2 and told("items")[1].startswith("dine.book_table: Reserve")
    out = str(tmp_path / "set")
    assert told("dataset", "--out", out, "--seed", "7")[0] == 0
    results = tmp_path / "results"
    code, text = told("bench", "--dataset", out, "--out", str(results))
    assert code == 0 and "## Gate" in text and (results / "summary.md").read_text() in text
    metrics = json.loads((results / "hybrid.json").read_text())
    assert metrics["metrics"]["all"]["p95_latency_ms"] > 0 and metrics["created"].endswith("+00:00")
    assert spark.read.json(f"{results}/dense_predictions.jsonl").count() == metrics["metrics"]["all"]["queries"]
    code, text = told("calibrate", "--dataset", out, "--out", str(results))
    assert code == 0 and "out of domain" in text and json.loads((results / "calibration.json").read_text())["best"] is not None
    assert main(["stats", "--manifest", str(tmp_path / "none.json")]) == 1


def test_json_forms(spark, path, tmp_path):
    router = Router.from_manifest(spark, path)
    routed = router.route(router.queries("book a table"), score_floor=0.1)
    result = json.loads(router.results_json(routed).first()["result"])
    assert result["items"][0]["item"] == "dine.book_table" and result["has_match"]
    schema = json.loads(prompt.function_schemas(router.items.where(F.col("name") == "book_table")).first()["schema"])
    assert schema["function"]["description"].startswith("[dine] ") and schema["function"]["parameters"]["properties"] == {"seats": {"type": "integer"}}
    predictions = spark.createDataFrame([("q", [0.123456])], "query string, scores array<double>")
    manifest.write_results({"top": 1}, predictions, str(tmp_path), "dense")
    assert spark.read.json(f"{tmp_path}/dense_predictions.jsonl").first()["scores"] == [0.1235]
