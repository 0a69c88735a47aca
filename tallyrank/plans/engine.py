"""The router: a catalogue of items behind one object, routing tables of queries."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Embedder
from ..operators import agent, dataset, evaluate, explain, gate, prompt, registry, scoring
from ..sources import manifest


class Router:
    """Routes tables of (query_id, query) over items of a manifest.

    Items are numbered by name, so that ties between equal scores go to the smaller name. Texts go through feature hashes unless
    another ``embedder`` is given.
    """

    def __init__(self, items: DataFrame, hybrid: bool = False, dense_weight: float = scoring.DENSE_WEIGHT, embedder: Embedder | None = None) -> None:
        if not 0 <= dense_weight <= 1:
            raise ValueError(f"dense_weight must be in [0, 1], got {dense_weight}")
        self.spark, self.hybrid, self.dense_weight = items.sparkSession, hybrid, dense_weight
        scoring.check_size(items, *(F.col(c) for c in ("name", "description", "parameters")))
        rows = sorted((r.asDict() for r in items.collect()), key=lambda r: r["name"])
        for i, r in enumerate(rows):
            r["item_id"] = i
        self.rows = rows
        schema = f"item_id long, {manifest.ITEM_SCHEMA}"
        names = [part.split()[0] for part in schema.split(", ")]
        base = self.spark.createDataFrame([[r[n] for n in names] for r in rows], schema)
        params = F.col("parameters")
        self.items = base.withColumns(
            {
                "parameter_names": registry.parameter_names(params),
                "required": registry.required_parameters(params),
                "text": registry.embedding_text(F.col("name"), F.col("description"), registry.parameter_names(params), F.col("examples")),
            }
        )
        self.index = scoring.build_index(self.items, embedder)
        self.compact = {r["item_id"]: prompt.compact_block(r["name"], r["server"], r["description"], r["parameters"]) for r in rows}
        self.full = {r["item_id"]: prompt.json_block(r["name"], r["server"], r["description"], r["parameters"]) for r in rows}

    @classmethod
    def from_manifest(cls, spark: SparkSession, path: str, **options: Any) -> Router:
        return cls(manifest.read_manifest(spark, path), **options)

    @classmethod
    def from_manifests(cls, spark: SparkSession, paths: list[str], **options: Any) -> Router:
        return cls(registry.union_manifests(*(manifest.read_manifest(spark, p) for p in paths)), **options)

    @classmethod
    def from_items(cls, spark: SparkSession, rows: list[dict], **options: Any) -> Router:
        return cls(manifest.items_from(spark, manifest.parse_document(rows)), **options)

    def load_manifest(self, path: str) -> Router:
        """A router over these items and one manifest more."""
        own = self.items.select(*(part.split()[0] for part in manifest.ITEM_SCHEMA.split(", ")))
        return Router(registry.append_manifest(own, manifest.read_manifest(self.spark, path)), self.hybrid, self.dense_weight, self.index.embedder)

    def queries(self, *texts: str) -> DataFrame:
        if not all(isinstance(t, str) for t in texts):
            raise TypeError("queries must be strings")
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")

    def retrieve(self, queries: DataFrame, k: int = 5, hybrid: bool | None = None, server: str | None = None) -> DataFrame:
        """queries with ``candidates``, at most k."""
        hybrid = self.hybrid if hybrid is None else hybrid
        allowed = None if server is None else [r["item_id"] for r in self.rows if r["server"] == server]
        return scoring.retrieve(queries, self.index, k, hybrid, self.dense_weight, allowed=allowed)

    def route(
        self, queries: DataFrame, k: int | None = None, hybrid: bool | None = None, use_gate: bool = True, server: str | None = None,
        min_k: int = gate.MIN_K, max_k: int = gate.MAX_K, gap_threshold: float = gate.GAP_THRESHOLD, score_floor: float = gate.SCORE_FLOOR,
    ) -> DataFrame:
        """queries with the gate's decision and ``candidates`` cut to it."""
        found = self.retrieve(queries, k or max_k, hybrid, server)
        gated = gate.confidence_gate(found, min_k, max_k, gap_threshold, score_floor) if use_gate else gate.disabled_gate(found)
        return gate.selected(gated)

    def explain(self, routed: DataFrame, hybrid: bool | None = None) -> DataFrame:
        source = "hybrid" if (self.hybrid if hybrid is None else hybrid) else "dense"
        return explain.explain(routed, self.items.select("item_id", "name", "description", "server", "parameter_names"), source)

    def prompts(self, routed: DataFrame, style: str = "compact", header: bool = True) -> DataFrame:
        """routed rows with ``prompt`` and ``prompt_tokens``."""
        blocks = self.compact if style == "compact" else self.full
        shown = scoring.looked_up(routed, self.index.ids, {"_shown": [blocks[i] for i in self.index.ids]})
        told = {"prompt": prompt.prompt(F.col("_shown"), style, header), "prompt_tokens": prompt.prompt_tokens(F.col("_shown"), style)}
        return shown.withColumns(told).drop("_shown")

    def all_items_prompt(self) -> str:
        """The block of all items in manifest order with full schemas."""
        return "[\n" + ",\n".join(self.full[i] for i in self.manifest_order()) + "\n]"

    def manifest_order(self) -> list[int]:
        """Item ids by position in the manifest."""
        return [r["item_id"] for r in sorted(self.rows, key=lambda r: r["position"])]

    def agent(self, queries: DataFrame, choose: agent.Chooser = agent.top_ranked, **route: Any) -> DataFrame:
        """routed rows with the decision, the call it leads to, the steps and the tokens saved."""
        echoed = agent.echo(agent.decide(self.prompts(self.route(queries, **route)), choose), self.items)
        return agent.steps(echoed, self.all_tokens())

    def all_tokens(self) -> int:
        """Estimated tokens of the block of all items."""
        shown = self.spark.createDataFrame([([self.full[i] for i in self.manifest_order()],)], "x array<string>")
        return shown.select(prompt.prompt_tokens(F.col("x"), "json")).first()[0]

    def outcomes(self, labelled: DataFrame, k: int = 5, baselines: tuple[str, ...] = evaluate.BASELINES, timed: bool = False) -> DataFrame:
        """One row per labelled query (query, correct_item, category) and baseline."""
        names = self.items.select(F.col("name").alias("correct_item"), F.col("item_id").alias("gold"))
        rows = labelled.join(F.broadcast(names), "correct_item", "left").withColumn("query_id", F.xxhash64("query", "correct_item"))
        return evaluate.run_baselines(rows, self.index, self.compact, self.full, k, baselines, dense_weight=self.dense_weight, order=self.manifest_order(), timed=timed)

    def benchmark(self, labelled: DataFrame, k: int = 5) -> DataFrame:
        return evaluate.evaluate(self.outcomes(labelled, k))

    def report(self, labelled: DataFrame, folder: str | None = None, k: int = 5) -> str:
        """The summary of all baselines; with a folder also written there, with each baseline's metrics and predictions.

        ``labelled`` is scored once: outcomes are held on the executors, and made again where one is lost.
        """
        rows = self.outcomes(labelled, k, timed=True).persist()
        try:
            metrics, ambiguous, modes = ([r.asDict() for r in f(rows).collect()] for f in (evaluate.evaluate, evaluate.ambiguous_behaviour, evaluate.gate_modes))
            config = {"items": len(self.rows), "k": k, "gap threshold": gate.GAP_THRESHOLD, "score floor": gate.SCORE_FLOOR, "dense weight": self.dense_weight}
            text = evaluate.render_summary(metrics, ambiguous, modes, self.all_tokens(), config)
            if folder is not None:
                for b in evaluate.BASELINES:
                    own = {m["category"] or "all": {c: v for c, v in m.items() if c not in ("baseline", "category")} for m in metrics if m["baseline"] == b}
                    manifest.write_results({"baseline": b, "config": config, "metrics": own}, rows.where(F.col("baseline") == b), folder, b)
                manifest.write_text(self.spark, f"{folder}/summary.md", text)
            return text
        finally:
            rows.unpersist()

    def calibration(self, labelled: DataFrame, folder: str | None = None, k: int = 5, score_floor: float = gate.SCORE_FLOOR) -> str:
        """The threshold sweep and the floor report as text; with a folder also written there, with their figures as JSON."""
        sweep = self.calibrate(labelled, k, score_floor)
        rows, floor = ([r.asDict() for r in df.collect()] for df in (sweep, self.floor_report(labelled, k=k)))
        text = evaluate.render_calibration(rows, floor)
        if folder is not None:
            best = evaluate.best_threshold(self.spark.createDataFrame(rows)).first()["gap_threshold"] if rows else None
            manifest.write_text(self.spark, f"{folder}/calibration.md", text)
            manifest.write_text(self.spark, f"{folder}/calibration.json", json.dumps({"shipped": gate.GAP_THRESHOLD, "best": best, "sweep": rows, "floor": floor}, indent=2) + "\n")
        return text

    def calibrate(self, labelled: DataFrame, k: int = 5, score_floor: float = gate.SCORE_FLOOR) -> DataFrame:
        names = self.items.select(F.col("name").alias("correct_item"), F.col("item_id").alias("gold"))
        rows = labelled.join(F.broadcast(names), "correct_item", "left").withColumn("query_id", F.xxhash64("query", "correct_item"))
        return evaluate.gap_sweep(self.retrieve(rows, k, hybrid=False), k=k, score_floor=score_floor)

    def floor_report(self, labelled: DataFrame, out_of_domain: tuple[str, ...] = evaluate.OUT_OF_DOMAIN, k: int = 5) -> DataFrame:
        """Spread of the best dense score of labelled queries and of queries that no item serves."""
        queries = labelled.select("query", F.lit(True).alias("in_domain"))
        foreign = self.queries(*out_of_domain).select("query", F.lit(False).alias("in_domain"))
        found = self.retrieve(queries.unionByName(foreign), k, hybrid=False)
        return evaluate.score_floor_report(found.select("in_domain", F.get("candidates", F.lit(0))["score"].alias("top_score")))

    def results_json(self, routed: DataFrame) -> DataFrame:
        """(query_id, result): each routed row as JSON with names, servers and scores in 6 decimals."""
        names = {r["item_id"]: f"{r['server']}.{r['name']}" for r in self.rows}
        routed = scoring.looked_up(routed, self.index.ids, {"_name": [names[i] for i in self.index.ids]})
        shown = F.transform(
            F.arrays_zip("candidates", "_name"),
            lambda x: F.struct(x["_name"].alias("item"), F.round(x["candidates"]["score"], 6).alias("score"), x["candidates"]["rank"].alias("rank")),
        )
        fields = ("query", "mode", "selected_k", F.round("gap", 6).alias("gap"), "reason", "widened", "has_match", shown.alias("items"))
        return routed.select("query_id", F.to_json(F.struct(*fields)).alias("result"))

    def dataset(self, per_item: int = 12, seed: int = dataset.SEED) -> DataFrame:
        return dataset.generate(self.items, per_item, seed)

    def stats(self) -> dict[str, Any]:
        servers = [r["server"] for r in registry.distinct_servers(self.items).orderBy("first_seen").collect()]
        return {"items": len(self.rows), "servers": servers, "dim": self.index.dim, "terms": len(self.index.terms), "hybrid": self.hybrid}
