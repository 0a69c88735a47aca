"""Command line: route, prompt, items, agent, stats, bench, calibrate, dataset. Exit 0 ok, 2 no match, 1 error, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dataset, gate, scoring
from .plans.engine import Router
from .sources import manifest


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tallyrank")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("route", "prompt", "agent", "items", "stats", "bench", "calibrate", "dataset"):
        c = commands.add_parser(name)
        c.add_argument("--manifest", action="append", required=True)
        c.add_argument("--hybrid", action="store_true")
        c.add_argument("--dense-weight", type=float, default=scoring.DENSE_WEIGHT)
        c.add_argument("-k", type=int, default=gate.MAX_K, help="candidates that are retrieved")
        if name in ("route", "prompt", "agent"):
            c.add_argument("query")
            c.add_argument("--server", help="only items of this server")
            c.add_argument("--no-gate", action="store_true", help="keep all candidates")
            c.add_argument("--min-k", type=int, default=gate.MIN_K)
            c.add_argument("--max-k", type=int, help="kept when the gate widens; -k if not given")
            c.add_argument("--gap-threshold", type=float, default=gate.GAP_THRESHOLD)
        if name in ("route", "prompt", "agent", "calibrate"):
            c.add_argument("--score-floor", type=float, default=gate.SCORE_FLOOR)
        if name == "prompt":
            c.add_argument("--style", choices=("compact", "json"), default="compact")
        if name in ("route", "agent", "items"):
            c.add_argument("--json", action="store_true", help="one JSON document a row")
        if name in ("bench", "calibrate"):
            c.add_argument("--dataset", required=True)
            c.add_argument("--out", help="folder for result files")
        if name == "dataset":
            c.add_argument("--out", required=True)
            c.add_argument("--per-item", type=int, default=12)
            c.add_argument("--seed", type=int, default=dataset.SEED)
    return out


def route_options(args: argparse.Namespace) -> dict[str, Any]:
    return {
        "k": args.k, "server": args.server, "use_gate": not args.no_gate, "min_k": args.min_k, "max_k": args.k if args.max_k is None else args.max_k,
        "gap_threshold": args.gap_threshold, "score_floor": args.score_floor,
    }


def printed(rows: DataFrame, column: str) -> None:
    print("\n".join(r[0] for r in rows.select(column).collect()))


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    router = Router.from_manifests(spark, args.manifest, hybrid=args.hybrid, dense_weight=args.dense_weight)
    match args.command:
        case "items":
            shown = router.items.select("name", "server", "description").orderBy("server", "name")
            printed(shown.withColumn("j", F.to_json(F.struct("*")) if args.json else F.concat("server", F.lit("."), "name", F.lit(": "), "description")), "j")
        case "stats":
            print(json.dumps(router.stats(), indent=2))
        case "bench":
            print(router.report(manifest.read_queries(spark, args.dataset), args.out, args.k))
        case "calibrate":
            print(router.calibration(manifest.read_queries(spark, args.dataset), args.out, args.k, args.score_floor))
        case "dataset":
            meta = {"items": len(router.rows), "per_item": args.per_item, "seed": args.seed, "manifests": args.manifest}
            manifest.write_queries(router.dataset(args.per_item, args.seed), args.out, meta)
        case "agent":
            done = router.agent(router.queries(args.query), **route_options(args)).persist()
            if args.json:
                fields = ("query", "mode", "stage", "tool", "server", "arguments", "reason", "steps", "prompt_tokens", "all_tokens", "tokens_saved", "token_reduction")
                printed(done.withColumn("j", F.to_json(F.struct(*fields))), "j")
            else:
                printed(done.select(F.explode("steps").alias("s")).withColumn("j", F.concat("s.step", F.lit(": "), "s.detail")), "j")
            return 0 if done.first()["has_match"] else 2
        case command:
            routed = router.route(router.queries(args.query), **route_options(args)).persist()
            if command == "prompt":
                printed(router.prompts(routed, args.style), "prompt")
            elif args.json:
                printed(router.results_json(routed), "result")
            else:
                printed(router.explain(routed).orderBy("rank").withColumn("j", F.coalesce("reason", "gate_reason")), "j")
            return 0 if routed.first()["has_match"] else 2
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, SparkSession.builder.appName("tallyrank").getOrCreate())
    except KeyboardInterrupt:
        return 130
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
