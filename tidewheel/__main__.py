"""Command line: ``python -m tidewheel COMMAND ...``; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import action_tokens, curation, inspect, quality, segment
from tidewheel.plans.catalog import Catalog, Files
from tidewheel.plans.registry import Registry
from tidewheel.plans.report import catalog_page
from tidewheel.session import build_session
from tidewheel.sources import datasets, lerobot, records


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewheel")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *places: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=text)
        for place in places:
            one.add_argument(place)
        return one

    add("detect", "name a dataset's format", "path")
    add("channels", "channels of MCAP files", "path")
    for name, text in (("stats", "statistics of each dimension"), ("quality", "metrics and score of each episode")):
        add(name, text, "path").add_argument("--fps", type=float, default=30.0)
    c = add("convert", "write a dataset in another format", "path", "target")
    c.add_argument("--to", required=True, choices=datasets.WRITABLE)
    c.add_argument("--fps", type=float, default=30.0)
    add("inspect", "what a dataset is, from a sample of it", "path")
    add("lint", "issues of a dataset and its episodes", "path")
    g = add("segment", "segments of each episode", "path")
    g.add_argument("--model", default="rbf")
    g.add_argument("--penalty", default="bic")
    t = add("tokenize", "write a dataset with action tokens", "path", "target")
    t.add_argument("--strategy", default="quantile-bins")
    t.add_argument("--bins", type=int, default=256)
    t.add_argument("--keep-actions", action="store_true")
    add("compare-tokenizers", "errors of each strategy of action tokens", "path")
    d = add("datasets", "entries of a registry", "registry")
    d.add_argument("words", nargs="*")
    d.add_argument("--format")
    d.add_argument("--embodiment")
    d.add_argument("--tag")
    n = add("ingest", "hash, score and register a dataset's episodes", "catalog", "path")
    n.add_argument("--fps", type=float)
    n.add_argument("--robot")
    n.add_argument("--batches", type=int, default=1)
    add("report", "write a page on a catalog", "catalog", "target")
    add("init", "make an empty catalog", "catalog")
    add("query", "run a SELECT over a catalog", "catalog", "sql")
    s = add("search", "episodes like one of the catalog", "catalog", "episode")
    s.add_argument("--top", type=int, default=10)
    s.add_argument("--model")
    r = add("curate", "label a selection of a catalog", "catalog")
    r.add_argument("--by", required=True)
    r.add_argument("--where")
    r.add_argument("--label", default="approved")
    r.add_argument("--reason")
    r.add_argument("--dedup", type=float)
    add("catalog-stats", "episodes and scores by task", "catalog")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | str | None:
    """The command's rows, or a line of text, or nothing."""
    match args.command:
        case "detect":
            return lerobot.detect_format(spark, args.path)
        case "channels":
            return records.mcap_inventory(spark, args.path)
        case "stats":
            frames, _ = datasets.open_dataset(spark, args.path, args.fps)
            state, action = (curation.pooled_stats(curation.dimension_stats(frames, c, ["episode_id"])).selectExpr(f"'{c}' AS signal", "*") for c in ("state", "action"))
            return state.unionByName(action).orderBy("signal", "dim")
        case "quality":
            return quality.episode_metrics(datasets.open_dataset(spark, args.path, args.fps)[0], args.fps)
        case "convert":
            return datasets.convert(spark, args.path, args.target, args.to, args.fps)
        case "inspect":
            frames, episodes = datasets.open_dataset(spark, args.path)
            return json.dumps({"format": lerobot.detect_format(spark, args.path)} | inspect.report(frames, episodes))
        case "lint":
            frames, episodes = datasets.open_dataset(spark, args.path)
            sizes = frames.groupBy("episode_id").agg(F.count("*").alias("num_frames"))
            whole = curation.lint_dataset(frames, episodes=episodes).selectExpr("CAST(NULL AS STRING) AS episode_id", "code", "severity")
            return whole.unionByName(curation.lint_episodes(episodes.join(sizes, "episode_id")))
        case "segment":
            penalty = args.penalty if args.penalty in ("bic", "aic") else float(args.penalty)
            return segment.segment_episodes(datasets.open_dataset(spark, args.path)[0], model=args.model, penalty=penalty)
        case "tokenize":
            frames, episodes = datasets.open_dataset(spark, args.path)
            made = action_tokens.fit(frames, args.strategy, bins=args.bins)
            fps = lerobot.info(spark, args.path).get("fps", 30.0) if lerobot.detect_format(spark, args.path).startswith(("lerobot", "groot")) else 30.0
            lerobot.write_v3(action_tokens.with_tokens(frames, made, keep_actions=args.keep_actions), episodes, args.target, fps)
            Files(spark, args.target).write("meta/tokenizer.json", made.save())
            return None
        case "compare-tokenizers":
            return action_tokens.compare(datasets.open_dataset(spark, args.path)[0])
        case "datasets":
            known = Registry(spark, args.registry)
            return known.search(" ".join(args.words)) if args.words else known.list(args.format, args.embodiment, args.tag)
        case "ingest":
            return json.dumps(Catalog(spark, args.catalog).ingest_dataset(args.path, args.fps, args.robot, batches=args.batches))
        case "report":
            catalog_page(Catalog(spark, args.catalog), args.target)
            return None
        case "init":
            Catalog.init(spark, args.catalog)
            return None
        case "query":
            return Catalog(spark, args.catalog).query(args.sql)
        case "search":
            return Catalog(spark, args.catalog).search(like=args.episode, model_id=args.model, top=args.top)
        case "curate":
            return Catalog(spark, args.catalog).curate(args.by, args.where, label=args.label, reason=args.reason, dedup=args.dedup)
        case "catalog-stats":
            return Catalog(spark, args.catalog).stats()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session()
    out = run(spark, args)
    if isinstance(out, str):
        print(out)
    elif out is not None:
        for line in out.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
