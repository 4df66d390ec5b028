"""spark-submit entry: python -m tessera.plans.cli encode-dataset|encode-queries|evaluate|adapt ..."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from tessera.plans import pipelines
from tessera.sources.registry import DEFAULT_PATH


def load_env(path: str = ".env") -> dict[str, str]:
    """The KEY=VALUE lines of a file, if there is one, without quotes and comments; put into the environment where it lacks them."""
    found = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                key, equals, value = line.strip().removeprefix("export ").partition("=")
                if equals and not key.startswith("#"):
                    value = value.strip()
                    found[key.strip()] = value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value.split(" #")[0].strip()
    for key, value in found.items():
        os.environ.setdefault(key, value)
    return found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description="Exact embedding retrieval on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    for name, split in (("encode-dataset", "test"), ("encode-queries", "train")):
        p = commands.add_parser(name)
        p.add_argument("--dataset", required=True)
        p.add_argument("--model", required=True)
        p.add_argument("--dataset-root", default="datasets")
        p.add_argument("--split", default=split)
        p.add_argument("--models-config", default=str(DEFAULT_PATH))
        p.add_argument("--cache-root", default="cache")
        p.add_argument("--download", action="store_true")
        p.add_argument("--missing-relevant-policy", choices=("error", "keep"), default="error")
        p.add_argument("--chunks", type=int)
    p = commands.add_parser("evaluate")
    p.add_argument("--cache", required=True)
    p.add_argument("--dataset-root", default="datasets")
    p.add_argument("--search-k", type=int, default=10)
    p.add_argument("--results-root", default="results")
    p.add_argument("--missing-relevant-policy", choices=("error", "keep"))
    p = commands.add_parser("adapt")
    p.add_argument("--cache", required=True)
    p.add_argument("--mode", choices=("gold", "corpus"), required=True)
    p.add_argument("--dataset-root", default="datasets")
    p.add_argument("--eval-split")
    p.add_argument("--train-split", default="train")
    p.add_argument("--model")
    p.add_argument("--train-query-cache")
    p.add_argument("--models-config", default=str(DEFAULT_PATH))
    p.add_argument("--adaptation-root", default="adaptation_results")
    p.add_argument("--alpha", type=float, default=1e-2)
    p.add_argument("--search-k", type=int, default=10)
    p.add_argument("--max-corpus-documents", type=int)
    return top


COMMANDS = {"encode-dataset": pipelines.encode_dataset, "encode-queries": pipelines.encode_queries, "evaluate": pipelines.evaluate, "adapt": pipelines.run_adaptation}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = vars(parser().parse_args(argv))
    run = COMMANDS[args.pop("command")]
    keys = load_env()
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    for key in keys:  # Python workers call hosted models
        spark.sparkContext.environment.setdefault(key, os.environ[key])
    found = run(spark, **args)
    print(json.dumps(found, indent=2, default=str))
    return found


if __name__ == "__main__":
    main()
