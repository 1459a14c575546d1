"""python -m siftgrain preprocess|review|run: runs over a folder and tables.

preprocess FOLDER --tables DIR: writes DIR/photos and DIR/todo, from DIR/results and DIR/versions where they are.
review PHOTOS --tables DIR: writes DIR/review_sets (JSON lines) and DIR/summary from a Parquet table of photos.
run FOLDER --tables DIR: both, with the features of DIR/features for the photos of the folder; --skip-preprocess takes DIR/photos as it is.
Exit codes: 0 done, 1 failed, 2 no such input.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from siftgrain.config import Config
from siftgrain.plans import review as plans
from siftgrain.sources import files, sinks

RESULTS = "source_id string, stage string, status string, version string, config_hash string, has_output boolean"
PRIOR = "source_id string, size long, mtime_ns long"
VERSIONS = "stage string, version string, config_hash string"


def _table(spark: SparkSession, path: str, schema: str):
    return spark.read.parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siftgrain", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["preprocess", "review", "run"])
    parser.add_argument("input")
    parser.add_argument("--tables", required=True)
    parser.add_argument("--config")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--skip-preprocess", action="store_true")
    parser.add_argument("--progress", choices=["text", "jsonl", "quiet"], default="text")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("siftgrain").getOrCreate()
    if not files.exists(spark, a.input):
        print(f"no such input: {a.input}", file=sys.stderr)
        return 2
    config = Config.load(a.config)

    def say(kind: str, **more) -> None:
        if a.progress == "jsonl":
            print(json.dumps({"type": kind, **more}), flush=True)
        elif a.progress == "text":
            print(kind, *[f"{k}={v}" for k, v in more.items()], flush=True)

    try:
        if a.command == "preprocess" or (a.command == "run" and not a.skip_preprocess):
            prior, results, versions = (_table(spark, f"{a.tables}/{n}", s) for n, s in (("prior", PRIOR), ("results", RESULTS), ("versions", VERSIONS)))
            photos, todo = plans.preprocess(spark, a.input, prior, results, versions, config, a.force, a.limit)
            photos.write.mode("overwrite").parquet(f"{a.tables}/photos")
            todo.write.mode("overwrite").parquet(f"{a.tables}/todo")
            kind = "completed" if a.command == "preprocess" else "preprocessed"
            say(kind, photos=spark.read.parquet(f"{a.tables}/photos").count(), todo=spark.read.parquet(f"{a.tables}/todo").count())
        if a.command != "preprocess":
            photos = spark.read.parquet(a.input) if a.command == "review" else plans.with_features(spark.read.parquet(f"{a.tables}/photos"), spark.read.parquet(f"{a.tables}/features"))
            reviewed = plans.review(photos, config)
            sinks.write_jsonl(reviewed.documents(), f"{a.tables}/review_sets")
            sinks.write_jsonl(reviewed.summary(), f"{a.tables}/summary")
            say("completed", input_hash=reviewed.input_hash)
    except Exception as e:  # noqa: BLE001  the exit code tells
        say("failed", error=str(e)[:500])
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
