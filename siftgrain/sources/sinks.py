"""Writers; all of them leave either the old content or the whole new one."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrain.config import Config


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines; keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """(source_id, role, vector array<float>) by role."""
    df.write.mode("overwrite").partitionBy("role").parquet(path)


def write_document(value: dict | str, path: str) -> None:
    """One JSON document of the driver, by a file beside it and a rename."""
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)


def snapshot_config(config: Config, path: str) -> None:
    write_document(config.snapshot(), path)


def cluster_export(photos: DataFrame) -> DataFrame:
    """(review_set_id, name, preview_path): where each photo's preview goes in an export by set, KEEP before ALT."""
    tag = F.when(F.col("recommendation").isin("keep_candidate", "alternate_keeper"), "KEEP").otherwise("ALT")
    return photos.select("review_set_id", F.format_string("%02d__%s__%s", F.col("rank").cast("int"), tag, "display_id").alias("name"), "preview_path")


def move_files(ops: Iterable, made: list[dict] | None = None) -> list[dict]:
    """Carry out collected operations on the driver, one by one; each has a status, and none overwrites a file."""
    out = [] if made is None else made
    for op in ops:
        row = op.asDict() if hasattr(op, "asDict") else dict(op)
        if os.path.exists(row["destination"]):
            row["status"] = "destination_exists"
        else:
            try:
                os.makedirs(os.path.dirname(row["destination"]) or ".", exist_ok=True)
                shutil.move(row["source"], row["destination"])
                row["status"] = "success"
            except OSError as e:
                row["status"], row["error"] = "failed", str(e)
        out.append(row)
    return out
