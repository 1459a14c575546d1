"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that count as hot, at most, where each of them has a share of 1 / HOT_KEYS of the rows.
HOT_KEYS = 2000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and the executors are in this process, as in tests, a folder of our own is set.

    Raises ValueError on a cluster without one: a folder of one machine is no place for tables that all of them read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="siftgrain-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again; gives the new DataFrame and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siftgrain/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return spark.read.schema(schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of write_table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def unique_names(df: DataFrame, wanted: list[str]) -> list[str]:
    """Names like the wanted ones that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def hot_count(rows: int) -> int:
    """Rows of a key from which on it is hot: so many that at most HOT_KEYS keys can be, and two at least."""
    return max(2, -(-rows // HOT_KEYS))


def looked_up(df: DataFrame, table: DataFrame, hot: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """df joined ("left" or "inner") with a table of one row a key; the rows of the `hot` keys (at most HOT_KEYS of them) stay where they are.

    The table's rows of hot keys are broadcast; the rest of df is shuffled. Both are read twice.
    """
    known = unique_names(df.join(table.limit(0), keys, "left"), ["is_hot"])[0]
    few = table.join(F.broadcast(hot.select(*keys).distinct()), keys, "left_semi").withColumn(known, F.lit(True))
    marked = df.join(F.broadcast(few), keys, "left")
    rest = marked.filter(F.col(known).isNull()).select(*[F.col(f"`{c}`") for c in df.columns]).join(table, keys, how)
    return marked.filter(F.col(known)).drop(known).unionByName(rest)
