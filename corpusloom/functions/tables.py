"""Tables kept between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most so many rows, and so many characters in its text columns; larger sides are shuffled.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may do without: one is made for it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut there, and later steps read columns of it instead of doing the work again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """df marked for broadcast if its rows and texts are within the bounds, else as it is."""
    texts = [F.coalesce(F.char_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(0)).cast("long")).alias("chars")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["chars"] or 0) <= chars else df
