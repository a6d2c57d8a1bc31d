"""What the operators of this subpackage share: reading tables, shared scratch tables, size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

#: White space of the word and line definitions: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side is broadcast only when it has at most so many rows and bytes; larger sides are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Rows of a batch that Python works on at once.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local session, whose tasks run on this machine, may do without: one is made for it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut there, and any executor can read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.scratch = path
    return table_


def discard(table_: DataFrame) -> None:
    """Removes a stored() table that no later step reads."""
    spark = table_.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table_.scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(field: StructField) -> Column:
    """About how many bytes a value takes."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType):
        return F.coalesce(8 * F.size(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType | StructType):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 16
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows and takes at most about `most_bytes`, else as it is: the join then shuffles both sides."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(sum((width(f) for f in df.schema.fields), F.lit(0)).cast("long")).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= most_bytes else df


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1, ..., so that no name of an operator's own can clash with one; and what `names` are called there."""
    lower = [c.lower() for c in df.columns]
    return df.toDF(*[f"c{i}" for i in range(len(lower))]), [f"c{lower.index(n.lower())}" for n in names]


def named_again(rows: DataFrame, df: DataFrame, new: dict[str, str | Column]) -> DataFrame:
    """The columns of df (numbered in rows) under their own names, then the new ones; a column of df with the name of a new one gives way to it."""
    taken = {n.lower() for n in new}
    old = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in taken]
    return rows.select(*old, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in new.items()])


def doc_key(id_col: str, text_col: str) -> list[Column]:
    """Two key columns, k1 and k2, without nulls that tell rows apart even where ids repeat or are null.

    Rows that agree in both have the same id and the same text, so they share every result.
    """
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")).alias("k1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("k2")]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def sliced(batches: Iterator) -> Iterator:
    """Arrow or pandas batches in slices of SLICE_ROWS rows, so that a worker holds copies and results of one slice, not of Spark's whole batch.

    At a task's end Arrow gives back the memory it keeps, which a worker would hold for its life.
    """
    for b in batches:
        for lo in range(0, len(b), SLICE_ROWS):
            yield b.slice(lo, SLICE_ROWS) if isinstance(b, pa.RecordBatch) else b.iloc[lo : lo + SLICE_ROWS]
        del b
    pa.default_memory_pool().release_unused()


def with_columns(df: DataFrame, of: str, make: Callable[[], Callable[[list], list[list]]], new: dict[str, str]) -> DataFrame:
    """df with columns that Python makes of column `of`; all others pass through as they are, but for those that a new one replaces.

    make() runs once in each task and returns what turns a batch of values into a list for each new column.
    """
    inner, (column,) = numbered(df, of)
    schema = StructType(list(inner.schema.fields))
    for k, kind in enumerate(new.values()):
        schema = schema.add(f"new{k}", kind)
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in sliced(batches):
            made = work(b.column(b.schema.get_field_index(column)).to_pylist())
            for k, (kind, values) in enumerate(zip(new.values(), made)):
                b = b.append_column(f"new{k}", pa.array(values, kinds[kind]))
            yield b

    return named_again(inner.mapInArrow(run, schema), df, {n: f"new{k}" for k, n in enumerate(new)})
