"""Vectors as whole numbers, stored for many passes, and sums over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

#: A component becomes floor(SCALE * component).
SCALE = 1024
#: Components must stay below this, so that whole numbers and doubles hold the same.
LARGEST = float(1 << 40)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, *more: str) -> tuple[DataFrame, int]:
    """(id, y, more columns as c0, c1, ...) as a stored table, and the vectors' length; y is the whole numbers' bytes, eight each.

    Rows whose vector is null or holds a null or non-finite component are left out, and so are vectors of another length
    than most (of two lengths as frequent, the longer counts). A component of LARGEST or more is an error.
    """
    finite = F.forall(F.col(vec_col), lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    kept = df.filter(F.col(vec_col).isNotNull() & finite)
    chosen = kept.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(more)])
    schema = ", ".join(f"{f.name} {'binary' if f.name == 'v' else f.dataType.simpleString()}" for f in chosen.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            if len(values) and np.abs(values).max() >= LARGEST:
                raise OverflowError(f"a component of a vector is {LARGEST:g} or more")
            data = pa.py_buffer(np.floor(SCALE * values).astype(np.int64).tobytes())
            ends = lists.offsets.to_numpy().astype(np.int64)
            y = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(((ends - ends[0]) * 8).tobytes()), data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), y, *b.columns[2:]], b.schema.names)

    rows = stored(chosen.mapInArrow(run, schema).withColumnRenamed("v", "y"), "vectors")
    lengths = rows.groupBy(F.octet_length("y").alias("size")).agg(F.count("*").alias("n")).agg(F.max_by("size", F.struct("n", "size")).alias("size")).first()
    size = lengths["size"] or 0
    return rows.filter(F.octet_length("y") == size), size // 8


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch's y, a row each."""
    sizes = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[sizes[0] : sizes[-1]].view(np.int64).reshape(len(column), width) if len(column) else np.zeros((0, width), np.int64)


def totals(rows: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """Sums of the `size` numbers that work(vectors of a batch) returns, over all batches. Each task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.float64 if kind == "double" else np.int64)
        for b in batches:
            sums += work(matrix(b.column(0), width))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["k", "v"])

    out = np.zeros(size, np.float64 if kind == "double" else np.int64)
    for r in rows.select("y").mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out
