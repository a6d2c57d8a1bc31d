"""Python works on slices of Spark's batches, so that a worker's memory doesn't grow with a batch."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import bpe_codec
from corpusloom.llm.common import SLICE_ROWS, with_columns
from corpusloom.llm.queries import tokenizer_file


def test_columns_are_made_of_a_slice_at_a_time(spark):
    rows = spark.range(2 * SLICE_ROWS + 3).select("id", F.concat(F.lit("text "), "id").alias("text")).coalesce(1)

    def make():
        return lambda texts: [[t.upper() for t in texts], [len(texts)] * len(texts)]

    found = with_columns(rows, "text", make, {"_upper": "string", "_together": "long"}).orderBy("id").collect()
    assert [(r["id"], r["_upper"]) for r in found] == [(k, f"TEXT {k}") for k in range(2 * SLICE_ROWS + 3)]
    assert max(r["_together"] for r in found) <= SLICE_ROWS


def test_encoding_keeps_ids_and_rows_of_all_slices(spark):
    n = 2 * SLICE_ROWS + 3
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("number "), "id").alias("text")).coalesce(1)
    found = bpe_codec.encode(rows, tokenizer_file("byte_bpe_multi_50k.tiktoken")).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in found) == sorted((k, f"number {k}".encode()) for k in range(n))
    assert all(r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4")) for r in found)
