"""Labelled rows: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small

FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, fold) of about `most` labelled rows of each class at most, held-out rows never among them.

    Where a class has more, rows are picked by a hash of the id, each task on its own. Rows without an
    id, a text or a label are left out; an id with both labels counts as 1.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("fold", fold("id")).filter("fold > 0")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(label), "id"), F.lit(1_000_000))
    bound = F.when(F.col("label") == 1, int(1_000_000 * min(1, most / max(1, counts.get(1, 0))))).otherwise(int(1_000_000 * min(1, most / max(1, counts.get(0, 0)))))
    picked = known.filter(draw < bound)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(small(picked), "id")
