"""The corpus tables: passages, sources, queries, claims, and the gates and jobs that build them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.tables import shared_dir
from corpusloom.operators.retrieval import Index

#: Lines of one document that the order key has room for.
LINES = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of documents in (document, line) order: rid, id, source_id, location, kind, text."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.filter("text <> ''").select(
        F.when(F.col("line") < LINES, F.col("doc_id") * LINES + F.col("line")).otherwise(F.raise_error(F.lit("a document has more lines than the order key has room for"))).alias("rid"),
        F.concat_ws(":", "doc_id", "line").alias("id"),
        F.col("source").alias("source_id"),
        F.col("doc_id").alias("location"),
        F.col("lang").alias("kind"),
        "text",
    )


_INDEXES: dict[tuple, Index] = {}


def passage_index(spark: SparkSession, sf_dir: str) -> Index:
    """The keyword index of passages(), built once in a session for what the table of documents holds now, and shared by all searches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listStatus(path)
    state = tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, state)
    if key not in _INDEXES:
        _INDEXES[key] = Index(passages(spark, sf_dir))
    return _INDEXES[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of assistant turns, each citing one document by a rule: conv_id, turn, n, text, cited."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    sentences = turns.select("conv_id", "turn", F.posexplode(F.split("text", "(?<=[.!?])\\s+")).alias("n", "text")).filter("trim(text) <> ''")
    return sentences.withColumn("cited", F.concat_ws(":", F.col("conv_id") + F.col("n"), F.lit("0")))


def violations(rule: str, rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def validate(sources: DataFrame, items: DataFrame, kinds: DataFrame) -> DataFrame:
    """(rule, key) of every violation: empty fields, repeated ids, unknown sources and kinds, sources without passages."""
    checks = [
        violations("source id repeated", repeated(sources, "source_id"), F.col("source_id")),
        violations("source without name", sources.filter("name IS NULL OR trim(name) = ''"), F.col("source_id")),
        violations("passage id repeated", repeated(items, "id"), F.col("id")),
        violations("passage without text", items.filter("text IS NULL OR trim(text) = ''"), F.col("id")),
        violations("unknown source", items.join(sources, "source_id", "left_anti"), F.col("id")),
        violations("unknown kind", items.join(kinds, "kind", "left_anti"), F.col("id")),
        violations("no passages", sources.join(items, "source_id", "left_anti"), F.col("source_id")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def completeness(items: DataFrame, minimums: DataFrame) -> DataFrame:
    """Sources with fewer passages than expected: source_id, expected, found."""
    found = items.groupBy("source_id").agg(F.count("*").alias("found"))
    return minimums.join(found, "source_id", "left").select("source_id", "expected", F.coalesce("found", F.lit(0)).alias("found")).filter("found < expected")


def merge(live: DataFrame, candidate: DataFrame, rid: str = "rid") -> DataFrame:
    """live, then what only the candidate's other sources have, numbered on from the last live row in the candidate's order.

    New rows are numbered within their source, sources by their first row, so no window spans all rows.
    """
    last = live.agg(F.coalesce(F.max(rid), F.lit(-1)).alias("last"))
    new = candidate.join(live.select("source_id").distinct(), "source_id", "left_anti")
    sizes = new.groupBy("source_id").agg(F.count("*").alias("n"), F.min(rid).alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a source
    offsets = F.broadcast(sizes.withColumn("before", before).join(last).select("source_id", (F.col("last") + F.col("before")).alias("offset")))
    placed = new.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy(rid))).join(offsets, "source_id")
    return live.unionByName(placed.withColumn(rid, F.col("offset") + F.col("k")).select(live.columns))


def fingerprint(items: DataFrame, bucket: int = 100_000, wide: int = 100) -> DataFrame:
    """One digest per stretch of the order, of `wide` buckets each: changes with any id, text or place of a row in it.

    A bucket's digests are put together first, a stretch is the digest of its buckets', so no row holds more than a bucket.
    """
    rows = items.select((F.col("rid") / bucket).cast("long").alias("part"), "rid", F.sha2(F.concat(F.col("id"), F.lit("\t"), F.col("text")), 256).alias("h"))
    packed = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("rid", "h"))).alias("x"), F.count("*").alias("n"))
    joined = lambda: F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256)
    parts = packed.select((F.col("part") / wide).cast("long").alias("stretch"), "part", "n", joined().alias("h"))
    whole = parts.groupBy("stretch").agg(F.sort_array(F.collect_list(F.struct("part", "h"))).alias("x"), F.sum("n").alias("n_rows"))
    return whole.select("stretch", "n_rows", joined().alias("digest"))


def ordered_distinct(values: str, order: list[str], by: list[str], df: DataFrame, sep: str) -> DataFrame:
    """Per group, distinct values in first-seen order, joined."""
    first = df.groupBy(*by, values).agg(F.min(F.struct(*order)).alias("at"))
    listed = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", values))).alias("x"))
    return listed.select(*by, F.array_join(F.transform("x", lambda r: r[values]), sep).alias(values))


def group_identical(items: DataFrame) -> DataFrame:
    """Rows with the same text as one: first and last location, number of rows, source of the first."""
    return items.groupBy("text").agg(F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid"), F.count("*").alias("n_rows"), F.min_by("source_id", "rid").alias("source_id"))


def join_cut(items: DataFrame) -> DataFrame:
    """Passages of a document joined where one lacks a sentence end: location, first rid, joined text."""
    in_order = Window.partitionBy("location").orderBy("rid")
    previous = F.lag("text").over(in_order)
    starts = F.when(previous.isNull() | previous.rlike("[.!?؟:»\"]\\s*$"), 1).otherwise(0)
    islands = items.withColumn("starts", starts).withColumn("island", F.sum("starts").over(in_order))
    packed = islands.groupBy("location", "island").agg(F.sort_array(F.collect_list(F.struct("rid", "text"))).alias("x"))
    joined = F.regexp_replace(F.array_join(F.transform("x", lambda r: r["text"]), " "), " +([,،])", "$1")
    return packed.select("location", F.col("x")[0]["rid"].alias("first_rid"), F.size("x").cast("long").alias("n_joined"), joined.alias("text"))


def extract_html(pages: DataFrame) -> DataFrame:
    """Visible text of pages: scripts, styles and head out, block tags as line ends, the common entities decoded, blank lines squeezed."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "(?is)<(script|style|head)\\b.*?</(?:script|style|head)>", " ")
    text = F.regexp_replace(text, "(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, "(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/article|/section)\\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), " ?\\n[ \\n]*", "\n")
    return pages.select("page_id", F.trim(text, F.lit(" \n")).alias("text"))
