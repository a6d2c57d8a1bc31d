"""Readers of corpus files, sinks, and gates between stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.chunking import split_sentences

CORPUS = (
    "sources array<struct<id:string,name:string,about:string,url:string>>, "
    "passages array<struct<id:string,source_id:string,location:string,text:string,kind:string,grade:string,keywords:string>>, "
    "_translations map<string,map<string,string>>"
)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, passages, translations) of a JSON corpus file; passages keep their order as rid."""
    whole = spark.read.schema(CORPUS).json(path, multiLine=True)
    sources = whole.select(F.explode("sources").alias("x")).select(F.col("x.id").alias("source_id"), "x.name", "x.about", "x.url")
    passages = whole.select(F.posexplode("passages").alias("rid", "x")).select(F.col("rid").cast("long").alias("rid"), "x.*")
    texts = whole.select(F.explode("_translations").alias("lang", "m")).select("lang", F.explode("m").alias("passage_id", "text"))
    return sources, passages, texts


def read_marked(spark: SparkSession, path: str) -> DataFrame:
    """Marked-up book text: (file, book, heading, n, text, first_page, last_page) per paragraph.

    "###" is a heading, "# " starts a paragraph, "~~" continues it, PageVxxPyyy ends a page. Lines keep
    their place in the file; the window spans one file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.element_at(F.split("value", "#META#Header#End#", 2), -1), "\\r?\\n")).alias("line", "raw"))
    # a line is cut at its page marks; the text before a mark lies on the page it ends
    pieces = lines.select("file", "line", "raw", F.posexplode(F.split("raw", "(?<=PageV\\d{2}P\\d{3})")).alias("piece", "part"))
    in_file = Window.partitionBy("file").orderBy("line", "piece")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("part", "PageV\\d+P\\d+|ms\\d+", " "), "^(?:### *\\|*|# |~~)", ""), "\\s+", " "))
    page = F.regexp_extract("part", "PageV(\\d+)P(\\d+)", 0)
    rows = pieces.withColumn("text", bare).withColumn("mark", F.when(page != "", page)).withColumn("head", F.when(F.col("raw").startswith("###"), F.regexp_replace(bare, "^[|\\[ ]+|[\\] .:]+$", "")))
    rows = rows.withColumn("heading", F.last("head", ignorenulls=True).over(in_file)).withColumn("book", F.last(F.when(F.col("head").startswith("كتاب"), F.col("head")), ignorenulls=True).over(in_file))
    rows = rows.withColumn("page", F.first("mark", ignorenulls=True).over(in_file.rowsBetween(0, Window.unboundedFollowing)))
    starts = (F.col("raw").startswith("###") | (F.col("raw").startswith("# ") & ~F.col("raw").rlike("^# *PageV\\d+P\\d+\\s*$"))) & (F.col("piece") == 0)
    rows = rows.withColumn("n", F.sum(F.when(starts, 1).otherwise(0)).over(in_file))
    body = rows.filter("text <> '' AND head IS NULL AND heading IS NOT NULL AND (raw LIKE '# %' OR raw LIKE '~~%')")
    packed = body.groupBy("file", "book", "heading", "n").agg(F.sort_array(F.collect_list(F.struct("line", "piece", "text", "page"))).alias("x"))
    at = lambda k: F.regexp_replace(F.element_at("x", k)["page"], "PageV(\\d+)P(\\d+)", "$1:$2")
    return packed.select("file", "book", "heading", "n", F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("text"), at(1).alias("first_page"), at(-1).alias("last_page"))


def read_dump(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(rid, id, location, text) of a (gzipped) JSON dump of units, each with its numbered texts: ids are prefix:unit:number."""
    units = spark.read.schema("number int, name string, verses array<struct<number:int,text:string>>").json(path, multiLine=True)
    rows = units.select(F.col("number").alias("unit"), "name", F.posexplode("verses").alias("pos", "v"))
    return rows.select(
        (F.col("unit").cast("long") * 1_000_000 + F.col("pos")).alias("rid"), F.concat_ws(":", F.lit(prefix), "unit", "v.number").alias("id"),
        F.format_string("%s, %d", "name", "v.number").alias("location"), F.col("v.text").alias("text"),
    )


def read_numbered(spark: SparkSession, path: str, prefix: str, limit: int = 1200) -> DataFrame:
    """(number, part, id, text) of a JSON file of numbered items: long ones in parts of whole sentences, empty ones left out. A number found twice is an error."""
    rows = spark.read.schema("number long, text string").json(path)
    twice = [r["number"] for r in rows.groupBy("number").count().filter("count > 1").limit(10).collect()]
    if twice:
        raise ValueError(f"numbers found twice: {sorted(twice)}")
    parts = rows.filter("trim(text) <> ''").select("number", split_sentences(F.col("text"), limit).alias("parts"))
    cut = parts.select("number", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "text"))
    return cut.select("number", "part", F.concat_ws(":", F.lit(prefix), "number", F.when(F.col("n") > 1, F.col("part"))).alias("id"), "text")


def manifest_violations(live: DataFrame, manifest: DataFrame, version: int) -> DataFrame:
    """(rule, key) of everything that forbids appending a manifest (source_id, name, url, rights, id, kind, grade): any row refuses all of it."""
    spark = manifest.sparkSession
    rule = lambda name, rows, key: rows.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key")).distinct()
    checks = [
        rule("schema version", spark.createDataFrame([(version,)], "v int").filter("v <> 1"), "v"),
        rule("empty field", manifest.filter("coalesce(trim(name), '') = '' OR coalesce(trim(url), '') = '' OR coalesce(trim(source_id), '') = ''"), "id"),
        rule("url without https", manifest.filter("url NOT LIKE 'https://%'"), "source_id"),
        rule("rights", manifest.filter("rights IS NULL OR rights NOT IN ('public-domain', 'license', 'permission')"), "source_id"),
        rule("id pattern", manifest.filter("NOT id RLIKE '^[a-z0-9-]+(:[a-z0-9.-]+)+$'"), "id"),
        rule("kind", manifest.filter("kind = 'quran'"), "id"),
        rule("grade missing", manifest.filter("kind = 'hadith' AND coalesce(trim(grade), '') = ''"), "id"),
        rule("source held already", manifest.join(live, "source_id", "left_semi"), "source_id"),
        rule("id held already", manifest.join(live.select("id"), "id", "left_semi"), "id"),
        rule("id repeated", manifest.groupBy("id").count().filter("count > 1"), "id"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def translate_codes(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, grades): grades (id, pos, who, grade) put into other words, "who: grade" joined by "؛ "; null if a word of any is unknown.

    Codes of two words are taken before those of one.
    """
    words = rows.select("id", "pos", "who", F.split(F.lower(F.trim("grade")), "\\s+").alias("w"))
    codes = dictionary.select(F.lower("code").alias("code"), "meaning", F.size(F.split("code", " ")).alias("n"))
    at = words.select("id", "pos", "who", "w", F.posexplode("w").alias("k", "first"))
    one = at.join(F.broadcast(codes.filter("n = 1").select(F.col("code").alias("first"), F.col("meaning").alias("single"))), "first", "left")  # a dictionary of grades
    pair = one.withColumn("both", F.concat_ws(" ", "first", F.get("w", F.col("k") + 1)))
    two = pair.join(F.broadcast(codes.filter("n = 2").select(F.col("code").alias("both"), F.col("meaning").alias("double"))), "both", "left")
    order = Window.partitionBy("id", "pos").orderBy("k")
    # a word taken by the pair before it starts none of its own
    started = two.withColumn("taken", F.coalesce(F.lag("double").over(order).isNotNull(), F.lit(False)))
    said = started.filter("NOT taken").withColumn("meaning", F.coalesce("double", "single"))
    grade = said.groupBy("id", "pos", "who").agg(F.bool_and(F.col("meaning").isNotNull()).alias("known"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "meaning"))), lambda x: x["meaning"]), " ").alias("said"))
    listed = grade.groupBy("id").agg(F.bool_and("known").alias("known"), F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(": ", "who", "said").alias("x")))).alias("all"))
    return listed.select("id", F.when(F.col("known"), F.array_join(F.transform("all", lambda r: r["x"]), "؛ ")).alias("grades"))


def skip_sections(rows: DataFrame, by: str, order: str, heading: str, pattern: str) -> DataFrame:
    """Rows outside the sections whose heading matches."""
    last = F.last(heading, ignorenulls=True).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_section", last).filter(F.col("_section").isNull() | ~F.col("_section").rlike(pattern)).drop("_section")


def write_corpus(rows: DataFrame, path: str) -> None:
    """One folder per source; readers see the table once the job has committed."""
    rows.write.mode("errorifexists").partitionBy("source_id").parquet(path)


def attach_translations(passages: DataFrame, translations: DataFrame, lang: str, kind: str) -> DataFrame:
    """passages with the translation in a language, for those of one kind; "" where there is none."""
    wanted = translations.filter(F.col("lang") == lang).select(F.col("passage_id").alias("id"), F.col("text").alias("translation"))
    joined = passages.join(wanted, "id", "left")
    return joined.withColumn("translation", F.when(F.col("kind") == kind, F.coalesce("translation", F.lit(""))).otherwise(""))


def stamp_check(stamped: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, state): passages whose vector was made from this text (matches), from another (mismatch), or from an unknown one (unverified)."""
    now = passages.select("id", F.sha2("text", 256).alias("now"))
    state = F.when(F.col("text_sha").isNull(), "unverified").when(F.col("text_sha") == F.col("now"), "matches").otherwise("mismatch")
    return stamped.join(now, "id").select("id", state.alias("state"))
