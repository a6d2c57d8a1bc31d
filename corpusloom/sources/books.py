"""Readers of books kept as tables of pages and headings, and repairs of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.tables import small
from corpusloom.operators.chunking import pack_numbers

#: Levels of headings that a passage's place names.
TRAIL = 3
LETTERS = "[\\u0621-\\u064A]"
#: The pieces on either side of a cut are looked for within so many characters.
NEAR = 30


def drop_blocks(html: Column, name: str) -> Column:
    """html without its elements of a class, as editions wrap their footnotes; such elements hold none of their own kind."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), f"(?is)<(\\w+)\\b[^>]*\\bclass\\s*=\\s*[\"']?[^\"'>]*\\b{name}\\b[^>]*>.*?</\\1\\s*>", "")


def page_span(first: Column, last: Column) -> Column:
    """The pages that a passage stands on, each (part, page), as "(2, 45)", "(2, 45-46)" or "(2, 45 - 3, 1)"; the part is left out where it is "1" or unknown, all where the page is."""
    part = lambda p: F.coalesce(p["part"].cast("string"), F.lit(""))
    named = lambda p: F.when(part(p).isin("", "1"), "").otherwise(F.concat(part(p), F.lit(", ")))
    page = lambda p: p["page"].cast("string")
    one = last["page"].isNull() | (first == last)
    inside = F.when(one, page(first)).when(part(first) == part(last), F.concat(page(first), F.lit("-"), page(last))).otherwise(F.concat(page(first), F.lit(" - "), part(last), F.lit(", "), page(last)))
    return F.when(first["page"].isNull(), "").otherwise(F.concat(F.lit("("), named(first), inside, F.lit(")")))


def heading_trails(titles: DataFrame) -> DataFrame:
    """(tid, page, trail): each heading under its parents' names, TRAIL of them at most. titles: (tid, page, parent, text)."""
    names = titles.select(F.col("tid").alias("up"), F.col("parent").alias("next"), F.coalesce("text", F.lit("")).alias("name"))
    rows = titles.select("tid", "page", F.array(F.coalesce("text", F.lit(""))).alias("trail"), F.col("parent").alias("at"))
    for _ in range(TRAIL - 1):
        rows = rows.join(small(names), F.col("at") == F.col("up"), "left").select("tid", "page", F.when(F.col("name").isNotNull(), F.concat(F.array("name"), "trail")).otherwise(F.col("trail")).alias("trail"), F.col("next").alias("at"))
    return rows.select("tid", "page", F.array_join(F.filter("trail", lambda n: n != ""), " / ").alias("trail"))


def read_paged(pages: DataFrame, titles: DataFrame, limit: int = 1_500, notes: bool = False) -> DataFrame:
    """(book, heading, chunk, trail, span, text): the paragraphs of each book's pages under the heading they follow, packed up to `limit`.

    pages: (book, pid, part, page, body, foot), a paragraph to a line; titles: (book, tid, page, parent, text), page being
    the pid it stands on. With `notes`, a page's footnotes follow its body as one paragraph. A page takes the last heading
    at or before it: headings and pages are merged by place, a book's pages in stretches between its headings. Pages without
    a heading before them, and repeated pids, are kept; a heading on no page opens none.
    """
    by_book = titles.select("book", "tid", "page", "parent", "text")
    key = F.struct("book", "tid")
    trails = heading_trails(by_book.select(key.alias("tid"), "page", F.when(F.col("parent").isNotNull(), F.struct("book", F.col("parent").alias("tid"))).alias("parent"), "text"))
    heads = trails.groupBy(F.col("tid.book").alias("book"), F.col("page").alias("pid")).agg(F.max_by(F.struct(F.col("tid.tid").alias("tid"), "trail"), F.col("tid.tid")).alias("head"))
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\\r?\\n"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != "")
    paras = lines(F.col("body"))
    if notes:
        foot = F.array_join(lines(F.col("foot")), " ")
        paras = F.concat(paras, F.when(foot != "", F.array(F.concat(F.lit("الحاشية: "), foot))).otherwise(F.array().cast("array<string>")))
    placed = pages.join(heads, ["book", "pid"], "left").select("book", "pid", F.struct("part", "page").alias("at"), paras.alias("paras"), "head")
    in_book = Window.partitionBy("book").orderBy("pid")
    placed = placed.withColumn("head", F.last("head", ignorenulls=True).over(in_book))
    rows = placed.select("book", "pid", "at", "head", F.posexplode("paras").alias("n", "text"))
    items = rows.select(F.struct("book", F.col("head.tid").alias("tid")).alias("key"), F.struct("pid", "n").alias("rid"), "text", "at", F.col("head.trail").alias("trail"))
    packed = _with_spans(items, limit)
    return packed.select(F.col("key.book").alias("book"), F.col("key.tid").alias("heading"), "chunk", F.coalesce("trail", F.lit("")).alias("trail"), "span", "text")


def _with_spans(items: DataFrame, limit: int) -> DataFrame:
    """(key, chunk, text, trail, span) of items (key, rid, text, at, trail)."""
    sized = items.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rid", F.char_length("text").alias("n")))).alias("x"))
    none = F.transform("x", lambda r: F.lit(False))
    numbers = sized.select("key", "x", pack_numbers(F.transform("x", lambda r: r["n"]), none, limit, 1).alias("packs"))
    placed = numbers.select(F.col("key").alias("k"), F.explode(F.arrays_zip(F.transform("x", lambda r: r["rid"]).alias("rid"), F.col("packs").alias("chunk"))).alias("p")).select("k", F.col("p.rid").alias("r"), "p.chunk")
    joined = items.join(placed, (F.col("rid") == F.col("r")) & F.col("key").eqNullSafe(F.col("k"))).drop("k", "r")
    texts = joined.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("rid", "text"))).alias("x"), F.min_by("at", "rid").alias("first"), F.max_by("at", "rid").alias("last"), F.first("trail").alias("trail"))
    return texts.select("key", "chunk", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"), "trail", page_span(F.col("first"), F.col("last")).alias("span"))


def glue_split_words(pieces: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(book, entry, text): pieces (book, entry, pos, text) of each entry joined in order, without a blank where the two words at a cut make one of the book's words.

    vocabulary: (book, word); without it, all words of the book's pieces. Each cut is a pair of neighbouring pieces, looked
    up by the word that they would make.
    """
    words = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}+"), F.lit(0))).alias("word")
    known = (pieces.select("book", words) if vocabulary is None else vocabulary).select("book", "word").distinct()
    in_entry = Window.partitionBy("book", "entry").orderBy("pos")
    cuts = pieces.select("book", "entry", "pos", "text", F.lag("text").over(in_entry).alias("before"))
    left = F.regexp_extract(F.col("before"), f"({LETTERS}{{1,{NEAR}}})$", 1)
    right = F.regexp_extract(F.col("text"), f"^({LETTERS}{{1,{NEAR}}})", 1)
    cuts = cuts.withColumn("word", F.when((left != "") & (right != ""), F.concat(left, right)))
    tight = cuts.join(known.withColumn("tight", F.lit(True)), ["book", "word"], "left")
    glue = F.when(F.col("before").isNull() | F.coalesce("tight", F.lit(False)), "").otherwise(" ")
    listed = tight.groupBy("book", "entry").agg(F.sort_array(F.collect_list(F.struct("pos", glue.alias("glue"), "text"))).alias("x"))
    return listed.select("book", "entry", F.array_join(F.transform("x", lambda r: F.concat(r["glue"], F.coalesce(r["text"], F.lit("")))), "").alias("text"))


def false_headings(headings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """headings (book, title, before) with `cut`: whether a title is words out of the middle of an entry: it has punctuation, or what stands before it ends no sentence and it has several words or makes a word of the book with the word before it."""
    ended = F.coalesce(F.col("before"), F.lit("")).rlike("[.؟?!:\\]»)]\\s*$")
    last = F.element_at(F.regexp_extract_all(F.coalesce(F.col("before"), F.lit("")), F.lit(f"{LETTERS}+"), F.lit(0)), -1)
    first = F.get(F.regexp_extract_all("title", F.lit(f"{LETTERS}+"), F.lit(0)), 0)
    rows = headings.withColumn("word", F.concat(F.when(F.size(F.regexp_extract_all(F.coalesce("before", F.lit("")), F.lit(f"{LETTERS}+"), F.lit(0))) > 0, last), first))
    rows = rows.join(vocabulary.select("book", "word").distinct().withColumn("known", F.lit(True)), ["book", "word"], "left").drop("word")
    cut = F.col("title").rlike("[،:.؛/\\[\\]]") | (~ended & (F.contains("title", F.lit(" ")) | F.coalesce("known", F.lit(False))))
    return rows.withColumn("cut", cut).drop("known")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rid) of a file of judgements, a line each (question, anything, passage, relevance): the relevant passages of a question, or one row without any where none of its lines names one (passage -1: no answer)."""
    rows = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ").alias("x")).filter(F.col("x")[0] != "")
    relevant = (F.size("x") >= 4) & (F.get("x", F.lit(2)) != "-1") & (F.get("x", F.lit(3)).try_cast("int") > 0)
    found = rows.groupBy(F.col("x")[0].alias("qid")).agg(F.collect_set(F.when(relevant, F.get("x", F.lit(2)))).alias("rids"))
    return found.select("qid", F.explode_outer("rids").alias("rid"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) of tab-separated lines; lines without a tab are left out."""
    rows = spark.read.text(path).filter(F.contains("value", F.lit("\t")))
    return rows.select(F.substring_index("value", "\t", 1).alias("qid"), F.regexp_replace("value", "^[^\t]*\t", "").alias("text"))
