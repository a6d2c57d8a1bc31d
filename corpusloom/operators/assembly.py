"""Candidates of multi-phrase questions put together: slots, filters, neighbours, openers, references, pinned texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tables import saved, small
from corpusloom.functions.text import normalize, tokenize
from corpusloom.operators.retrieval import bm25

MIN_COVERAGE, MIN_WORDS = 0.34, 4
PART_SLOTS, NEIGHBOUR_OF, MAX_NEIGHBOURS = 3, 4, 4
PINNED, PINNED_COVERAGE = 4, 0.6


def placed(rows: DataFrame, capacity: int, *order) -> DataFrame:
    """(question, rid, place): the first `capacity` of each question's items in an order, each item once, at its first place."""
    once = rows.groupBy("question", "rid").agg(F.min(F.struct(*order)).alias("at"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("at", "rid")).cast("long"))
    return ranked.filter(F.col("place") <= capacity).select("question", "rid", "place")


def reserved_slots(lists: DataFrame, capacity: int, slots: int = PART_SLOTS) -> DataFrame:
    """(question, rid, place) of lists (question, list_no, part, rid, rank): the best `slots` of each part by turns first, then all lists by turns."""
    tier = F.when(F.col("part") & (F.col("rank") <= slots), 0).otherwise(1).alias("tier")
    return placed(lists, capacity, tier, "rank", "list_no")


def usable_hits(hits: DataFrame, primary_kinds: list[str], least_coverage: float = MIN_COVERAGE, least_words: int = MIN_WORDS) -> DataFrame:
    """hits (text, kind, answer_part, coverage) that may be evidence: an answer, long enough unless of a primary kind, and near enough to the question."""
    words = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    return hits.filter(F.col("answer_part") & (F.col("kind").isin(primary_kinds) | (words >= least_words)) & (F.col("coverage") >= least_coverage))


def without_lookalikes(hits: DataFrame, guards: DataFrame) -> DataFrame:
    """hits (qid, heading, question) without those whose heading holds a guarded word (word, unless) while the question lacks the word that tells it apart."""
    asked = hits.select("qid", "rid", tokenize(F.col("question")).alias("asked"), F.explode(F.array_distinct(tokenize(F.col("heading")))).alias("word"))
    confused = asked.join(small(guards), "word").filter(~F.array_contains("asked", F.col("unless"))).select("qid", "rid").distinct()
    return hits.join(confused, ["qid", "rid"], "left_anti")


def lines_around(hits: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """The columns of all items in the documents of hits (question, rid, place), stored: what is ordered within documents needs no others."""
    rids = small(saved(hits.select("rid").distinct(), "offered-items"))
    locations = small(saved(items.join(rids, "rid", "left_semi").select("location").distinct(), "offered-documents"))
    return saved(items.select(*columns).join(locations, "location", "left_semi"), "offered-lines")


def neighbour_fill(hits: DataFrame, items: DataFrame, kind: str, best: int = NEIGHBOUR_OF, most: int = MAX_NEIGHBOURS) -> DataFrame:
    """(question, rid, nth): up to `most` items next to the first `best` hits (question, rid, place) of a kind, under the same heading, not offered already.

    items: (rid, location, kind, heading). Neighbours are looked up by place in their document.
    """
    line = F.row_number().over(Window.partitionBy("location").orderBy("rid"))
    near = lines_around(hits, items, "rid", "location", "kind", "heading")
    numbered = near.select("rid", "location", "kind", "heading", line.alias("line"))
    of_kind = hits.join(numbered.filter(F.col("kind") == kind), "rid").withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy("place"))).filter(F.col("k") <= best)
    steps = of_kind.select("question", "location", "heading", "k", "line", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step")).withColumn("line", F.col("line") + F.col("step"))
    beside = numbered.select(F.col("rid").alias("near"), "location", "heading", "line")
    found = steps.join(beside, ["location", "line", "heading"]).join(hits.select("question", F.col("rid").alias("near")), ["question", "near"], "left_anti")
    first = found.groupBy("question", "near").agg(F.min(F.struct("k", "step")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("question").orderBy("at")).cast("long")
    return first.withColumn("nth", nth).filter(F.col("nth") <= most).select("question", F.col("near").alias("rid"), "nth")


def issue_openers(hits: DataFrame, items: DataFrame, kind: str, opener: str) -> DataFrame:
    """(question, rid, place): hits of a kind have the item that opens their issue put before them.

    The opener is one or two items before, under the same heading, its text matching the pattern; an
    opener that is offered already moves up. items: (rid, location, kind, heading, text).
    """
    order = Window.partitionBy("location").orderBy("rid")
    before = [F.when((F.lag("heading", n).over(order) == F.col("heading")) & F.lag("text", n).over(order).rlike(opener), F.lag("rid", n).over(order)) for n in (1, 2)]
    near = lines_around(hits, items, "rid", "location", "kind", "heading", "text")
    openers = near.select("rid", "kind", F.col("text").rlike(opener).alias("opens"), F.coalesce(*before).alias("opener"))
    joined = hits.join(openers, "rid", "left")
    wanted = joined.filter((F.col("kind") == kind) & ~F.col("opens") & F.col("opener").isNotNull()).select("question", F.col("opener").alias("rid"), F.col("place").alias("at"), F.lit(0).alias("after"))
    return placed(hits.select("question", "rid", F.col("place").alias("at"), F.lit(1).alias("after")).unionByName(wanted), 1 << 30, "at", "after")


def quotations_in(text: Column, least_words: int = 4, most: int = 12) -> Column:
    """The first `most` quotations of a text of `least_words` words or more."""
    all_ = F.transform(F.regexp_extract_all(text, F.lit("[«\"“]([^«»\"“”]+)[»\"”]"), F.lit(1)), lambda q: F.trim(q))
    return F.slice(F.filter(all_, lambda q: F.size(F.filter(F.split(normalize(q), " "), lambda w: w != "")) >= least_words), 1, most)


def quoted_sources(texts: DataFrame, index, most: int = 3, coverage: float = 0.9) -> DataFrame:
    """(rid, quoted, nth): for each text (rid, text), the items that hold nearly all words of its quotations, the first quotation's best first."""
    quotes = saved(texts.select("rid", F.posexplode(quotations_in(F.col("text"))).alias("k", "quote")), "quotations")
    asked = quotes.select("quote").distinct().select(F.xxhash64("quote").alias("qid"), F.col("quote").alias("text"))
    hits = bm25(asked, index).filter(F.col("coverage") >= coverage).select("qid", F.col("rid").alias("quoted"), "rank")
    met = quotes.select("rid", "k", F.xxhash64("quote").alias("qid")).join(hits, "qid")
    nth = F.row_number().over(Window.partitionBy("rid").orderBy("k", "rank"))
    return met.withColumn("nth", nth).filter(F.col("nth") <= most).select("rid", "quoted", "nth")


def quoted_source_first(hits: DataFrame, sources: DataFrame, most: int = 2) -> DataFrame:
    """(question, rid, place): before a hit that quotes a primary text, that text, for `most` hits of a question.

    sources: (rid, quoted): what the search found for the quotations of a hit, best first (nth).
    """
    first = hits.join(sources.groupBy("rid").agg(F.min_by("quoted", "nth").alias("quoted")), "rid")
    new = first.groupBy("question", "quoted").agg(F.min("place").alias("at"))
    counted = new.withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy("at", "quoted"))).filter(F.col("k") <= most)
    before = counted.select("question", F.col("quoted").alias("rid"), "at", F.lit(0).alias("after"))
    return placed(hits.select("question", "rid", F.col("place").alias("at"), F.lit(1).alias("after")).unionByName(before), 1 << 30, "at", "after")


def verse_references(texts: DataFrame, names: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(key, id, nth): items that a text names by a unit's name and a number or a range, in the order named.

    texts: (key, text). names: (name: normalised, unit). items: (unit, number, id). A range is taken whole;
    what does not exist is left out.
    """
    pattern = "([\\p{L}]+)\\s*[,:(]?\\s*(\\d{1,3})(?:\\s*[-–]\\s*(\\d{1,3}))?"
    found = texts.select("key", F.posexplode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "name"), (2, "first"), (3, "last"))])).alias("pos", "x"))
    spans = found.select("key", "pos", normalize(F.col("x.name")).alias("name"), F.col("x.first").cast("int").alias("first"), F.coalesce(F.expr("try_cast(x.last as int)"), F.col("x.first").cast("int")).alias("last"))
    units = spans.join(small(names), "name").filter("last >= first").select("key", "pos", "unit", F.explode(F.sequence("first", "last")).alias("number"))
    known = units.join(items.select("unit", "number", "id"), ["unit", "number"]).groupBy("key", "id").agg(F.min(F.struct("pos", "number")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("at", "id")).cast("long")
    return known.withColumn("nth", nth).filter(F.col("nth") <= most).select("key", "id", "nth")


def missing_entries(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(unit, number) asked for that no entry (unit, first, last) covers."""
    covered = entries.select("unit", F.explode(F.sequence("first", "last")).alias("number")).distinct()
    return asked.join(covered, ["unit", "number"], "left_anti").select("unit", "number").distinct()


def pinned(hits: DataFrame, kinds: list[str], most: int = PINNED, coverage: float = PINNED_COVERAGE) -> DataFrame:
    """(question, rid, nth): hits (question, rid, rank, kind, coverage) of text the user quoted that go before all others."""
    near = hits.filter(F.col("kind").isin(kinds) & (F.col("coverage") >= coverage)).groupBy("question", "rid").agg(F.min("rank").alias("rank"))
    nth = F.row_number().over(Window.partitionBy("question").orderBy("rank", "rid")).cast("long")
    return near.withColumn("nth", nth).filter(F.col("nth") <= most).select("question", "rid", "nth")


def new_words(turns: DataFrame, least_chars: int = 4) -> DataFrame:
    """(conv_id, turn, word): words of a turn that no earlier turn of the conversation holds."""
    words = turns.select("conv_id", "turn", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("word")).filter(F.char_length("word") >= least_chars)
    return words.groupBy("conv_id", "word").agg(F.min("turn").alias("turn")).select("conv_id", "turn", "word")
