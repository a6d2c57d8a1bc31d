"""Benchmark decontamination by a distributed positional inverted index.

A window is LENGTH consecutive words of a benchmark item; a shorter item is one window. The search
starts from the rarest terms: the corpus frequency of every benchmark word is counted (partial sums
before the shuffle), and each window takes its ANCHORS rarest positions as anchors. `postings` stores
(term, document, position) for the anchor terms. Lists are intersected after adjusting offsets: a
posting at p of a term at place a of an item lies on the diagonal p - a, and a window can occur on a
diagonal only if all its anchors are there. What is left is checked word by word against the
document, which gives exact phrase matches. `proximity` returns pairs of terms within a distance.

No posting list is gathered anywhere: postings join the anchors by term (broadcast if the anchors are
few, otherwise shuffled and split by adaptive skew handling), diagonals are grouped by (document,
item, diagonal), and every document meets its own diagonals once.

DataFrame functions only. Null and empty texts have no words. Rows that repeat an id and a text share
one result; equal ids with different texts, and null ids, are told apart by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, doc_key, let, named_again, numbered, small, stored

#: Fixed value: what separates words once A-Z are lower-cased.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LENGTH = 10
ANCHORS = 2


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item with words: item (its row number's hash key), item_id, item_words."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("item_words")).filter(F.size("item_words") > 0)
    return rows.withColumn("item", F.xxhash64("item_id", F.concat_ws(" ", "item_words"))).dropDuplicates(["item_id", "item_words"])


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences of each of the terms in the corpus, summed in each task before the shuffle."""
    tokens = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    return tokens.join(small(terms), "term", "left_semi").groupBy("term").count()


def anchors(items: DataFrame, counts: DataFrame, length: int = LENGTH, per_window: int = ANCHORS) -> DataFrame:
    """(item, first, place, term, needed): window `first` of the item needs `needed` anchors, this one at `place`.

    Windows with a word that the corpus lacks cannot occur and have no rows.
    """
    places = items.select("item", "item_id", F.size("item_words").alias("n"), F.posexplode("item_words").alias("place", "term")).join(counts, "term", "left")
    firsts = F.sequence(F.greatest(F.col("place") - length + 1, F.lit(0)), F.greatest(F.least(F.col("place"), F.col("n") - length), F.lit(0)))
    in_windows = places.withColumn("first", F.explode(firsts))
    window = Window.partitionBy("item", "item_id", "first")
    ranked = in_windows.withColumn("k", F.row_number().over(window.orderBy(F.col("count").asc_nulls_first(), "term", "place"))).withColumn("lacks", F.count_if(F.col("count").isNull()).over(window))
    chosen = ranked.filter((F.col("lacks") == 0) & (F.col("k") <= per_window))
    return chosen.select("item", "item_id", "first", "place", "term", F.least(F.lit(per_window), "n").alias("needed"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: (k1, k2, term, pos) for the given terms."""
    tokens = docs.select(*doc_key(id_col, text_col), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return stored(tokens.join(small(terms), "term", "left_semi").select("k1", "k2", "term", "pos"), "postings")


def candidates(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(k1, k2, item, item_id, diagonal, firsts): windows all of whose anchors lie on the diagonal."""
    places = chosen.groupBy("item", "item_id", "term", "place").agg(F.collect_set(F.struct("first", "needed")).alias("windows"))
    on_diagonals = index.join(small(places), "term").select("k1", "k2", "item", "item_id", (F.col("pos") - F.col("place")).alias("diagonal"), "place", "windows")
    grouped = on_diagonals.groupBy("k1", "k2", "item", "item_id", "diagonal").agg(F.collect_set(F.struct("place", "windows")).alias("found"))
    opened = F.flatten(F.transform("found", lambda x: x["windows"]))
    full = let(opened, lambda w: F.transform(F.filter(F.array_distinct(w), lambda x: F.size(F.filter(w, lambda y: y["first"] == x["first"])) >= x["needed"]), lambda x: x["first"]))
    return grouped.withColumn("firsts", full).filter(F.size("firsts") > 0).drop("found")


def proximity(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """Occurrences of (left, right) term pairs at most `distance` words apart: (left, right, k1, k2, left_pos, right_pos)."""
    left = index.withColumnsRenamed({"term": "left", "pos": "left_pos"}).join(small(pairs), "left")
    right = index.withColumnsRenamed({"term": "right", "pos": "right_pos"})
    return left.join(right, ["k1", "k2", "right"]).filter(F.abs(F.col("left_pos") - F.col("right_pos")) <= distance).select("left", "right", "k1", "k2", "left_pos", "right_pos")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with _n_words, _hit (positions inside occurrences of windows) and _items (item ids, sorted as strings).

    Columns of docs by these three names give way to them.
    """
    left, (doc, text) = numbered(docs, id_col, text_col)
    items = stored(item_words(benchmark, item_id_col, item_text_col), "benchmark-words")
    vocabulary = items.select(F.explode("item_words").alias("term")).distinct()
    chosen = stored(anchors(items, term_counts(left, vocabulary, text), length), "anchors")
    index = postings(left, chosen.select("term").distinct(), doc, text)
    # an item's words join once for each document that may hold it, not for each diagonal
    found = candidates(index, chosen).groupBy("k1", "k2", "item", "item_id").agg(F.collect_list(F.struct("diagonal", "firsts")).alias("diagonals")).join(small(items), ["item", "item_id"])
    per_doc = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "diagonals", "item_words")).alias("found"))

    # the words are cut after the join, so that the texts alone are shuffled
    joined = left.select("*", *doc_key(doc, text)).join(per_doc, ["k1", "k2"], "left").withColumn("words", words(F.col(text)))

    def exact(w: Column) -> Column:
        """Of each item, (item_id, n words a window, starts in the document of its windows)."""

        def starts(x: Column) -> Column:
            n = F.least(F.lit(length), F.size(x["item_words"]))
            alike = lambda d, f: (f + d >= 0) & (F.slice(w, F.greatest(f + d, F.lit(0)) + 1, n) == F.slice(x["item_words"], f + 1, n))
            return F.flatten(F.transform(x["diagonals"], lambda d: F.transform(F.filter(d["firsts"], lambda f: alike(d["diagonal"], f)), lambda f: f + d["diagonal"])))

        all_ = F.transform("found", lambda x: F.struct(x["item_id"].alias("item_id"), F.least(F.lit(length), F.size(x["item_words"])).alias("n"), starts(x).alias("starts")))
        return F.filter(all_, lambda x: F.size(x["starts"]) > 0)

    checked = joined.withColumn("exact", F.when(F.col("found").isNull(), F.lit(None)).otherwise(let(F.col("words"), exact)))
    covered = F.array_distinct(F.flatten(F.transform("exact", lambda x: F.flatten(F.transform(x["starts"], lambda s: F.sequence(s, s + x["n"] - 1))))))
    return named_again(checked, docs, {
        "_n_words": F.size("words").cast("long"), "_hit": F.coalesce(covered, F.array().cast("array<int>")),
        "_items": F.coalesce(F.array_sort(F.array_distinct(F.transform("exact", lambda x: x["item_id"]))), F.array().cast("array<string>")),
    })


def report(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return marked.select(
        id_col, F.col("_n_words").alias("n_words"), F.size("_hit").cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_hit") > 0).alias("contaminated"),
    )
