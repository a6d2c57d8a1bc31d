"""Dictionary search: entries found by the root of an asked word, gates on what they hold, close spellings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import forms
from corpusloom.functions.tables import saved, small
from corpusloom.functions.text import STOPWORDS, normalize, tokenize
from corpusloom.operators.retrieval import RARE, Index, as_index

MATCH, MISMATCH, GAP = 2, -1, -1
CLOSE, HEADING_CLOSE = 0.8, 0.6
HEADING_ENTRIES, HEADING_SCORE = 6, 100
#: Words may differ by so many letters in length to be aligned.
LENGTHS = 2
#: Pairs of words that a task aligns at once.
AT_ONCE = 100_000
# Fixed values, in normalised spelling: words that frame a question about a meaning, those that make it one about a
# word, and those that point at the conversation itself.
FRAME = """
معني معاني المعني معنا معناه معناها بمعني يعني تعني المقصود مقصود المراد مراد تفسير تفسيره شرح اشرح فسر
توضيح كلمه لفظ لفظه
""".split()
MEANING = "معني معاني المعني معنا معناه معناها بمعني يعني تعني المقصود مقصود المراد مراد".split()
DEICTIC = """
الكلام كلام الجواب جواب الاجابه الايه السابق السابقه اعلاه ايش شو وش ايه شنو ليش كلمه
هذا بهذا هذه بهذه ذلك بذلك هذي هاد هادا
""".split()


def _words(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def is_meaning_question(text: Column) -> Column:
    return F.exists(_words(text), lambda w: w.isin(FRAME))


def focus_terms(text: Column) -> Column:
    """The distinct tokens of a question that name its topic."""
    return F.filter(F.array_distinct(tokenize(text)), lambda t: ~t.isin(FRAME))


def raw_terms(text: Column) -> Column:
    """The distinct topic words of a question as normalised, the article still on."""
    return F.filter(F.array_distinct(_words(text)), lambda w: (F.char_length(w) >= 2) & ~w.isin(STOPWORDS) & ~w.isin(FRAME))


def local_alignment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local alignment score of each pair of rows of code points, rows padded with -1 (a) and -2 (b)."""
    before = np.zeros((b.shape[1] + 1, len(a)), np.int16)
    best = np.zeros(len(a), np.int16)
    for i in range(a.shape[1]):
        now = np.zeros_like(before)
        same = np.where(a[:, i, None] == b, MATCH, MISMATCH).astype(np.int16)
        for j in range(b.shape[1]):
            now[j + 1] = np.maximum(np.maximum(before[j] + same[:, j], 0), np.maximum(before[j + 1], now[j]) + GAP)
        best = np.maximum(best, now.max(0))
        before = now
    return best


def _coded(words: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words])
    out = np.full((len(words), sizes.max(initial=0)), fill, np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = [ord(c) for c in w]
    return out, sizes


def closeness(rows: DataFrame) -> DataFrame:
    """rows with `close` instead of `terms` and `words`: the best share of a term's letters that align in a word about as long, 0 without any.

    Words become numbers in each batch, so a pair of words that several rows ask for is aligned once there.
    """
    others = [f for f in rows.schema.fields if f.name not in ("terms", "words")]

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            left, right = b["terms"].explode().dropna(), b["words"].explode().dropna()
            best = pd.Series(0.0, index=b.index)
            if len(left) and len(right):
                a_at, a_words = pd.factorize(left)
                b_at, b_words = pd.factorize(right)
                (a_codes, a_sizes), (b_codes, b_sizes) = _coded(a_words, -1), _coded(b_words, -2)
                held = np.bincount(right.index, minlength=len(b))
                n, ends = held[left.index], np.cumsum(held[left.index])
                row, x = np.repeat(left.index.to_numpy(), n), np.repeat(a_at, n)
                first = (np.cumsum(held) - held)[left.index]  # where the words of each term's row begin
                y = b_at[np.arange(len(row)) + np.repeat(first - (ends - n), n)]
                near = np.abs(a_sizes[x] - b_sizes[y]) <= LENGTHS
                row, x, y = row[near], x[near], y[near]
                pairs, which = np.unique(x.astype(np.int64) * len(b_words) + y, return_inverse=True)
                px, py = pairs // len(b_words), pairs % len(b_words)
                order = np.argsort(a_sizes[px], kind="stable")  # pairs of like length, so that padding stays short
                score = np.zeros(len(pairs))
                for lo in range(0, len(pairs), AT_ONCE):
                    at = order[lo : lo + AT_ONCE]
                    most = a_sizes[px[at]].max()
                    score[at] = local_alignment(a_codes[px[at], :most], b_codes[py[at], : most + LENGTHS]) / (MATCH * a_sizes[px[at]])
                found = pd.Series(score[which], index=row).groupby(level=0).max()
                best.loc[found.index] = found
            yield b[[f.name for f in others]].assign(close=best)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "close double"])
    return rows.select(*[f.name for f in others], "terms", "words").mapInPandas(align, schema)


def alignment(pairs: DataFrame) -> DataFrame:
    """(term, word, close) of distinct pairs: the share of the term's letters found in the word by local alignment, whatever their lengths."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, sizes = _coded(b["term"].to_numpy(), -1)
            scores = local_alignment(a, _coded(b["word"].to_numpy(), -2)[0]) if len(b) else np.zeros(0)
            yield b.assign(close=np.where(sizes > 0, scores / np.maximum(MATCH * sizes, 1), 0.0))

    return pairs.select("term", "word").na.drop().distinct().mapInPandas(align, "term string, word string, close double")


class Headings:
    """The headings of a dictionary by root key, stored: (key, heading). Entries are (rid, heading, text)."""

    def __init__(self, entries: DataFrame):
        self.entries = entries
        distinct = entries.select("heading").distinct()
        self.keys = saved(distinct.select("heading", F.explode(forms.heading_keys(F.col("heading"))).alias("key")), "heading-keys")

    def candidates(self, terms: DataFrame) -> DataFrame:
        """(term, heading): headings that the words `terms`(term) may come from."""
        asked = terms.select("term").distinct().select("term", F.explode(forms.root_keys(F.col("term"))).alias("key"))
        return self.keys.join(small(asked), "key").select("term", "heading").distinct()


def heading_lookup(queries: DataFrame, headings: Headings, most: int = HEADING_ENTRIES) -> DataFrame:
    """(qid, rid, close, score, coverage, rank): for questions about a meaning, the entries under the roots of their words, the closest spelling first."""
    asked = queries.filter(is_meaning_question(F.col("text"))).select("qid", raw_terms(F.col("text")).alias("terms"))
    by_term = saved(asked.select("qid", F.explode("terms").alias("term")), "asked-terms")
    found = headings.candidates(by_term).join(small(by_term), "term").select("qid", "heading").distinct()
    entries = headings.entries.join(small(found.select("heading").distinct()), "heading", "left_semi").select("rid", "heading", F.array_distinct(_words(F.col("text"))).alias("words"))
    rows = entries.join(found, "heading").join(small(asked), "qid").select("qid", "rid", "terms", "words")
    close = closeness(rows).withColumn("close", F.round("close", 6))
    order = Window.partitionBy("qid").orderBy(F.col("close").desc(), "rid")
    ranked = close.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("qid", "rid", "close", (HEADING_SCORE + F.col("close")).alias("score"), F.lit(1.0).alias("coverage"), "rank")


def rare_terms(terms: DataFrame, index: Index, most: int = RARE) -> DataFrame:
    """(term) of `terms`(term) whose first token stands in at most `most` items; words without a token are none."""
    tokens = terms.select("term").distinct().select("term", F.get(tokenize(F.col("term")), 0).alias("token")).filter("token IS NOT NULL")
    held = index.items.select(F.explode(F.array_distinct("t")).alias("token")).join(small(tokens.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    return tokens.join(held, "token", "left").filter(F.coalesce("df", F.lit(0)) <= most).select("term")


def supported(rows: DataFrame, least: float = CLOSE, heading_least: float = 0.0) -> DataFrame:
    """rows (key, term, words and, if present, heading) with `ok` for `words`: whether they hold the term as written, as a core of three letters or more, by the heading's root, or closely spelt.

    heading_least above 0 asks a root in common to be backed by a spelling as close as that.
    """
    has_heading = "heading" in rows.columns
    terms = rows.select("term").distinct().select(
        "term", F.array_union(F.array("term"), F.filter(forms.cores(F.col("term")), lambda c: F.char_length(c) >= 3)).alias("_cores"), forms.root_keys(F.col("term")).alias("_keys")
    )
    joined = rows.join(small(saved(terms, "term-forms")), "term")
    direct = F.arrays_overlap("_cores", "words")
    rooted = F.arrays_overlap("_keys", forms.heading_keys(F.col("heading"))) if has_heading else F.lit(False)
    marked = joined.withColumn("_direct", F.coalesce(direct, F.lit(False))).withColumn("_rooted", F.coalesce(rooted, F.lit(False))).drop("_cores", "_keys")
    open_ = ~F.col("_direct") & ~(F.col("_rooted") & F.lit(heading_least <= 0))
    aligned = closeness(marked.withColumn("terms", F.array(F.when(open_, F.col("term")))))
    ok = F.col("_direct") | F.when(F.col("_rooted"), F.lit(heading_least <= 0) | (F.col("close") >= heading_least)).otherwise(F.col("close") >= least)
    return aligned.withColumn("ok", ok).drop("_direct", "_rooted", "close")


def keeps_entry(hits: DataFrame, queries: DataFrame, entries: DataFrame, index: Index | DataFrame, kind: str = "gharib", least: float = CLOSE, heading_least: float = HEADING_CLOSE) -> DataFrame:
    """hits (qid, rid) with `keeps`: false for a dictionary entry that holds none of the words of a question with a rare word.

    entries: (rid, kind, heading, text). Entries of other kinds, and those of questions without a rare word, stay.
    """
    asked = saved(queries.select("qid", F.explode(raw_terms(F.col("text"))).alias("term")), "asked-terms")
    rare = asked.join(small(rare_terms(asked, as_index(index))), "term", "left_semi").select("qid").distinct()
    wanted = hits.select("qid", "rid").distinct()
    judged = wanted.join(small(rare), "qid", "left_semi").join(entries.filter(F.col("kind") == kind).select("rid", "heading", F.array_distinct(_words(F.col("text"))).alias("words")), "rid")
    ok = supported(judged.join(small(asked), "qid"), least, heading_least).groupBy("qid", "rid").agg(F.bool_or("ok").alias("ok"))
    return hits.join(ok, ["qid", "rid"], "left").withColumn("keeps", F.coalesce("ok", F.lit(True))).drop("ok")


def rewrite_lost_word(queries: DataFrame, rewrites: DataFrame, index: Index | DataFrame) -> DataFrame:
    """(qid, lost): whether the rewrites (qid, text) of a question about a meaning hold none of its words, or miss a rare one."""
    asked = saved(queries.filter(is_meaning_question(F.col("text"))).select("qid", F.explode(raw_terms(F.col("text"))).alias("term")), "asked-terms")
    held = rewrites.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(_words(F.col("text"))))).alias("words"))  # a question's few rewrites
    rows = asked.join(held, "qid", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    rare = rare_terms(asked, as_index(index)).withColumn("rare", F.lit(True))
    judged = supported(rows).join(small(rare), "term", "left").groupBy("qid").agg((~F.bool_or("ok") | F.bool_or(~F.col("ok") & F.col("rare").isNotNull())).alias("lost"))
    return queries.select("qid").join(judged, "qid", "left").select("qid", F.coalesce("lost", F.lit(False)).alias("lost"))


def asks_new_word(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, asks): whether a user's turn asks what a word means that no earlier turn of the conversation holds in any form."""
    worded = turns.select("conv_id", "turn", "role", "text", _words(F.col("text")).alias("w"))
    asking = worded.filter(F.col("role") == "user").filter(F.exists("w", lambda x: x.isin(MEANING)))
    asked = saved(asking.select("conv_id", "turn", F.explode(F.filter(raw_terms(F.col("text")), lambda t: ~t.isin(DEICTIC))).alias("term")), "asked-terms")
    said = worded.select("conv_id", F.col("turn").alias("earlier"), F.col("w").alias("words"))
    rows = asked.join(said, (asked["conv_id"] == said["conv_id"]) & (F.col("earlier") < F.col("turn")), "left").select(asked["conv_id"], "turn", "term", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    heard = supported(rows).groupBy("conv_id", "turn", "term").agg(F.bool_or("ok").alias("ok"))
    new = heard.groupBy("conv_id", "turn").agg(F.bool_or(~F.col("ok")).alias("asks"))
    users = turns.filter(F.col("role") == "user").select("conv_id", "turn")
    return users.join(new, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("asks", F.lit(False)).alias("asks"))


def gate_report(cases: DataFrame, headings: Headings, entries: DataFrame, index: Index | DataFrame, unrelated: DataFrame) -> DataFrame:
    """One row: how well dictionary search serves cases (qid, text, rid): shares of entries found first, among three and kept by the gate, and of unrelated pairs (qid, rid) kept."""
    found = heading_lookup(cases, headings).join(cases.select("qid", F.col("rid").alias("right")), "qid").filter("rid = right").select("qid", "rank")
    placed = cases.select("qid").join(found, "qid", "left").agg((F.count_if(F.col("rank") == 1) / F.count("*")).alias("first"), (F.count_if(F.col("rank") <= 3) / F.count("*")).alias("in_three"))
    share = lambda hits, name: keeps_entry(hits, cases, entries, index).agg((F.count_if("keeps") / F.count("*")).alias(name))
    return placed.crossJoin(share(cases.select("qid", "rid"), "true_kept")).crossJoin(share(unrelated, "unrelated_kept"))  # one row each


def synonyms(lemmas: DataFrame, words: DataFrame, most: int = 200) -> DataFrame:
    """(word, synonym): words that share a synset with a word as written, with its stem or with the article before the stem.

    lemmas: (synset, lemma). Lemmas of several words play no part. A synset of more than `most` lemmas says nothing
    about any of them and is an error in the list: it raises.
    """
    single = lemmas.select("synset", normalize(F.col("lemma")).alias("lemma")).filter("lemma <> '' AND NOT contains(lemma, ' ')").distinct()
    size = F.count("*").over(Window.partitionBy("synset"))
    single = single.withColumn("size", size).withColumn("lemma", F.when(F.col("size") <= most, F.col("lemma")).otherwise(F.raise_error(F.lit("a synset has more lemmas than allowed")))).drop("size")
    stem = forms.light_stem(F.col("word"))
    asked = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.array(F.col("word"), stem, F.concat(F.lit("ال"), stem)))).alias("lemma"))
    met = asked.join(single, "lemma").select("word", "synset").distinct()
    return met.join(single, "synset").select("word", F.col("lemma").alias("synonym")).filter("word <> synonym").distinct()


def read_synsets(spark, path: str) -> DataFrame:
    """(synset, lemma) of a tab-separated word list: synset, a type that ends in ":lemma", lemma; lines with # are comments."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("x")).filter("size(x) >= 3")
    return lines.filter(F.endswith(F.col("x")[1], F.lit(":lemma"))).select(F.col("x")[0].alias("synset"), F.col("x")[2].alias("lemma"))


def _keyed(rows: DataFrame, key: str, word: str) -> DataFrame:
    """(key, root) of each row's word."""
    vocabulary = rows.select(F.col(word).alias("_w")).distinct().select("_w", forms.roots(F.col("_w")).alias("_r"))
    return rows.join(vocabulary, F.col(word) == F.col("_w")).select(key, word, F.explode("_r").alias("root"))


def same_word_form(tokens: DataFrame, held: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """tokens (key, token) with `found`: whether the tokens of `held` (key, token) hold it in any form or as a synonym.

    Skeletons meet equal skeletons; stems meet equal stems, and those of which one begins the other and has three
    letters or more, looked up by their first three. A synonym counts by a root or skeleton of its own.
    """
    asked = saved(tokens.select("key", "token").distinct(), "asked-tokens")
    mine = saved(_keyed(asked, "key", "token"), "asked-roots")
    theirs = saved(_keyed(held.select("key", F.col("token").alias("other")).distinct(), "key", "other").select("key", F.col("root").alias("have")).distinct(), "held-roots")
    equal = mine.join(theirs, (mine["key"] == theirs["key"]) & (F.col("root") == F.col("have"))).select(mine["key"], "token")
    plain = lambda df, c: df.filter(~F.startswith(c, F.lit("~")) & (F.char_length(c) >= 3)).withColumn("_p", F.substring(c, 1, 3))
    a, b = plain(mine, "root"), plain(theirs, "have")
    begins = a.join(b, (a["key"] == b["key"]) & (a["_p"] == b["_p"]) & (F.startswith("root", F.col("have")) | F.startswith("have", F.col("root")))).select(a["key"], "token")
    found = equal.unionByName(begins)
    if lemmas is not None:
        other = synonyms(lemmas, asked.select(F.col("token").alias("word")))
        pairs = asked.join(small(other.withColumnRenamed("word", "token")), "token").select("key", "token", "synonym")
        vocabulary = pairs.select("synonym").distinct().select("synonym", F.explode(forms.roots(F.col("synonym"))).alias("root"))
        rooted = pairs.join(small(vocabulary), "synonym").select("key", "token", "root").distinct()
        by_synonym = rooted.join(theirs.withColumnRenamed("have", "root"), ["key", "root"]).select("key", "token")
        found = found.unionByName(by_synonym)
    found = found.distinct().withColumn("found", F.lit(True))
    return tokens.join(found, ["key", "token"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def synonym_roots(lemmas: DataFrame, words: DataFrame) -> DataFrame:
    """(word, roots): the roots and skeletons of all synonyms of `words` (word); words without any are left out."""
    other = synonyms(lemmas, words).select("word", F.explode(forms.roots(F.col("synonym"))).alias("root"))
    return other.groupBy("word").agg(F.collect_set("root").alias("roots"))  # a word's synonyms


def _places(column: pa.Array) -> tuple[list[list[int]], list[str]]:
    """Lists of words as lists of places among their distinct words, and these."""
    flat = column.flatten().dictionary_encode()
    codes, ends = flat.indices.to_pylist(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).cumsum().tolist()
    return [codes[b:e] for b, e in zip([0, *ends], ends)], flat.dictionary.to_pylist()


def words_lacking(rows: DataFrame) -> DataFrame:
    """(claim, words, lacking) of rows (claim, words, subject, held, also): the words that are no form of a word of the subject, and the places among them of those that are no form of a word held either.

    Words meet as in same_word_form(), but in the row where they stand: nothing is shuffled, and the forms of a word are looked
    for once a task. also: the roots of synonyms by word, or null.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (words, names), (subjects, s_names), (held, h_names) = (_places(b.column(c)) for c in ("words", "subject", "held"))
            mine, of_subject, of_held = ([forms.reach(w) for w in x] for x in (names, s_names, h_names))
            also = [dict(x or ()) for x in b.column("also").to_pylist()]

            def found(codes: list[int], among: list[int], reached: list, more: dict) -> list[bool]:
                own, begun = set(), set()
                for k in among:
                    own |= reached[k][0]
                    begun |= reached[k][1]
                meets = lambda k: not (mine[k][0].isdisjoint(own) and mine[k][0].isdisjoint(begun) and mine[k][1].isdisjoint(own) and own.isdisjoint(more.get(names[k], ())))
                return [meets(k) for k in codes]

            kept, places = [], []
            for w, s, h, more in zip(words, subjects, held, also):
                w = [k for k, is_form in zip(w, found(w, s, of_subject, more)) if not is_form]
                kept.append([names[k] for k in w])
                places.append([i for i, there in enumerate(found(w, h, of_held, more)) if not there])
            yield pa.RecordBatch.from_arrays([b.column("claim"), pa.array(kept, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))], ["claim", "words", "lacking"])

    return rows.select("claim", "words", "subject", "held", "also").mapInArrow(search, f"claim {dict(rows.dtypes)['claim']}, words array<string>, lacking array<int>")


def keyboard_reading(queries: DataFrame, index: Index | DataFrame) -> DataFrame:
    """(qid, reading): what a question (qid, text) of Latin keys alone, three letters at least, would have been on an Arabic keyboard, where all tokens of that are words of the corpus."""
    keys = F.col("text").rlike("^[A-Za-z\\[\\];',./`\\s]+$") & (F.char_length(F.regexp_replace("text", "[^A-Za-z]", "")) >= 3)
    read = saved(queries.filter(keys).select("qid", forms.keyboard_remap(F.col("text")).alias("reading")), "keyboard")
    tokens = read.select("qid", F.explode(tokenize(F.col("reading"))).alias("token")).distinct()
    known = as_index(index).frequencies().join(small(tokens.select("token").distinct()), "token", "left_semi").select("token", F.lit(True).alias("known"))
    whole = tokens.join(small(known), "token", "left").groupBy("qid").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known")).filter("all_known")
    return read.join(whole, "qid", "left_semi")
