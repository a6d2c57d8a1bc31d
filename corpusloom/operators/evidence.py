"""Quotations located in passages, concordance, and claims checked against what they cite."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tables import saved, small
from corpusloom.functions.text import collapse_spaces, let, matches_with_offsets, normalize, normalized_words, words_with_offsets
from corpusloom.operators.retrieval import runs_of

CLOSE_COVERAGE, CLOSE_RUN, LEAST_WORDS = 0.6, 4, 3
FUZZY_WORD, FUZZY_COVERAGE, FUZZY_FOUND, FUZZY_SLACK = 4, 0.7, 4, 2
# Vowel marks, those that may end a word, and a tanween before a last alif.
MARK = "[\\u064B-\\u0652\\u0670]"
ENDINGS = "\u064b\u064c\u064d\u064e\u064f\u0650"
TANWEEN_ALIF = ("\u064bا", "\u064bى")
#: A word of Arabic letters with its marks, and a quotation, to its end or the text's.
LETTER_WORD = "[\\u0621-\\u063a\\u0641-\\u064a\\u0671][\\u0621-\\u063a\\u0641-\\u064a\\u0671\\u064b-\\u0652\\u0670]*"
QUOTED = "«[^»]*(?:»|$)|﴿[^﴾]*(?:﴾|$)|“[^”]*(?:”|$)|\"[^\"\\n]*(?:\"|$)"
#: What a word must hold for something of it to be left by normalize().
WORDY = "[\\p{L}\\p{N}_&&[^\\u0640\\u06D6-\\u06ED]]"
EDGES = "^[^\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_]+$"
_LETTER_WORD, _QUOTED, _MARKS = re.compile(LETTER_WORD), re.compile(QUOTED), re.compile(f"{MARK}+")
#: Texts whose words a task holds at once.
ROWS_AT_ONCE = 512
# Kinds and sources that come first among equally exact findings.
KIND_ORDER = ["quran", "hadith"]
PRIMARY_SOURCES = ["sahih-bukhari", "sahih-muslim"]


def quote_words(quotes: DataFrame) -> DataFrame:
    """(qid, t): all words of a quotation, normalised; stopwords stay."""
    return quotes.select("qid", F.filter(F.split(normalize(F.col("text")), " "), lambda w: w != "").alias("t"))


def item_words(items: DataFrame) -> DataFrame:
    """(rid, t, at): the normalised words of an item and (s, e), where each stands in its text. Stored, since the text is cut but once."""
    rows = items.select("rid", words_with_offsets(F.col("text")).alias("x"))
    return saved(rows.select("rid", F.transform("x", lambda w: w["w"]).alias("t"), F.transform("x", lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"))).alias("at")), "item-words")


def longest_runs(quotes: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """(qid, rid, n, run, qstart, start): the longest run of a quotation's words in an item; on ties first in the quotation, then in the item.

    With least = 1 single words in common count as well where nothing longer is found; they meet on the word itself.
    """
    asked, held = quote_words(quotes), saved(items.select("rid", normalized_words(F.col("text")).alias("t")), "item-words")
    return longest_of(runs_of(asked, held), asked, held, least)


def longest_of(runs: DataFrame, asked: DataFrame, held: DataFrame, least: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("qid", "rid").orderBy(F.col("run").desc(), "qstart", "start"))
    columns = ["qid", "rid", "n", F.col("run").cast("long").alias("run"), F.col("qstart").cast("long").alias("qstart"), F.col("start").cast("long").alias("start")]
    if least > 1:
        return runs.withColumn("k", best).filter("k = 1").select(*columns)
    first = lambda df, key, name: df.select(key, F.posexplode("t").alias(name, "w")).groupBy(key, "w").agg(F.min(name).alias(name))
    q = first(asked, "qid", "qstart").join(asked.select("qid", F.size("t").alias("n")), "qid")
    single = first(held, "rid", "start").join(small(q), "w").select("qid", "n", "rid", "start", "qstart", F.lit(1).cast("long").alias("run"))
    return runs.unionByName(single).withColumn("k", best).filter("k = 1").select(*columns)


def classify(runs: DataFrame) -> DataFrame:
    """runs with coverage and status: exact, close or null."""
    coverage = F.col("run") / F.col("n")
    status = F.when(F.col("n") < LEAST_WORDS, None).when(F.col("run") == F.col("n"), "exact").when((coverage >= CLOSE_COVERAGE) & (F.col("run") >= CLOSE_RUN), "close")
    return runs.withColumn("coverage", F.round(coverage, 3)).withColumn("status", status)


def one_letter_apart(a: str, b: str) -> bool:
    """Whether two words are equal or, at FUZZY_WORD letters or more, differ by one letter changed, added or left out."""
    if a == b:
        return True
    if min(len(a), len(b)) < FUZZY_WORD or abs(len(a) - len(b)) > 1:
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


def _places(quote: set[str], words: list[str]) -> dict[str, int]:
    """For each word of the quotation, one bit a word of the item that is one letter apart at most."""
    held: dict[str, int] = {}
    for k, w in enumerate(words):
        held[w] = held.get(w, 0) | 1 << k
    return {q: sum(at for w, at in held.items() if one_letter_apart(q, w)) for q in quote}


def _best_stretch(quote: list[str], size: int, places: dict[str, int], starts: int, least: int = 0) -> tuple[int, int, int] | None:
    """(found, first, last) of the stretch of an item of `size` words, begun at a bit of `starts`, that holds most of the quotation in order, `least` words at least.

    The longest common subsequence of the quotation and a stretch is kept as one bit a word of the stretch; on ties the
    shortest stretch wins, then the first. A stretch with fewer words of the quotation in any order cannot win.
    """
    n, anywhere, best = len(quote), 0, None
    for at in places.values():
        anywhere |= at
    while starts:
        start = (starts & -starts).bit_length() - 1
        starts &= starts - 1
        full = (1 << min(n + FUZZY_SLACK, size - start)) - 1
        if (anywhere >> start & full).bit_count() < max(least, -best[0][0] if best else 0):
            continue
        row = full  # a zero bit marks where the common subsequence grows
        for q in quote:
            hit = row & (places[q] >> start)
            row = ((row + hit) | (row & ~hit)) & full
        grown = full & ~row
        found, length = grown.bit_count(), grown.bit_length()
        if found >= least and (best is None or (-found, length) < best[0]):
            best = (-found, length), start
    if best is None:
        return None
    (found, length), start = best
    return -found, start, start + length - 1


def fuzzy_place(quote: list[str], words: list[str]) -> tuple[int, int, int] | None:
    """(found, first, last) of the best stretch that begins with one of the first three words, in an item that holds a third of the words as written: a quick look, which no search uses. closest_stretch() looks everywhere."""
    held, distinct = set(words), set(quote)
    if 2 * len(distinct & held) < FUZZY_COVERAGE * len(distinct):
        return None
    places, starts = _places(distinct, words), 0
    for q in quote[:3]:
        starts |= places[q]
    return _best_stretch(quote, len(words), places, starts)


def closest_stretch(quote: list[str], words: list[str], least: int) -> tuple[int, int, int] | None:
    """(found, first, last): where most of the quotation's words stand in order among n + FUZZY_SLACK words of the item, `least` of them at least, wherever the stretch begins."""
    places, starts = _places(set(quote), words), 0
    if sum(places[q] != 0 for q in quote) < least:
        return None
    for at in places.values():
        starts |= at
    return _best_stretch(quote, len(words), places, starts, least)


def fuzzy_spans(pairs: DataFrame) -> DataFrame:
    """(qid, rid, found, first, last) of candidate pairs (qid, rid, asked, held): those whose span holds enough of the quotation."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for qid, rid, asked, held in zip(b["qid"], b["rid"], b["asked"], b["held"]):
                least = next(k for k in range(FUZZY_FOUND, FUZZY_FOUND + len(asked) + 1) if k >= FUZZY_COVERAGE * len(asked))
                place = closest_stretch(list(asked), list(held), least)
                if place:
                    rows.append((qid, rid, *place))
            yield pd.DataFrame(rows, columns=["qid", "rid", "found", "first", "last"])

    kinds = dict(pairs.dtypes)
    return pairs.select("qid", "rid", "asked", "held").mapInPandas(search, f"qid {kinds['qid']}, rid {kinds['rid']}, found long, first long, last long")


def find_quotes(quotes: DataFrame, items: DataFrame, candidates: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(qid, rid, n, status, coverage, run, s, e): what each candidate item (qid, rid) holds of a quotation, s and e in its text.

    Quotations of fewer than LEAST_WORDS words point nowhere. Candidates that hold no run long enough are
    searched for a span with a wrong or missing word.
    """
    asked = quote_words(quotes).filter(F.size("t") >= LEAST_WORDS)
    pairs = candidates.select("qid", "rid").distinct().join(small(asked.select("qid")), "qid", "left_semi")
    held = item_words(items.join(small(pairs.select("rid").distinct()), "rid", "left_semi"))
    met = pairs.join(small(asked.withColumnRenamed("t", "asked")), "qid").join(held.withColumnRenamed("t", "held"), "rid")
    runs = runs_of(asked, held).join(small(pairs), ["qid", "rid"], "left_semi")
    found = classify(longest_of(runs, asked, held, 2)).filter("status IS NOT NULL")
    spans = found.select("qid", "rid", "n", "status", "coverage", "run", F.col("start").alias("first"), (F.col("start") + F.col("run") - 1).alias("last"))
    if fuzzy:
        rest = met.join(found.select("qid", "rid"), ["qid", "rid"], "left_anti")
        loose = fuzzy_spans(rest).join(small(asked.select("qid", F.size("t").alias("n"))), "qid")
        spans = spans.unionByName(loose.select("qid", "rid", "n", F.lit("close").alias("status"), F.round(F.col("found") / F.col("n"), 3).alias("coverage"), F.col("found").alias("run"), "first", "last"))
    placed = spans.join(held.select("rid", "at"), "rid")
    at = lambda k: F.get("at", F.col(k).cast("int"))
    return placed.select("qid", "rid", "n", "status", "coverage", "run", at("first")["s"].alias("s"), at("last")["e"].alias("e"))


def rank_quotes(found: DataFrame, most: int = 8, kinds: list[str] = KIND_ORDER, sources: list[str] = PRIMARY_SOURCES) -> DataFrame:
    """The best findings of each quotation: exact first, then kinds as listed, first sources, coverage, and the search's rank.

    found: (qid, rid, status, coverage, kind, source_id, rank) and whatever else.
    """
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(len(kinds)))
    order = Window.partitionBy("qid").orderBy((F.col("status") != "exact").cast("int"), kind, (~F.col("source_id").isin(sources)).cast("int"), F.col("coverage").desc(), "rank", "rid")
    return found.filter("status IS NOT NULL").withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


def collapse_wording(ranked: DataFrame, most: int = 3) -> DataFrame:
    """Findings of one wording in one source as one, its other places in `also`: the first `most` of each quotation.

    ranked: (qid, rid, place, source_id, location, excerpt) and whatever else.
    """
    same = ["qid", "source_id", "wording"]
    worded = ranked.withColumn("wording", normalize(F.col("excerpt")))
    groups = worded.groupBy(*same).agg(F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "location"))).alias("all"))
    also = groups.select(*same, "place", F.transform(F.slice("all", 2, F.size("all")), lambda x: x["location"]).alias("also"))  # a quotation has no more than its ranked findings
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("long")
    return worded.join(also, [*same, "place"]).drop("wording").withColumn("nth", nth).filter(F.col("nth") <= most)


def too_generic(quotes: DataFrame, hits: DataFrame, found: DataFrame, candidates: int = 12, least: int = 8, coverage: float = 0.8) -> DataFrame:
    """(qid, outcome): the status of the first finding; without any, too_generic where many of the best hits hold nearly all the words, else not_found."""
    wide = hits.filter(F.col("rank") <= candidates).groupBy("qid").agg((F.count_if(F.col("coverage") >= coverage) >= least).alias("generic"))
    first = found.groupBy("qid").agg(F.min_by("status", "place").alias("status"))
    joined = quotes.select("qid").join(wide, "qid", "left").join(first, "qid", "left")
    return joined.select("qid", F.coalesce("status", F.when(F.col("generic"), "too_generic").otherwise("not_found")).alias("outcome"))


def quote_parts(quotes: DataFrame, least: int = 4) -> DataFrame:
    """(qid, nth, part): the whole quotation, what follows its first colon, then its endings and beginnings of fewer and fewer words, down to `least`; each once."""
    w = F.filter(F.split(normalize(F.col("text")), " "), lambda x: x != "")
    after = normalize(F.when(F.col("text").rlike("[:：]"), F.regexp_replace("text", "(?s)^[^:：]*[:：]", "")))
    rows = quotes.select("qid", w.alias("w"), after.alias("after")).filter(F.size("w") > 0)
    sizes = F.when(F.size("w") > least, F.sequence(F.size("w") - 1, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    ends = F.flatten(F.transform(sizes, lambda n: F.array(F.array_join(F.slice("w", F.size("w") - n + 1, n), " "), F.array_join(F.slice("w", F.lit(1), n), " "))))
    parts = F.filter(F.array_distinct(F.concat(F.array(F.array_join("w", " "), "after"), ends)), lambda x: x != "")
    return rows.select("qid", F.posexplode(parts).alias("nth", "part"))


def written_words(items: DataFrame) -> DataFrame:
    """(rid, pos, written, word)"""
    rows = items.select("rid", F.posexplode(F.filter(F.split("text", "\\s+"), lambda w: w != "")).alias("pos", "written"))
    return rows.withColumn("word", normalize(F.col("written"))).filter("word <> ''")


def concordance(targets: DataFrame, items: DataFrame, around: int = 4) -> DataFrame:
    """(word, rid, pos, snippet): every place of the wanted words, with the words around it."""
    listed = items.select("rid", F.filter(F.split("text", "\\s+"), lambda w: w != "").alias("w"))
    placed = listed.select("rid", "w", F.posexplode("w").alias("pos", "written")).withColumn("word", normalize(F.col("written")))
    snippet = F.array_join(F.slice("w", F.greatest(F.col("pos") - around, F.lit(0)) + 1, F.col("pos") + around + 1 - F.greatest(F.col("pos") - around, F.lit(0))), " ")
    return placed.join(targets, "word", "left_semi").select("word", "rid", "pos", snippet.alias("snippet"))


def unambiguous(items: DataFrame) -> DataFrame:
    """(word, written): normalised words that are written one way only."""
    forms = written_words(items).groupBy("word").agg(F.min("written").alias("written"), F.max("written").alias("other"))
    return forms.filter("written = other").select("word", "written")


def by_reading(items: DataFrame) -> DataFrame:
    """(word, written, n): how often each written form of a word occurs, edge punctuation off."""
    forms = written_words(items).withColumn("written", F.regexp_replace("written", "^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$", ""))
    return forms.groupBy("word", "written").agg(F.count("*").alias("n"))


def split_ending(word: Column) -> Column:
    """A marked word as head, ending and tail: the ending is the vowels after the last letter, or the tanween before a last alif."""
    size = F.char_length(word)
    tanween = (size >= 2) & F.substring(word, -2, 2).isin(*TANWEEN_ALIF)
    head = F.when(tanween, F.substr(word, F.lit(1), size - 2)).otherwise(F.rtrim(word, F.lit(ENDINGS)))
    ending = F.when(tanween, TANWEEN_ALIF[0][:1]).otherwise(F.substr(word, F.char_length(head) + 1, size))
    return F.struct(head.alias("head"), ending.alias("ending"), F.when(tanween, F.substring(word, -1, 1)).otherwise("").alias("tail"))


def bare(word: Column) -> Column:
    return F.regexp_replace(word, MARK, "")


def marked_words(items: DataFrame) -> DataFrame:
    """(rid, pos, written, word, before, marked): words without edge punctuation, bare of marks, and the bare word before; taken from within an item, so nothing is shuffled."""
    parts = F.transform(F.filter(F.split("text", "\\s+"), lambda w: w != ""), lambda w, i: F.struct(i.alias("pos"), w.alias("raw")))
    held = F.transform(F.filter(parts, lambda x: x["raw"].rlike(WORDY)), lambda x: F.struct(x["pos"].alias("pos"), F.regexp_replace(x["raw"], EDGES, "").alias("written")))
    listed = items.select("rid", let(held, lambda x: F.struct(x.alias("x"), F.transform(x, lambda w: bare(w["written"])).alias("word"))).alias("l"))
    joined = lambda w, i: F.struct(w["pos"].alias("pos"), w["written"].alias("written"), F.get("l.word", i).alias("word"), F.get("l.word", i - 1).alias("before"))
    rows = listed.select("rid", F.explode(F.transform("l.x", joined)).alias("w"))
    return rows.select("rid", "w.pos", "w.written", "w.word", "w.before", F.col("w.written").rlike(MARK).alias("marked"))


def dominant(forms: DataFrame, key: list[str], least: int, share: float) -> DataFrame:
    """(key, head, tail, ending, n): the head and tail that hold at least that share of a key's marked places, and their most frequent ending; ties to the first seen.

    forms: (key, written, k, at), how often a marked form occurs and where first.
    """
    dealt = forms.repartition(*key)  # once, for all that follows
    parts = dealt.select(*key, split_ending(F.col("written")).alias("x"), "k", "at").select(*key, "x.head", "x.ending", "x.tail", "k", "at")
    endings = parts.groupBy(*key, "head", "tail", "ending").agg(F.sum("k").alias("k"), F.min("at").alias("at"))
    stems = endings.groupBy(*key, "head", "tail").agg(F.sum("k").alias("k"), F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "at", "ending")))[0]["ending"].alias("ending"))  # a few endings a stem
    whole = Window.partitionBy(*key)
    ranked = stems.withColumn("n", F.sum("k").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(F.col("k").desc(), "at")))
    return ranked.filter((F.col("r") == 1) & (F.col("n") >= least) & (F.col("k") >= share * F.col("n"))).select(*key, "head", "tail", "ending", "n")


def counted(words: DataFrame, *key: str) -> DataFrame:
    """words (rid, pos, key) as (key, k, at)"""
    return words.groupBy(*key).agg(F.count("*").alias("k"), F.min(F.struct("rid", "pos")).alias("at"))


def mark_lexicon(items: DataFrame, least: int = 3, share: float = 0.9) -> DataFrame:
    """(word, head, tail, ending, n) for bare words that are marked one way nearly everywhere.

    Words are counted as written first; the rules then look at each written form once.
    """
    raw = items.select("rid", F.posexplode(F.split("text", "\\s+")).alias("pos", "raw")).filter("raw <> ''")
    forms = counted(raw.filter(F.col("raw").rlike(MARK)), "raw").filter(normalize(F.col("raw")) != "")
    forms = forms.select(F.regexp_replace("raw", EDGES, "").alias("written"), "k", "at").filter(F.col("written").rlike(MARK))
    return dominant(forms.select(bare(F.col("written")).alias("word"), "written", "k", "at"), ["word"], least, share)


def with_before(words: DataFrame) -> DataFrame:
    return words if "before" in words.columns else words.withColumn("before", F.lag("word").over(Window.partitionBy("rid").orderBy("pos")))


def bigram_lexicon(items: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(before, word, head, tail, ending, n): mark_lexicon keyed by the bare word before as well."""
    words = with_before(marked_words(items)).filter("marked AND before IS NOT NULL")
    return dominant(counted(words, "before", "word", "written"), ["before", "word"], least, share)


def lexicons(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What mark_lexicon() and bigram_lexicon() give for the items of words (as marked_words() has them), whose forms are counted once for both."""
    forms = saved(counted(with_before(words).filter("marked"), "before", "word", "written"), "marked-forms")
    alone = forms.groupBy("word", "written").agg(F.sum("k").alias("k"), F.min("at").alias("at"))
    return dominant(alone, ["word"], 3, 0.9), dominant(forms.filter("before IS NOT NULL"), ["before", "word"], 3, 0.8)


def apply_lexicon(words: DataFrame, lexicon: DataFrame, bigrams: DataFrame) -> DataFrame:
    """words (rid, pos, written, word) with `fixed`: head and tail of the bigram's entry, else of the word's.

    The word's own ending stays; the entry's is used where it has none; words that the entries never end
    with a mark get none. A word whose bare letters would change stays as it is.
    """
    entry = lambda df, n: df.select(*[c for c in ("before", "word") if c in df.columns], F.struct("head", "tail", "ending").alias(n))
    two, one = saved(entry(bigrams, "two"), "bigram-lexicon"), saved(entry(lexicon, "one"), "lexicon")  # counted once, then joined
    found = with_before(words).join(small(two), ["before", "word"], "left").join(small(one), "word", "left").withColumn("entry", F.coalesce("two", "one"))
    own = split_ending(F.col("written"))
    e = F.col("entry")
    same = (own["head"] == e["head"]) & (own["tail"] == e["tail"])
    kept = F.when((own["ending"] == "") | (e["ending"] != ""), F.col("written")).otherwise(F.concat(e["head"], e["tail"]))
    ending = F.when(e["ending"] == "", "").when(own["ending"] != "", own["ending"]).otherwise(e["ending"])
    stem = F.concat(e["head"], ending, e["tail"])
    fixed = F.when(e.isNull(), F.col("written")).when(same, kept).when(bare(stem) == bare(F.col("written")), stem).otherwise(F.col("written"))
    return found.select("rid", "pos", "written", "word", fixed.alias("fixed"))


def spans_of(text: Column, pattern: str) -> Column:
    """(s, e) of each match of a pattern in a text."""
    return F.transform(matches_with_offsets(text, pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def letter_words(items: DataFrame) -> DataFrame:
    """(rid, pos, s, e, written, word): Arabic words with their marks, where they stand, and bare of marks; stored."""
    rows = items.select("rid", F.posexplode(matches_with_offsets(F.coalesce("text", F.lit("")), LETTER_WORD)).alias("pos", "x"))
    flat = rows.select("rid", "pos", "x.s", "x.e", F.col("x.w").alias("written"))
    return saved(flat.withColumn("word", bare(F.col("written"))), "letter-words")


def bare_words(text: str) -> list[str]:
    """The words of a text bare of marks. A mark that no letter precedes is in no word, so all can be taken out first."""
    return _LETTER_WORD.findall(_MARKS.sub("", text))


def common_runs(a: list[str], b: list[str], least: int) -> list[tuple[int, int, int]]:
    """(run, start in b, start in a): maximal runs of `least` words, two at least, that follow each other in both, and runs that are the whole of b."""
    if len(b) == 1:
        return [(1, 0, i) for i, w in enumerate(a) if w == b[0]]
    places: dict[tuple[str, str], list[int]] = {}
    for j, pair in enumerate(zip(b, b[1:])):
        places.setdefault(pair, []).append(j)
    enough, out, open_ = min(max(least, 2), len(b)), [], {}
    for i, pair in enumerate([*zip(a, a[1:]), ("", "")]):  # the last pair stands nowhere and ends all runs
        went_on = {j: open_.pop(j - 1, 1) + 1 for j in places.get(pair, ())}
        out += [(run, j + 2 - run, i + 1 - run) for j, run in open_.items() if run >= enough]
        open_ = went_on
    return out


def protected_words(text: str, sources: list[str], least: int, share: float) -> list[tuple[int, int, int, str, str]]:
    """(pos, s, e, written, kept) of one text, its sources in order."""
    words, own = list(_LETTER_WORD.finditer(text)), bare_words(text)
    form: list[str | None] = [None] * len(words)
    runs, forms = [], []
    for k, source in enumerate(sources):
        theirs, plain = _LETTER_WORD.findall(source), bare_words(source)
        marked = list(accumulate((len(w) != len(o) for w, o in zip(theirs, plain)), initial=0))
        forms.append(theirs)
        runs += [(-run, k, start - at, at) for run, start, at in common_runs(own, plain, least) if marked[start + run] - marked[start] >= share * run]
    free = list(range(len(words) + 1))  # the next word that no run holds yet

    def next_free(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    for run, k, diagonal, at in sorted(runs):
        i = next_free(at)
        while i < at - run:
            form[i] = forms[k][i + diagonal]
            free[i] = i = i + 1
            i = i if free[i] == i else next_free(i)
    quotes = [m.span() for m in _QUOTED.finditer(text)]
    begins, out = [s for s, _ in quotes], []
    for i, (word, plain, given) in enumerate(zip(words, own, form)):
        (s, e), w = word.span(), word.group()
        has = e - s != len(plain)
        if has or given is not None or (begins and (q := bisect_right(begins, s)) and e <= quotes[q - 1][1]):
            out.append((i, s, e, w, w if has or given is None else given))
    return out


def protected_spans(texts: DataFrame, sources: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(rid, pos, s, e, written, kept): the words of a text (rid, text) whose vowels are given: marked ones, those inside quotation marks, and those that run as in one of its sources (rid, k, text).

    A run is `least` words that follow each other in both, or a whole source; its words take the source's marks, unless they
    have marks, where that share of them has. All runs count, the longest first where several hold a word, then the first
    source. A text meets its own sources only, so both are dealt out by rid once, and words are cut where they met.
    """
    own = sources.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))  # a text's sources
    met = texts.select("rid", F.coalesce("text", F.lit("")).alias("text")).join(own, "rid", "left").select("rid", "text", F.transform("x", lambda r: r["text"]).alias("sources"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(lo, ROWS_AT_ONCE)
                rows = [protected_words(t, s or [], least, share) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                rid = pc.take(b.column(0), pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64()))
                columns = list(zip(*(w for r in rows for w in r))) or [()] * 5
                yield pa.RecordBatch.from_arrays([rid, *[pa.array(c, kind) for c, kind in zip(columns, [pa.int32()] * 3 + [pa.string()] * 2)]], ["rid", "pos", "s", "e", "written", "kept"])

    return met.mapInArrow(search, f"rid {dict(met.dtypes)['rid']}, pos int, s int, e int, written string, kept string")


def cited_prose(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, text, ids): sentences that carry [id, id]; others are dropped."""
    sentences = texts.select(*key, F.posexplode(F.split("text", "(?<=[.!?])\\s+")).alias("n", "sentence"))
    ids = F.filter(F.transform(F.split(F.array_join(F.regexp_extract_all("sentence", F.lit("\\[([^\\]]*)\\]"), F.lit(1)), ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    bare = collapse_spaces(F.regexp_replace("sentence", "\\s*\\[[^\\]]*\\]", ""))
    return sentences.select(*key, "n", bare.alias("text"), ids.alias("ids")).filter(F.size("ids") > 0)


def resolve_ids(cites: DataFrame, allowed: DataFrame) -> DataFrame:
    """(claim, pos, id): cited ids that are allowed, or that one allowed id alone begins with at ":" or "."."""
    parts = F.split("id", "(?<=[:.])")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == F.size(parts), F.col("id")).otherwise(F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n), ""), "[:.]$", "")))
    prefixes = allowed.select(F.col("id").alias("full"), F.explode(F.array_distinct(cuts)).alias("id"))
    one = prefixes.groupBy("id").agg(F.min("full").alias("full"), F.count("*").alias("n"), F.max(F.col("id") == F.col("full")).alias("whole"))
    usable = one.select("id", F.when(F.col("whole"), F.col("id")).when(F.col("n") == 1, F.col("full")).alias("full")).filter("full IS NOT NULL")
    return cites.join(usable, "id").groupBy("claim", F.col("full").alias("id")).agg(F.min("pos").alias("pos"))


def source_cards(cites: DataFrame, items: DataFrame) -> DataFrame:
    """(claim, cards): distinct cited passages in the order of citation, as "id (source)"."""
    first = cites.groupBy("claim", "id").agg(F.min("pos").alias("pos")).join(items.select("id", "source_id"), "id")
    card = F.concat(F.col("id"), F.lit(" ("), F.col("source_id"), F.lit(")"))
    listed = first.groupBy("claim").agg(F.sort_array(F.collect_list(F.struct("pos", card.alias("card")))).alias("x"))
    return listed.select("claim", F.array_join(F.transform("x", lambda r: r["card"]), "; ").alias("cards"))


def rejection_rollup(verdicts: DataFrame) -> DataFrame:
    """(answer, kept, rejected, broken, reasons) of (answer, pos, reason): reasons as a map of counts; broken if none is kept, the first is lost, or as many go as stay."""
    by_reason = verdicts.filter("reason IS NOT NULL").groupBy("answer", "reason").count().groupBy("answer").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "count")))).alias("reasons"))
    agg = verdicts.groupBy("answer").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.min_by(F.col("reason").isNull(), "pos").alias("first_kept"))
    broken = (F.col("kept") == 0) | ~F.col("first_kept") | (F.col("rejected") >= F.col("kept"))
    return agg.join(by_reason, "answer", "left").select("answer", "kept", "rejected", broken.alias("broken"), F.coalesce("reasons", F.create_map().cast("map<string,bigint>")).alias("reasons"))


def pending(claims: DataFrame, memo: DataFrame, key: list[Column]) -> DataFrame:
    """Claims without an earlier positive verdict on the same content."""
    named = claims.withColumn("content", F.sha2(F.concat_ws("\x1f", *key), 256))
    return named.join(memo.filter("ok").select("content"), "content", "left_anti")
