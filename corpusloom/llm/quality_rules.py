"""Quality rules with adaptive thresholds.

Each rule compares one ratio of a text (symbols, capitals, exclamation marks per character, repeated
lines per line, characters per word) with a threshold that its own language and source set: a KLL
quantile sketch per (lang, source) gives the quartiles, and the fence lies some interquartile
ranges (REACH, by rate) above the upper one (for characters per word, below the lower one too). Ratios are taken as
logarithms with one count per 100 characters added, so that texts without a single symbol still have
a spread. Sketches merge: a (lang, source) of fewer than `least` documents takes the sketch merged
over its language, then the one over everything. The thresholds are joined back to the documents.

DataFrame functions only. Null texts count as empty. Null languages and sources are groups of their
own. Texts of fewer than 10 words, or with more than a fifth of their words in repeated five-word
windows, fail whatever the thresholds say, and only texts of 10 words or more enter the sketches. A
rate on its fence stays. Repeated rows and ids, null ids too, get one result each and each weighs in
the sketches. Only the four named columns are read, so extra columns of any name play no part; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BLANKS, UPPER, let, small, stored

WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: Interquartile ranges between the quartile and the fence: rates that are zero in most texts spread with the texts' lengths alone, so their fences lie nearer.
REACH = {"symbol_rate": 2.0, "upper_rate": 5.0, "bang_rate": 2.0, "dup_line_rate": 4.0, "word_length": 5.0}
#: An interquartile range counts as this much at least (a factor of e ** SPREAD on the ratio).
SPREAD = 0.25
LEAST_DOCS = 50
SKETCH_K = 400
RATES = ("symbol_rate", "upper_rate", "bang_rate", "dup_line_rate", "word_length")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(words: Column) -> Column:
    """How many words lie in five-word windows found twice or more among them."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def twice(t: Column) -> Column:
            alike = lambda k: (F.get(t, k)["h"] == F.get(t, k - 1)["h"]) | (F.get(t, k)["h"] == F.get(t, k + 1)["h"])
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda k: F.coalesce(alike(k), F.lit(False))), lambda k: F.get(t, k)["p"]))

        reach = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), lambda n, k: n + F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)))
        return let(ordered, lambda t: let(twice(t), reach))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    counted = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW, 0).otherwise(counted)


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _text, _words, n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn("_words", F.filter(F.split("_text", "[ \\t-\\r]+"), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    )
    rows = (
        rows.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(without(F.col("_text"), BLANKS)).cast("long"))
        .withColumn("n_symbols", (F.char_length("_text") - F.char_length(without(F.col("_text"), SYMBOLS))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )
    return rows.withColumn("n_repeat_words", repeat_words(F.col("_words")).cast("long"))


def rates(rows: DataFrame) -> DataFrame:
    """base() rows with the logarithms that the thresholds bound."""
    chars = F.col("word_chars")
    share = lambda n, of, add: F.log((n + 1) / (of + add))
    count = lambda chars_: F.char_length("_text") - F.char_length(without(F.col("_text"), chars_))
    return (
        rows.withColumn("symbol_rate", share(F.col("n_symbols"), chars, 100))
        .withColumn("upper_rate", share(count(UPPER), chars, 100))
        .withColumn("bang_rate", share(count("!"), chars, 100))
        .withColumn("dup_line_rate", share(F.col("n_dup_lines"), F.col("n_lines"), 10))
        .withColumn("word_length", F.log((chars + 10) / (F.col("n_words") + 2)))
    )


def thresholds(rows: DataFrame, lang_col: str, source_col: str, reach: dict[str, float] = REACH, least: int = LEAST_DOCS) -> DataFrame:
    """One row per (lang, source): low_<rate> and high_<rate>."""
    sketches = stored(
        rows.filter(F.col("n_words") >= LEAST_WORDS)
        .groupBy(F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
        .agg(F.count("*").alias("_n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATES]),
        "rule-sketches",
    )
    merged = [F.kll_merge_agg_double(r).alias(r) for r in RATES]
    by_lang = sketches.groupBy("_lang").agg(F.sum("_n").alias("_n"), *merged).select("_lang", *[F.col(c).alias(f"l_{c}") for c in ("_n", *RATES)])
    overall = sketches.groupBy(F.lit(0).alias("_one")).agg(*merged).select("_one", *[F.col(r).alias(f"o_{r}") for r in RATES])
    groups = (
        sketches.join(by_lang, sketches["_lang"].eqNullSafe(by_lang["_lang"]))
        .drop(by_lang["_lang"])
        .withColumn("_one", F.lit(0))
        .join(F.broadcast(overall), "_one")  # one row
    )

    def bounds(rate: str) -> list[Column]:
        sketch = F.when(F.col("_n") >= least, F.col(rate)).when(F.col("l__n") >= least, F.col(f"l_{rate}")).otherwise(F.col(f"o_{rate}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        spread = F.greatest(high - low, F.lit(SPREAD))
        return [(low - reach[rate] * spread).alias(f"low_{rate}"), (high + reach[rate] * spread).alias(f"high_{rate}")]

    return groups.select("_lang", "_source", *[b for r in RATES for b in bounds(r)])


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: dict[str, float] = REACH, least: int = LEAST_DOCS) -> DataFrame:
    """One row per row of docs: id, counts, base_failed, kept, and failed_rules (the rates beyond their thresholds)."""
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    rows = rates(base(picked, "_raw"))
    # the texts are read once; sketches and verdicts both come from the stored counts
    rows = stored(rows.select("_id", "_lang", "_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RATES), "rule-counts")
    limits = small(stored(thresholds(rows, "_lang", "_source", reach, least), "rule-thresholds"))
    limits = limits.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = rows.join(limits, rows["_lang"].eqNullSafe(limits["_l"]) & rows["_source"].eqNullSafe(limits["_s"]), "left")
    beyond = [F.when(F.col(r) > F.col(f"high_{r}"), F.lit(r)) for r in RATES] + [F.when(F.col("word_length") < F.col("low_word_length"), F.lit("word_length"))]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = joined.withColumn("base_failed", failed).withColumn("failed_rules", F.array_compact(F.array(*beyond)))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )
