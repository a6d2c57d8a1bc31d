"""Words and phrases counted in a corpus: as asked, joined to other letters, and with a long alif left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tables import saved, small
from corpusloom.functions.text import collapse_spaces, let, normalize

# What may be joined before a word, the pronouns after it, and the marks a written form is compared without.
BEFORE = ["", "و", "ف", "ب", "ل", "ك", "وب", "فب", "ول", "فل", "وك", "فك"]
AFTER = ["", "ه", "ها", "هم", "هما", "هن", "ك", "كم", "كما", "كن", "ي", "نا", "ني"]
SMALL_MARKS = "[\\u064B-\\u0652\\u0670\\u0640]"
AROUND = 4


def written(items: DataFrame) -> DataFrame:
    """(rid, written, plain): the words of each item that normalise to something, as written and normalised; stored."""
    words = F.filter(F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " "), lambda w: normalize(w) != "")
    return saved(items.select("rid", words.alias("written")).withColumn("plain", F.transform("written", normalize)), "written-words")


def places(words: DataFrame) -> DataFrame:
    """(rid, pos, word) of written() rows."""
    return words.select("rid", F.posexplode("plain").alias("pos", "word"))


def snippet(words: Column, pos: Column, n: Column) -> Column:
    """AROUND words either side of n words at pos, with an ellipsis where cut."""
    left, right = F.greatest(pos - AROUND, F.lit(0)), F.least(pos + n + AROUND, F.size(words))
    return F.concat(F.when(left > 0, "… ").otherwise(""), F.array_join(F.slice(words, left + 1, right - left), " "), F.when(right < F.size(words), " …").otherwise(""))


def round_taa(word: Column) -> Column:
    """Whether a word as written ends with taa marbuta, marks aside."""
    return F.endswith(F.regexp_replace(F.coalesce(word, F.lit("")), SMALL_MARKS, ""), F.lit("ة"))


def affixes(spark: SparkSession) -> DataFrame:
    """(b, a): everything that may be joined before and after, some 150 rows."""
    return spark.createDataFrame([(b, a) for b in BEFORE for a in AFTER if b or a], "b string, a string")


def joined_forms(targets: DataFrame, before: bool = True, after: bool = True) -> DataFrame:
    """(word, form): the surface forms of each target (word) with letters joined to it, so that a corpus is matched by an equi-join.

    A word keeps its final letter before a pronoun but for h, which is written t there; the article's first
    letter falls after l.
    """
    pairs = affixes(targets.sparkSession)
    pairs = pairs if before else pairs.filter("b = ''")
    pairs = pairs if after else pairs.filter("a = ''")
    words = targets.select("word").distinct().withColumn("key", F.lit(0))
    every = words.join(F.broadcast(pairs.withColumn("key", F.lit(0))), "key")  # times the affix table, of a fixed size
    long_, ends = F.char_length("word") >= 3, F.endswith("word", F.lit("ه"))
    plain = F.when(long_ & ~((F.col("a") != "") & ends), F.concat("b", "word", "a"))
    taa = F.when(long_ & ends & (F.col("a") != ""), F.concat(F.col("b"), F.expr("left(word, length(word) - 1)"), F.lit("ت"), F.col("a")))
    lam = F.when(F.col("b").isin("ل", "ول", "فل") & (F.col("a") == "") & F.startswith("word", F.lit("ال")), F.concat(F.col("b"), F.lit("ل"), F.expr("substring(word, 3)")))
    forms = every.select("word", F.explode(F.array_compact(F.array(plain, taa, lam))).alias("form"))
    return forms.filter("form <> word").distinct()


def occurrences(targets: DataFrame, items: DataFrame) -> DataFrame:
    """(word, rid, pos, way, written, snippet) for targets (word: normalised, asked: as typed): every place, exact or joined.

    A form written with taa marbuta is no pronoun after a word typed without one, and a word typed with it
    is not the one written with h.
    """
    rows = written(items)
    exact = targets.select("word", "asked", F.col("word").alias("form"), F.lit("exact").alias("way"))
    joined = joined_forms(targets).join(targets.select("word", "asked"), "word").select("word", "asked", "form", F.lit("joined").alias("way"))
    forms = exact.unionByName(joined)
    met = places(rows).withColumnRenamed("word", "form").join(small(forms), "form").join(rows, "rid")
    shown = met.withColumn("at", F.get("written", F.col("pos")))
    right = F.when(F.col("way") == "exact", ~round_taa(F.col("asked")) | round_taa(F.col("at"))).otherwise(~round_taa(F.col("at")) | round_taa(F.col("asked")))
    return shown.filter(right).select("word", "rid", "pos", "way", F.col("at").alias("written"), snippet(F.col("written"), F.col("pos"), F.lit(1)).alias("snippet"))


def phrases(targets: DataFrame, items: DataFrame) -> DataFrame:
    """(phrase, rid, pos, way, snippet) for targets (phrase: normalised, two words or more): exact places, and joined ones.

    Joined means letters before the first word, a pronoun after the last, or both, the words between being
    the same. Phrases are looked up by their two first words.
    """
    rows = written(items)
    asked = targets.select("phrase", F.split("phrase", " ").alias("t")).filter(F.size("t") > 1)
    ends = asked.select("phrase", "t", F.col("t")[0].alias("first"), F.element_at("t", -1).alias("last"))
    heads = joined_forms(ends.select(F.col("first").alias("word")), after=False)
    tails = joined_forms(ends.select(F.col("last").alias("word")), before=False)
    same = lambda c: ends.select(F.col(c).alias("word"), F.col(c).alias("form")).distinct()
    heads, tails = heads.unionByName(same("first")), tails.unionByName(same("last"))
    starts = ends.join(heads.withColumnsRenamed({"word": "first", "form": "head"}), "first")
    met = places(rows).withColumnRenamed("word", "head").join(small(starts.select("phrase", "t", "last", "head")), "head").join(rows, "rid")
    n = F.size("t")
    window = F.slice("plain", F.col("pos") + 1, n)
    inner = lambda c: F.slice(c, F.lit(2), n - 2)
    alike = met.filter((F.size(window) == n) & ((n == 2) | (inner(window) == inner("t")))).withColumn("form", F.element_at(window, -1)).withColumn("exact", window == F.col("t"))
    found = alike.join(small(tails.withColumnRenamed("word", "last")), ["last", "form"])
    return found.select("phrase", "rid", "pos", F.when(F.col("exact"), "exact").otherwise("joined").alias("way"), snippet(F.col("written"), F.col("pos"), n).alias("snippet"))


def alif_variants(targets: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """(word, rid, pos, form): for targets (word) that `found` (word) lacks, words that hold one or two alifs more inside them and nothing else."""
    alif = "ا"
    lost = targets.select("word").distinct().join(found.select("word"), "word", "left_anti")
    key = lambda c: F.replace(c, F.lit(alif), F.lit(""))
    vocabulary = places(written(items)).withColumnRenamed("word", "form")
    met = vocabulary.withColumn("key", key(F.col("form"))).join(small(lost.withColumn("key", key(F.col("word")))), "key")
    more = F.char_length("form") - F.char_length("word")
    # per gap between other letters the form has at least the word's alifs; none is added before the first letter or after the last
    runs = lambda c: F.transform(F.split(F.regexp_replace(c, f"[^{alif}]", "\x01"), "\x01", -1), F.char_length)
    fewer = F.forall(F.zip_with(runs("word"), runs("form"), lambda a, b: b - a), lambda d: d >= 0)
    edges = (F.substring("form", 1, 1) == F.substring("word", 1, 1)) & (F.element_at(runs("form"), -1) == F.element_at(runs("word"), -1))
    return met.filter((more >= 1) & (more <= 2) & fewer & edges).select("word", "rid", "pos", "form")


# How a message asks to count, names the book or a chapter of it, another source, or a root; where it names the
# word (in quotation marks, after "the word", after the verb), where the chapter; and words that are never the word counted.
ASKS_COUNT = "(?i)كم\\s*(?:مر[ةه]|مرات|عدد)|عدد\\s*(?:مرات|ورود|تكرار|ذكر)|كم\\s*(?:وردت?|ذكرت?|تكررت?|جاءت?|جات|جت|اجت|انذكرت?|اتذكرت?)|how\\s+(?:many\\s+times|often)"
IN_BOOK = "(?i)القرآن|القران|المصحف|سور[ةه]\\s|qur'?an|koran"
OTHER_SOURCE = "(?i)حديث|الحديث|البخاري|مسلم|السنة|السنه|تفسير|الطبري|ابن\\s|كتاب|hadith|bukhari|muslim|book"
ROOT_ASKED = "(?i)جذر|مشتقات|مادة|تصاريف|اشتقاق|root|derivatives?"
QUOTED_WORD = "[«\"“'(﴿]([^»\"”')﴾]{2,40})[»\"”')﴾]"
NAMED_WORD = "(?i)(?:كلم[ةه]|لفظ[ةه]?|اسم|word)\\s+([\\u0600-\\u06FF\\u0750-\\u077F ]{2,40}?)(?:\\s+(?:في|ف|بال|من|داخل|in)(?:[^\\p{L}\\p{N}_]|$)|[؟?.،,]|$)"
AFTER_VERB = "(?:وردت?|ذكرت?|تكررت?|جاءت?|جات|جت|اجت|انذكرت?|اتذكرت?|ذكر|ورود|تكرار)\\s+([\\u0600-\\u06FF ]{2,40}?)(?:\\s+(?:في|ف)\\s|\\s*[؟?.،,]|\\s*$)"
IN_CHAPTER = "(?:في|ف)\\s+سور[ةه]\\s+([\\u0600-\\u06FF ]{2,30}?)\\s*(?:[؟?.،,]|$|\\s(?:في|من)\\s)"
NEVER_COUNTED = "كلمه لفظ لفظه اسم الكلمه اللفظ جذر الجذر ماده مشتقات الجلاله word the root".split()
_LETTER = "\\u0621-\\u064A"


def count_request(text: Column) -> Column:
    """(word, scope, root) of a message that asks how often a word stands in the book, null for any other: the word as written, the chapter it is limited to or "", and whether its root or derivatives are asked for.

    A question put in quotation marks as a whole is read without them; letters drawn out, digits, Latin letters and signs
    stuck to the word are typing slips. Without the book's name a word asked for by a noun or a verb counts, unless
    another source is named.
    """
    q = collapse_spaces(text)
    q = F.regexp_replace(q, "^[«\"“']\\s*(.*?)\\s*[»\"”']\\s*([؟?.]?)\\s*$", "$1$2")
    q = F.replace(q, F.lit("\u0640"), F.lit(""))
    slip = "[A-Za-z0-9\\u0660-\\u0669\\u06F0-\\u06F9]+"
    q = F.regexp_replace(q, f"(?<=[{_LETTER}\\u064B-\\u0652]){slip}|{slip}(?=[{_LETTER}])", "")
    q = F.regexp_replace(q, f"(?<=[{_LETTER}])[-_*~^|/\\\\+=#@&%$!]+(?=[{_LETTER}])", "")
    q = collapse_spaces(F.regexp_replace(q, "[-_*~^|/\\\\+=#@&%$!(){}\\[\\]<>]+", " "))
    q = F.regexp_replace(q, "(?<![\\p{L}\\p{N}_])ب(القرآن|القران|المصحف)(?![\\p{L}\\p{N}_])", "في $1")

    def read(q: Column) -> Column:
        about = q.rlike(ASKS_COUNT) & (q.rlike(IN_BOOK) | ((q.rlike(NAMED_WORD) | q.rlike(AFTER_VERB)) & ~q.rlike(OTHER_SOURCE)))
        named = [F.regexp_extract(q, p, 1) for p in (QUOTED_WORD, NAMED_WORD, AFTER_VERB)]
        fit = lambda w: (normalize(w) != "") & (normalize(w) != "القران") & ~w.rlike(ASKS_COUNT)
        word = F.coalesce(*[F.when(fit(w), w) for w in named], F.lit(""))
        word = F.regexp_replace(word, f"(?:^|(?<=\\s))ال\\s+(?=[{_LETTER}])", "ال")
        words = F.filter(F.split(F.trim(word), "\\s+"), lambda w: (normalize(w) != "") & ~normalize(w).isin(NEVER_COUNTED))
        found = F.struct(F.array_join(words, " ").alias("word"), F.trim(F.regexp_extract(q, IN_CHAPTER, 1)).alias("scope"), q.rlike(ROOT_ASKED).alias("root"))
        return F.when(about & (F.size(words) > 0) & F.exists(words, lambda w: w.rlike("[\\u0600-\\u06FF]")), found)

    return let(q, read)
