"""What is left of an answer before it is shown: named views, length, ids, credits, repairs, the gate before all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let, normalize

# Sentences a style allows in prose and in lists, and the longest one for children.
CEILINGS = {"kids": (7, 10), "youth": (12, 20), "newcomer": (12, 20), "extended": (18, 28)}
KIDS_LONGEST = 18
BOTH_BOOKS = "^(و?)(?:روى|رواه|أخرج)\\s+(?:الإمام\\s+)?(?:البخاري\\s+و(?:الإمام\\s+)?مسلم|مسلم\\s+والبخاري)\\s+"
AGREED = "$1في الحديث المتفق عليه (رواه البخاري ومسلم) "


def named_views(views: DataFrame, unnamed: str) -> DataFrame:
    """views (answer, pos, school) with a real name (the pattern tells others) that names one view only; none where fewer than two are left."""
    named = views.filter(~F.col("school").rlike(unnamed)).withColumn("key", normalize(F.col("school")))
    once = named.withColumn("same", F.count("*").over(Window.partitionBy("answer", "key"))).filter("same = 1")
    return once.withColumn("left", F.count("*").over(Window.partitionBy("answer"))).filter("left >= 2").drop("key", "same", "left")


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))


def ceilings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, p, i) for s, (p, i) in CEILINGS.items()], "style string, prose int, items int")


def length_ceiling(sentences: DataFrame) -> DataFrame:
    """sentences (answer, pos, text, style, listing) that the style has room for, in their order.

    A list may hold more. In answers for children the longest of the sentences beyond KIDS_LONGEST words go
    first, as many as needed; equal ones in their order.
    """
    sized = sentences.join(F.broadcast(ceilings(sentences.sparkSession)), "style", "left").withColumn("most", F.when(F.col("listing"), F.coalesce("items", F.lit(CEILINGS["youth"][1]))).otherwise(F.coalesce("prose", F.lit(CEILINGS["youth"][0]))))
    answer = Window.partitionBy("answer")
    counted = sized.withColumn("words", words_in(F.col("text"))).withColumn("n", F.count("*").over(answer))
    long_ = (F.col("style") == "kids") & (F.col("words") > KIDS_LONGEST)
    dropped = F.row_number().over(Window.partitionBy("answer", long_).orderBy(F.col("words").desc(), "pos"))
    kept = counted.withColumn("goes", long_ & (dropped <= F.col("n") - F.col("most"))).filter("NOT goes")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("answer").orderBy("pos"))).filter(F.col("place") <= F.col("most")).select("answer", "pos", "text", "style", "listing")


def strip_ids(text: Column, ids: str = "[\\[(]?(?<![\\w:])[a-z]\\d*(?::\\d+(?:\\.\\d+)?){1,5}(?![\\w:])[\\])]?") -> Column:
    """A text without passage ids and brackets that they leave empty."""
    return F.regexp_replace(F.regexp_replace(text, "\\s*" + ids, ""), "\\s*[\\[(]\\s*[\\])]", "")


def missing_cards(cites: DataFrame, cards: DataFrame) -> DataFrame:
    """(answer, id): cited ids (answer, id) that no shown card (answer, id) stands for."""
    return cites.select("answer", "id").distinct().join(cards.select("answer", "id"), ["answer", "id"], "left_anti")


def gate(questions: DataFrame, patterns: DataFrame) -> DataFrame:
    """(qid, class, rule): the first class, by priority, one of whose patterns (class, priority, rule, words) a question's words hold in full; no row where none does.

    words: the normalised words of a pattern, all of which must be in the question.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(F.split(normalize(F.col("text")), " "))).alias("word"))
    needed = patterns.select("class", "priority", "rule", F.explode(F.array_distinct("words")).alias("word"), F.size(F.array_distinct("words")).alias("n"))
    met = asked.join(F.broadcast(needed), "word").groupBy("qid", "class", "priority", "rule", "n").count().filter("count = n")  # patterns are a few dozen
    return met.groupBy("qid").agg(F.min(F.struct("priority", "rule", "class")).alias("x")).select("qid", "x.class", "x.rule")


def agreed_upon(claims: DataFrame, sources: list[str]) -> DataFrame:
    """claims (claim, text, sources) reworded as agreed upon where they cite a passage of each of the two books and name both."""
    both = F.size(F.array_except(F.array(*map(F.lit, sources)), F.col("sources"))) == 0
    return claims.withColumn("text", F.when(both & ~F.contains("text", F.lit("متفق عليه")), F.regexp_replace("text", BOTH_BOOKS, AGREED)).otherwise(F.col("text")))


def merge_repairs(kept: DataFrame, repaired: DataFrame, draft: DataFrame, head: int = 6) -> DataFrame:
    """(answer, pos, text): kept sentences (answer, text) and rewritten ones (answer, was, text) in the order of the draft (answer, pos, text).

    A sentence is placed by its text, else by its first words, else at the end. Equal places keep kept ones first.
    """
    start = lambda c: F.array_join(F.slice(F.split(normalize(F.col(c)), " "), 1, head), " ")
    rows = kept.select("answer", "text", F.col("text").alias("was"), F.lit(0).alias("new")).unionByName(repaired.select("answer", "text", "was", F.lit(1).alias("new")))
    exact = draft.groupBy("answer", F.col("text").alias("was")).agg(F.min("pos").alias("exact"))
    loose = draft.groupBy("answer", start("text").alias("start")).agg(F.min("pos").alias("loose"))
    placed = rows.withColumn("start", start("was")).join(exact, ["answer", "was"], "left").join(loose, ["answer", "start"], "left")
    at = F.coalesce("exact", "loose", F.lit(1 << 30))
    return placed.withColumn("pos", F.row_number().over(Window.partitionBy("answer").orderBy(at, "new", "text")).cast("long")).select("answer", "pos", "text")


# Fixed values, in normalised spelling: what attributes words to the Prophet, how far before them it may stand, kinds whose
# text is never one of a hadith, and a source's own notice that nothing sound is known of a matter.
ATTRIBUTES = "صلي الله عليه وسلم|ﷺ|رسول الله|النبي|عليه الصلاه والسلام"
ATTRIBUTED_WITHIN = 200
NOT_HADITH = ["quran", "gharib", "takhrij"]
NOTICE = "لم\\s+يرد\\s+(?:في\\s+ذلك|فيه)\\s+حديث\\s+ثابت"
NOTICE_KINDS = ["fiqh", "tafsir", "takhrij"]


def found_at(quote: Column, body: Column) -> Column:
    """Where a quotation begins in a normalised text, from 1, or 0; one shortened by an ellipsis is found by its parts, of two words or more, in order."""
    parts = F.filter(F.transform(F.split(quote, "\\s*(?:…|\\.{3,})\\s*"), normalize), lambda p: p != "")

    def step(acc: Column, part: Column) -> Column:
        at = F.when(acc["at"] < 0, F.lit(-1)).otherwise(F.call_function("locate", part, body, acc["at"] + 1))
        at = F.when(at > 0, at).otherwise(-1).cast("int")
        return F.struct(at.alias("at"), F.coalesce(acc["first"], at).alias("first"))

    def place(p: Column) -> Column:
        short = (F.size(p) > 1) & F.exists(p, lambda x: ~F.contains(x, F.lit(" ")))
        found = F.aggregate(p, F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("first")), step)
        return F.when((F.size(p) == 0) | short, 0).otherwise(let(found, lambda f: F.when(f["at"] > 0, f["first"]).otherwise(0)))

    return let(parts, place)


def requested_text_first(claims: DataFrame, cited: DataFrame, requests: DataFrame) -> DataFrame:
    """(answer, claim, place): of each answer's claims (answer, pos, claim, school, text), the first that shows the text asked for moves to the front, others keep their order.

    requests: (answer, form), form verse_text, verse_evidence or hadith_text. cited: (claim, kind, text). A claim shows a verse
    by a quotation that stands in a cited verse, and a hadith by one that stands in a cited hadith, or, of three words or
    more, in another book's text shortly after the Prophet is named. Claims of a school are passed over.
    """
    forms = requests.filter(F.col("form").isin("verse_text", "verse_evidence", "hadith_text")).select("answer", "form")
    asked = claims.filter(F.coalesce("school", F.lit("")) == "").join(forms, "answer")
    inner = lambda g: F.regexp_extract_all("text", F.lit("«([^»]+)»|﴿([^﴾]+)﴾"), F.lit(g))
    quotes = asked.select("claim", "form", F.explode(F.filter(F.concat(inner(1), inner(2)), lambda q: normalize(q) != "")).alias("quote"))
    met = quotes.join(cited.select("claim", "kind", normalize(F.col("text")).alias("body")), "claim").withColumn("at", found_at(F.col("quote"), F.col("body"))).filter("at > 0")
    before = F.substr("body", F.greatest(F.col("at") - ATTRIBUTED_WITHIN, F.lit(1)), F.least(F.col("at") - 1, F.lit(ATTRIBUTED_WITHIN)))
    other = ~F.col("kind").isin(NOT_HADITH) & (F.size(F.split(normalize(F.col("quote")), " ")) >= 3) & before.rlike(ATTRIBUTES)
    shows = F.when(F.col("form") == "hadith_text", (F.col("kind") == "hadith") | other).otherwise(F.col("kind") == "quran")
    shown = met.filter(shows).select("claim").distinct().withColumn("shows", F.lit(True))
    marked = claims.join(shown, "claim", "left")
    first = marked.filter("shows").groupBy("answer").agg(F.min_by("claim", "pos").alias("lead"))
    order = Window.partitionBy("answer").orderBy((F.coalesce(F.col("claim") == F.col("lead"), F.lit(False))).desc(), "pos")
    return marked.join(first, "answer", "left").select("answer", "claim", F.row_number().over(order).cast("long").alias("place"))


def carry_source_notice(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim, text): claims (claim, text), with a cited source's own notice that nothing sound is known, where the claim quotes the only quotation of that source (claim, kind, text), of four words or more, and doesn't say so already."""
    quotes = F.regexp_extract_all("text", F.lit("«([^»]+)»"), F.lit(1))
    notices = F.filter(F.transform(F.split("text", "[.\\n؟]"), lambda x: F.trim(x)), lambda x: x.rlike(NOTICE))
    sources = cited.filter(F.col("kind").isin(NOTICE_KINDS)).select("claim", quotes.alias("q"), notices.alias("n"))
    sources = sources.filter((F.size("q") == 1) & (F.size("n") > 0)).filter(F.size(F.split(F.trim(F.col("q")[0]), "\\s+")) >= 4)
    held = sources.join(claims.select("claim", normalize(F.col("text")).alias("said")), "claim").filter(F.contains("said", normalize(F.col("q")[0])))
    new = held.select("claim", F.explode(F.filter("n", lambda x: ~F.contains(F.col("said"), normalize(x)))).alias("notice"))
    listed = new.groupBy("claim").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    added = F.aggregate("notices", F.col("text"), lambda t, x: F.concat(F.rtrim(t, F.lit(" .")), F.lit(". ويذكر المصدر: "), x, F.lit(".")))
    return claims.join(listed, "claim", "left").select("claim", F.when(F.col("notices").isNull(), F.col("text")).otherwise(added).alias("text"))
