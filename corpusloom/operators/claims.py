"""Claims checked against the passages they cite: nine rules in order, the first that fails being the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tables import saved, small
from corpusloom.functions.text import ARABIC, let, normalize, tokenize
from corpusloom.operators import rulings

# What the rules look for, as written or in normalised spelling.
QUOTATION = "«([^»]+)»|﴿([^﴾]+)﴾"
BOOK_DIVISION = (
    "(?:^| )(?:جملتين|(?:ثلاث|اربع|خمس|ست|سبع|ثماني|ثمان|تسع|عشر) جمل)(?: |$)"
    "|(?:^| )الجمله (?:الاولي|الثانيه|الثالثه|الرابعه|الخامسه|السادسه|الاخيره)(?: |$)"
    "|(?:^| )(?:هذا الباب|هذه الجمله|هذا الفصل)(?: |$)"
)
COLLECTIONS = {"البخاري": "sahih-bukhari", "مسلم": "sahih-muslim"}
NAMES_COLLECTION = "(?:روى|رواه|رواها|أخرج|أخرجه|في صحيح|صحيح)\\s+(?:الإمام\\s+)?(البخاري|مسلم)(?:\\s+و(?:الإمام\\s+)?(البخاري|مسلم))?"
CASES = {"ابي": "ابو", "ابا": "ابو"}
LABEL_FILLER = ["أصحابه", "أصحابهم", "أصحابهما", "غيرهم", "مذهب", "الإمام", "أصحاب"]
TITLES = ["شيخ", "امام", "الشيخ", "الامام"]
#: Aliases that a label of one school may consist of, and the names of which a passage must hold one.
SCHOOLS = [
    ("حنفي حنفيه احناف ابو حنيفه", "حنيفه حنفيه احناف"),
    ("مالك مالكي مالكيه", "مالك مالكيه"),
    ("شافعي شافعيه", "شافعي شافعيه"),
    ("احمد بن حنبل حنبلي حنبليه حنابله", "احمد حنبل حنابله"),
]
REASONS = ["nothing cited", "passage of another answer", "question without its answer", "quotation not in the passages", "school not named", "book's own division", "collection not cited", "ruling not in the passages", "ruling turned around"]


def words(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def names_of(text: Column) -> Column:
    """Content tokens of a text, names in one grammatical case."""
    one = lambda t: F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in CASES.items()], t)
    return F.transform(tokenize(text), one)


def with_forms(tokens: Column) -> Column:
    """Tokens, and those with a joined "and" without it."""
    bare = F.transform(F.filter(tokens, lambda t: F.startswith(t, F.lit("و")) & (F.char_length(t) > 2)), lambda t: F.substring(t, 2, 1_000))
    one = F.transform(bare, lambda t: F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in CASES.items()], t))
    return F.array_distinct(F.concat(tokens, one))


def name_attested(label: Column, held: Column) -> Column:
    """Whether every name of a label is among the tokens `held`, or whether the label is one school's and one of its names is."""
    bare = F.regexp_replace(label, "[(\\[][^)\\]]*[)\\]]", " ")
    filler = F.flatten(F.array(*[tokenize(F.lit(w)) for w in LABEL_FILLER]))

    def decide(have: Column) -> Column:
        named = F.filter(names_of(bare), lambda w: ~F.array_contains(filler, w) & ~F.array_contains(filler, F.substring(w, 2, 1_000)))
        all_there = (F.size(named) > 0) & F.forall(named, lambda w: F.arrays_overlap(with_forms(F.array(w)), have))
        untitled = F.array_except(names_of(label), words("مذهب", *TITLES))
        school = F.lit(False)
        for aliases, names in SCHOOLS:
            own = [a for a in aliases.split() if a not in ("ابو", "بن")]
            school = school | ((F.size(F.array_except(untitled, words(*aliases.split()))) == 0) & F.arrays_overlap(untitled, words(*own)) & F.arrays_overlap(have, words(*names.split())))
        return all_there | ((F.size(untitled) > 0) & school)

    return let(with_forms(held), decide)


def speakers(cites: DataFrame, items: DataFrame, persons: DataFrame) -> DataFrame:
    """(claim, speaker): the one person behind all sources that a claim cites; no row where there are several or one is unknown."""
    known = cites.join(items.select("id", "source_id"), "id").join(small(persons), "source_id", "left")
    found = known.groupBy("claim").agg(F.min("person").alias("speaker"), F.max("person").alias("last"), F.bool_and(F.coalesce(F.col("person"), F.lit("")) != "").alias("all_known"))
    return found.filter("all_known AND speaker = last").select("claim", "speaker")


def names_speaker(label: Column, speaker: Column) -> Column:
    """Whether a label is the speaker's name, titles and a joined "and" aside."""
    core = F.array_except(tokenize(speaker), words(*TITLES))
    bare = F.transform(tokenize(label), lambda t: F.when(F.startswith(t, F.lit("و")) & (F.char_length(t) > 2), F.substring(t, 2, 1_000)).otherwise(t))
    have = F.array_except(bare, words(*TITLES))
    return (F.size(core) > 0) & (F.size(F.array_except(core, have)) == 0) & (F.size(F.array_except(have, core)) == 0)


def quotations(text: Column) -> Column:
    """Quotations of a text that hold Arabic letters, normalised."""
    inner = lambda g: F.regexp_extract_all(text, F.lit(QUOTATION), F.lit(g))
    both = F.filter(F.concat(inner(1), inner(2)), lambda q: q.rlike(ARABIC))
    return F.transform(both, normalize)


def evidence_contiguous(claims: DataFrame, items: DataFrame) -> DataFrame:
    """(claim, held): whether a claim's witness (claim, witness, cited) stands word by word in one of its passages."""
    asked = claims.select("claim", normalize(F.col("witness")).alias("w"), F.explode_outer("cited").alias("id"))
    bodies = items.select("id", normalize(F.col("text")).alias("body"))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    held = (F.col("w") != "") & F.coalesce(F.contains(spaced(F.col("body")), spaced(F.col("w"))), F.lit(False))
    return asked.join(bodies, "id", "left").groupBy("claim").agg(F.bool_or(held).alias("held"))


def verify(claims: DataFrame, items: DataFrame, allowed: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """(claim, reason), reason null where kept.

    claims: (claim, text, cited) and, if present, answer, school, section and label. items: (id, source_id, text)
    and, if present, answer_part. allowed: (answer, id), the passages retrieved for each answer, or (id) for all.
    persons: (source_id, person). A rule is a flag of the claim; claims meet their passages once for all of them.
    """
    spark = claims.sparkSession
    extra = [c for c in ("section", "label", "school") if c in claims.columns]
    own = ["answer"] if "answer" in allowed.columns else []
    school = F.coalesce(F.col("school"), F.lit("")) if "school" in extra else F.lit("")
    shown = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in (*extra, "text")])
    told = F.filter(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(NAMES_COLLECTION), F.lit(g)) for g in (1, 2)])), lambda x: x != "")
    books = F.transform(told, lambda x: F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in COLLECTIONS.items()]))
    claims = claims.select("claim", *own, "text", "cited", school.alias("school"), shown.alias("shown")).withColumn("quotes", quotations(F.col("shown"))).withColumn("books", books)
    claims = saved(claims, "claims")
    cites = claims.select("claim", *own, F.explode("cited").alias("id")).distinct()
    answer = F.col("answer_part") if "answer_part" in items.columns else F.lit(True)
    offered = allowed.select(*own, "id").distinct().withColumn("offered", F.lit(True))
    held = cites.join(offered, [*own, "id"], "left").join(items.select("id", "source_id", answer.alias("answer_part"), "text"), "id", "left")
    held = saved(held, "cited-texts")

    asked = claims.select("claim", "quotes", "school")
    bodies = held.filter("text IS NOT NULL").join(asked, "claim").select("claim", "source_id", "school", "text", normalize(F.col("text")).alias("body"), "quotes")
    found = bodies.select("claim", "source_id", F.filter("quotes", lambda q: (q != "") & F.contains(F.col("body"), q)).alias("found"), F.when(F.col("school") != "", names_of(F.col("text"))).alias("names"))
    texts = found.groupBy("claim").agg(  # a claim's few passages
        F.flatten(F.collect_list("found")).alias("found"), F.collect_set("source_id").alias("sources"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")
    )
    flags = held.groupBy("claim").agg(F.bool_or(F.col("offered").isNull()).alias("outside"), F.bool_or(~F.coalesce("answer_part", F.lit(True))).alias("asks"))
    spoken = speakers(cites, items, persons if persons is not None else spark.createDataFrame([], "source_id string, person string"))
    ruled = rulings.against_passages(claims.select("claim", F.col("shown").alias("text")), held.filter("text IS NOT NULL").select("claim", "text"))

    joined = claims
    for one in (flags, texts, spoken, ruled):
        joined = joined.join(one, "claim", "left")
    none = F.array().cast("array<string>")
    loose = F.size(F.array_except("quotes", F.coalesce("found", none))) > 0
    unnamed = (F.col("school") != "") & ~name_attested(F.col("school"), F.coalesce("names", none)) & ~F.coalesce(names_speaker(F.col("school"), F.col("speaker")), F.lit(False))
    elsewhere = F.size(F.array_except("books", F.coalesce("sources", none))) > 0
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    conditions = [F.coalesce(F.size("cited"), F.lit(0)) <= 0, F.col("outside"), F.col("asks"), loose, unnamed, normalize(F.col("shown")).rlike(BOOK_DIVISION), elsewhere, some("mismatch"), some("flipped")]
    return joined.select("claim", F.coalesce(*[F.when(c, F.lit(r)) for c, r in zip(conditions, REASONS)]).alias("reason"))
