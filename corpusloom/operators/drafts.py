"""Drafted answers: replies read into claims, and rules on what a sentence may say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tables import saved, small
from corpusloom.functions.text import let, normalize, tokenize
from corpusloom.operators.dictionary import same_word_form, synonym_roots, words_lacking
from corpusloom.operators.evidence import cited_prose

#: What may surround an id, and how much of a section's or a label's name is kept.
ID_EDGES, NAME_LENGTH = " \t\n[](){}<>«»\"'", 60
# Fixed values, in normalised spelling: words that say yes, the words that open a conclusion of one's own (a lead before
# any of the verbs, or alone), demonstratives before a verb, and words that a sentence may not end on.
YES = ["true", "yes", "نعم"]
LEADS = "ما مما وهذا فهذا وذلك فذلك هذا ذلك".split()
INFERRING = "يدل يعني يوكد يبين يثبت يوضح يظهر يفيد يوحي يشير يبرهن".split()
ALONE = "وبالتالي فبالتالي وعليه اذن فاذن فدل".split()
DEMONSTRATIVES = "وهذا فهذا وذلك فذلك هذا ذلك".split()
DANGLING = """
لمن من الذي التي الذين ان انه انها في علي الي عن ل ب ك و ف ثم او لكن بل الا اذا لو كما حتي مع عند هو هي ما لا لم لن
""".split()
LEAST_KEPT = 4
# How sentences begin that conclude, that stop half-way, that hang on the one before; words that say nothing
# by themselves, and those among them that point elsewhere; what likens, labels a case, names no holder of a view, or
# speaks of disagreement.
CONCLUDES = "(?i)^\\s*(?:thus|therefore|hence|consequently)(?:[^\\p{L}\\p{N}_]|$)"
HALVES = "اما واما".split()
LINKS = "(?i)^\\s*(?:كما|وكذلك|كذلك|وأيضًا|وأيضا|أيضًا|أيضا|ثم|وكما|also,?|moreover,?)\\s+"
POINTERS = "ذلك هذا هذه تلك this that".split()
EMPTY = [*POINTERS, *"في من علي الي عن هو هي و ف ثم او the a an of in is it and to".split()]
LIKENS = "(?:يشبه|تشبه|يشابه|تشابه|مثلما|كما لو|تماما مثل)"
EXAMPLE = "مثلا"
LABELS_CASE = "(?i)(?:[،,؛:]\\s*[فو]?(?:هذا|هذه|ذلك|تلك)|[,;:]\\s*(?:so\\s+|and\\s+)?(?:this|that)\\s+is)(?:\\s+\\S+){1,6}\\s*[.!]?\\s*$"
UNNAMED = (
    "(?i)^\\s*(?:(?:بعض|بعضهم|آخرون|اخرون|فريق|طائفة|قوم|غيرهم|some|others|العلماء)(?:[^\\p{L}\\p{N}_]|$)"
    "|(?:ال)?(?:قول|رأي|راي|مذهب|view|opinion)\\s+(?:ال)?(?:اول|أول|ثاني|ثالث|رابع|خامس|first|second|third|fourth))"
)
DISAGREES = "(?i)(?:ا|ي|ت)ختلف\\s+(?:ال)?(?:علماء|فقهاء)|خلاف\\s+بين\\s+(?:ال)?(?:علماء|فقهاء)|(?:^|[^\\p{L}\\p{N}_])scholars\\s+(?:differ|disagree)"
LEAST_SAID = 3
# A quotation of five words or more, and what a notice on a hadith's grade looks for.
COPIED = '«(?:[^»\\s]+\\s+){4,}[^»]*»|"(?:[^"\\s]+\\s+){4,}[^"]*"|“(?:[^”\\s]+\\s+){4,}[^”]*”|﴿(?:[^﴾\\s]+\\s+){4,}[^﴾]*﴾'
COPIED_SHARE = 0.5
WEAK = "ضعيف|منكر|موضوع|شاذ|باطل|معلول"
SAYS_WEAK = "ضعيف|ضعف|اختلف|منكر|موضوع"
SOUND_SOURCES = ["sahih-bukhari", "sahih-muslim"]
# Fixed values, in normalised spelling: what defines, and words that add nothing to a definition.
COPULAS = "هو هي هم هما".split()
DEFINES = "يقصد المقصود المراد معني تعريف ويقصد والمقصود والمراد ومعني وتعريف".split()
FILLER = """
عليه عليها عليهم فيه فيها فيهم منه منها لها له لهم به بها بهم اليه اليها
وهو وهي وهم اي يعني ايضا التي الذي الذين اللاتي شيء امر الامور كلها جميع بعض
""".split()
SUBJECT_WORDS, DEFINING_WORDS, DEFINING_SHARE = 4, 2, 0.75


# --- replies ---------------------------------------------------------------------------------------


def first_object(text: Column) -> Column:
    """The first complete {...} of a text, strings in it read as such; null without one.

    The text is cut into strings, braces and what lies between, so that few pieces are walked through.
    """
    rest = F.substr(text, F.instr(text, "{"), F.char_length(text))
    pieces = F.regexp_extract_all(rest, F.lit('(?s)"(?:[^"\\\\]|\\\\.)*(?:"|$)|[{}]|[^"{}]+'), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        n = F.when(acc["closed"], acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(depth.alias("depth"), n.alias("n"), (acc["closed"] | (depth == 0)).alias("closed"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("closed"))
    whole = lambda p: let(F.aggregate(p, start, step), lambda a: F.when(a["closed"], F.array_join(F.slice(p, F.lit(1), a["n"]), "")))
    return F.when(F.contains(text, F.lit("{")), let(pieces, whole))


def load_reply(raw: Column) -> Column:
    """A model's reply as a variant: what is between think marks and fences taken off, the whole of it or its first complete object; null where there is no JSON."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "(?s)<think>.*?</think>", ""))
    fenced = F.regexp_replace(F.trim(F.trim(text, F.lit("`"))), "^(?i)json", "")
    text = F.when(F.startswith(text, F.lit("```")), fenced).otherwise(text)
    return let(text, lambda t: F.coalesce(F.when(F.trim(t) != "", F.try_parse_json(t)), F.try_parse_json(first_object(t))))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN or another type's name of a variant; null where it is missing or null."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name != "VOID", name)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _text(value: Column, name: str) -> Column:
    """A field's string, trimmed; null for another type."""
    return F.when(_kind(_field(value, name)) == "STRING", F.trim(F.try_variant_get(value, f"$.{name}", "string"), F.lit(" \t\n\r")))


def _ids(value: Column) -> Column:
    """The ids of a field passage_ids, without what surrounds them; empty unless it is a string or a list of strings."""
    found, kind = _field(value, "passage_ids"), _kind(_field(value, "passage_ids"))
    many = F.try_variant_get(value, "$.passage_ids", "array<variant>")
    strings = F.when(F.forall(many, lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False))), F.transform(many, lambda x: F.try_variant_get(x, "$", "string")))
    ids = F.when(kind == "STRING", F.array(F.try_variant_get(found, "$", "string"))).when(kind == "ARRAY", strings)
    return F.coalesce(F.filter(F.transform(ids, lambda x: F.trim(x, F.lit(ID_EDGES))), lambda x: x != ""), F.array().cast("array<string>"))


def parse_drafts(replies: DataFrame) -> DataFrame:
    """(key, n, text, ids, school, section, label) of replies (key, raw): the claims and then the views of each, in order.

    A reply that abstains, is JSON of another kind, or whose claims or views are no list gives nothing; a malformed item is
    passed over by itself. A claim may come without ids, a view may not. A reply without JSON is read as prose whose
    sentences carry their ids.
    """
    read = saved(replies.select("key", "raw", load_reply(F.col("raw")).alias("v")), "replies")
    v = F.col("v")
    abstains = F.coalesce(F.lower(F.trim(F.try_variant_get(v, "$.abstain", "string"))).isin(YES) & _kind(_field(v, "abstain")).isin("STRING", "BOOLEAN"), F.lit(False))
    no_list = lambda name: F.coalesce(_kind(_field(v, name)) != "ARRAY", F.lit(False))
    usable = read.filter((_kind(v) == "OBJECT") & ~abstains & ~no_list("claims") & ~no_list("views"))

    def items(name: str, part: int) -> DataFrame:
        rows = usable.select("key", F.posexplode(F.try_variant_get(v, f"$.{name}", "array<variant>")).alias("i", "x")).filter(_kind(F.col("x")) == "OBJECT")
        x = F.col("x")
        name_ = lambda n: F.substring(F.coalesce(_text(x, n), F.lit("")), 1, NAME_LENGTH)
        fields = rows.select("key", F.lit(part).alias("part"), "i", _text(x, "text").alias("text"), _ids(x).alias("ids"), _text(x, "school").alias("school"), name_("section").alias("section"), name_("label").alias("label"))
        fields = fields.filter("text <> ''")
        if part:
            return fields.filter("school <> '' AND size(ids) > 0").withColumn("section", F.lit("")).withColumn("label", F.lit(""))
        return fields.withColumn("school", F.lit(""))

    bare = F.regexp_replace(F.coalesce("raw", F.lit("")), "(?s)<think>.*?</think>", "")
    prose = cited_prose(read.filter("v IS NULL").select("key", F.trim(bare).alias("text")), ["key"]).filter(F.char_length("text") > 3)
    prose = prose.select("key", F.lit(0).alias("part"), F.col("n").alias("i"), "text", F.array_distinct("ids").alias("ids"), *[F.lit("").alias(c) for c in ("school", "section", "label")])
    every = items("claims", 0).unionByName(items("views", 1)).unionByName(prose)
    numbered = every.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "i", "text", "ids", "school", "section", "label"))).alias("x"))  # a reply's few claims
    return numbered.select("key", F.posexplode("x").alias("n", "c")).select("key", "n", "c.text", "c.ids", "c.school", "c.section", "c.label")


def check_reply_shape(replies: DataFrame) -> DataFrame:
    """(key, reason, problem, evidence, missing, on_topic) of replies (key, raw, count) to a question about `count` sentences: reason is null where the reply can be used.

    It needs one verdict and one witness a sentence, strings or nulls. A list of missing terms may be a string, or be left
    out as a whole, and so may on_topic, whose entries may be words that say yes.
    """
    v = F.col("v")
    rows = replies.select("key", "count", load_reply(F.col("raw")).alias("v"))
    many = lambda name: F.try_variant_get(v, f"$.{name}", "array<variant>")
    kind = lambda name: _kind(_field(v, name))
    sized = lambda name: F.coalesce((kind(name) == "ARRAY") & (F.size(many(name)) == F.col("count")), F.lit(False))
    strings = lambda name: F.forall(many(name), lambda x: F.coalesce(_kind(x), F.lit("STRING")) == "STRING")
    reason = F.when(F.coalesce(_kind(v), F.lit("")) != "OBJECT", "not an object")
    for name in ("problem", "evidence"):
        reason = reason.when(~sized(name), f"{name} missing or of another length").when(~strings(name), f"{name} of the wrong type")
    given = lambda name: _field(v, name).isNotNull()
    for name in ("missing", "on_topic"):
        reason = reason.when(given(name) & ~sized(name), f"{name} of another length")
    text = lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
    plain = lambda name: F.transform(many(name), lambda x: F.coalesce(text(x), F.lit("")))
    listed = lambda x: F.filter(F.transform(F.try_variant_get(x, "$", "array<variant>"), text), lambda t: t.isNotNull())
    none = F.array().cast("array<string>")
    missing = F.transform(many("missing"), lambda x: F.when(_kind(x) == "STRING", F.array(text(x))).otherwise(F.coalesce(listed(x), none)))
    yes = F.transform(many("on_topic"), lambda x: F.coalesce(F.lower(F.trim(F.try_variant_get(x, "$", "string"))).isin([*YES, "1"]), F.lit(False)))
    marked = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return marked.select(
        "key",
        "reason",
        F.when(ok, plain("problem")).alias("problem"),
        F.when(ok, plain("evidence")).alias("evidence"),
        F.when(ok, F.when(given("missing"), missing).otherwise(F.array_repeat(none, F.col("count").cast("int")))).alias("missing"),
        F.when(ok, F.when(given("on_topic"), yes).otherwise(F.array_repeat(F.lit(True), F.col("count").cast("int")))).alias("on_topic"),
    )


# --- sentences -------------------------------------------------------------------------------------


def cut_inference(text: Column) -> Column:
    """A sentence up to where it begins a conclusion of its own, LEAST_KEPT words in at least; as it is where it begins none, or where the part before would end inside a quotation or on a word that needs another."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")

    def cut(pair: Column) -> Column:
        raw, plain = pair["raw"], pair["plain"]
        n = F.size(raw)

        def begins(k: Column) -> Column:
            one, two = F.get(plain, k), F.coalesce(F.get(plain, k + 1), F.lit(""))
            verb = one.isin(DEMONSTRATIVES) & (F.char_length(two) >= 4) & F.substring(two, 1, 1).isin("ي", "ت")
            return one.isin(ALONE) | (one.isin(LEADS) & two.isin(INFERRING)) | ((one == "ومن") & (two == "ثم")) | verb

        head = lambda k: F.rtrim(F.array_join(F.slice(raw, F.lit(1), k), " "), F.lit(" ،,؛:"))
        count = lambda t, c: F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))
        whole = lambda t: (count(t, "«") == count(t, "»")) & ~normalize(F.element_at(F.split(t, " "), -1)).isin(DANGLING)
        places = F.when(n > LEAST_KEPT, F.sequence(F.lit(LEAST_KEPT), n - 1)).otherwise(F.array().cast("array<int>"))
        at = F.filter(places, lambda k: begins(k) & whole(head(k)))
        return F.when(F.size(at) > 0, F.concat(head(F.get(at, F.lit(0))), F.lit("."))).otherwise(text)

    return let(F.struct(words.alias("raw"), F.transform(words, normalize).alias("plain")), cut)


def sentence_flags(text: Column, school: Column | None = None) -> Column:
    """What may be wrong with a sentence, as a struct of booleans: concludes (opens with a conclusion of its own), unfinished (stops half-way), says_little (points at what it doesn't say), likens (an example that likens), links (hangs on the sentence before), labels_case (an example that ends by naming what it is), disagrees (speaks of disagreement), and unnamed, whether the view it is given under names no one."""
    said = F.coalesce(text, F.lit(""))

    def flags(w: Column) -> Column:
        one, two = F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
        concludes = one.isin(ALONE) | (one.isin([x for x in LEADS if x not in ("ما", "مما")]) & two.isin(INFERRING)) | ((one == "ومن") & (two == "ثم")) | said.rlike(CONCLUDES)
        half = one.isin(HALVES) & ~F.exists(F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1))), lambda x: F.startswith(x, F.lit("ف")) & (F.char_length(x) > 2))
        points = (F.size(w) > 0) & F.coalesce(F.try_element_at(w, F.lit(-1)).isin(POINTERS), F.lit(False))
        little = (F.size(F.filter(w, lambda x: ~x.isin(EMPTY))) < LEAST_SAID) & points
        plain = F.array_join(w, " ")
        return F.struct(
            concludes.alias("concludes"),
            half.alias("unfinished"),
            (little | half).alias("says_little"),
            (F.startswith(plain, F.lit(EXAMPLE)) & plain.rlike(LIKENS)).alias("likens"),
            said.rlike(LINKS).alias("links"),
            said.rlike(LABELS_CASE).alias("labels_case"),
            said.rlike(DISAGREES).alias("disagrees"),
            F.coalesce(school, F.lit("")).rlike(UNNAMED).alias("unnamed") if school is not None else F.lit(False).alias("unnamed"),
        )

    return let(F.filter(F.split(normalize(said), " "), lambda x: x != ""), flags)


def copied_share(claims: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """(claim, share, copies): the words of a claim's long quotations over all its words, and whether these are more than half; quotations whose words stand in a text approved for it (claim, text) don't count."""
    quotes = claims.select("claim", F.explode(F.regexp_extract_all("text", F.lit(COPIED), F.lit(0))).alias("quote"))
    quotes = quotes.select("claim", "quote", F.size(F.split(F.trim("quote"), "\\s+")).alias("n"))
    if approved is not None:
        texts = approved.select("claim", normalize(F.col("text")).alias("body"))
        said = quotes.withColumn("said", normalize(F.col("quote")))
        held = said.join(texts, "claim").filter((F.col("said") != "") & F.contains("body", F.col("said"))).select("claim", "quote").distinct()
        quotes = quotes.join(held, ["claim", "quote"], "left_anti")
    copied = quotes.groupBy("claim").agg(F.sum("n").alias("n"))
    total = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != ""))
    joined = claims.select("claim", F.greatest(F.lit(1), total).alias("total")).join(copied, "claim", "left")
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    return joined.select("claim", F.round(share, 6).alias("share"), (share > COPIED_SHARE).alias("copies"))


def graded_notice(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim, notice) of claims (claim, text): "weak" where every grader of a cited passage (claim, kind, source_id, grade) calls it so, else "mixed" where some do, null where none does or the claim itself says it.

    Graders stand in the grade between ؛; passages of other kinds than hadith, of the sound books or without a grade say nothing.
    """
    graded = cited.filter((F.col("kind") == "hadith") & ~F.col("source_id").isin(SOUND_SOURCES) & (F.coalesce("grade", F.lit("")) != ""))
    parts = F.transform(F.split("grade", "؛"), lambda p: p.rlike(WEAK))
    marked = graded.select("claim", F.forall(parts, lambda w: w).alias("all"), F.exists(parts, lambda w: w).alias("any"))
    rolled = marked.groupBy("claim").agg(F.bool_or("all").alias("weak"), F.bool_or("any").alias("mixed"))
    notice = F.when(F.coalesce("text", F.lit("")).rlike(SAYS_WEAK), None).when(F.col("weak"), "weak").when(F.col("mixed"), "mixed")
    return claims.select("claim", "text").join(rolled, "claim", "left").select("claim", notice.alias("notice"))


def invented_definition(claims: DataFrame, cited: DataFrame, lemmas: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """(claim, missing): the defining words of a claim (claim, text) that none of its passages (claim, text) holds in any form or as a synonym, where these are more than a quarter of them.

    Looked at are clauses that define: "X is ..." with a subject of SUBJECT_WORDS words at most, or a word for meaning and
    one defined word, with DEFINING_WORDS words or more that aren't forms of the subject. With questions (claim, text), only
    definitions of what the question is about count. lemmas: (synset, lemma).
    """
    clause = F.get(F.split(F.coalesce("text", F.lit("")), "[،,.؛:؟?!]", 2), F.lit(0))
    words = F.filter(F.split(normalize(clause), " "), lambda w: w != "")
    rows = claims.select("claim", words.alias("w")).withColumn("at", F.array_min(F.transform("w", lambda w, i: F.when(w.isin(COPULAS), i))))
    defines = F.get("w", F.lit(0)).isin(DEFINES)
    n = F.size("w")
    split = rows.filter((n > 0) & (defines | F.col("at").between(1, SUBJECT_WORDS))).select(
        "claim",
        F.when(defines, F.slice("w", F.lit(2), F.lit(1))).otherwise(F.slice("w", F.lit(1), F.greatest(F.col("at"), F.lit(1)))).alias("subject"),
        F.when(defines, F.slice("w", F.lit(3), n)).otherwise(F.slice("w", F.coalesce("at", F.lit(0)) + 2, n)).alias("defining"),
    )
    tokens = lambda c: tokenize(F.array_join(c, " "))
    content = F.filter(tokens("defining"), lambda t: ~t.isin(FILLER))
    split = split.select("claim", tokens("subject").alias("subject"), F.explode(F.array(content)).alias("words"))  # exploded, so that the filter takes it as it is
    split = saved(split.filter(F.size("words") >= DEFINING_WORDS), "definitions")
    if questions is not None:
        asked = questions.select(F.col("claim").alias("key"), F.explode(tokenize(F.col("text"))).alias("token"))
        subject = split.select(F.col("claim").alias("key"), F.explode("subject").alias("token"))
        about = same_word_form(asked, subject, lemmas).filter("found").select(F.col("key").alias("claim")).distinct()
        split = saved(split.join(about, "claim", "left_semi"), "definitions")
    if lemmas is None:
        split = split.withColumn("also", F.lit(None).cast("map<string,array<string>>"))
    else:
        each = split.select("claim", F.explode(F.array_distinct("words")).alias("word")).distinct()
        other = each.join(small(saved(synonym_roots(lemmas, each.select("word")), "synonym-roots")), "word")
        split = split.join(other.groupBy("claim").agg(F.map_from_entries(F.collect_list(F.struct("word", "roots"))).alias("also")), "claim", "left")
    met = split.join(cited.select("claim", "text"), "claim", "left").withColumn("held", tokenize(F.col("text")))
    judged = words_lacking(met).groupBy("claim", "words").agg(F.collect_list("lacking").alias("x"))  # a claim's few passages
    lacking = judged.select("claim", "words", F.aggregate("x", F.get("x", F.lit(0)), F.array_intersect).alias("lacking"))
    n = F.size("words")
    bad = lacking.filter((n >= DEFINING_WORDS) & (n - F.size("lacking") < DEFINING_SHARE * n))
    return bad.select("claim", F.transform("lacking", lambda k: F.get("words", k)).alias("missing"))


def product_filter(claims: DataFrame, cited: DataFrame, products: DataFrame, questions: DataFrame) -> DataFrame:
    """The claims (claim, question) whose cited passages (claim, text) speak of the product that their question (question, text) names: products are (pattern, words), any of the words in a passage counts. Claims of questions that name none stay."""
    rules = small(products.select("pattern", "words").distinct())
    named = questions.join(rules, F.expr("text RLIKE pattern")).select("question", "words")
    asked = claims.select("claim", "question").join(small(saved(named, "named-products")), "question")
    spoken = asked.join(cited.select("claim", tokenize(F.col("text")).alias("t")), "claim").filter(F.arrays_overlap("t", "words")).select("claim").distinct()
    silent = asked.select("claim").distinct().join(spoken, "claim", "left_anti")
    return claims.join(silent, "claim", "left_anti")
