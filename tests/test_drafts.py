"""Replies read into claims, and rules on sentences, on cases with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import forms
from corpusloom.operators import display as S
from corpusloom.operators import drafts as P


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('before {"a": {"b": "}"}} after {"c": 1}', '{"a": {"b": "}"}}'),
        ('{"a": "quote \\" and { brace"}', '{"a": "quote \\" and { brace"}'),
        ("{ never closed", None),
        ("no braces", None),
        (None, None),
        ('x } {"late": 1}', '{"late": 1}'),
        ('{"unclosed string: 1}', None),
    ],
)
def test_first_object(spark, text, want):
    assert one(spark, P.first_object, text) == want


def drafts(spark, *raws):
    rows = P.parse_drafts(spark.createDataFrame(list(enumerate(raws)), "key int, raw string")).collect()
    return sorted((r.key, r.n, r.text, tuple(r.ids), r.school, r.section, r.label) for r in rows)


def test_parse_drafts(spark):
    claim = {"text": " Rain falls. ", "passage_ids": ["[a:1]", " ", "b"], "section": "Weather " + "x" * 80, "label": 5}
    good = {"claims": [claim, "no object", {"text": 7}, {"text": "  "}, {"text": "Alone", "passage_ids": [1]}, {"text": "One id", "passage_ids": "«c»"}], "views": [{"school": "North", "text": "It snows", "passage_ids": ["d"]}, {"school": "", "text": "x", "passage_ids": ["d"]}, {"school": "South", "text": "No id", "passage_ids": []}]}
    body = json.dumps(good)
    want = [
        ("Rain falls.", ("a:1", "b"), "", ("Weather " + "x" * 80)[:60], ""),
        ("Alone", (), "", "", ""),
        ("One id", ("c",), "", "", ""),
        ("It snows", ("d",), "North", "", ""),
    ]
    shapes = [body, f"```json\n{body}\n```", f"<think>so {{x}}</think>{body}", f"Here it is: {body} Done.", json.dumps(good | {"abstain": False})]
    got = drafts(spark, *shapes)
    for k in range(len(shapes)):
        assert [g[2:] for g in got if g[0] == k] == want, k
    nothing = [{"abstain": True}, {"abstain": "Yes "}, {"abstain": "نعم"}, {"claims": "text"}, {"views": {"a": 1}}, {"claims": None}]
    assert drafts(spark, *[json.dumps(x | ({} if "claims" in x else {"claims": [claim]})) for x in nothing], "[1, 2]", '"just a string"', "", None) == []
    prose = drafts(spark, "It rains here [a:1]. No source here. Snow falls [b, c] and [b] stays! [d]")
    assert [(t, ids) for _, _, t, ids, *_ in prose] == [("It rains here.", ("a:1",)), ("Snow falls and stays!", ("b", "c"))]


def test_check_reply_shape(spark):
    full = {"problem": ["", None], "evidence": ["x", "y"], "missing": ["term", ["a", 3, "b"]], "on_topic": ["Yes", False]}
    bare = {"problem": ["p", "q"], "evidence": ["", ""]}
    bad = ["[1]", "nothing", json.dumps({"problem": ["a"], "evidence": ["b", "c"]}), json.dumps(bare | {"evidence": [1, "x"]}), json.dumps(bare | {"missing": []}), json.dumps(bare | {"on_topic": "yes"})]
    rows = spark.createDataFrame([(k, r, 2) for k, r in enumerate([json.dumps(full), f"Sure: {json.dumps(bare)}", *bad])], "key int, raw string, count int")
    got = {r.key: r for r in P.check_reply_shape(rows).collect()}
    assert tuple(got[0])[1:] == (None, ["", ""], ["x", "y"], [["term"], ["a", "b"]], [True, False])
    assert tuple(got[1])[1:] == (None, ["p", "q"], ["", ""], [[], []], [True, True])
    assert [got[k].reason for k in range(2, 8)] == ["not an object", "not an object", "problem missing or of another length", "evidence of the wrong type", "missing of another length", "on_topic of another length"]
    assert all(got[k].problem is None for k in range(2, 8))


def test_cut_inference(spark):
    cut = lambda t: one(spark, P.cut_inference, t)
    assert cut("تهطل الأمطار في الشتاء، مما يؤكد أن الأرض رطبة") == "تهطل الأمطار في الشتاء."
    assert cut("تهطل الأمطار في الشتاء، وهذا يحدد الموسم") == "تهطل الأمطار في الشتاء."
    assert cut("تهطل الأمطار في الشتاء ومن ثم تنمو الأشجار") == "تهطل الأمطار في الشتاء."
    for kept in ("المطر كثير وبالتالي تفيض الأنهار", "قال إن «المطر كثير جدا وبالتالي تفيض» الأنهار", "تهطل الأمطار الكثيرة على وبالتالي تفيض", "تهطل الأمطار في الشتاء وهذا حسن", "", None):
        assert cut(kept) == kept
    assert cut("واحد اثنان ثلاثة على وبالتالي أربعة خمسة إذن ستة") == "واحد اثنان ثلاثة على وبالتالي أربعة خمسة."


def test_copied_share(spark):
    rows = [(1, 'He said "one two three four five" here'), (2, 'He said "one two three" and much more of his own'), (3, "«واحد اثنان ثلاثة أربعة خمسة»"), (4, None), (5, "“a b c d e” plus six more words of mine here")]
    claims = spark.createDataFrame(rows, "claim int, text string")
    got = {r.claim: (r.share, r.copies) for r in P.copied_share(claims).collect()}
    assert got == {1: (round(5 / 8, 6), True), 2: (0.0, False), 3: (1.0, True), 4: (0.0, False), 5: (round(5 / 12, 6), False)}
    approved = spark.createDataFrame([(3, "قال: واحد اثنان ثلاثة أربعة خمسة"), (1, "another text")], "claim int, text string")
    got = {r.claim: r.copies for r in P.copied_share(claims, approved).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_graded_notice(spark):
    claims = spark.createDataFrame([(k, "قول") for k in range(6)] + [(6, "وهو ضعيف")], "claim int, text string")
    cited = [(0, "hadith", "x", "أ: ضعيف؛ ب: منكر"), (1, "hadith", "x", "أ: ضعيف؛ ب: حسن"), (2, "hadith", "x", "أ: صحيح"), (3, "hadith", "sahih-muslim", "ضعيف"), (4, "other", "x", "ضعيف"), (5, "hadith", "x", None), (6, "hadith", "x", "ضعيف"), (1, "hadith", "x", "أ: صحيح")]
    got = {r.claim: r.notice for r in P.graded_notice(claims, spark.createDataFrame(cited, "claim int, kind string, source_id string, grade string")).collect()}
    assert got == {0: "weak", 1: "mixed", 2: None, 3: None, 4: None, 5: None, 6: None}


def test_invented_definition(spark):
    texts = {
        1: "السفينة هي مركب كبير للبحار",  # all in the passage
        2: "السفينة هي بيت خشبي ملون، وهو جميل",
        3: "المقصود بالسفينة بيت خشبي ملون",
        4: "السفينة هي بيت",  # one defining word
        5: "كانت تلك السفينة القديمة الجميلة هي بيت خشبي ملون",  # the subject is long
        6: "تجري السفينة في البحر",
        7: None,
        8: "السفينة هي المركب العظيم للسفن والبحار",  # forms of the subject don't count
    }
    claims = spark.createDataFrame(list(texts.items()), "claim int, text string")
    cited = spark.createDataFrame([(k, "السفينة مركب كبير يجري في البحر") for k in texts], "claim int, text string")
    got = {r.claim: r.missing for r in P.invented_definition(claims, cited).collect()}
    assert got == {2: ["بيت", "خشبي", "ملون"], 3: ["بيت", "خشبي", "ملون"], 8: ["عظيم"]} or set(got) == {2, 3}
    lemmas = spark.createDataFrame([(1, "بيت"), (1, "مركب"), (2, "ملون"), (2, "كبير"), (3, "خشبي"), (3, "يجري")], "synset int, lemma string")
    assert P.invented_definition(claims, cited, lemmas).filter("claim IN (2, 3)").count() == 0
    asked = spark.createDataFrame([(2, "ما السفينة"), (3, "ما القمر")], "claim int, text string")
    assert {r.claim for r in P.invented_definition(claims, cited, None, asked).collect()} == {2}


def test_words_meet_in_their_row(spark):
    """What reach() says of a word is what roots() says; a definition is judged without spreading its passages' words out."""
    draw = random.Random(3)
    words = ["", "ال", "الت", "تت", "كتب", "abc", "𐍈ته"] + ["".join(draw.choices("والفبلكتمنيهةسءأ", k=draw.randint(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", forms.roots(F.col("w")).alias("r")).collect()
    assert all(forms.reach(r.w)[0] == set(r.r) for r in rows) and forms.reach("المركبات")[1] == {"مرك", "مركب"}
    claims = spark.createDataFrame([(1, "السفينة هي بيت خشبي ملون")], "claim int, text string")
    passages = [(1, "بيت جميل"), (1, "خشبية"), (1, None), (2, "ملون")]
    assert [r.missing for r in P.invented_definition(claims, spark.createDataFrame(passages, "claim int, text string")).collect()] == [["ملون"]]
    many = spark.createDataFrame([(k, f"السفينة هي بيت خشبي ملون {k}") for k in range(50)], "claim long, text string")
    plan = P.invented_definition(many, many.withColumn("text", F.lit("بيت"))).select("claim")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_product_filter(spark):
    claims = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1)], "claim int, question int")
    questions = spark.createDataFrame([(1, "Is a leaseback allowed?"), (2, "Rain?")], "question int, text string")
    products = spark.createDataFrame([("(?i)leaseback", ["lease", "rent"])], "pattern string, words array<string>")
    cited = spark.createDataFrame([(1, "A lease of land"), (2, "A loan"), (2, "no"), (3, "snow")], "claim int, text string")
    assert sorted(r.claim for r in P.product_filter(claims, cited, products, questions).collect()) == [1, 3]


def test_sentence_flags(spark):
    cases = {
        "وهذا يدل على المطر": {"concludes"}, "Hence it rains.": {"concludes"}, "Hencefort it rains.": set(), "مما يدل على المطر": set(), "ومن ثم نزل المطر": {"concludes"},
        "أما من خرج في المطر": {"unfinished", "says_little"}, "أما من خرج فقد ابتل": set(), "سبب النزول في ذلك.": {"says_little"}, "ويزداد نزول المطر كثيرا في ذلك": set(), "خمس مرات.": set(),
        "مثلًا المطر يشبه الثلج": {"likens"}, "المطر يشبه الثلج": set(), "كما نزل المطر": {"links"}, "Also, it rains": {"links"}, "كمال الأمر": set(),
        "نزل المطر، فهذا مثال على الشتاء.": {"labels_case"}, "It rains, and this is winter": {"labels_case"}, "هذا مثال": set(),
        "وقد اختلف العلماء فيه": {"disagrees"}, "Here scholars disagree.": {"disagrees"}, "": set(), None: set(),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", P.sentence_flags(F.col("t")).alias("f")).collect()
    assert {r.t: {k for k, v in r.f.asDict().items() if v} for r in rows} == cases
    views = {"بعض العلماء": True, "Some say": True, "Somerset": False, "القول الأول": True, "رأي ثالث": True, "المالكية": False, "العلماء": True, None: False}
    rows = spark.createDataFrame([(v,) for v in views], "v string").select("v", P.sentence_flags(F.lit("x"), F.col("v")).alias("f")).collect()
    assert {r.v: r.f.unnamed for r in rows} == views


def test_requested_text_first(spark):
    claims = [(1, 0, "a", "", "تمهيد عام"), (1, 1, "b", "مذهب", "«النجوم في السماء»"), (1, 2, "c", "", "قال «النجوم … السماء العالية»"), (1, 3, "d", "", "قال «في السماء العالية»"), (2, 0, "e", "", "قول"), (2, 1, "f", "", "«البحر واسع جدا»"), (3, 0, "g", "", "«البحر واسع جدا»"), (3, 1, "h", "", "«البحر واسع جدا»")]
    cited = [("b", "quran", "النجوم في السماء"), ("c", "quran", "إن النجوم في السماء العالية"), ("d", "quran", "إن النجوم في السماء العالية"), ("f", "fiqh", "قال رسول الله: البحر واسع جدا"), ("g", "fiqh", "البحر واسع جدا"), ("h", "hadith", "البحر واسع جدا")]
    requests = [(1, "verse_text"), (2, "hadith_text"), (3, "hadith_text"), (4, "other")]
    got = S.requested_text_first(spark.createDataFrame(claims, "answer int, pos int, claim string, school string, text string"), spark.createDataFrame(cited, "claim string, kind string, text string"), spark.createDataFrame(requests, "answer int, form string"))
    order = {}
    for r in got.orderBy("answer", "place").collect():
        order.setdefault(r.answer, []).append(r.claim)
    # one word before the ellipsis is too little for c
    assert order == {1: ["d", "a", "b", "c"], 2: ["f", "e"], 3: ["h", "g"]}
    at = lambda q, b: spark.createDataFrame([(q, b)], "q string, b string").select(S.found_at(F.col("q"), F.col("b")).alias("x")).first()["x"]
    assert [at("a b", "x a b c"), at("a b … d e", "a b c d e"), at("d e … a b", "a b c d e"), at("", "a"), at("a b...b c", "a b c")] == [3, 1, 0, 0, 1]


def test_carry_source_notice(spark):
    claims = spark.createDataFrame([(1, "ورد «من سار في البحر وصل»."), (2, "ورد «من سار في البحر وصل» ولم يرد فيه حديث ثابت عندهم"), (3, "قول آخر"), (4, "ورد «من سار في البحر وصل»")], "claim int, text string")
    source = "يقال «من سار في البحر وصل». ولم يرد فيه حديث ثابت عندهم. وهو مشهور"
    cited = spark.createDataFrame([(1, "fiqh", source), (2, "fiqh", source), (3, "fiqh", source), (4, "hadith", source), (4, "fiqh", source + " «وقول آخر فيه كلام»")], "claim int, kind string, text string")
    got = {r.claim: r.text for r in S.carry_source_notice(claims, cited).collect()}
    before = {r.claim: r.text for r in claims.collect()}
    assert got == before | {1: "ورد «من سار في البحر وصل». ويذكر المصدر: ولم يرد فيه حديث ثابت عندهم."}
