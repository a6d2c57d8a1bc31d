"""Column rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "written, plain",
    [("سَفِينَةٌ", "سفينه"), ("ٱستأجر إبلًا وآنية", "استاجر ابلا وانيه"), ("شاطئ البحر، رؤية", "شاطي البحر رويه"), ("طويـــل؛ (جدا)", "طويل جدا"), (None, ""), ("Zig-zag_3  OK", "zig zag_3 ok")],
)
def test_normalize(spark, written, plain):
    assert one(spark, T.normalize(F.lit(written).cast("string"))) == plain


@pytest.mark.parametrize("written, tokens", [("هذه الستارة للنافذة", ["ستاره", "نافذه"]), ("كالجبال ثم بالرمل", ["جبال", "رمل"]), ("لل ال", ["لل", "ال"]), ("Who did it: a fox", ["fox"]), ("", [])])
def test_tokenize(spark, written, tokens):
    assert one(spark, T.tokenize(F.lit(written))) == tokens


def test_words_with_offsets(spark):
    got = one(spark, T.words_with_offsets(F.lit("قَالَ  — الله. x")))
    assert [(w.w, w.s, w.e) for w in got] == [("قال", 0, 5), ("الله", 9, 14), ("x", 15, 16)]
    assert one(spark, T.words_with_offsets(F.lit(None).cast("string"))) == []


def test_normalized_words_are_those_with_offsets(spark):
    texts = ["well-known  facts,\tand  (more)", " - ", "", None, "a\u064b\u064c b", "x\n\n--y z--", "«سفينة-بحر» ؛ موج", "--a--", "tab\x0bform"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalized_words(F.col("t")).alias("a"), F.transform(T.words_with_offsets(F.col("t")), lambda w: w["w"]).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_identity_keeps_vowels(spark):
    assert one(spark, T.answer_identity(F.lit(" «البُـــرّ»؟ "))) == "البُرّ"
    assert one(spark, T.answer_identity(F.lit("آية"))) == "آية"


def test_languages(spark):
    assert [one(spark, T.script_language(F.lit(x), F.lit("?"))) for x in ("یہ ہے ٹھیک", "هذا", "yes it is", "123")] == ["ur", "ar", "en", "?"]
    assert [one(spark, T.language_share_ok(F.lit(x), F.lit(y))) for x, y in (("plain words", "en"), ("plain", "ar"), ("كلام", "ar"), ("12", "en"))] == [True, False, True, False]
    assert [one(spark, T.mostly_marked(F.lit(x))) for x in ("قَالَ نَعَمْ", "قال نعم", "")] == [True, False, False]


def test_clean_print(spark):
    assert one(spark, T.clean_print(F.lit("a‏ \t b\r\n\r\n\r\n\r\nc \x07"))) == "a b\n\nc"
