"""Texts without Arabic skip the Arabic rules and keep the words they had."""

import re

from pyspark.sql import functions as F

from corpusloom.functions import text as T

TEXTS = [None, "", "The Cat and the Über-Hat_1", "Ünï of Öl", "والكتاب الى لل للبيت كِتَابٌ مـــكتبة أحمد", "the الله in on x", "لا ل ٱلرَّحْمَٰنِ", "Ａ café\tx y2"]


def normalized(text):
    bare = re.sub(T.MARKS.encode().decode("unicode_escape"), "", text or "").replace(T.TATWEEL, "").translate(str.maketrans(*T.VARIANTS))
    return re.sub(r"[^\w]+", " ", bare.lower()).strip()


def tokens(text):
    words = normalized(text).split(" ")
    cut = [re.sub(f"^(?:{'|'.join(T.PREFIXES)})(?=..)", "", w) for w in words]
    return [c for c, w in zip(cut, words) if len(c) >= 2 and c not in T.STOPWORDS and w not in T.STOPWORDS]


def test_same_words_with_and_without_arabic(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    found = rows.select("text", T.normalize(F.col("text")).alias("n"), T.tokenize(F.col("text")).alias("t")).collect()
    assert [r["n"] for r in found] == [normalized(x) for x in TEXTS]
    assert [r["t"] for r in found] == [tokens(x) for x in TEXTS]


def test_arabic_rules_stand_behind_a_test_for_arabic():
    rules = str(T.normalize(F.col("text")))
    assert rules.index("CASE WHEN") < rules.index("translate(")
