"""Counting words and phrases, and putting candidates together, on small tables with known results."""

from pyspark.sql import functions as F

from corpusloom.operators import assembly as A
from corpusloom.operators import counting as N

def lines_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "rid long, text string")


def count(spark, lines, asked, word):
    rows = N.occurrences(spark.createDataFrame([(word, asked)], "word string, asked string"), lines).collect()
    return [sorted(r.rid for r in rows if r.way == way) for way in ("exact", "joined")]


def test_every_joined_form_of_a_word(spark):
    """All that may stand before and after a word, each in a line of its own, among words that only look alike."""
    forms = sorted({b + "مركب" + a for b in N.BEFORE for a in N.AFTER})
    others = ["مراكب", "مركبة", "مركبات", "المركب", "سمركب", "مركبون", "مرك", "لمراكب"]
    lines = lines_of(spark, *forms, *others)
    exact, joined = count(spark, lines, "مركب", "مركب")
    assert exact == [forms.index("مركب")]
    assert [forms[k] for k in joined if k < len(forms)] == [f for f in forms if f != "مركب"] and max(joined) < len(forms)


def test_the_article_after_l_and_marks(spark):
    lines = lines_of(spark, "رَبَطَ الحَبلَ", "لِلحَبلِ طرفان", "وبالحبل", "فللحبل عقدة", "لالحبل", "حبل", "كَالحَبلِ وَالحَبلِ")
    assert count(spark, lines, "الحبل", "الحبل") == [[0], [1, 2, 3, 4, 6, 6]]


def test_round_taa(spark):
    """It is written t before a pronoun, and is none itself."""
    lines = lines_of(spark, "خَيْمَةٌ", "خيمتهم", "خيمته", "خيمه", "خيم", "بخيمة", "خيمات")
    assert count(spark, lines, "خيمة", "خيمه") == [[0], [1, 2, 5]]
    assert count(spark, lines, "خيم", "خيم") == [[4], [3]]


def test_long_alif(spark):
    lines = lines_of(spark, "طاولات", "طولات", "طاولت", "اطولت", "طولتا", "طااولت")
    asked = spark.createDataFrame([("طولت",), ("غرفه",)], "word string")
    none = spark.createDataFrame([], "word string")
    got = sorted(r.form for r in N.alif_variants(asked, lines, none).collect())
    assert got == sorted(["طاولات", "طولات", "طاولت", "طااولت"])  # alifs inside the word, none at an edge
    found = spark.createDataFrame([("طولت",)], "word string")
    assert not N.alif_variants(asked, lines, found).count()


def test_phrases_with_joined_ends(spark):
    lines = lines_of(spark, "ثُمَّ حَمَلَ البَحَّارُ شِراعَهُ وعاد", "والبحار شراع", "حمل شراع", "البحار شراع جديد")
    targets = spark.createDataFrame([("البحار شراع",), ("حمل شراع",), ("حمل البحار",)], "phrase string")
    got = sorted((r.phrase, r.rid, r.way) for r in N.phrases(targets, lines).collect())
    assert got == sorted([("البحار شراع", 0, "joined"), ("البحار شراع", 1, "joined"), ("البحار شراع", 3, "exact"), ("حمل شراع", 2, "exact"), ("حمل البحار", 0, "exact")])
    (r,) = N.phrases(targets.filter("phrase = 'حمل البحار'"), lines).collect()
    assert r.snippet == "ثُمَّ حَمَلَ البَحَّارُ شِراعَهُ وعاد"


def test_lookalikes_quotations_and_references(spark):
    hits = spark.createDataFrame([(1, 10, "Fasting in travel", "fasting rules"), (1, 11, "Prayer in travel", "travel prayer rules")], "qid int, rid int, heading string, question string")
    guards = spark.createDataFrame([("travel", "travel")], "word string, unless string")
    assert [r.rid for r in A.without_lookalikes(hits, guards).collect()] == [11]
    text = spark.createDataFrame([("He said «one two three four» and «too short» then “five six seven eight nine”.",)], "text string")
    assert text.select(A.quotations_in(F.col("text"))).first()[0] == ["one two three four", "five six seven eight nine"]
    names = spark.createDataFrame([("genesis", "g"), ("exodus", "e")], "name string, unit string")
    items = spark.createDataFrame([("g", n, f"g:{n}") for n in range(1, 6)] + [("e", 2, "e:2")], "unit string, number int, id string")
    asked = spark.createDataFrame([(1, "See Exodus 2 and Genesis (3-9), not Leviticus 1"), (2, "nothing")], "key int, text string")
    assert [r.id for r in A.verse_references(asked, names, items).orderBy("nth").collect()] == ["e:2", "g:3", "g:4", "g:5"]


def test_openers_and_neighbours(spark):
    items = spark.createDataFrame([(1, 1, "law", "h", "Issue one"), (2, 1, "law", "h", "evidence"), (3, 1, "law", "h", "more"), (4, 1, "law", "k", "apart"), (5, 1, "law", "k", "apart too")], "rid long, location int, kind string, heading string, text string")
    hits = spark.createDataFrame([(1, 3, 1), (1, 4, 2)], "question int, rid long, place int")
    assert [r.rid for r in A.issue_openers(hits, items, "law", "^Issue").orderBy("place").collect()] == [1, 3, 4]
    assert [r.rid for r in A.neighbour_fill(hits, items, "law").orderBy("nth").collect()] == [2, 5]


def test_count_requests(spark):
    asked = {
        "كم مرة وردت كلمة الجبل في القرآن؟": ("الجبل", "", False),
        "كم مره ذكرت السفينة في سورة النجم": ("السفينة", "النجم", False),
        "عدد مرات ذكر البحر": ("البحر", "", False),
        "كم عدد مشتقات «قلم» في المصحف؟": ("قلم", "", True),
        "«كم مرة وردت لفظة المطر بالقرآن؟»": ("المطر", "", False),
        "كم مرة تكررت كلمة الجـــبل2 في القرآن": ("الجبل", "", False),
        "كم مرة وردت كلمة ال نهر في القرآن": ("النهر", "", False),
        "كم مرة وردت كلمة الج-بل": ("الجبل", "", False),
        "How many times is the word شجر in the Quran?": ("شجر", "", False),
        "كم مرة وردت كلمة الجبل في صحيح البخاري": None,
        "كم عدد الكواكب": None,
        "ما معنى الجبل في القرآن": None,
        "كم مرة وردت كلمة «word» في القرآن": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in asked], "t string").select("t", N.count_request(F.col("t")).alias("r")).collect()
    assert {r.t: r.r and tuple(r.r) for r in rows} == asked
