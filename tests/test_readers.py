"""Readers, chunking and rulings on literal inputs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as K
from corpusloom.operators import evaluation as V
from corpusloom.operators import rulings
from corpusloom.sources import readers as X

BOOK = """######OpenITI#
#META# 010.AuthorNAME	:: made up for this test
#META#Header#End#

# PageV02P004
### | [كتاب البستان]
### | [فصل في الاشجار]
# تنمو الاشجار قرب النهر
~~وتعطي ثمارها ms0003 في الخريف.
# PageV02P017
# ثم ياتي الشتاء. PageV02P018 ms0004
### | [كتاب البحر]
# البحر واسع.
# PageV02P030
"""


def test_marked_text(spark, tmp_path):
    (tmp_path / "book.txt").write_text(BOOK, encoding="utf-8")
    got = X.read_marked(spark, str(tmp_path / "book.txt")).orderBy("n").collect()
    assert [(r.heading, r.text, r.first_page, r.last_page) for r in got] == [
        ("فصل في الاشجار", "تنمو الاشجار قرب النهر وتعطي ثمارها في الخريف.", "02:017", "02:017"),
        ("فصل في الاشجار", "ثم ياتي الشتاء.", "02:018", "02:018"),
        ("كتاب البحر", "البحر واسع.", "02:030", "02:030"),
    ]
    assert [r.book for r in got] == ["كتاب البستان", "كتاب البستان", "كتاب البحر"]


def test_dump_of_units(spark, tmp_path):
    dump = [{"number": 1, "name": "One", "verses": [{"number": 1, "text": "a"}, {"number": 2, "text": "b"}]}, {"number": 2, "name": "Two", "verses": [{"number": 1, "text": "c"}]}]
    with gzip.open(tmp_path / "dump.json.gz", "wt") as f:
        json.dump(dump, f)
    got = X.read_dump(spark, str(tmp_path / "dump.json.gz"), "q").orderBy("rid").collect()
    assert [(r.id, r.location, r.text) for r in got] == [("q:1:1", "One, 1", "a"), ("q:1:2", "One, 2", "b"), ("q:2:1", "Two, 1", "c")]


def test_numbered_items(spark, tmp_path):
    rows = [{"number": 2, "text": "Second item. It has two sentences."}, {"number": 1, "text": "First."}, {"number": 3, "text": " "}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got = X.read_numbered(spark, str(tmp_path / "a.json"), "b", 20).orderBy("number", "part").collect()
    assert [(r.id, r.text) for r in got] == [("b:1", "First."), ("b:2:0", "Second item."), ("b:2:1", "It has two sentences.")]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, [rows[0], rows[0]])))
    with pytest.raises(ValueError, match="2"):
        X.read_numbered(spark, str(tmp_path / "b.json"), "b", 20)


def test_manifest_is_taken_whole_or_not_at_all(spark):
    live = spark.createDataFrame([("a", "a:1")], "source_id string, id string")
    good = ("b", "B", "https://x.org", "license", "b:1", "hadith", "sound")
    schema = "source_id string, name string, url string, rights string, id string, kind string, grade string"
    assert X.manifest_violations(live, spark.createDataFrame([good], schema), 1).count() == 0
    bad = [("b", "", "http://x.org", "unknown", "b 1", "quran", None), ("a", "A", "https://x.org", "license", "a:1", "other", None), ("c", "C", "https://x.org", "license", "c:1", "hadith", " ")]
    got = {(r.rule, r.key) for r in X.manifest_violations(live, spark.createDataFrame(bad, schema), 2).collect()}
    assert got == {("schema version", "2"), ("empty field", "b 1"), ("url without https", "b"), ("rights", "b"), ("id pattern", "b 1"), ("kind", "b 1"), ("source held already", "a"), ("id held already", "a:1"), ("grade missing", "c:1")}


def test_codes(spark):
    words = spark.createDataFrame([("sound", "سند صحيح"), ("very weak", "ضعيف جدا"), ("weak", "ضعيف")], "code string, meaning string")
    rows = spark.createDataFrame([(1, 0, "Ali", "Very weak"), (1, 1, "Omar", "sound weak"), (2, 0, "Ali", "sound odd"), (3, 0, "Ali", "weak")], "id int, pos int, who string, grade string")
    assert {r.id: r.grades for r in X.translate_codes(rows, words).collect()} == {1: "Ali: ضعيف جدا؛ Omar: سند صحيح ضعيف", 2: None, 3: "Ali: ضعيف"}


def test_corpus_file(spark, tmp_path):
    corpus = {
        "sources": [{"id": "a", "name": "A", "about": "x", "url": "u"}],
        "passages": [{"id": f"a:{i}", "source_id": "a", "location": "l", "text": f"t{i}", "kind": "other"} for i in range(3)],
        "_translations": {"en": {"a:1": "one"}},
    }
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    sources, passages, texts = X.read_corpus(spark, str(tmp_path / "c.json"))
    assert sources.count() == 1 and [r.id for r in passages.orderBy("rid").collect()] == ["a:0", "a:1", "a:2"]
    got = X.attach_translations(passages, texts, "en", "other").orderBy("rid").collect()
    assert [r.translation for r in got] == ["", "one", ""]
    X.write_corpus(passages, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_packing(spark):
    df = spark.createDataFrame([(["aa", "bb", "c" * 9, "d"],), ([],)], "x array<string>")
    got = [r[0] for r in df.select(K.packed(F.col("x"), 6, "\n")).collect()]
    assert got == [["aa\nbb", "c" * 9, "d"], []]
    text = F.lit("One. Two! Three is longer. Four")
    assert spark.range(1).select(K.split_sentences(text, 12)).first()[0] == ["One. Two!", "Three is longer.", "Four"]
    w = spark.range(1).select(K.window(F.lit("alpha beta gamma delta epsilon"), F.lit(11), F.lit(16), 8).alias("w")).first().w
    assert (w.lead, w.match, w.trail, w.cut_lead, w.cut_trail) == ("beta ", "gamma", " delta", True, True)


def test_rulings(spark):
    claims = spark.createDataFrame([("a", "تجوز الصلاة"), ("b", "لا يجب الوضوء"), ("c", "يجب الوضوء"), ("d", "كلام عام")], "claim string, text string")
    cited = spark.createDataFrame([("a", "تجب الصلاة"), ("b", "يجب الوضوء"), ("c", "يجب الوضوء"), ("d", "يحرم كذا")], "claim string, text string")
    assert {(r.claim, r.kind, r.negated) for r in rulings.polarity(claims, "claim").collect()} == {("a", "permitted", False), ("b", "obligatory", True), ("c", "obligatory", False)}
    assert {tuple(r) for r in rulings.mismatched(claims, cited).collect()} == {("a", "permitted")}
    assert {tuple(r) for r in rulings.flipped(claims, cited).collect()} == {("b", "obligatory")}


def test_gold_and_traces(spark):
    gold = spark.createDataFrame([(1, "answered"), (2, "answered"), (3, "answered"), (4, "abstained")], "id int, expect string")
    answers = spark.createDataFrame([(1, "answered", [True, False]), (2, "answered", None), (3, "abstained", None), (4, "abstained", None)], "id int, status string, covered array<boolean>")
    got = {r.id: (r.status_ok, r.covered) for r in V.score_gold(gold, answers).collect()}
    assert got == {1: (True, 0.5), 2: (True, None), 3: (False, 0.0), 4: (True, 0.0)}
    was = spark.createDataFrame([(1, 0.8), (2, 0.5)], "id int, covered double")
    now = spark.createDataFrame([(1, 0.5), (2, 0.4)], "id int, covered double")
    assert [r.id for r in V.gold_regressions(was, now).collect()] == [1]
    lines = spark.createDataFrame([('x TRACE {"schema_version": 1, "request_id": "a", "events": []}',), ("TRACE {cut",), ("other",), ('TRACE {"schema_version": 2, "request_id": "b"}',)], "value string")
    good, bad = V.parse_traces(lines)
    assert [r.request_id for r in good.collect()] == ["a"] and bad.count() == 2


def test_skip_sections(spark):
    rows = spark.createDataFrame([("d", 0, None), ("d", 1, "Poem"), ("d", 2, None), ("d", 3, "Text"), ("d", 4, None)], "doc string, n int, head string")
    assert [r.n for r in X.skip_sections(rows, "doc", "n", "head", "^Poem").orderBy("n").collect()] == [0, 3, 4]
