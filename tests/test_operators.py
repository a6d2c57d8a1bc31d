"""Operators on small literal tables with known results."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import claims as M
from corpusloom.operators import evaluation as V
from corpusloom.operators import evidence as E
from corpusloom.operators import retrieval as R
from corpusloom.operators import vectors as W
from corpusloom.sources import corpus as C

ITEMS = [
    (0, "test-a:1", "test-a", 1, "other", "The palm tree needs water in summer and bears dates."),
    (1, "test-a:2", "test-a", 1, "other", "The moon shows phases through the month."),
    (2, "test-a:3", "test-a", 1, "other", "Water freezes at zero degrees and boils at a hundred."),
    (3, "test-b:1", "test-b", 2, "other", "The camel bears thirst for many days."),
    (4, "test-b:2", "test-b", 2, "other", "Birds migrate to warm lands in winter."),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "rid long, id string, source_id string, location int, kind string, text string")


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, text string")


def test_bm25_by_hand(spark, items):
    asked = questions(spark, "water palm", "nothing matches zebra", "the of")
    got = {(r.qid, r.rid): r for r in R.bm25(asked, items).collect()}
    assert set(got) == {(0, 0), (0, 2)}
    lengths = [len(x) for x in (r.t for r in items.select(R.tokenize(F.col("text")).alias("t")).collect())]
    avg = sum(lengths) / 5
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda df, dl: idf(df) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got[0, 0].score == pytest.approx(part(2, lengths[0]) + part(1, lengths[0]), abs=1e-6)
    assert (got[0, 0].coverage, got[0, 2].coverage, got[0, 0].rank) == (1.0, 0.5, 1)
    ok = {r.qid: r.answered for r in R.sufficient(asked, R.bm25(asked, items)).collect()}
    assert ok == {0: True, 1: False, 2: False}


def test_index_opened_again(spark, items, tmp_path):
    asked = questions(spark, "water palm", "camel winter lands")
    built = R.Index(items, path=str(tmp_path / "index")).save()
    opened = R.Index.open(spark, built.path)
    for search in (R.bm25, R.phrase_match, R.all_words):
        assert sorted(search(asked, opened).collect()) == sorted(search(asked, items).collect())
    want = {}
    for r in opened.items.collect():
        for t in r.t:
            want[t, r.rid, len(r.t)] = want.get((t, r.rid, len(r.t)), 0) + 1
    assert {(r.token, r.rid, r.dl): r.tf for r in opened.postings().collect()} == want
    assert {r.token: r.df for r in opened.frequencies().collect()} == {t: sum(k[0] == t for k in want) for t, *_ in want}
    empty = R.Index(items.limit(0)).save()
    assert empty.postings().count() == 0 and R.bm25(asked, empty).count() == 0


def test_exact_neighbours_of_several_batches(spark):
    """Vectors of other lengths, with missing entries or without length, and ties, in batches of ten."""
    import numpy as np

    draw = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(draw.integers(-2, 3, size=(150, 3)).astype(float))] + [(200, [1.0] * 4), (201, [1.0, None, 0.0]), (202, None), (203, [0.0] * 3)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = sorted((r.qid, r["rank"], r.rid, r.score) for r in W.knn(v.filter("vec_id % 50 = 0 AND vec_id < 200"), v, 7).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    m = {i: np.array(x) for i, x in rows if x and len(x) == 3 and None not in x}
    cos = lambda a, b: round(float(a @ b / np.sqrt(a @ a * (b @ b))), 6) if a.any() and b.any() else -1.0
    want = [(q, k + 1, i, s) for q in (0, 50, 100) for k, (s, i) in enumerate(sorted(((-cos(m[q], x), i) for i, x in m.items()))[:7])]
    assert [(q, k, i) for q, k, i, _ in got] == [(q, k, i) for q, k, i, _ in want]


def test_phrases(spark, items):
    asked = questions(spark, "palm tree needs water", "water", "camel bears thirst often enough", "degrees boils")
    assert sorted(map(tuple, R.phrase_match(asked, items).collect())) == [(0, 0), (1, 0), (1, 2), (3, 2)]
    assert [tuple(r) for r in R.longest_subphrase(asked.filter("qid = 2"), items).collect()] == [(2, 3, 3)]
    runs = E.classify(E.longest_runs(asked, items)).filter("qid = 0 AND rid = 0").first()  # all four words
    assert (runs.run, runs.status, runs.coverage) == (4, "exact", 1.0)


def test_longest_run_of_letters(spark):
    quote, text = questions(spark, "a b c d e"), spark.createDataFrame([(7, "x b c d y"), (8, "z e q"), (9, "nothing")], "rid long, text string")
    assert [(r.rid, r.run, r.qstart, r.start) for r in E.longest_runs(quote, text).collect()] == [(7, 3, 1, 1)]
    assert sorted((r.rid, r.run, r.qstart, r.start) for r in E.longest_runs(quote, text, least=1).collect()) == [(7, 3, 1, 1), (8, 1, 4, 1)]


def test_words_between_are_no_exact_quotation(spark):
    quote, text = questions(spark, "water of life and fire"), spark.createDataFrame([(1, "water is the life in fire"), (2, "The Water of life, and fire!")], "rid long, text string")
    hits = spark.createDataFrame([(0, 1), (0, 2)], "qid int, rid long")
    got = {r.rid: r for r in E.find_quotes(quote, text, hits).collect()}
    assert set(got) == {2} and (got[2].status, got[2].coverage, got[2].s, got[2].e) == ("exact", 1.0, 4, 28)


def test_quotations_with_wrong_words(spark):
    """Letters changed, a word left out, and the same words in another order."""
    told = "In spring the keeper of the northern lighthouse painted every window green and blue before the storms"
    shuffled = "green window every painted lighthouse northern the of keeper the"
    items = spark.createDataFrame([(1, told), (2, shuffled)], "rid long, text string")
    quote = questions(spark, "keeper of the nothern lighthause painted window green", "lighthouse green")
    hits = spark.createDataFrame([(q, i) for q in (0, 1) for i in (1, 2)], "qid int, rid long")
    (r,) = E.find_quotes(quote, items, hits).collect()
    assert (r.qid, r.rid, r.status, r.coverage) == (0, 1, "close", 1.0)
    assert told[r.s : r.e] == "keeper of the northern lighthouse painted every window green"


def edits(a, b):
    """The least number of letters changed, added and left out."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_one_letter_apart_by_edits(a, b):
    assert E.one_letter_apart(a, b) == (a == b or min(len(a), len(b)) >= 4 and edits(a, b) == 1)


def fuzzy_by_hand(quote, words):
    """From the definition: of all stretches that begin with one of the first three words, the one with most of the quotation in order, the shortest, the first."""

    def in_order(i, j, end):
        """The most words of quote[i:] that stand in order in words[j:end]."""
        if i == len(quote) or j == end:
            return 0
        if (i, j, end) not in seen:
            here = 1 + in_order(i + 1, j + 1, end) if E.one_letter_apart(quote[i], words[j]) else 0
            seen[i, j, end] = max(here, in_order(i + 1, j, end), in_order(i, j + 1, end))
        return seen[i, j, end]

    seen = {}
    present = set(quote) & set(words)
    if len(present) < 0.35 * len(set(quote)):
        return None
    stretches = [(a, b) for a in range(len(words)) for b in range(a + 1, min(len(words), a + len(quote) + 2) + 1) if any(E.one_letter_apart(words[a], q) for q in quote[:3])]
    if not stretches:
        return None
    a, b = min(stretches, key=lambda s: (-in_order(0, *s), s[1] - s[0], s[0]))
    return in_order(0, a, b), a, b - 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["tree", "trees", "true", "a", "water", "watter", "b"]), min_size=3, max_size=7), st.lists(st.sampled_from(["tree", "trees", "true", "a", "water", "watter", "b"]), max_size=14))
def test_fuzzy_place_equals_a_plain_table(quote, words):
    assert E.fuzzy_place(quote, words) == fuzzy_by_hand(quote, words)


def stretch_by_hand(quote, words, least):
    """From the definition: of all stretches of n + 2 words at most, the one with most of the quotation in order, the shortest, the first."""

    def in_order(part):
        row = [0] * (len(part) + 1)
        for q in quote:
            before = row[:]
            for j, w in enumerate(part, 1):
                row[j] = max(before[j], row[j - 1], before[j - 1] + E.one_letter_apart(q, w))
        return row[-1]

    spans = [(-in_order(words[a:b]), b - a, a) for a in range(len(words)) for b in range(a + 1, min(len(words), a + len(quote) + 2) + 1)]
    found, length, a = min(spans, default=(0, 0, 0))
    return (-found, a, a + length - 1) if -found >= least else None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["tree", "trees", "true", "a", "water", "watter", "b"]), min_size=3, max_size=7), st.lists(st.sampled_from(["tree", "trees", "true", "a", "water", "watter", "b"]), max_size=14), st.integers(1, 5))
def test_closest_stretch_equals_a_plain_table(quote, words, least):
    assert E.closest_stretch(quote, words, least) == stretch_by_hand(quote, words, least)


def test_spans_without_their_first_words_or_with_every_word_respelt(spark):
    quote = "alpha bravo carol delta eagle foxes grand hotel india julie".split()
    respelt = [w + "s" for w in quote]
    rows = [(1, 1, quote, ["x", "y", *quote[3:], "z"]), (1, 2, quote, ["x", *respelt]), (1, 3, quote, quote[4:])]
    got = {r.rid: (r.found, r.first, r.last) for r in E.fuzzy_spans(spark.createDataFrame(rows, "qid int, rid long, asked array<string>, held array<string>")).collect()}
    assert got == {1: (7, 2, 8), 2: (10, 1, 10)}


def test_outcomes_of_a_lookup(spark):
    asked = questions(spark, "found here", "common words", "rare words", "no hits")
    hits = spark.createDataFrame([(q, k, k + 1, c) for q, c in ((0, 0.9), (1, 0.9), (2, 0.3)) for k in range(12)], "qid int, rid long, rank int, coverage double")
    found = spark.createDataFrame([(0, "close", 2), (0, "exact", 1)], "qid int, status string, place int")
    assert {r.qid: r.outcome for r in E.too_generic(asked, hits, found).collect()} == {0: "exact", 1: "too_generic", 2: "not_found", 3: "not_found"}
    rows = [(1, 5, "exact", 1.0, "other", "b", 3), (1, 6, "close", 0.9, "hadith", "x", 1), (1, 7, "exact", 1.0, "other", "b", 1), (1, 8, "exact", 1.0, "hadith", "y", 5), (1, 9, "exact", 1.0, "hadith", "sahih-muslim", 9)]
    ranked = E.rank_quotes(spark.createDataFrame(rows, "qid int, rid int, status string, coverage double, kind string, source_id string, rank int"))
    assert [r.rid for r in ranked.orderBy("place").collect()] == [9, 8, 7, 5, 6]
    shown = E.collapse_wording(ranked.withColumn("location", F.col("rid") * 10).withColumn("excerpt", F.lit("Some words,")))
    assert [(r.rid, r.also, r.nth) for r in shown.orderBy("nth").collect()] == [(9, [], 1), (8, [], 2), (7, [50], 3)]


def test_fusion_and_turns(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "qid int, rid string, rank int")
    assert [r.rid for r in R.rrf([ranked("abc"), ranked("ca")]).orderBy("rank").collect()] == ["a", "c", "b"]
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "question int, list_no int, rid string, rank int")
    assert [r.rid for r in R.round_robin(lists, 20).orderBy("place").collect()] == ["a", "b", "c"]
    hits = spark.createDataFrame([(1, i, i, i < 5) for i in range(8)], "qid int, rid int, rank int, inside boolean")
    assert [r.rid for r in R.interleave(hits).orderBy("place").collect()] == [0, 1, 2, 5, 3, 4, 6, 7]


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, None), (6, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r.reason for r in R.normalize_vectors(v, 2).orderBy("vec_id").collect()] == [None, None, "zero", None, "dimension", "dimension", "not finite"]
    usable = v.filter("vec_id < 4")
    got = [(r.rid, r.score) for r in W.knn(usable.filter("vec_id = 0"), usable, 4).orderBy("rank").collect()]
    assert got == [(0, 1.0), (3, 0.707107), (1, 0.0), (2, -1.0)]


def test_claims_are_held_against_their_own_answer(spark):
    items = spark.createDataFrame([("a", "s", "rain fell"), ("b", "s", "snow fell")], "id string, source_id string, text string")
    claims = spark.createDataFrame([("1", "x", "rain", ["a"]), ("2", "x", "snow", ["a", "b"]), ("3", "y", "snow", ["b"]), ("4", "z", "rain", ["a"])], "claim string, answer string, text string, cited array<string>")
    allowed = spark.createDataFrame([("x", "a"), ("y", "b"), ("y", "b")], "answer string, id string")
    assert {r.claim: r.reason for r in M.verify(claims, items, allowed).collect()} == {"1": None, "2": "passage of another answer", "3": None, "4": "passage of another answer"}
    assert {r.claim for r in M.verify(claims, items, items).filter("reason IS NULL").collect()} == {"1", "2", "3", "4"}


def test_approximate_neighbours(spark):
    """Recall of 0.9 or more on vectors without any clusters, a twentieth of them scored exactly; every vector has a code."""
    import numpy as np

    draw = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(draw.normal(size=(2_000, 64)))] + [(5_000, [1.0] * 3), (5_001, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked, index = v.filter("vec_id % 100 = 0 AND vec_id < 2000"), W.codes(v, 64)
    assert index.count() == 2_000
    exact = W.knn(asked, v)  # vectors of another length are left out
    found = W.knn_approx(asked, index)
    assert found.count() == 200 and R.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    same = found.join(exact.withColumnRenamed("score", "exact"), ["qid", "rid"]).filter("abs(score - exact) > 1e-5")
    assert same.count() == 0


def test_stitching(spark):
    live = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    other = spark.createDataFrame([(2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0])], "id long, embedding array<double>")
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    assert {(r.id, r.origin) for r in W.stitch(live, other, items).collect()} == {(1, "live"), (2, "live"), (3, "other"), (4, "missing")}
    assert sorted(map(tuple, W.stitch_violations(live, other, items, 2).collect())) == [("dimension", 3), ("missing", 4)]


def test_metrics(spark):
    qrels = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c")], "qid string, rid string")
    ranked = spark.createDataFrame([("q1", x, k + 1) for k, x in enumerate("xayb")] + [("q2", "c", 1), ("q3", "a", 1)], "qid string, rid string, rank int")
    assert tuple(V.rank_metrics(ranked, qrels).first()) == (2, 0.75, 0.75, 1.0)


def test_validation_and_merge(spark, items):
    sources = spark.createDataFrame([("test-a", "A"), ("test-c", " ")], "source_id string, name string")
    kinds = spark.createDataFrame([("other",)], "kind string")
    extra = spark.createDataFrame([(9, "test-a:1", "test-a", 1, "odd", " ")], items.schema)
    got = sorted(map(tuple, C.validate(sources, items.unionByName(extra), kinds).collect()))
    assert got == sorted([("no passages", "test-c"), ("passage id repeated", "test-a:1"), ("passage without text", "test-a:1"), ("source without name", "test-c"), ("unknown kind", "test-a:1"), ("unknown source", "test-b:1"), ("unknown source", "test-b:2")])
    live, candidate = items.filter("source_id = 'test-a'"), items.withColumn("rid", F.col("rid") + 50)
    merged = C.merge(live, candidate).orderBy("rid").collect()
    assert [(r.rid, r.id) for r in merged] == [(0, "test-a:1"), (1, "test-a:2"), (2, "test-a:3"), (3, "test-b:1"), (4, "test-b:2")]


def test_fingerprint_sees_every_change(spark, items):
    digest = lambda df: [r.digest for r in C.fingerprint(df).collect()]
    assert digest(items) == digest(items.repartition(3))
    assert digest(items) != digest(items.withColumn("text", F.when(F.col("rid") == 3, "x").otherwise(F.col("text"))))
    assert digest(items) != digest(items.withColumn("rid", 10 - F.col("rid")))


def test_claims(spark):
    """One claim that breaks each rule, in the order of the rules, and the first rule wins where two are broken."""
    items = spark.createDataFrame(
        [("a:1", "sahih-muslim", True, "الْمَاءُ طَهُورٌ لا يُنَجِّسُهُ شيء"), ("a:2", "other", False, "سؤال"), ("a:3", "other", True, "قال أبو حنيفة ومالك: يجب ذلك"), ("a:4", "fatawa", True, "لا يجوز هذا"), ("a:5", "other", True, "نص بلا حكم")],
        "id string, source_id string, answer_part boolean, text string",
    )
    persons = spark.createDataFrame([("fatawa", "الشيخ ابن باز")], "source_id string, person string")
    rows = [
        ("ok", "قال: «الماء طهور»", ["a:1"], "", None), ("none", "بلا مصدر", [], "", "nothing cited"), ("null", "بلا مصدر", None, "", "nothing cited"), ("outside", "غيره «لا»", ["z:9"], "", "passage of another answer"), ("asks", "نص", ["a:2"], "", "question without its answer"),
        ("quote", "قال: «الماء نجس»", ["a:1"], "", "quotation not in the passages"), ("verse", "﴿كلام آخر﴾", ["a:1", "a:3"], "", "quotation not in the passages"), ("latin", 'a "word" and «word» here', ["a:1"], "", None), ("school", "يجب ذلك", ["a:3"], "الشافعي", "school not named"),
        ("named", "يجب ذلك", ["a:3"], "أبي حنيفة وأصحابه", None), ("alias", "يجب ذلك", ["a:3"], "الحنفية", None), ("and", "يجب ذلك", ["a:3"], "مالك", None), ("speaker", "لا يجوز", ["a:4"], "ابن باز", None), ("division", "ذكر في هذا الباب", ["a:5"], "", "book's own division"),
        ("book", "رواه البخاري", ["a:1"], "", "collection not cited"), ("cited book", "رواه مسلم", ["a:1"], "", None), ("kind", "هو حرام", ["a:3"], "", "ruling not in the passages"), ("flip", "يجوز هذا", ["a:4"], "", "ruling turned around"), ("silent", "هو حرام", ["a:5"], "", None),
    ]
    claims = spark.createDataFrame([r[:4] for r in rows], "claim string, text string, cited array<string>, school string")
    assert {r.claim: r.reason for r in M.verify(claims, items, items, persons).collect()} == {r[0]: r[4] for r in rows}
    plain = claims.drop("school").filter("claim IN ('ok', 'none')")
    assert {r.claim: r.reason for r in M.verify(plain, items.drop("answer_part"), items).collect()} == {"ok": None, "none": "nothing cited"}
    told = spark.createDataFrame([(1, "طهور لا ينجسه", ["a:1"]), (2, "طهور شيء", ["a:1"]), (3, "", ["a:1"]), (4, "نص", [])], "claim int, witness string, cited array<string>")
    assert {r.claim: r.held for r in M.evidence_contiguous(told, items).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_ids_and_cards(spark, items):
    cites = spark.createDataFrame([("c", 0, "test-b:1"), ("c", 1, "test-a"), ("c", 2, "zz"), ("c", 3, "test-b:1")], "claim string, pos int, id string")
    assert [tuple(r) for r in E.resolve_ids(cites, items).collect()] == [("c", "test-b:1", 0)]
    single = items.filter("id = 'test-a:1' OR source_id = 'test-b'")
    assert {r.id for r in E.resolve_ids(cites, single).collect()} == {"test-a:1", "test-b:1"}
    prose = spark.createDataFrame([(1, "First one [test-a:1, test-b:2]. Not cited. Last [x].")], "answer int, text string")
    assert [(r.n, r.text, r.ids) for r in E.cited_prose(prose, ["answer"]).orderBy("n").collect()] == [(0, "First one.", ["test-a:1", "test-b:2"]), (2, "Last.", ["x"])]


def test_pending(spark):
    claims = spark.createDataFrame([(1, "q", "a"), (2, "q", "b"), (3, "q", "c")], "claim int, question string, text string")
    key = [F.col("question"), F.col("text")]
    memo = claims.filter("claim < 3").select(F.sha2(F.concat_ws("\x1f", *key), 256).alias("content"), (F.col("claim") == 1).alias("ok"))
    assert sorted(r.claim for r in E.pending(claims, memo, key).collect()) == [2, 3]


def test_lexicon(spark):
    rows = [(i, "كِتَابٌ قديم") for i in range(3)] + [(9, "كُتِب علمٌ عِلم عَلم")] + [(20 + i, "غَوْرًا غَوْرٌ") for i in range(2)]
    df = spark.createDataFrame(rows, "rid long, text string")
    got = {(r.word, r.head, r.ending, r.tail, r.n) for r in E.mark_lexicon(df).collect()}
    assert got == {("كتاب", "كِتَاب", "ٌ", "", 3)}  # unmarked words count nothing; two places are too few
    pairs = E.bigram_lexicon(df, least=2)
    assert {(r.before, r.word, r.head, r.ending, r.tail) for r in pairs.collect()} == {("غورا", "غور", "غَوْر", "ٌ", "")}
    words = spark.createDataFrame([(1, 0, "غورا", "غورا"), (1, 1, "غور", "غور"), (1, 2, "كتابِ", "كتاب"), (1, 3, "كتاب", "كتاب"), (1, 4, "قلم", "قلم")], "rid long, pos int, written string, word string")
    assert [r.fixed for r in E.apply_lexicon(words, E.mark_lexicon(df), pairs).orderBy("pos").collect()] == ["غورا", "غَوْرٌ", "كِتَابِ", "كِتَابٌ", "قلم"]


def test_lexicons_are_counted_once(spark):
    rows = [(k, "كِتَابٌ جَدِيدٌ ـ كِتَابٌ قَدِيمٌ، ۥ « بَيْتًا") for k in range(3)] + [(9, None), (10, "كِتَابًا جَدِيدٌ x_1 —"), (11, " ـَـ ١ جَدِيدٌ")]
    df = spark.createDataFrame(rows, "rid long, text string")
    words = E.marked_words(df)
    one, two = E.lexicons(words)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, E.mark_lexicon(df).collect())) and one.count() > 1
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, E.bigram_lexicon(df).collect())) and two.count() > 1
    listed = df.select("rid", F.posexplode(F.filter(F.split("text", "\\s+"), lambda w: w != "")).alias("pos", "raw"))
    assert words.count() == listed.filter(T.normalize(F.col("raw")) != "").count()
