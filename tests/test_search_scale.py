"""What searches hand on grows with their queries, not with the items these meet."""

import math
from collections import Counter

import pyarrow as pa
import pytest

from corpusloom.operators import retrieval as R


def plain(queries, items, avgdl, idf, k):
    """The best k of each query: (qid, score, rid, coverage)."""
    out = []
    for qid, terms in queries.items():
        rows = []
        for rid, t in items:
            tf = Counter(t)
            parts = [idf[x] * tf[x] * 2.5 / (tf[x] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for x in terms if x in tf]
            if parts:
                rows.append((-round(sum(parts), 6), rid, len(parts) / len(terms)))
        out += [(qid, -s, rid, c) for s, rid, c in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
@pytest.mark.parametrize("name", [lambda i: i, lambda i: f"r{i:03}"])
def test_scorer_keeps_the_best_of_equal_items(monkeypatch, pairs, name):
    monkeypatch.setattr(R, "PAIRS", pairs)
    items = [(name(i), [w for j, w in enumerate("abcdef") for _ in range((i * (j + 3)) % 4 % 3)]) for i in range(200, 0, -1)]
    queries, idf = {5: "abc", 2: "cdx", 9: "e"}, {w: 1 + k / 3 for k, w in enumerate("abcdefx")}
    terms = [{"qid": q, "token": w, "counts": True, "n_terms": len(t), "avgdl": 6.0, "idf": idf[w]} for q, t in queries.items() for w in t]
    scorer = R.Scorer(pa.Table.from_pylist(terms), 3)
    for b in range(0, 200, 50):
        part = items[b : b + 50]
        scorer.add(pa.array([r for r, _ in part]), pa.array([t for _, t in part], pa.list_(pa.string())))
    got = scorer.batch(pa.int64() if isinstance(items[0][0], int) else pa.string()).to_pylist()
    want = plain(queries, items, 6.0, idf, 3)
    assert len(got) == len(want) == 9
    assert sorted((r["qid"], r["score"], r["rid"], r["coverage"]) for r in got) == sorted((q, pytest.approx(s, abs=1e-6), r, pytest.approx(c)) for q, s, r, c in want)


def test_hits_are_stored_and_tasks_give_k_rows_a_query(spark):
    items = R.Index(spark.range(400).selectExpr("id AS rid", "'water palm camel' AS text").repartition(1))
    asked = spark.createDataFrame([(0, "water camel"), (1, "palm")], "qid int, text string")
    hits = R.bm25(asked, items, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan parquet" in plan  # nothing is searched for again by what reads the hits
    assert sorted((r.qid, r.rid, r["rank"]) for r in hits.collect()) == [(q, i, i + 1) for q in (0, 1) for i in range(5)]
    assert not items._stored("postings")  # no posting of any other word was shuffled
    weighed = spark.createDataFrame([(0, "water", True, 1, 3.0, math.log(2))], "qid int, token string, counts boolean, n_terms int, avgdl double, idf double")
    assert R.scored(weighed, items.items, 5).count() <= 5 * items.items.rdd.getNumPartitions()
    assert sorted(r.rid for r in R.all_words(asked, items).filter("qid = 0").collect()) == list(range(400))


def test_closest_verse_shuffles_few_pairs(spark, monkeypatch):
    """Verses that share a quotation's rarest word alone are left out where they meet, before a pair is stored or order is looked at."""
    from corpusloom.operators import verses as Z

    stored = {}
    monkeypatch.setattr(Z, "saved", lambda df, name, f=Z.saved: stored.setdefault(name, f(df, name)))
    rows = [(i, " ".join([f"w{i}a{j}" for j in range(6)] + ["rare"])) for i in range(300)] + [(999, "one two three five six seven rare eight")]
    got = Z.closest_verse(spark.createDataFrame([(1, "one two three four five six seven rare")], "qid long, text string"), spark.createDataFrame(rows, "rid long, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 999, 7, 8)]
    assert stored["verse-pairs"].count() < 5  # 301 verses hold the word


def test_quotations_are_cut_once_and_looked_up_by_hashes(spark, monkeypatch):
    from corpusloom.operators import verses as Z

    stored = {}
    monkeypatch.setattr(Z, "saved", lambda df, name, f=Z.saved: stored.setdefault(name, f(df, name)))
    quotes = spark.createDataFrame([(1, "alpha beta gammas delta"), (2, "eta theta iota")], "qid long, text string")
    verses = spark.createDataFrame([(5, "zero alpha beta gammat delta"), (6, "و eta theta iota")], "rid long, text string")
    assert [tuple(r) for r in Z.misquoted(quotes, verses).collect()] == [(1, 5, 1, "gammas", "gammat")]
    assert {"asked-words", "rarest-grams", "places"} <= set(stored) and dict(stored["held-grams"].dtypes)["gram"] == "bigint"


def test_spans_of_long_texts(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import evidence as E

    text = "كلم " * 40_000 + "«نص»"
    rows = spark.createDataFrame([(1, text)], "rid long, text string")
    words = E.letter_words(rows)
    assert words.count() == 40_001 and words.filter("s <> pos * 4 AND pos < 40000").count() == 0
    assert rows.select(F.explode(E.spans_of(F.col("text"), E.QUOTED)).alias("q")).select("q.*").collect() == [(160_000, 160_004)]


def test_a_task_meets_a_batch_a_slice_of_queries_at_a_time(spark):
    import numpy as np

    from corpusloom.operators import vectors as W

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(900)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = W.knn(v, v, 2).filter("rank = 1").collect()
    assert len(got) == 900 and all(r.qid == r.rid for r in got)
    q, q0 = W.unit(np.array([r[1] for r in rows]))
    assert W.SLICE < 900 and W.cosines(q[: W.SLICE], q0[: W.SLICE], q, q0).shape == (W.SLICE, 900)


def test_words_before_are_taken_from_the_item(spark):
    from corpusloom.operators import evidence as E

    rows = spark.createDataFrame([(1, " كِتاب  ! (قَلَم) باب"), (2, "باب"), (3, None)], "rid long, text string")
    words = E.marked_words(rows)
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString() and E.with_before(words) is words
    got = [(r.rid, r.pos, r.written, r.word, r.before, r.marked) for r in words.orderBy("rid", "pos").collect()]
    assert got == [(1, 0, "كِتاب", "كتاب", None, True), (1, 2, "قَلَم", "قلم", "كتاب", True), (1, 3, "باب", "باب", "قلم", False), (2, 0, "باب", "باب", None, False)]


def test_only_documents_of_hits_are_put_in_order(spark, monkeypatch):
    """Neighbours, openers and units are looked for in the documents that hits lie in; the lines of all others stay unread by any shuffle."""
    from corpusloom.operators import assembly as A
    from corpusloom.operators import vectors as W

    stored, keep = {}, A.saved
    monkeypatch.setattr(A, "saved", lambda df, name: stored.setdefault(name, keep(df, name)))
    items = spark.range(4000).selectExpr("id AS rid", "id div 10 AS location", "'en' AS kind", "id div 5 AS heading", "if(id % 5 = 0, 'A', 'b') AS text")
    hits = spark.createDataFrame([(1, 11, 1), (1, 42, 2)], "question int, rid long, place int")
    assert sorted(tuple(r) for r in A.neighbour_fill(hits, items, "en").collect()) == [(1, 10, 1), (1, 12, 2), (1, 41, 3), (1, 43, 4)]
    assert stored.pop("offered-lines").count() == 20
    stored.clear()
    assert [r.rid for r in A.issue_openers(hits, items, "en", "^A").orderBy("place").collect()] == [10, 11, 40, 42]
    assert stored["offered-lines"].count() == 20
    ranges = items.selectExpr("concat(location, '/', heading) AS unit", "location", "0L AS first", "9L AS last").distinct()
    found = W.map_to_units(spark.createDataFrame([(1, 3, 2, 1)], "qid int, location long, line long, rank int"), ranges)
    assert sorted(r.unit for r in found.collect()) == ["3/6", "3/7"]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
