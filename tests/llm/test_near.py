"""Operator 10 against all pairs, and the pipeline against its parts."""

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from corpusloom.llm import near_dedup
from tests.llm.cases import documents, empty


def all_pairs(rows):
    """Classes of (id, text) by aligning every pair."""
    import pyspark.sql.functions as F
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seqs = {r.id: near_dedup.kmers(np.array(r.hashes, np.int64)) for r in near_dedup.nodes(df, "doc_id", "text").collect()}
    ids, parent = list(seqs), {i: i for i in seqs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if near_dedup.similarity(seqs[a], seqs[b]) >= 0.8:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}


def test_classes_equal_all_pairs(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 6)))
    rows, n = [], 0
    passage = [word() for _ in range(40)]
    for group in range(25):
        base = [word() for _ in range(draw.choice([4, 9, 20, 60, 150, 400]))]
        for _ in range(draw.choice([1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 60))):
                k = draw.randrange(len(copy))
                copy[k : k + 1] = draw.choice([[], [word()], [copy[k], word()]])
            rows.append((n, " ".join(copy + passage * (group % 2)).capitalize()))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == all_pairs(rows)


def test_links_that_large_buckets_leave_open(spark):
    """Texts with some of 40 edits each reach 0.8 with few others, though all share large buckets."""
    draw = random.Random(3)
    base = [f"b{i}" for i in range(240)]
    rows = []
    for n in range(500):
        copy = list(base)
        for k in draw.sample(range(40), 5):
            copy[6 * k + 3] = f"edit{k}"
        rows.append((n, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == all_pairs(rows)


def test_similarity_follows_the_order():
    a = near_dedup.kmers(np.arange(100))
    swapped = near_dedup.kmers(np.concatenate([np.arange(50, 100), np.arange(50)]))
    assert near_dedup.similarity(a, a) == 1 and near_dedup.similarity(a, swapped) < 0.6
    again = near_dedup.kmers(np.tile(np.arange(3), 20))
    assert len(set(again.tolist())) == len(again)


def test_odd_rows(spark):
    docs = documents(spark)
    got = defaultdict(set)
    for r in near_dedup.classes(docs).collect():
        got[r.doc_id].add(r.class_id)
    assert got[4] == {4} and got[2] == {2} and got[3] == {3}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "None"])
    assert near_dedup.classes(empty(spark)).count() == 0


def test_no_class_is_lost_where_ids_are_null_or_repeat(spark):
    draw = random.Random(12)
    body = lambda: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c, d, e = (body() for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (5, a + " x"), (7, d), (7, e), (7, e), (9, d + " y"), (None, b), (3, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.classes(docs).collect()
    keys = {r.class_key for r in got if r.node}
    assert len(keys) == 5 and len(got) == len(rows)
    assert sorted(str(r.class_id) for r in got) == sorted(["5", "5", "None", "None", "None", "7", "7", "7", "7", "3", "None"])
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(5, a + " x"), (None, b), (None, c), (7, d), (7, e), (3, ""), (None, None)], key=str)


def test_pipeline_keeps_documents_without_ids(spark, tmp_path):
    draw = random.Random(13)
    body = lambda: " ".join(draw.choice([f"w{i}" for i in range(300)]) for _ in range(60))
    docs = [(None if i % 2 else i, body(), "en", "s", 0) for i in range(60)] + [(4, body(), "en", "s", 0)]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(0, 60, 2)]
    docs = [(i, t + " nincompoop nincompoop" if i is not None and i % 8 == 0 else t, *r) for i, t, *r in docs]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [t for _, t, *_ in docs if "nincompoop" not in t]
    near = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert near.count() == len(docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(clean)


def test_pipeline(spark, tmp_path):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(300):
        body = [draw.choice(words) for _ in range(60)]
        if i % 4 == 0:
            body[10], body[30] = "nincompoop", "nincompoop"
        docs.append((i, " ".join(body) + ("\nall rights reserved" if i % 2 else ""), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    docs.append((1000, docs[1][1] + " more", "en", "s", 0))
    leaked = " ".join(f"leak{i}" for i in range(12))
    docs.append((1001, " ".join(words[:20]) + " " + leaked, "en", "s", 0))
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, leaked)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in range(300) if i % 4}
    import hashlib

    assert got[1].decoded_sha256 == hashlib.sha256(docs[1][1].split("\n")[0].encode()).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "encoding"]
