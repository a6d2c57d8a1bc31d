"""Retrieval metrics, gold-set scoring and trace analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(ranked: DataFrame, qrels: DataFrame, depth: int = 10) -> DataFrame:
    """One row: questions with an answer, MAP (over all relevant), MRR and recall at `depth`."""
    relevant = qrels.groupBy("qid").agg(F.count("*").alias("n_rel"))
    got = ranked.filter(F.col("rank") <= depth).join(qrels, ["qid", "rid"])
    hits = F.count("*").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    per = got.withColumn("precision", hits / F.col("rank")).groupBy("qid").agg(F.sum("precision").alias("ap"), F.min("rank").alias("first"), F.count("*").alias("found"))
    joined = relevant.join(per, "qid", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return joined.agg(F.count("*").alias("questions"), mean(F.col("ap") / F.col("n_rel")).alias("map"), mean(1 / F.col("first")).alias("mrr"), mean(F.col("found") / F.col("n_rel")).alias("recall"))


def hit_at(ranked: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """One row over all questions: how many have a gold item in the first 1, 5 and 10, and MRR at 10."""
    first = ranked.join(gold, ["qid", "rid"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    all_ = questions.select("qid").join(first, "qid", "left")
    at = lambda n: F.count_if(F.col("first") <= n).alias(f"hit_{n}")
    return all_.agg(F.count("*").alias("questions"), at(1), at(5), at(10), F.round(F.avg(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)), 6).alias("mrr"))


def missing_gold(gold: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, missing, none_left): labelled ids that the corpus lacks, per question that has any."""
    known = items.select("rid").withColumn("known", F.lit(True))
    per = gold.join(known, "rid", "left").groupBy("qid").agg(F.count_if(F.col("known").isNull()).alias("missing"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("any"))
    return per.filter("missing > 0").select("qid", "missing", (~F.col("any")).alias("none_left"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, rid, rank_a, rank_b, shift) wherever two runs place an item differently."""
    left, right = a.select("qid", "rid", F.col("rank").alias("rank_a")), b.select("qid", "rid", F.col("rank").alias("rank_b"))
    return left.join(right, ["qid", "rid"], "full_outer").filter("NOT (rank_a <=> rank_b)").withColumn("shift", F.col("rank_b") - F.col("rank_a"))


def summarize(rows: DataFrame, by: list[list[str]], measures: list[Column]) -> DataFrame:
    """One row per value of each grouping set; keys outside a set are null."""
    keys = list(dict.fromkeys(k for s in by for k in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in by], *[F.col(k) for k in keys]).agg(*measures)


def consistency(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_runs")).withColumn("same", F.col("n_values") == 1)


def stratified(df: DataFrame, key: str, id_col: str, n: int, seed: str) -> DataFrame:
    """The n rows of each stratum that come first by a seeded digest of their id."""
    order = Window.partitionBy(key).orderBy(F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256))
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def duration_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, nearest-rank 95th percentile and maximum by group."""
    disc = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.median(value), 6).alias("median"), F.round(disc, 6).alias("p95"), F.round(F.max(value), 6).alias("most"))


def cost_summary(calls: DataFrame, by: list[str], cost: str) -> DataFrame:
    """Known cost, calls of unknown cost (which is not 0), and whether the cost is complete."""
    known = F.sum(cost)
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), known.alias("known_cost"), F.count_if(F.col(cost).isNull()).alias("unknown")).withColumn("complete", F.col("unknown") == 0)


def loss_summary(events: DataFrame, counts: str) -> DataFrame:
    """(stage, key, answers, total) over a map column of counts."""
    rows = events.select("stage", "answer", F.explode(counts).alias("key", "n"))
    return rows.groupBy("stage", "key").agg(F.count_distinct("answer").alias("answers"), F.sum("n").alias("total"))


def label_agreement(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(expected, got, n): confusion counts; a null expectation matches anything and is left out."""
    joined = expected.filter("expected IS NOT NULL").join(got, key)
    return joined.groupBy("expected", "got").agg(F.count("*").alias("n"))


def assemble(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Each request with the number of its events and whether one says that the work is done."""
    per = events.groupBy("request_id").agg(F.count("*").alias("n_events"), F.bool_or(F.col("kind") == "completed").alias("done"))
    return requests.join(per, "request_id", "left").select(requests["*"], F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("done", F.lit(False)).alias("done"))


def score_gold(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, status_ok, covered): the status that was expected, and the share of key points covered: 0 if unanswered, null if answered but not judged."""
    joined = gold.join(answers, "id", "left")
    share = F.size(F.filter("covered", lambda c: c)) / F.size("covered")
    covered = F.when(F.coalesce(F.col("status") != "answered", F.lit(True)), 0.0).when(F.col("covered").isNull(), None).otherwise(share)
    return joined.select("id", F.coalesce(F.col("status") == F.col("expect"), F.lit(False)).alias("status_ok"), covered.alias("covered"))


def gold_regressions(before: DataFrame, after: DataFrame, drop: float = 0.25) -> DataFrame:
    """(id, was, now): rows whose share of covered points fell by `drop` or more."""
    joined = before.select("id", F.col("covered").alias("was")).join(after.select("id", F.col("covered").alias("now")), "id")
    return joined.filter(F.col("was") - F.col("now") >= drop)


TRACE = "schema_version int, request_id string, endpoint string, http_status int, duration_ns bigint, events array<struct<kind:string,stage:string,cost:decimal(18,9)>>"


def parse_traces(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, skipped) of log lines `value`: what follows TRACE, with version 1 and a request; other lines without the word are ignored."""
    rows = lines.select(F.regexp_extract("value", "TRACE (.*)$", 1).alias("json")).filter("json <> ''").select("json", F.from_json("json", TRACE).alias("t"))
    good = F.coalesce((F.col("t.schema_version") == 1) & F.col("t.request_id").isNotNull(), F.lit(False))
    return rows.filter(good).select("t.*"), rows.filter(~good).select("json")


def one_revision(traces: DataFrame, revision: str) -> DataFrame:
    """traces, if all come from one revision; else an error, since different deployments must not be pooled."""
    found = [r[0] for r in traces.select(revision).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"traces of several revisions: {sorted(map(str, found))}")
    return traces


def revisions(traces: DataFrame, group: str, revision: str) -> DataFrame:
    """(group, n_revisions, pooled): groups whose traces may be pooled hold one revision."""
    return traces.groupBy(group).agg(F.count_distinct(revision).alias("n_revisions")).withColumn("pooled", F.col("n_revisions") <= 1)


def judgement_diff(together: DataFrame, alone: DataFrame, key: list[str]) -> DataFrame:
    """(key, together, alone, risky) where two readings (key, ok) differ; risky: accepted together, rejected alone."""
    both = together.select(*key, F.col("ok").alias("together")).join(alone.select(*key, F.col("ok").alias("alone")), key)
    return both.filter("together <> alone").withColumn("risky", F.col("together") & ~F.col("alone"))


def unanswered_review(replies: DataFrame, hits: DataFrame, since, weak: float = 0.34) -> DataFrame:
    """(qid, notes) of replies (qid, at, status) that abstained from `since` on: no match, a weak or a strong best match (hits: qid, rank, coverage)."""
    best = hits.filter("rank = 1").select("qid", "coverage")
    rows = replies.filter((F.col("at") >= since) & (F.col("status") == "abstained")).join(best, "qid", "left")
    match = F.when(F.col("coverage").isNull(), "no match").when(F.col("coverage") < weak, "weak match").otherwise("strong match")
    return rows.select("qid", match.alias("note"))


def style_audit(answers: DataFrame, limits: DataFrame, words: list[str]) -> DataFrame:
    """(answer, flag) of sentences (answer, style, text): more of them or longer ones than the style's limits (style, sentences, longest), or a listed word."""
    sized = answers.withColumn("n", F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))).withColumn("hard", F.col("text").rlike("(?:" + "|".join(words) + ")"))
    rows = sized.groupBy("answer", "style").agg(F.count("*").alias("n_sentences"), F.max("n").alias("longest_words"), F.bool_or("hard").alias("hard")).join(F.broadcast(limits), "style")
    flags = F.array_compact(F.array(F.when(F.col("n_sentences") > F.col("sentences"), F.lit("too many sentences")), F.when(F.col("longest_words") > F.col("longest"), F.lit("a sentence too long")), F.when(F.col("hard"), F.lit("hard words"))))
    return rows.select("answer", F.explode(flags).alias("flag"))


def shared_trigrams(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, share): of the three-word pieces of one text (qid, text), how many the other text of the same question holds."""
    pieces = lambda df, name: df.select("qid", F.array_distinct(F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).otherwise(F.array().cast("array<string>"))).alias(name))
    split = lambda df: df.select("qid", F.filter(F.split("text", "\\s+"), lambda x: x != "").alias("w"))
    both = pieces(split(a), "x").join(pieces(split(b), "y"), "qid")
    return both.select("qid", F.round(F.when(F.size("x") == 0, 0.0).otherwise(F.size(F.array_intersect("x", "y")) / F.size("x")), 6).alias("share"))
