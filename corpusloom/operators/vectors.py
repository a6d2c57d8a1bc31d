"""Vector search for whole tables of queries, and the upkeep of vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tables import saved, small
from corpusloom.operators.retrieval import DECIMALS, rrf, top

#: Bytes of query vectors that go to every task at once; more queries are answered in several passes over the corpus.
BLOCK_BYTES = 64 << 20
#: Queries that a task holds a batch's scores of at once.
SLICE = 256
BITS = 512
#: Of each batch of vectors, the part that approximate search scores exactly.
SHARE, LEAST_SCORED = 0.05, 50


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix, without Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1, and which had no length."""
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n == 0, 1, n)[:, None], n == 0


def blocks(queries: DataFrame, dim: int) -> list[DataFrame]:
    """The queries in as many parts as keep each within BLOCK_BYTES."""
    n = -(-queries.count() * dim * 8 // BLOCK_BYTES) or 1
    return [queries.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) for k in range(n)] if n > 1 else [queries]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, equal ones in order."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


class Nearest:
    """The k best vectors of each query that a task has seen so far, equal scores in order of ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.rids = k, np.zeros((n, 0)), np.zeros((n, 0), np.int64)

    def add(self, scores: np.ndarray, rids: np.ndarray) -> None:
        """scores and rids: a row each query."""
        scores, rids = np.hstack([self.scores, scores]), np.hstack([self.rids, rids])
        if scores.shape[1] > self.k:
            order = np.lexsort((rids, -scores), axis=1)[:, : self.k]
            scores, rids = np.take_along_axis(scores, order, 1), np.take_along_axis(rids, order, 1)
        self.scores, self.rids = scores, rids

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        keep = self.scores.ravel() > -np.inf
        columns = [np.repeat(qids, self.scores.shape[1]), self.rids.ravel(), self.scores.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["qid", "rid", "score"])


def of_length(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors that can be compared with those of dim components; normalize_vectors() says what is wrong with others."""
    return vectors.filter((F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull()))


def asked_blocks(queries: DataFrame) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The queries' length (the longest one's; others are left out), and (ids, vectors) of each block of BLOCK_BYTES at most."""
    asked = queries.select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    dim = asked.agg(F.max(F.size("embedding"))).first()[0] or 0
    out = []
    for block in blocks(of_length(asked, dim), dim) if dim > 0 else []:
        rows = block.toPandas()  # BLOCK_BYTES at most
        if len(rows):
            out.append((rows["qid"].to_numpy(), np.array(rows["embedding"].tolist(), float).reshape(len(rows), dim)))
    return dim, out


def searched(index: DataFrame, queries: DataFrame, k: int, score) -> DataFrame:
    """(qid, rid, score, rank): the k best of what score(unit queries, which have no length, the queries as given) offers of a batch, for a slice of the queries, as (scores, rids).

    The corpus stays where it is: a task goes through its batches and gives the k best of each query once, at
    its end, so that no more than k rows a query and task are shuffled. SLICE queries meet a batch at a time, so a task's
    memory grows with k rows a query and not with the scores of a whole batch.
    """
    dim, asked = asked_blocks(queries)
    found = None
    for qids, raw in asked:
        shared = queries.sparkSession.sparkContext.broadcast((*unit(raw), raw))

        def run(batches: Iterator[pa.RecordBatch], qids=qids, shared=shared) -> Iterator[pa.RecordBatch]:
            slices = [slice(lo, min(lo + SLICE, len(qids))) for lo in range(0, len(qids), SLICE)]
            nearest = [Nearest(x.stop - x.start, k) for x in slices]
            work = score(*shared.value)
            for batch in batches:
                if batch.num_rows:
                    offered = work(batch)
                    for x, some in zip(slices, nearest):
                        some.add(*offered(x))
            for x, some in zip(slices, nearest):
                yield some.batch(qids[x])

        one = index.mapInArrow(run, "qid long, rid long, score double")
        found = one if found is None else found.unionByName(one)
    return top(found, k) if found is not None else top(queries.sparkSession.createDataFrame([], "qid long, rid long, score double"), k)


def cosines(q: np.ndarray, q0: np.ndarray, m: np.ndarray, m0: np.ndarray) -> np.ndarray:
    scores = np.round(q @ m.T, DECIMALS)
    scores[q0] = -1
    scores[:, m0] = -1
    return scores


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rid, score, rank): the k vectors of highest cosine; vectors without length score -1, ties in id order.

    Vectors of another length than the queries' can't be compared and are left out.
    """
    dim = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    corpus = of_length(vectors, dim).select(F.col("vec_id").alias("rid"), "embedding")

    def score(q: np.ndarray, q0: np.ndarray, raw: np.ndarray):
        def work(batch: pa.RecordBatch):
            rids, (m, m0) = batch.column(0).to_numpy(zero_copy_only=False), unit(matrix(batch.column(1)))

            def offered(x: slice) -> tuple[np.ndarray, np.ndarray]:
                scores = cosines(q[x], q0[x], m, m0)
                return scores, np.broadcast_to(rids, scores.shape)

            return offered

        return work

    return searched(corpus, queries, k, score)


def planes(dim: int, bits: int = BITS) -> np.ndarray:
    """The hyperplanes of the codes: the same for every table of one dimension."""
    return np.random.default_rng(20_251).normal(size=(dim, bits))


def codes(vectors: DataFrame, dim: int, bits: int = BITS) -> DataFrame:
    """(rid, code, embedding): on which side of each hyperplane a vector lies. Every vector is indexed; no label or sample is needed."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes(dim, bits)
        for batch in batches:
            if batch.num_rows:
                packed = np.packbits(matrix(batch.column(1)) @ p > 0, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), batch.column(1)], ["rid", "code", "embedding"])

    usable = of_length(vectors, dim).select(F.col("vec_id").alias("rid"), "embedding")
    return saved(usable.mapInArrow(sign, f"rid long, code binary, embedding {usable.schema['embedding'].dataType.simpleString()}"), "vector-codes")


def knn_approx(queries: DataFrame, index: DataFrame, k: int = 10, share: float = SHARE, least: int = LEAST_SCORED) -> DataFrame:
    """(qid, rid, score, rank): of codes(), in each batch the `share` whose codes differ least from a query's, `least` at least, are scored exactly where they lie.

    A comparison of codes is eight operations on words, whatever the vectors' length; a cosine takes as many as they
    have components. Neither leaves the task: it gives k rows a query at its end.
    """

    def score(q: np.ndarray, q0: np.ndarray, raw: np.ndarray):
        signs = np.packbits(raw @ planes(raw.shape[1]) > 0, axis=1).view(np.uint64)

        def work(batch: pa.RecordBatch):
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(rids), -1)
            m, m0 = unit(matrix(batch.column(2)))
            n = min(len(rids), max(least, k, int(share * len(rids))))

            def offered(x: slice) -> tuple[np.ndarray, np.ndarray]:
                scores, found = np.empty((x.stop - x.start, n)), np.empty((x.stop - x.start, n), np.int64)
                for k, i in enumerate(range(x.start, x.stop)):
                    far = np.bitwise_count(own ^ signs[i]).sum(1, dtype=np.int32)
                    at = np.argpartition(far, n - 1)[:n] if n < len(rids) else np.arange(n)
                    scores[k], found[k] = cosines(q[i : i + 1], q0[i : i + 1], m[at], m0[at])[0], rids[at]
                return scores, found

            return offered

        return work

    return searched(index, queries, k, score)


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, u: s + u)
    length = dot(a, a) * dot(b, b)
    return F.round(F.when(length > 0, dot(a, b) / F.sqrt(length)).otherwise(-1.0), DECIMALS)


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Candidates (qid, rid) reordered by exact cosine: (qid, rid, score, rank)."""
    asked = queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    held = vectors.select(F.col("vec_id").alias("rid"), F.col("embedding").alias("v"))
    return top(candidates.join(held, "rid").join(asked, "qid").select("qid", "rid", cosine("q", "v").alias("score")), k)


def hybrid(keyword: DataFrame, vector: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rid, score, rank): both lists fused where a query has a vector ranking, its keyword list unchanged where it has none (score null)."""
    asked = vector.select("qid").distinct()
    fused = rrf([keyword.join(asked, "qid", "left_semi"), vector], k)
    alone = keyword.join(asked, "qid", "left_anti").filter(F.col("rank") <= k)
    return fused.unionByName(alone.select("qid", "rid", F.lit(None).cast("double").alias("score"), F.col("rank").cast("long").alias("rank")))


def map_to_units(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """(qid, unit, rank) of hits (qid, location, line, rank): each goes to the unit (unit, location, first, last) whose lines hold it; a unit's first hit counts and ranks close up."""
    asked = small(hits.select("location").distinct())
    held = ranges.join(asked, "location", "left_semi").select("unit", "location", F.explode(F.sequence("first", "last")).alias("line"))
    units = hits.join(held, ["location", "line"]).groupBy("qid", "unit").agg(F.min("rank").alias("first_rank"))
    return units.select("qid", "unit", F.row_number().over(Window.partitionBy("qid").orderBy("first_rank", "unit")).cast("long").alias("rank"))


def stitch(live: DataFrame, other: DataFrame, items: DataFrame) -> DataFrame:
    """(id, embedding, origin): each item's vector from the live table, else from the other one, else null (origin missing)."""
    a, b = (t.select("id", F.col("embedding").alias(n)) for t, n in ((live, "a"), (other, "b")))
    both = items.select("id").join(a, "id", "left").join(b, "id", "left")
    origin = F.when(F.col("a").isNotNull(), "live").when(F.col("b").isNotNull(), "other").otherwise("missing")
    return both.select("id", F.coalesce("a", "b").alias("embedding"), origin.alias("origin"))


def stitch_violations(live: DataFrame, other: DataFrame, items: DataFrame, dim: int, step: int = 1, least: float = 0.98) -> DataFrame:
    """(rule, id) that forbid stitching: wrong dimensions, items in neither table, and shared ids, each step-th by id, whose vectors disagree."""
    wrong = live.unionByName(other).filter(F.size("embedding") != dim).select(F.lit("dimension").alias("rule"), "id")
    missing = stitch(live, other, items).filter("origin = 'missing'").select(F.lit("missing").alias("rule"), "id")
    shared = live.select("id", F.col("embedding").alias("a")).join(other.select("id", F.col("embedding").alias("b")), "id")
    sampled = shared.filter((F.pmod(F.col("id"), F.lit(step)) == 0) & (F.size("a") == F.size("b")))
    apart = sampled.filter(cosine("a", "b") < least).select(F.lit("disagree").alias("rule"), "id")
    return wrong.unionByName(missing).unionByName(apart)
