"""MinHash near-dedup with Order MinHash, verified by banded alignment.

A text is its sequence of words (A-Z lower-cased, letters, digits and non-ASCII), cut into k-mers of
SHINGLE words, each labelled with how often it has occurred before. A sketch takes the PICKED k-mers
of lowest hash and keeps them in text order, so it agrees only where the picked k-mers and their
order do; SKETCHES independent ones are taken. Texts of SHORT k-mers or fewer also get SHORT_SKETCHES
sketches of two k-mers. Two texts at similarity 0.8 share a sketch with probability above 0.99999.

Similarity comes from an alignment of the two k-mer sequences: the longest chain of equal labelled
k-mers that ascends in both texts, within the band of diagonals that `similarity` leaves open; its
length over the k-mers of both less the chain is the similarity. Texts at `similarity` or more are
linked, and classes are the connected components of the links.

Texts with the same words are one node from the start. In a bucket of up to BUCKET nodes all pairs
are candidates; in a larger one every node meets the LEADERS nodes that share most sketches overall
(in a group of near copies, its centre) and its NEIGHBOURS successors in a hashed order of its slice
of the bucket. Each node is
first aligned with the candidate it shares most sketches with; pairs that this leaves in different
components are then all aligned. Then every large bucket that still holds several components is taken
whole: all pairs of its nodes in different components are candidates, in blocks of SLICE by SLICE
nodes, without those that their lengths or the parities of their k-mers prove to lie below
`similarity`. So no two nodes that share a sketch are left unaligned unless they are already in one
class or cannot reach `similarity`. Components are found by label propagation over stored tables.

Texts without words (null, empty) are classes of their own. Repeated rows fall into the class of their
words, whatever their ids, and so do rows without an id. class_id is the lowest id of the class, null where
it has none; several classes can share that where ids repeat or are null, so class_key tells them apart, and
one row of each stays. Only the id and the text are
read, so extra columns of any name play no part; keep_one() returns them as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, named_again, numbered, sliced, small, stored
from corpusloom.llm.decontaminate import words

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, PICKED = 32, 5
SHORT, SHORT_SKETCHES, SHORT_PICKED = 24, 16, 2
BUCKET = 8
LEADERS = 3
NEIGHBOURS = 2
SLICE = 200
PARITIES = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(20_231).integers(1, 2**63 - 1, SKETCHES + SHORT_SKETCHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers of a sequence of word hashes; a shorter sequence is one k-mer."""
    k = min(SHINGLE, len(hashes))
    if not k:
        return np.zeros(0, np.uint64)
    h = hashes.astype(np.uint64)
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = mixed(out * _MIX + h[i : len(h) - k + 1 + i])
    order = np.argsort(out, kind="stable")
    ordered = out[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if not fresh.all():
        at = np.arange(len(out))
        seen = np.zeros(len(out), np.uint64)
        seen[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
        out = np.where(seen > 0, mixed(out + seen * _MIX), out)
    return out


def order_sketches(labelled: np.ndarray) -> list[int]:
    """Order-MinHash values of a text's labelled k-mers."""
    plans = [(0, SKETCHES, PICKED)] * (len(labelled) >= PICKED) + [(SKETCHES, SKETCHES + SHORT_SKETCHES, SHORT_PICKED)] * (0 < len(labelled) <= SHORT)
    out: list[int] = []
    for lo, hi, picked in plans:
        picked = min(picked, len(labelled))
        for j in range(lo, hi, 8):  # eight at a time, so that a long text needs little memory
            scored = labelled[None] * _FACTORS[j : j + 8, None]
            scored ^= scored >> np.uint64(32)
            at = np.argpartition(scored, picked - 1, axis=1)[:, :picked] if picked < len(labelled) else np.tile(np.arange(picked), (len(scored), 1))
            value = np.arange(j, j + len(scored), dtype=np.uint64) + np.uint64(1)
            for chosen in np.sort(at, axis=1).T:
                value = mixed(value * _MIX + labelled[chosen])
            out += value.astype(np.int64).tolist()
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned k-mers over all k-mers of two labelled sequences; 0 where they cannot reach `least`."""
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # a chain long enough leaves at most this many k-mers of the longer text unaligned, so no match lies further off the diagonal
    band = max(len(a), len(b)) - int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i, kind="stable")]
    if len(j) < 2 or (np.diff(j) > 0).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        chain = len(tails)
    return chain / (len(a) + len(b) - chain)


def parities(labelled: np.ndarray) -> np.ndarray:
    """PARITIES bits as longs: whether an odd number of the labelled k-mers falls to a bit. Two texts differ in no more bits than k-mers."""
    odd = np.bincount((labelled % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, hashes): node is the digest of the words, null without words."""
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    return rows.select("id", F.when(F.size("w") > 0, F.md5(F.concat_ws(" ", "w").cast("binary"))).alias("node"), F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"))


def sketched(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            labelled = [kmers(np.asarray(h, np.int64)) for h in b["hashes"]]
            columns = {"sigs": map(order_sketches, labelled), "n": map(len, labelled), "bits": map(parities, labelled)}
            yield pd.DataFrame({"id": b["id"], "node": b["node"], **{k: pd.Series(list(v), dtype=object, index=b.index) for k, v in columns.items()}})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, node string, sigs array<long>, n int, bits array<long>")


def buckets(distinct: DataFrame) -> DataFrame:
    """(sig, node, size): the sketches that several nodes share."""
    exploded = distinct.select("node", F.explode(F.array_distinct("sigs")).alias("sig"))
    shared = exploded.groupBy("sig").agg(F.count("*").alias("size")).filter("size > 1")
    return exploded.join(shared, "sig")


def candidates(full: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of nodes to be aligned first, a < b, and how often each came up."""
    few = full.filter(F.col("size") <= BUCKET).select("sig", "node")
    pairs = few.alias("x").join(few.alias("y"), "sig").filter("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = full.filter(F.col("size") > BUCKET)
    central = many.groupBy("node").agg(F.sum("size").alias("central"))
    # a large bucket is dealt out as slices of about SLICE nodes; leaders are the best of the slices' best
    sliced = many.join(central, "node").withColumn("slice", F.pmod(F.xxhash64("sig", "node"), F.ceil(F.col("size") / SLICE)))
    by_rank = [F.col("central").desc(), F.col("node")]
    of_slices = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("sig", "slice").orderBy(*by_rank))).filter(F.col("rank") <= LEADERS)
    leaders = of_slices.withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy(*by_rank))).filter(F.col("rank") <= LEADERS).select("sig", F.col("node").alias("leader"))
    starred = many.select("sig", "node").join(leaders, "sig").filter("node <> leader").select("node", F.col("leader").alias("other"))
    in_turn = Window.partitionBy("sig", "slice").orderBy(F.xxhash64("node", "sig"), "node")
    others = F.array_compact(F.array(*[F.lag("node", k).over(in_turn) for k in range(1, NEIGHBOURS + 1)]))
    chained = sliced.select("node", others.alias("others")).select("node", F.explode("others").alias("other"))
    wide = starred.unionByName(chained).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    return pairs.unionByName(wide).groupBy("a", "b").agg(F.count("*").alias("shared"))


def open_pairs(full: DataFrame, roots: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """(a, b, shared): all pairs of large buckets whose nodes lie in different components and may reach `least`."""
    rooted = full.filter(F.col("size") > BUCKET).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = rooted.groupBy("sig", "root").agg(F.count("*").alias("part"))
    # a bucket's largest component meets the others only, so that its own pairs are never made
    largest = parts.groupBy("sig").agg(F.max_by("root", F.struct("part", "root")).alias("major"), (F.sum("part") - F.max("part")).alias("rest")).filter("rest > 0")
    placed = stored(rooted.join(largest, "sig").select("sig", "node", "root", "size", "rest", (F.col("root") == F.col("major")).alias("in_major")), "near-open")
    marks = distinct.select("node", "n", "bits").join(placed.select("node").distinct(), "node", "left_semi")
    dealt = lambda n: F.pmod(F.xxhash64("node", "sig"), F.ceil(F.col(n) / SLICE))
    turns = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / SLICE) - 1))
    placed = placed.join(marks, "node")
    x = placed.filter("NOT in_major").withColumn("row", dealt("rest")).withColumn("column", turns("size")).alias("x")
    y = placed.withColumn("column", dealt("size")).withColumn("row", turns("rest")).alias("y")
    both = F.col("x.n") + F.col("y.n")
    unlike = sum((F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k])) for k in range(PARITIES // 64)), F.lit(0))
    met = (
        (F.col("x.root") != F.col("y.root"))
        & (F.col("y.in_major") | (F.col("x.node") < F.col("y.node")))
        & (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n") - 1e-6)
        & (unlike <= both * (1 - 2 * least / (1 + least)) + 1e-6)
    )
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.column") == F.col("y.column")) & met)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def sequences_of(docs: DataFrame, id_col: str, text_col: str, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes of pairs. Only the texts of one row of each are cut into words again, found by its id."""
    wanted = distinct.select("node", "first_id").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    ids = small(wanted.select(F.col("first_id").alias("wanted_id")).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    return nodes(chosen, "id", "text").filter("node IS NOT NULL").dropDuplicates(["node"]).select("node", "hashes")


def linked(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The pairs whose alignment reaches `least`."""
    left, right = (sequences.select(F.col("node").alias(k), F.col("hashes").alias(f"{k}_h")) for k in "ab")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            keep = [similarity(kmers(np.asarray(x, np.int64)), kmers(np.asarray(y, np.int64)), least) >= least for x, y in zip(b["a_h"], b["b_h"])]
            yield b.loc[keep, ["a", "b"]]

    return joined.mapInPandas(run, "a string, b string")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the lowest node of each component, by label propagation with shortcuts."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "near-labels")
    last = labels
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        jumped = labels.join(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), "root")
        stepped = jumped.join(offered.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "far", "near").alias("next"), (F.least("far", "near") < F.col("root")).alias("moved"))
        stepped = stored(stepped, "near-labels")
        discard(last)
        last, labels = stepped, stepped.select("node", F.col("next").alias("root"))
        if not stepped.filter("moved").limit(1).count():
            return labels


def with_links(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links: these are taken between the roots they join, so that what is one component already isn't walked again."""
    if roots is None:
        return components(links)
    a, b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in "ab")
    rooted = stored(links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")), "near-links")
    over = components(rooted.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("above"))
    ends = rooted.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return stored(roots.unionByName(ends).join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "near-labels")


def joined_up(pairs: DataFrame, sequences: DataFrame, least: float, roots: DataFrame | None = None) -> DataFrame:
    """The components after all pairs: each node's likeliest is aligned first, then those in different components."""
    likely = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "shared").groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("p"))
    roots = with_links(roots, stored(linked(likely.select("p.a", "p.b").distinct(), sequences, least), "near-links"))
    a, b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in "ab")
    apart = pairs.join(a, "a", "left").join(b, "b", "left").filter("a_root IS NULL OR b_root IS NULL OR a_root <> b_root")
    second = stored(linked(apart, sequences, least), "near-links")
    return with_links(roots, second) if second.limit(1).count() else roots


def classed(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each row, and (node, first_id, root) of each node: root is the node by which its class goes."""
    rows = stored(sketched(nodes(docs, id_col, text_col)), "near-sketches")
    distinct = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("sigs").alias("sigs"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("id").alias("first_id"))
    full = stored(buckets(distinct.select("node", "sigs")), "near-buckets")
    pairs = stored(candidates(full), "near-pairs")
    sequences = stored(sequences_of(docs, id_col, text_col, distinct, pairs), "near-sequences")

    roots = joined_up(pairs, sequences, least)
    late = stored(open_pairs(full, roots, distinct, least), "near-pairs")
    if late.limit(1).count():
        roots = joined_up(late, sequences, least, roots)

    named = distinct.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows.select("id", "node"), named


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, node (null without words), class_id and class_key.

    class_key tells all classes apart, those too that have no id or share their lowest id; null without words.
    """
    rows, named = classed(docs, id_col, text_col, least)
    lowest = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    ids = named.select("node", "root").join(lowest, "root").select("node", "class_id", F.col("root").alias("class_key"))
    return rows.join(ids, "node", "left").select(F.col("id").alias(id_col), "node", F.coalesce("class_id", F.when(F.col("node").isNull(), F.col("id"))).alias("class_id"), "class_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of its lowest id, one of them where several rows hold it or no row has one. Rows without words all stay."""
    _, named = classed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", least)
    chosen = named.groupBy("root").agg(F.min_by(F.struct("node", "first_id"), F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("c")).select(F.col("c.node").alias("first_node"), "c.first_id")
    inner, (doc, text) = numbered(docs, id_col, text_col)
    marked = inner.withColumn("w", words(F.col(text)))
    marked = marked.withColumn("node", F.when(F.size("w") > 0, F.md5(F.concat_ws(" ", "w").cast("binary")))).drop("w")
    alone = marked.filter("node IS NULL")
    kept = marked.join(chosen, (F.col("node") == F.col("first_node")) & F.col(doc).eqNullSafe(F.col("first_id")), "left_semi")
    return named_again(kept.dropDuplicates(["node"]).unionByName(alone), docs, {})
