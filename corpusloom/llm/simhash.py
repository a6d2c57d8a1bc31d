"""SimHash near-dedup with BK-trees.

A text is its words (runs of anything but white space, A-Z lower-cased) and its fingerprint 64 bits: bit k
is set if more than half of the text's shingles of SHINGLE words, repeats included, have bit k set in
their XXH64 (seed 42). Fewer words are one shingle; a text without words (null, empty, blank) has
fingerprint zero, which is linked like any other. Fingerprints that differ in RADIUS bits or fewer are
linked, and components are those of the links.

Distinct fingerprints are dealt out to shards so that no link is lost: the 64 bits are cut into blocks,
and of two fingerprints within RADIUS bits all blocks but RADIUS agree. Each choice of that many blocks
is a table, and its bits name a shard, so each fingerprint stands in one shard of every table and two
linked ones share at least one. More blocks make more tables of finer shards; their number follows from
the number of fingerprints.

A shard's fingerprints form a BK-tree: a node's children are keyed by their Hamming distance to it, and
all fingerprints below a child have that distance to the node. A search from a fingerprint at distance d
of a node follows only the edges d - RADIUS to d + RADIUS. The trees of many shards are built and
searched together, a level at a time. A shard of more than PIECE fingerprints is cut into pieces with a
tree each. First every piece meets its own tree and that of the shard's first piece, and what this links
is joined up. Then, in shards that still hold several components, every fingerprint outside the shard's
largest component meets all of the shard's trees, each sent to every piece of these, links within a
component left out. A task returns no pairs but each fingerprint's link to the first of those it is
linked with there, so that a group of copies costs no more rows than it has fingerprints.

Trees reach their searches by a shuffle on the shard: sending them all through the driver would gather
the fingerprints of all documents there.

Repeated rows and ids share a component; component_id is the lowest id in it, null where no row has one.
Only the id and the text are read, so extra columns of any name play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small, stored
from corpusloom.llm.near_dedup import components, with_links

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A shard should hold about so many fingerprints at most, were they random.
SHARD = 256
#: Fingerprints of one tree.
PIECE = 1024
#: Pairs of a fingerprint and a node that a task looks at together.
AT_ONCE = 2_000_000
#: Bytes of a text cut into words together.
STRETCH = 1 << 20


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    counts, total, carried, rest, text = np.zeros(64, np.int64), 0, [], b"", text or b""
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(text), STRETCH):
        piece = rest + text[lo : lo + STRETCH].lower()
        words = piece.split()
        whole = lo + STRETCH >= len(text)
        rest = b"" if whole or not words or piece[-1:].isspace() else words.pop()
        words = carried + words
        if whole and not total and 0 < len(words) < size:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)]
        carried = words[-(size - 1) :] if size > 1 else []
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
            total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """The bits, as signed longs, whose values name the shards of each table, for n fingerprints."""
    for blocks in range(radius + 1, radius + 5):
        ends = [64 * k // blocks for k in range(blocks + 1)]
        kept = [sum(((1 << (ends[k + 1] - ends[k])) - 1) << ends[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
        if n <= SHARD << min(m.bit_count() for m in kept):
            break
    return [m - (1 << 64) if m >> 63 else m for m in kept]


class Forest:
    """One BK-tree for each group of codes, all built together; node numbers are places in `codes`."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes = codes
        left, at, edges, children, level = np.arange(len(codes)), groups.astype(np.int64), [], [], 0
        while len(left):
            keys, first, which = np.unique(at, return_index=True, return_inverse=True)
            nodes = left[first]
            if level:
                edges.append(keys)
                children.append(nodes)
            else:
                self.groups, self.roots = keys, nodes
            parents, below = nodes[which], np.ones(len(left), bool)
            below[first] = False
            left, parents = left[below], parents[below]
            at, level = parents * 65 + np.bitwise_count(codes[left] ^ codes[parents]), level + 1
        self.edges = np.concatenate([*edges, np.zeros(0, np.int64)])
        self.children = np.concatenate([*children, np.zeros(0, np.int64)])
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]

    def within(self, codes: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of codes, and of the nodes of their group's tree, that differ in `radius` bits or fewer."""
        asked = np.arange(len(codes))
        where = np.minimum(np.searchsorted(self.groups, groups), len(self.groups) - 1)
        nodes = self.roots[where]
        there = self.groups[where] == groups
        asked, nodes, found = asked[there], nodes[there], []
        while len(asked):
            apart = np.bitwise_count(codes[asked] ^ self.codes[nodes]).astype(np.int64)
            near = apart <= radius
            found.append((asked[near], nodes[near]))
            lo = np.searchsorted(self.edges, nodes * 65 + np.maximum(apart - radius, 0))
            n = np.searchsorted(self.edges, nodes * 65 + np.minimum(apart + radius, 64), side="right") - lo
            asked, ends = np.repeat(asked, n), np.cumsum(n)
            nodes = self.children[np.arange(len(asked)) + np.repeat(lo - (ends - n), n)]
        return np.concatenate([x for x, _ in found] or [np.zeros(0, int)]), np.concatenate([y for _, y in found] or [np.zeros(0, int)])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between codes, as a link from each code to the lowest that it is joined with."""
    codes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(codes))
    while True:
        before = low.copy()
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], least)
        np.minimum.at(low, low[y], least)
        low = low[low]
        if (low == before).all():
            break
    others = low != np.arange(len(codes))
    return codes[others], codes[low[others]]


def searched(cells: DataFrame, radius: int) -> DataFrame:
    """(a, b): the links between asked and treed fingerprints of each cell, as stars. Both hold (fp, root); links within a root are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(column: pa.Array) -> tuple[np.ndarray, ...]:
            sizes = np.diff(column.offsets.to_numpy())
            items = column.flatten()
            return sizes, items.field(0).to_numpy().view(np.uint64), items.field(1).to_numpy()

        def links(asked: pa.Array, tree: pa.Array) -> pa.RecordBatch:
            (na, ca, ra), (nt, ct, rt) = flat(asked), flat(tree)
            cells_ = np.arange(len(na))
            x, y = Forest(ct, np.repeat(cells_, nt)).within(ca, np.repeat(cells_, na), radius)
            apart = ra[x] != rt[y]
            a, b = stars(ca[x[apart]].view(np.int64), ct[y[apart]].view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            work = np.cumsum(np.diff(batch.column(0).offsets.to_numpy()) * np.diff(batch.column(1).offsets.to_numpy())) // AT_ONCE
            starts = np.concatenate([[0], np.flatnonzero(np.diff(work)) + 1, [batch.num_rows]]) if batch.num_rows else []
            for lo, hi in zip(starts[:-1], starts[1:]):
                yield links(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))

    return cells.select("asked", "tree").mapInArrow(run, "a long, b long")


def _pieces(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, codes): (fp, root) of each piece, a piece to a row. Dealt out by all keys, so that a large shard's pieces lie apart."""
    return rows.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("fp", "root"))).alias("codes"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root): the lowest fingerprint of each component of the fingerprints of `distinct`(fp), for those that have a link."""
    tables = masks(distinct.count(), radius)
    named = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(tables)])
    placed = distinct.select("fp", F.explode(named).alias("shard")).select("fp", F.col("fp").alias("root"), "shard.t", "shard.key")
    large = stored(placed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > PIECE), "simhash-large")
    dealt = lambda n: F.pmod(F.xxhash64("fp", "t", "key"), F.ceil(F.col(n) / PIECE))
    placed = placed.join(small(large), ["t", "key"], "left").withColumn("piece", F.when(F.col("n").isNull(), 0).otherwise(dealt("n")))
    pieces = stored(_pieces(placed, "t", "key", "piece").filter("size(codes) > 1 OR piece > 0"), "simhash-pieces")
    own = pieces.select(F.col("codes").alias("asked"), F.col("codes").alias("tree"))
    others = pieces.filter("piece > 0").join(pieces.filter("piece = 0").select("t", "key", F.col("codes").alias("tree")), ["t", "key"])
    others = others.repartition("t", "key", "piece").select(F.col("codes").alias("asked"), "tree")
    roots = components(stored(searched(own.unionByName(others), radius).distinct(), "simhash-links"))

    held = pieces.join(small(large), ["t", "key"]).select("t", "key", "n", F.explode("codes.fp").alias("fp"))
    held = stored(held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-held")
    parts = held.groupBy("t", "key", "root").agg(F.count("*").alias("part"))
    open_ = parts.groupBy("t", "key").agg(F.max_by("root", F.struct("part", "root")).alias("major"), (F.sum("part") - F.max("part")).alias("rest")).filter("rest > 0")
    left = held.join(small(stored(open_, "simhash-open")), ["t", "key"])
    trees = _pieces(left.withColumn("piece", dealt("n")), "t", "key", "piece").select("t", "key", "piece", F.col("codes").alias("tree"))
    asked = _pieces(left.filter("root <> major").withColumn("part", dealt("rest")), "t", "key", "part").select("t", "key", "part", F.col("codes").alias("asked"))
    cells = asked.join(trees, ["t", "key"]).repartition("t", "key", "part", "piece")
    late = stored(searched(cells, radius).distinct(), "simhash-links")
    return with_links(roots, late) if late.limit(1).count() else roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fp (signed long) and component_id."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    roots = links(distinct.select("fp"), radius)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = named.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    """classes() with the fingerprint as 16 hexadecimal digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
