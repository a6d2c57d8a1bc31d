"""Line dedup that can be taken back: exact reference counts per line key, with sharded cuckoo filters in front.

A line's key is the line without blanks at both ends, A-Z lower-cased, held as two 64-bit hashes. The
reference table counts the documents that hold a key; documents are added by adding their keys'
counts and deleted by subtracting them, so any state can be reached again. Keys with at least
`least_docs` references form the frequent set. Each shard of that set (by hash) has a cuckoo filter:
16-bit fingerprints, four to a bucket. `Index` keeps both tables; when documents come or go, each
filter takes in the keys that became frequent and gives up those that no longer are, and only a
filter that runs full is built anew. Documents probe the filters; what passes (all frequent lines, and
about one other in 8,000) is joined with the exact table, so a false positive never drops a line.
Filters of up to FILTER_BYTES together go to every task; larger sets are dealt out by shard, and the
keys come to them: a task reads the filter of its shard first, then streams the keys past it, the
keys of a shard being split over PARTS tasks so that a frequent line isn't one task's.

Counts are summed in each task before they are shuffled, so that a line in a third of all documents
is one row a task; the exact join is a plain equi-join that adaptive execution can split.

Null and empty texts are one empty line. Keys shorter than `least_chars` are never dropped. Repeated
rows and ids count as separate documents, null ids too. Columns named as the results give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BLANKS, ascii_lower, doc_key, named_again, numbered, small, stored

LEAST_DOCS = 10
LEAST_CHARS = 1
SHARD_KEYS = 50_000
SLOTS = 4
KICKS = 500
FILTER_BYTES = 64 << 20
PARTS = 16


class Cuckoo:
    """A cuckoo filter over pairs of 64-bit hashes: buckets of SLOTS 16-bit fingerprints, 0 for free."""

    def __init__(self, n_keys: int, table: np.ndarray | None = None):
        self.size = 1 << max(3, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.size, SLOTS), np.uint16) if table is None else table.reshape(-1, SLOTS).copy()
        self.size = len(self.table)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, other bucket)"""
        prints = (h2.astype(np.uint64) % np.uint64(65_535) + np.uint64(1)).astype(np.uint16)
        first = h1.astype(np.uint64) & np.uint64(self.size - 1)
        return prints, first.astype(np.int64), (first ^ self.spread(prints)).astype(np.int64)

    def spread(self, prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.size - 1)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(h1, h2)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if a fingerprint found no place; the caller then makes a larger filter."""
        for p, a, b in zip(*(x.tolist() for x in self.places(h1, h2))):
            for k in range(KICKS):
                free = np.flatnonzero(self.table[a] == 0)
                if not len(free):
                    free, a = np.flatnonzero(self.table[b] == 0), b
                if len(free):
                    self.table[a, free[0]] = p
                    break
                slot = (k * 7 + p) % SLOTS
                p, self.table[a, slot] = int(self.table[a, slot]), p
                b = int(a ^ int(self.spread(np.array([p], np.uint16))[0]))
                a = b
            else:
                return False
        return True

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self.places(h1, h2))):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == p)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


def key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def hashed(k: Column) -> Column:
    return F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def doc_keys(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """The distinct line keys of a text, hashed."""
    return F.transform(F.array_distinct(F.filter(F.transform(lines(text), key), lambda k: F.char_length(k) >= least_chars)), hashed)


def references(docs: DataFrame, text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, n): how many of the documents hold each key."""
    keys = docs.select(F.explode(doc_keys(F.col(text_col), least_chars)).alias("k"))
    return keys.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("n"))


def merge(table: DataFrame, delta: DataFrame, sign: int) -> DataFrame:
    both = table.select("h1", "h2", "n").unionByName(delta.select("h1", "h2", (F.col("n") * sign).alias("n")))
    return both.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 0")


@dataclass
class Index:
    """What line dedup keeps between runs: references (h1, h2, n) and filters (shard, payload) over n_shards shards."""

    references: DataFrame
    filters: DataFrame
    n_shards: int
    n_frequent: int
    least_docs: int = LEAST_DOCS
    least_chars: int = LEAST_CHARS

    def frequent(self) -> DataFrame:
        return self.references.filter(F.col("n") >= self.least_docs).select("h1", "h2")


def build(docs: DataFrame, text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> Index:
    """The index of docs."""
    return from_references(references(docs, text_col, least_chars), least_docs, least_chars)


def from_references(table: DataFrame, least_docs: int, least_chars: int) -> Index:
    table = stored(table, "line-references")
    frequent = table.filter(F.col("n") >= least_docs).select("h1", "h2")
    n_frequent = frequent.count()
    n_shards = max(1, -(-n_frequent // SHARD_KEYS))
    return Index(table, stored(filters(frequent, n_shards), "line-filters"), n_shards, n_frequent, least_docs, least_chars)


def update(index: Index, docs: DataFrame, sign: int, text_col: str = "text") -> Index:
    """The index after documents came (sign 1) or went (-1): counts are merged, and filters change by the keys that crossed least_docs."""
    delta = references(docs, text_col, index.least_chars)
    merged = stored(merge(index.references, delta, sign), "line-references")
    was, now = (t.join(delta.select("h1", "h2"), ["h1", "h2"], "left_semi").filter(F.col("n") >= index.least_docs).select("h1", "h2") for t in (index.references, merged))
    keys = ["h1", "h2"]
    moved = stored(now.join(was, keys, "left_anti").withColumn("comes", F.lit(True)).unionByName(was.join(now, keys, "left_anti").withColumn("comes", F.lit(False))), "line-moves")
    came = {r["comes"]: r["count"] for r in moved.groupBy("comes").count().collect()}
    n_frequent = index.n_frequent + came.get(True, 0) - came.get(False, 0)
    if n_frequent > 4 * SHARD_KEYS * index.n_shards:  # the shards have outgrown their size
        return from_references(merged, index.least_docs, index.least_chars)

    def change(shard: tuple, kept: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        gone, new = moves[~moves["comes"]], moves[moves["comes"]]
        payload = kept["payload"].iloc[0] if len(kept) else None
        made = Cuckoo(len(new)) if payload is None else Cuckoo(1, np.frombuffer(payload, np.uint16))
        made.remove(gone["h1"].to_numpy(), gone["h2"].to_numpy())
        full = not made.add(new["h1"].to_numpy(), new["h2"].to_numpy())
        return pd.DataFrame({"shard": [shard[0]], "payload": [None if full else made.table.tobytes()]})

    dealt = moved.withColumn("shard", shard_of(index.n_shards))
    changed = stored(index.filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(change, "shard int, payload binary"), "line-filters")
    grown = Index(merged, changed, index.n_shards, n_frequent, index.least_docs, index.least_chars)
    if changed.filter("payload IS NULL").limit(1).count():
        full = changed.filter("payload IS NULL").select("shard")
        keys_of = grown.frequent().withColumn("shard", shard_of(index.n_shards)).join(small(full), "shard", "left_semi").select("h1", "h2")
        grown.filters = stored(changed.filter("payload IS NOT NULL").unionByName(filters(keys_of, index.n_shards)), "line-filters")
    return grown


def insert_documents(index: Index, docs: DataFrame, text_col: str = "text") -> Index:
    return update(index, docs, 1, text_col)


def delete_documents(index: Index, docs: DataFrame, text_col: str = "text") -> Index:
    """The index without documents that were inserted before."""
    return update(index, docs, -1, text_col)


def shard_of(n_shards: int) -> Column:
    return F.pmod("h2", F.lit(n_shards)).cast("int")


def filters(frequent: DataFrame, n_shards: int) -> DataFrame:
    """(shard, payload): a cuckoo filter per shard of the frequent keys, SHARD_KEYS of them to one."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2, room = pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), len(pdf)
        while True:
            made = Cuckoo(room)
            if made.add(h1, h2):
                return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "payload": [made.table.tobytes()]})
            room *= 2

    return frequent.select("h1", "h2", shard_of(n_shards).alias("shard")).groupBy("shard").applyInPandas(make, "shard int, payload binary")


def probe_everywhere(keys: DataFrame, index: Index) -> DataFrame:
    """The rows of keys (k1, k2, h1, h2) that the filters may hold; all filters go to every task."""
    shared = keys.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["payload"]) for r in index.filters.collect()})
    n_shards = index.n_shards

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {s: Cuckoo(1, np.frombuffer(x, np.uint16)) for s, x in shared.value.items()}
        for b in batches:
            h1, h2 = b["h1"].to_numpy(), b["h2"].to_numpy()
            passed = np.zeros(len(b), bool)
            shards = h2 % n_shards
            for s, cuckoo in made.items():
                at = np.flatnonzero(shards == s)
                passed[at] = cuckoo.has(h1[at], h2[at])
            yield b[passed]

    return keys.mapInPandas(match, keys.schema)


def probe_by_shard(keys: DataFrame, index: Index) -> DataFrame:
    """The same where all filters together are too large for a task: each key goes to the tasks of its shard, behind the shard's filter."""
    n_shards = index.n_shards
    none = F.lit(0).cast("long")  # no nulls, which pandas would turn the hashes into floats for
    own = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "payload", F.lit("").alias("k1"), none.alias("k2"), none.alias("h1"), none.alias("h2"))
    dealt = keys.select(shard_of(n_shards).alias("shard"), F.pmod(F.xxhash64("k1", "k2"), F.lit(PARTS)).cast("int").alias("part"), F.lit(None).cast("binary").alias("payload"), "k1", "k2", "h1", "h2")
    rows = own.unionByName(dealt).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("payload").isNull())

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, None
        for b in batches:
            for (shard, _), part in b.groupby(["shard", "part"], sort=False):
                if shard != now:
                    now, made = shard, None
                head = part["payload"].notna()
                if head.any():
                    made = Cuckoo(1, np.frombuffer(part.loc[head, "payload"].iloc[0], np.uint16))
                asked = part[~head]
                if made is not None and len(asked):
                    yield asked.loc[made.has(asked["h1"].to_numpy(), asked["h2"].to_numpy()), ["k1", "k2", "h1", "h2"]]

    return rows.mapInPandas(match, keys.schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, index: Index | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """docs with _n_lines, _n_dropped and _kept, by an index (of docs themselves if none is given)."""
    index = build(docs, text_col, least_docs, least_chars) if index is None else index
    least = index.least_chars
    inner, (doc, text) = numbered(docs, id_col, text_col)
    keys = inner.select(*doc_key(doc, text), F.explode(doc_keys(F.col(text), least)).alias("k")).select("k1", "k2", "k.h1", "k.h2")
    size = index.filters.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    keys = (probe_everywhere if size <= filter_bytes else probe_by_shard)(keys, index)
    dropped = keys.join(small(index.frequent()), ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    joined = inner.select("*", *doc_key(doc, text)).join(dropped, ["k1", "k2"], "left").withColumn("lines", lines(F.col(text)))
    stays = lambda x: (F.char_length(key(x)) < least) | ~F.array_contains(F.col("drop"), hashed(key(x)))
    left = joined.withColumn("left", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    return named_again(left, docs, {"_n_lines": F.size("lines").cast("long"), "_n_dropped": (F.size("lines") - F.size("left")).cast("long"), "_kept": F.array_join("left", "\n")})


def report(deduped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return deduped.select(id_col, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))
