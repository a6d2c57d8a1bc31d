"""Token-id files: Simple-8b words in blocks, written in document order and read back.

A 64-bit word holds a selector in its top four bits and, under selector s, COUNTS[s] ids of BITS[s]
bits each, first id lowest. Each word takes the selector that costs the fewest bytes an id from where
it starts, escapes included. An id too wide for its field is an escape: the field holds 0, and the
block lists position and id. A block holds whole documents, at least BLOCK_IDS ids unless it is the last of
its shard, with lengths per document and its own offset in the shard, so that any block decodes alone
and by whole numpy arrays.

The files are Parquet files of blocks (`shard, block, first_id, n_ids, payload`) in one folder of the
shared store, shards numbered in ascending order of document id. Null and empty texts are stored as
the end id alone. Null ids come first; rows with equal ids follow each other, all kept.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import scratch_path

#: Ids a word and bits an id, by selector.
COUNTS = (12, 6, 5, 4, 3, 2, 1)
BITS = (5, 10, 12, 15, 20, 30, 60)
MAGIC = b"S8B1"
BLOCK_IDS = 65_536
END_ID = 0
CACHE_WORDS = 700_000
BATCH_DOCS = 2_048
#: Words that wait for others to be looked up with, beyond which they are at once.
WORDS_AT_ONCE = 600_000
BLOCKS = "shard int, block int, first_id long, n_ids long, payload binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, positions of escapes, their ids)."""
    n = len(ids)
    padded = np.zeros(n + COUNTS[0], np.uint32)
    padded[:n] = ids
    # bytes an id, escapes included, are in proportion to (escapes + 1) * bits; the selector takes the three lowest bits of the key
    best = np.full(n, BITS[-1] * 8 + len(BITS) - 1, np.int32)
    wide = np.zeros(len(padded) + 1, np.int32)
    for s, (count, bits) in enumerate(zip(COUNTS[:-1], BITS[:-1])):
        np.cumsum(padded >= np.uint32(1 << bits), out=wide[1:])
        key = wide[count : count + n] - wide[:n]
        key += 1
        key *= 8 * bits
        key += s
        np.minimum(best, key, out=best)
    chosen = (best & 7).astype(np.int8)
    sizes = np.array(COUNTS, np.uint8)[chosen].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += sizes[at]
    starts = np.array(starts, np.int64)
    words, escaped = np.zeros(len(starts), np.uint64), []
    selectors = chosen[starts]
    for s, (count, bits) in enumerate(zip(COUNTS, BITS)):
        rows = np.flatnonzero(selectors == s)
        if not len(rows):
            continue
        places = starts[rows][:, None] + np.arange(count)
        values = padded[places].astype(np.uint64)
        wide = values >> np.uint64(bits) > 0
        if wide.any():
            escaped.append(places[wide])
            values[wide] = 0
        words[rows] = np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1) | np.uint64(s << 60)
    at = np.sort(np.concatenate(escaped)) if escaped else np.zeros(0, np.int64)
    return words, at.astype(np.uint32), padded[at]


def unpack(words: np.ndarray, at: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    offsets = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint32)
    for s, (count, bits) in enumerate(zip(COUNTS, BITS)):
        rows = np.flatnonzero(selectors == s)
        if len(rows):
            values = (words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            ids[offsets[rows][:, None] + np.arange(count)] = values
    ids[at] = escapes
    return ids[:n]


def to_block(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, at, escapes = pack(ids)
    known = np.array([d is not None and d == d for d in doc_ids], np.uint8)
    numbers = np.array([int(d) if k else 0 for d, k in zip(doc_ids, known)], "<i8")
    head = MAGIC + struct.pack("<QQQQ", len(lengths), len(ids), len(words), len(at))
    return head + known.tobytes() + numbers.tobytes() + np.array(lengths, "<u4").tobytes() + words.astype("<u8").tobytes() + at.astype("<u4").tobytes() + escapes.astype("<u4").tobytes()


def from_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n, words, escapes = struct.unpack_from("<QQQQ", payload, 4)
    pos = 36

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal pos
        out = np.frombuffer(payload, kind, count, pos)
        pos += out.nbytes
        return out

    known, numbers, lengths = part("u1", docs), part("<i8", docs), part("<u4", docs)
    w, at, values = part("<u8", words), part("<u4", escapes), part("<u4", escapes)
    return [int(d) if k else None for d, k in zip(numbers, known)], lengths, unpack(w, at, values, n)


_encoders: dict = {}
#: Byte-level BPE writes a byte as the character of that number where it is printable, else as the next one from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}


def plain(text: str) -> bool:
    """Whether every single space and line end of the text starts a pre-token: no other blanks, no two in a row, none at the ends."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and text.replace("\n", "").isprintable() and not any(x in text for x in ("  ", " \n", "\n ", "\n\n", "<|"))


def byte_level(file: dict) -> bool:
    """Whether a tokenizer's file describes what words can be encoded apart for."""
    first, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    usual = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    plain_model = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    return bool(usual and plain_model and not file.get("normalizer") and not file.get("truncation") and not file.get("padding"))


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct word of a batch once.

    That rests on what the file says: byte-level pre-tokens by the usual pattern without a space put before a text, no
    normaliser, and a model without dropout. Of any other tokenizer texts are encoded whole, by the library alone.

    With byte-level pre-tokens no merge crosses a single space or line end between two words, or a
    letter or digit and a comma or full stop that ends the word; so a text's ids are those of its
    words, each with the space or line end before it. Texts with other blanks go to the tokenizer
    whole. The words that a worker meets first are kept, at most CACHE_WORDS of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = byte_level(json.loads(self.tokenizer.to_str()))
        self.line_end = self.whole("\n")
        self.stops = {x: self.whole(x) for x in ",."}
        self.kept: dict[str, bytes] = {}
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold no line end: one call for all, cut at the line ends between them."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
        (end,) = np.frombuffer(self.line_end, "<u4").tolist()
        cuts = np.flatnonzero(ids == end)
        if len(cuts) != len(words) - 1:
            return [self.whole(w) for w in words]
        raw, starts, ends = ids.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
        return [raw[4 * a : 4 * b] for a, b in zip(starts, ends)]

    def look_up(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words with what precedes them: "\x02word" starts a text, "\nword" a line, any other has a space before it."""
        stem = {w: w[:-1] for w in new if w[-1] in self.stops and w[-2:-1].isalnum()}
        kept = self.kept
        lack = new.difference(stem)
        lack.update(x for x in stem.values() if x not in kept)
        letters, model, space, end = {}, self.model.tokenize, BYTE_CHARS[32], self.line_end
        inner, outer = [], []
        for w in lack:
            if w.isalpha():  # one pre-token with the space before it, so the model takes it as it is
                letters[w] = array("I", [x.id for x in model(space + w if w.isascii() else space + w.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
            else:
                (outer if w[0] in "\x02\n" else inner).append(w)
        found = letters
        found.update(zip(inner, self.words([" " + w for w in inner])))
        found.update((w, end * (w[0] == "\n") + x) for w, x in zip(outer, self.words([w[1:] for w in outer])))
        found.update({w: (found[x] if x in found else kept[x]) + self.stops[w[-1]] for w, x in stem.items()})
        return found

    def batch(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [self.whole(t or "") for t in texts]
        kept, found, out, waiting, held = self.kept, {}, [b""] * len(texts), [], 0

        def fill() -> None:
            found.update(self.look_up({w for _, words, ids in waiting for w, x in zip(words, ids) if x is None and w not in found}))
            for k, words, ids in waiting:
                out[k] = b"".join([found[w] if x is None else x for w, x in zip(words, ids)])
            waiting.clear()

        for k, t in enumerate(texts):
            if not (t and plain(t)):
                out[k] = self.whole(t or "")
                continue
            words = ("\x02" + t.replace("\n", " \n")).split(" ")
            ids = list(map(kept.get, words))
            if None not in ids:
                out[k] = b"".join(ids)
                continue
            waiting.append((k, words, ids))
            held += len(words)
            if held > WORDS_AT_ONCE:
                fill()
                held = 0
        fill()
        if len(kept) < CACHE_WORDS:
            kept.update(islice(found.items(), CACHE_WORDS - len(kept)))
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs and writes the token files in ascending order of id: one range shuffle of the texts, then one pass."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        parts: list[bytes] = []
        held = 0
        end = np.array([END_ID], "<u4").tobytes()

        def flush() -> pd.DataFrame:
            nonlocal block, first, held, ids, parts
            all_ids = np.frombuffer(b"".join(parts), "<u4")
            row = pd.DataFrame({"shard": [shard], "block": [block], "first_id": [first], "n_ids": [len(all_ids)], "payload": [to_block(ids, [len(p) // 4 for p in parts], all_ids)]})
            block, first, held, ids, parts = block + 1, first + len(all_ids), 0, [], []
            return row

        for b in batches:
            numbers = b["id"].astype(object).where(b["id"].notna(), None)
            for lo in range(0, len(b), BATCH_DOCS):
                for doc, x in zip(numbers[lo : lo + BATCH_DOCS], encoder(tokenizer_path).batch(list(b["text"][lo : lo + BATCH_DOCS]))):
                    ids.append(doc)
                    parts.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= block_ids:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # rows without an id, or with one id and many texts, are dealt out by their texts as well
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(blocks, BLOCKS).write.parquet(out)


def read(spark, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """From token files: each document's id, start (ids before it), n_tokens, ids_crc32 and, if asked for, its ids as bytes."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, first, payload in zip(b["shard"], b["first_id"], b["payload"]):
                docs, lengths, ids = from_block(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                out = pd.DataFrame({"id": pd.Series(docs, dtype="Int64"), "shard": shard, "at": first + ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(p) for p in pieces]})
                yield out.assign(ids=[bytes(p) for p in pieces]) if with_ids else out

    files = spark.read.schema(BLOCKS).parquet(path)
    # one row per shard, far fewer than blocks: summed before the window and small enough to broadcast
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    decoded = files.mapInPandas(decode, "id long, shard int, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return decoded.join(F.broadcast(before), "shard").select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def write_and_read(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    out = scratch_path(docs.sparkSession, "token-files")
    write(docs, tokenizer_path, out, id_col, text_col)
    return read(docs.sparkSession, out, id_col, with_ids)
