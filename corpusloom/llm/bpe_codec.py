"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to `chunk_chars` code points are encoded where they lie. A longer text is dealt out as
chunks that overlap by `overlap_chars`: every chunk is pre-tokenised from its own first character, in
parallel, and neighbours are stitched at the first position in the overlap that both scans hold as a
boundary between pre-tokens. From a common boundary on both scans agree, since the pattern looks
ahead only, so the slices between such positions encode to the ids of the whole text. If two
neighbours share no boundary (one pre-token longer than the overlap), the text is put together again
and encoded whole. Decoding joins the bytes of the ids.

Null and empty texts have no ids. Repeated rows and repeated ids are kept, one result row each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import sliced

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
SCHEMA = "n_tokens long, ids binary, decoded binary"
_coders: dict = {}


def coder(ranks_path: str):
    """(encoding, bytes of each id, pre-token pattern) for a rank file; kept for the life of the worker."""
    if ranks_path not in _coders:
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        _coders[ranks_path] = encoding, pieces, regex.compile(public_tokenizers.PATTERN)
    return _coders[ranks_path]


def encode_whole(texts: pd.Series, ranks_path: str) -> pd.Series:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    encoding, _, _ = coder(ranks_path)
    return pd.Series([np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes() for t in texts], dtype=object)


def decode_ids(ids: pd.Series, ranks_path: str) -> pd.Series:
    """The bytes that the ids stand for."""
    _, pieces, _ = coder(ranks_path)
    return pd.Series([b"".join([pieces[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids], dtype=object)


def boundaries(text: str, ranks_path: str) -> np.ndarray:
    """Ends of the pre-tokens of a text, scanned from its first character."""
    _, _, pattern = coder(ranks_path)
    return np.cumsum([len(p) for p in pattern.findall(text)], dtype=np.int64)


def stitch(starts: list[int], texts: list[str], bounds: list[np.ndarray], ranks_path: str) -> bytes:
    """Ids of the text whose overlapping chunks these are, in order."""
    encoding, _, _ = coder(ranks_path)
    cuts = [starts[0]]
    for k in range(1, len(starts)):
        end = starts[k - 1] + len(texts[k - 1])
        # the last pre-token of a chunk may be cut short, so its end is no boundary
        both = np.intersect1d(bounds[k - 1] + starts[k - 1], bounds[k] + starts[k])
        both = both[(both > cuts[-1]) & (both < end - 1)]
        if not len(both):
            whole = "".join(t[: starts[k + 1] - s] if k + 1 < len(starts) else t for k, (s, t) in enumerate(zip(starts, texts)))
            return np.array(encoding.encode_ordinary(whole), "<u4").tobytes()
        cuts.append(int(both[0]))
    cuts.append(starts[-1] + len(texts[-1]))
    return b"".join(np.array(encoding.encode_ordinary(t[a - s : b - s]), "<u4").tobytes() for s, t, a, b in zip(starts, texts, cuts, cuts[1:]))


def encode(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decode: bool = True
) -> DataFrame:
    """One row per row of docs: its id, n_tokens, ids (little-endian unsigned 32-bit) and the bytes decoded from them."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def finish(ids: pd.Series, encoded: list[bytes]) -> pd.DataFrame:
        series = pd.Series(encoded, dtype=object)
        return pd.DataFrame({"id": ids.reset_index(drop=True), "n_tokens": [len(x) // 4 for x in encoded], "ids": series, "decoded": decode_ids(series, ranks_path) if decode else pd.Series([b""] * len(encoded), dtype=object)})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            yield finish(b["id"], list(encode_whole(b["text"], ranks_path)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(bounds=pd.Series([boundaries(t, ranks_path).astype("<i4").tobytes() for t in b["text"]], dtype=object, index=b.index))

    def join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for chunks in b["chunks"]:
                chunks = sorted(chunks, key=lambda x: x["start"])
                done.append(stitch([x["start"] for x in chunks], [x["text"] for x in chunks], [np.frombuffer(x["bounds"], "<i4").astype(np.int64) for x in chunks], ranks_path))
            yield finish(b["id"], done)

    schema = f"id {id_type}, {SCHEMA}"
    short = rows.filter(F.char_length("text") <= chunk_chars).mapInPandas(whole, schema)
    step = chunk_chars - overlap_chars
    dealt = (
        rows.filter(F.char_length("text") > chunk_chars)
        .withColumn("row", F.concat_ws(":", F.spark_partition_id(), F.monotonically_increasing_id()))
        .withColumn("start", F.explode(F.expr(f"sequence(0, char_length(text) - {overlap_chars} - 1, {step})").cast("array<int>")))
        .select("id", "row", "start", F.substring("text", F.col("start") + 1, F.lit(chunk_chars)).alias("text"))
        .repartition("row", "start")
    )
    long = (
        dealt.mapInPandas(scan, f"id {id_type}, row string, start int, text string, bounds binary")
        .groupBy("row")
        .agg(F.first("id").alias("id"), F.collect_list(F.struct("start", "text", "bounds")).alias("chunks"))
        .select("id", "chunks")
        .mapInPandas(join_up, schema)
    )
    return short.unionByName(long).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths and SHA-256 digests of encode()'s ids and decoded bytes."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
