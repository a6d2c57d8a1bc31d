"""Vector code compression: product codes, nearest entries found in an integer Walsh-Hadamard transform.

Vectors become whole numbers (see int_vectors) and are cut into PARTS equal parts (zeros fill up the last
where the length is no multiple). A part position's codebook starts as that part of the ENTRIES vectors of
lowest id (all of them where there are fewer; equal ids go by their vectors, null ids come last). In each
of ROUNDS rounds every part is given its nearest entry by squared distance, the lower index in a tie, and
each entry becomes its parts' mean, rounded down; an entry without parts stays.

Parts and entries are padded with zeros to a power of two P and transformed by additions and subtractions
alone. The transform multiplies every squared distance by P, so sums of squared differences over some of
the coefficients bound it from below. These are summed in sequency order (by number of sign changes, slow
patterns first): after the first few, the closest entry so far is measured whole, and from then on every
entry whose sum already exceeds that leaves. What stays is exact, in whole numbers throughout; where 64
bits could not hold the sums, Python's integers take their place.

A round is one pass: a task sends, for each entry, the sum and count of its parts. Codebooks are all that
the driver holds. Rows without a usable vector are left out; an empty table gives no rows. Repeated rows
get the same code. Extra columns of any name play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small
from corpusloom.llm.int_vectors import integer_vectors, matrix, totals

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Coefficients summed between two eliminations.
STEP = 4
#: Entries are summed side by side until this share of them stays, then one by one.
FEW = 0.1
#: Distances that a task sums at once: what a processor's cache holds.
AT_ONCE = 1 << 16


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows padded with zeros to a power of two, coefficients in sequency order."""
    size = 1 << max(x.shape[1] - 1, 0).bit_length()
    x = np.concatenate([x, np.zeros((len(x), size - x.shape[1]), x.dtype)], axis=1)
    half = 1
    while half < size:
        pairs = x.reshape(len(x), size // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
        half *= 2
    # pattern k changes sign between j and j + 1 as often as the bits shared by k and j differ in parity from those of k and j + 1
    places = np.arange(size)
    changes = np.zeros(size, np.int64)
    for j in range(size - 1):
        changes += np.bitwise_count(places & (j ^ (j + 1))) & 1
    return x[:, np.argsort(changes)]


def wide(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays, of Python integers where squared distances after the transform might not fit 63 bits."""
    size = 1 << max(arrays[0].shape[1] - 1, 0).bit_length()
    most = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    return arrays if 4 * size**3 * most**2 < 1 << 62 else tuple(a.astype(object) for a in arrays)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, the lowest of equals, and the squared distance."""
    if not len(parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts, entries = wide(parts, entries)
    c = transformed(entries)
    size, columns, many = c.shape[1], np.ascontiguousarray(c.T), max(1, AT_ONCE // len(entries))
    index, distance = [], []
    for lo in range(0, len(parts), many):
        a = transformed(parts[lo : lo + many])
        sums = np.zeros((len(a), len(c)), a.dtype)
        apart, bound, k = np.empty_like(sums), None, 0
        while k < size:  # all entries side by side, until few stay
            for j in range(k, min(k + STEP, size)):
                np.subtract(a[:, j, None], columns[None, j], out=apart)
                np.multiply(apart, apart, out=apart)
                np.add(sums, apart, out=sums)
            k += STEP
            bound = ((a - c[sums.argmin(1)]) ** 2).sum(1) if bound is None else bound
            stays = sums <= bound[:, None]
            if np.count_nonzero(stays) < FEW * stays.size:
                break
        row, entry = np.nonzero(stays)
        sums = sums[row, entry]
        for j in range(k, size, STEP):  # then each pair that is left by itself
            sums = sums + ((a[row, j : j + STEP] - c[entry, j : j + STEP]) ** 2).sum(1)
            stays = sums <= bound[row]
            row, entry, sums = row[stays], entry[stays], sums[stays]
        order = np.lexsort((entry, sums, row)) if sums.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], sums[i], entry[i])))
        row, entry, sums = row[order], entry[order], sums[order]
        first = np.searchsorted(row, np.arange(len(a)))
        index.append(entry[first])
        distance.append(sums[first] // size)
    return np.concatenate(index), np.concatenate(distance)


def cut(vectors: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    size = -(-vectors.shape[1] // parts)
    filled = np.concatenate([vectors, np.zeros((len(vectors), parts * size - vectors.shape[1]), vectors.dtype)], axis=1)
    return [filled[:, k * size : (k + 1) * size] for k in range(parts)]


def started(rows: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The codebooks before the first round."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "y").select("y").limit(entries).collect()
    return cut(np.array([np.frombuffer(r["y"], np.int64) for r in first], np.int64).reshape(len(first), width), parts)


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, entries as rows, from all rows of integer_vectors()."""
    books = started(rows, width, parts, entries)
    if not len(books[0]) or not width:
        return books
    size, n = books[0].shape[1], len(books[0])
    for _ in range(rounds):

        def work(y: np.ndarray, books: list[np.ndarray] = books) -> np.ndarray:
            sums = np.zeros((parts, n, size + 1), np.int64)
            for k, part in enumerate(cut(y, parts)):
                found = nearest(part, books[k])[0]
                np.add.at(sums[k], (found, slice(0, size)), part)
                sums[k, :, size] = np.bincount(found, minlength=n)
            return sums.ravel()

        sums = totals(rows, width, work, parts * n * (size + 1), "long").reshape(parts, n, size + 1)
        counts = sums[:, :, size:]
        books = [np.where(counts[k] > 0, sums[k, :, :size] // np.maximum(counts[k], 1), books[k]) for k in range(parts)]
    return books


def encode(rows: DataFrame, width: int, books: list[np.ndarray]) -> DataFrame:
    """rows of integer_vectors() with code (two hexadecimal digits a part) and error instead of y."""
    others = [f for f in rows.schema.fields if f.name != "y"]
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [nearest(part, book) for part, book in zip(cut(matrix(b.column(0), width), len(books)), books)]
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*[i.tolist() for i, _ in found])]
            errors = [sum(row) for row in zip(*[d.tolist() for _, d in found])]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], [*b.schema.names[1:], "code", "error"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "code string, error long"])
    return rows.select("y", *[f.name for f in others]).mapInArrow(run, schema)


def decode(codes: DataFrame, books: list[np.ndarray], width: int, code_col: str = "code") -> DataFrame:
    """codes with approx, the whole numbers that each code stands for."""
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
    of = lambda k: F.element_at(F.lit([[int(x) for x in e] for e in books[k]]), F.conv(F.substring(code_col, k * digits + 1, digits), 16, 10).cast("int") + 1)
    return codes.withColumn("approx", F.slice(F.flatten(F.array(*[of(k) for k in range(len(books))])), 1, width))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of the usable rows of df, and the codebooks."""
    rows, width = integer_vectors(df, id_col, vec_col, label_col)
    books = fit(rows, width, parts, entries, rounds)
    return encode(rows, width, books).select(F.col("id").alias(id_col), F.col("c0").alias(label_col), "code", "error"), books


def report(coded: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Codes with the errors summed over equal labels (nulls together) and the digest of the codebooks."""
    sums = coded.groupBy(F.col(label_col).alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(small(sums), F.col(label_col).eqNullSafe(F.col("of_label")))
    return joined.select(id_col, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
