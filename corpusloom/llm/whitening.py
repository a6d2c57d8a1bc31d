"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers x (see int_vectors; a constant OFFSET is added, which no result but x itself
can show), centred by their exact sums. From a start vector in the row space, products with the centred
rows X alternate with products with their transpose: u = Xv less the last u, then v = X'u less the last
v, each made orthogonal to all before. The coefficients fill an upper bidiagonal matrix B with XV = UB,
whose small singular value decomposition gives the components (V times its right vectors) and the
deviations (its singular values over the root of n).

A u is as long as the table, so it is never stored: every u is X times a short vector w, which the driver
keeps beside X'u. One pass over the rows gives Xw, its products with all earlier u and its product with
X', so each step is one pass; a task sends sums of the length of a vector only. Where rounding leaves too
much of the earlier u, the pass is made again. Steps end when the wanted singular vectors have converged
to LEAST of the largest, or the row space is used up; where X'u vanishes early, as with equal deviations,
it goes on from another vector of the row space.

Rows without a usable vector are left out. Repeated rows and ids count as often as they stand there, null
ids stay. Components without any deviation (equal vectors, fewer vectors than components) come out as
whitened 0. An empty table gives no rows. Vectors have as many components as they have entries, at most
the number asked for. Only the id and the vector are read, so extra columns of any name play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.int_vectors import integer_vectors, matrix, totals

OFFSET = 100_000
COMPONENTS = 8
#: Residual of a singular triplet, over the largest singular value, at which it counts as converged; and what counts as nothing.
LEAST = 1e-14
NOTHING = 1e-11


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # of y = x - OFFSET, a whole number for each entry
    trace: float
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # a column each
    identity_error: float = 0.0

    def __post_init__(self):
        self.mean = self.sums / max(self.n, 1)
        self.factor = self.components * np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0)


def bidiagonalised(rows: DataFrame, width: int, n: int, mean: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values over the root of n, falling, and right singular vectors (columns) of the centred rows, at most `wanted`."""
    scale = 1 / np.sqrt(n)  # sums stay the size of a row

    def step(w: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """X'Xw, |Xw|^2 and U'Xw."""

        def work(y: np.ndarray) -> np.ndarray:
            x = (y - mean) * scale
            r = x @ w
            earlier = (x @ ws).T @ r if ws.shape[1] else np.zeros(0)
            return np.concatenate([x.T @ r, [r @ r], earlier])

        sums = totals(rows, width, work, width + 1 + ws.shape[1])
        return sums[:width], sums[width], sums[width + 1 :]

    def orthogonal(v: np.ndarray, vs: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - vs @ (vs.T @ v)
        return v

    draw = np.random.default_rng(7)
    vs = ws = zs = np.zeros((width, 0))
    alphas, betas, beta = [], [], 0.0
    fresh = step(draw.standard_normal(width), ws)[0]
    first = np.linalg.norm(fresh)
    if first == 0:
        return np.zeros(0), vs
    v, largest = fresh / first, 0.0
    while True:
        vs = np.column_stack([vs, v])
        w = v - beta * ws[:, -1] if ws.shape[1] else v
        z, square, h = step(w, ws)
        w, z, alpha = w - ws @ h, z - zs @ h, np.sqrt(max(square - h @ h, 0))
        if h @ h > 1e-12 * square:
            z, square, h = step(w, ws)
            w, z, alpha = w - ws @ h, z - zs @ h, np.sqrt(max(square - h @ h, 0))
        largest = max(largest, alpha, beta)
        if alpha <= NOTHING * largest:
            vs = vs[:, :-1]
            betas = betas[:-1]
            break
        ws, zs = np.column_stack([ws, w / alpha]), np.column_stack([zs, z / alpha])
        alphas.append(alpha)
        p, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if len(alphas) == width:
            break
        v = orthogonal(zs[:, -1] - alpha * v, vs)
        beta = float(np.linalg.norm(v))
        if beta <= NOTHING * largest:
            fresh = step(orthogonal(draw.standard_normal(width), vs), ws[:, :0])[0]
            v, beta = orthogonal(fresh, vs), 0.0
            if np.linalg.norm(v) <= NOTHING * largest**2:
                break
            v = v / np.linalg.norm(v)
        elif len(alphas) >= wanted and (beta * np.abs(p[-1, :wanted]) <= LEAST * s[0]).all():
            break
        else:
            v = v / beta
        betas.append(beta)
    _, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    return s[:wanted], vs @ q[:wanted].T


def fit(rows: DataFrame, width: int, wanted: int = COMPONENTS) -> Whitening:
    """Whitening learnt from all rows of integer_vectors()."""
    wanted = min(wanted, width)
    counted = totals(rows, width, lambda y: np.concatenate([y.sum(0), [len(y)]]), width + 1, "long")
    sums, n = counted[:width], int(counted[width])
    if not n or not width:
        return Whitening(0, sums, 0.0, np.zeros(0), np.zeros((width, 0)))
    mean = sums / n
    trace = float(totals(rows, width, lambda y: np.array([((y - mean) ** 2).sum()]), 1)[0]) / n
    deviations, components = bidiagonalised(rows, width, n, mean, wanted)
    missing = wanted - len(deviations)
    if missing:
        basis = np.linalg.qr(np.column_stack([components, np.eye(width)]))[0][:, components.shape[1] :]
        components, deviations = np.column_stack([components, basis[:, :missing]]), np.concatenate([deviations, np.zeros(missing)])
    components = components * np.sign(components[np.abs(components).argmax(0), np.arange(wanted)])
    found = Whitening(n, sums, trace, deviations**2, components)
    found.identity_error = _identity_error(rows, found)
    return found


def _identity_error(rows: DataFrame, found: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, measured on the rows."""
    wanted, factor, mean = len(found.values), found.factor, found.mean

    def work(y: np.ndarray) -> np.ndarray:
        z = (y - mean) @ factor
        return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

    sums = totals(rows, len(mean), work, wanted * wanted + wanted) / found.n
    return float(np.abs(sums[: wanted * wanted].reshape(wanted, wanted) - np.outer(sums[-wanted:], sums[-wanted:]) - np.eye(wanted)).max())


def whitened(rows: DataFrame, found: Whitening) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of rows of integer_vectors()."""
    n, sums, mean, factor = found.n, found.sums, found.mean, found.factor
    largest = int(np.sqrt(float(1 << 62) / max(len(mean), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix(b.column(1), len(mean))
            apart = y.astype(object) * n - sums.astype(object) if y.size and float(np.abs(y).max()) * n >= 2.0**61 else y * n - sums
            apart = apart.astype(object) if apart.size and abs(apart).max() >= largest else apart
            z = (y - mean) @ factor
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([str(d) for d in (apart**2).sum(1).tolist()], pa.string()), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], ["id", "deviation", "whitened"])

    made = rows.select("id", "y").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation string, whitened array<double>")
    return made.select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """whitened() of the usable rows of df, and what was learnt from them."""
    rows, width = integer_vectors(df, id_col, vec_col)
    found = fit(rows, width, wanted)
    return whitened(rows, found).withColumnRenamed("id", id_col), found


def report(rows: DataFrame, found: Whitening, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component. A deviation that no long holds is null; deviation_exact has it."""
    shares = F.array(*[F.lit(float(e / found.trace) if found.trace else 0.0) for e in found.values]).cast("array<double>")
    out = rows.select(id_col, "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        id_col,
        (F.col("k") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )
