"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP and cover all of it. FILTERS
learned filters of WIDTH bytes slide over a chunk STRIDE bytes at a time; a filter is a table of one
weight per place and byte value. Each filter keeps its largest response in the chunk, a hidden layer
mixes these, and over the chunks of a document each hidden unit is max-pooled and averaged; a
logistic unit combines both into one probability (equal responses share no gradient: the first wins). Filters, hidden layer and output are learned
together by Adam from labelled rows.

Learned from are at most SAMPLE labelled rows of each label and about SAMPLE_CHUNKS chunks in all, every
row with all its chunks; scoring reads every chunk too. Null and empty texts are one chunk of zeros.
Without rows of both labels every score is the smoothed share of label 1. Each row, repeated or not,
is scored from its text alone; columns named as the results give way to them, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import with_columns
from corpusloom.llm.labelled import fold, training_rows

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, FILTERS, HIDDEN = 8, 1, 16, 12
SAMPLE = 1_500
SAMPLE_CHUNKS = 24_000
EPOCHS, BATCH, RATE = 6, 32, 0.01


def chunks(text: str | None) -> np.ndarray:
    """All chunks of a text, the last one filled up with zeros."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = 1 + max(0, -(-(len(raw) - CHUNK) // (CHUNK - OVERLAP)))
    padded = np.zeros(CHUNK + (n - 1) * (CHUNK - OVERLAP), np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[:: CHUNK - OVERLAP]


class Network:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.p = {
            "filters": draw.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32),
            "mix": draw.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
            "mix0": np.zeros(HIDDEN, np.float32),
            "out": draw.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
            "out0": np.zeros(1, np.float32),
        }

    def respond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where."""
        steps = (CHUNK - WIDTH) // STRIDE + 1
        total = np.zeros((len(x), steps, FILTERS), np.float32)
        for k in range(WIDTH):
            total += self.p["filters"][k].take(x[:, k : k + STRIDE * (steps - 1) + 1 : STRIDE], axis=0)
        at = total.argmax(1)
        return np.take_along_axis(total, at[:, None], 1)[:, 0], at

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled @ self.p["mix"] + self.p["mix0"])

    def read(self, x: np.ndarray) -> np.ndarray:
        """Hidden units of chunks, a few at a time so that responses stay in the cache."""
        return np.concatenate([self.hidden(self.respond(x[lo : lo + 16])[0]) for lo in range(0, len(x), 16)])

    def combine(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-odds of documents whose chunks begin at `starts`."""
        n = np.diff([*starts, len(h)])[:, None]
        pooled = np.hstack([np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / n])
        return pooled @ self.p["out"] + self.p["out0"]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        best, at = self.respond(x)
        h = self.hidden(best)
        counts = np.diff([*starts, len(h)])
        doc = np.repeat(np.arange(len(starts)), counts)
        top = np.maximum.reduceat(h, starts)
        pooled = np.hstack([top, np.add.reduceat(h, starts) / counts[:, None]])
        error = (1 / (1 + np.exp(-(pooled @ self.p["out"] + self.p["out0"]))) - y) * weight / len(y)
        g = {"out": pooled.T @ error, "out0": error.sum(keepdims=True)}
        back = error[doc][:, None] * ((h == top[doc]) * self.p["out"][:HIDDEN] + self.p["out"][HIDDEN:] / counts[doc][:, None]) * (1 - h * h)
        g |= {"mix": best.T @ back, "mix0": back.sum(0)}
        to_filters, g["filters"] = back @ self.p["mix"].T, np.zeros_like(self.p["filters"])
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        for k in range(WIDTH):
            np.add.at(g["filters"][k], (x[rows, at * STRIDE + k], np.broadcast_to(cols, at.shape)), to_filters)
        return g

    def fit(self, docs: list[np.ndarray], y: np.ndarray) -> Network:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        draw, t = np.random.default_rng(11), 0
        for epoch in range(EPOCHS):
            order = draw.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                ids, t = order[lo : lo + BATCH], t + 1
                starts = np.cumsum([0, *(len(docs[i]) for i in ids[:-1])])
                g = self.gradients(np.concatenate([docs[i] for i in ids]), starts, y[ids], weight[ids])
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= (RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def train(rows: DataFrame, most_chunks: int = SAMPLE_CHUNKS) -> tuple[Network, float]:
    """A network fitted to (id, text, label) rows, and the smoothed share of label 1.

    Where the rows have more than `most_chunks` chunks, whole rows are drawn by a hash of the id; a row that is a tenth of that alone is left out.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"].astype(str), "label": b["label"], "chunks": pd.Series([chunks(t).tobytes() for t in b["text"]], dtype=object, index=b.index)})

    n = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - OVERLAP) / (CHUNK - OVERLAP)))
    usable = rows.withColumn("n", n).filter(F.col("n") <= most_chunks // 10)
    total = usable.agg(F.sum("n")).first()[0] or 0
    drawn = usable.filter(F.pmod(F.xxhash64(F.lit("chunks"), "id"), F.lit(1_000_000)) < int(1_000_000 * min(1, most_chunks / max(1, total))))
    picked = drawn.select("id", "label", "text").mapInPandas(cut, "id string, label int, chunks binary").toPandas()  # bounded: most_chunks chunks
    picked = picked.sort_values(["id", "label"])
    y = picked["label"].to_numpy(np.float32)
    network, share = Network(), float((y.sum() + 0.5) / (len(y) + 2))
    if 0 < y.sum() < len(y):
        return network.fit([np.frombuffer(x, np.uint8).reshape(-1, CHUNK) for x in picked["chunks"]], y), share
    network.p["out"][:] = 0
    network.p["out0"][:] = log(share / (1 - share))
    return network, share


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """docs with _held_out, _score and _predicted (1 from `cut` on)."""
    network, _ = train(training_rows(docs, labels, label, sample, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(network.p)

    def make():
        net = Network()
        net.p = shared.value

        def judge(texts: list) -> list[list]:
            out: list[float] = []
            for lo in range(0, len(texts), 64):
                cut_up = [chunks(t) for t in texts[lo : lo + 64]]
                h = np.concatenate([net.read(c) for c in cut_up])
                starts = np.cumsum([0, *map(len, cut_up[:-1])])
                out += (1 / (1 + np.exp(-np.clip(net.combine(h, starts), -30, 30)))).tolist()
            return [out]

        return judge

    marked = with_columns(docs, text_col, make, {"_score": "double"})
    return marked.withColumn("_held_out", fold(id_col) == 0).withColumn("_predicted", (F.col("_score") >= cut).cast("int"))
