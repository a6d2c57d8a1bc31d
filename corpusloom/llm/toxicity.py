"""Toxicity by noisy-channel deobfuscation.

Tokens that may be disguised become character lattices, whatever their length: a look-alike stands for
itself or for its letters, a run of one letter for one or two of it, a separator for nothing or for
the edge of a word. A Viterbi pass under a character trigram model, counted over all documents, finds
the likeliest restored words. Decoded are tokens with letters and look-alikes anywhere in them, tokens of
look-alikes that are no number, tokens with a letter three times in a row, single letters set apart by
blanks, dots or dashes, and, once the lexicon is known, tokens that would reach one of its entries
with doubled letters made single or inner separators taken out.

The restored text is then scored: a lexicon of words and word beginnings, each with a cautious
log-odds of toxicity (two standard errors below the estimate) from labelled rows, gives every word a
weight; the largest weights of a text and the number of weighted words enter a logistic regression
fitted on labelled rows that the lexicon has not seen.

At most SAMPLE labelled rows of each label are learned from; the character model counts every
document. Null and empty texts score as texts without words. Without rows of both labels every score
is the smoothed share of label 1. Ties between paths go to the option listed first. Each row, repeated
or not, is scored from its text alone; columns named as the results give way to them, all others stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import sliced, with_columns
from corpusloom.llm.labelled import fold, training_rows

SAMPLE = 12_000
PREFIXES = (4, 5, 6)
LEAST_WEIGHT = 0.5
WEAK, STRONG = 1.0, 2.0
EVIDENCE = 5
CALIBRATION_FOLD = 4
CACHE_WORDS = 300_000
#: Letters that a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Log cost of a look-alike, of a character taken as it is though it is a look-alike, and of keeping a run double.
SWAP, AS_IS, DOUBLE = -1.0, -6.0, -1.5

#: Code points that the trigram counter handles at once.
STRETCH = 200_000
CLASSES = 60  # 0 a word's edge, 1-26 a-z, 27-58 U+00E0-U+00FF, 59 anything else
SEPARATORS = " .-_*"
EDGES = ".,;:?\"'()[]{}<>"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SIGN = re.compile(rf"[{re.escape(''.join(LOOKALIKES))}]")
_APART = re.compile(r"\w(?:[.\-_*]\w){2,}")
_LETTERS = re.compile(r"[^\W\d_]+")


def char_class(c: str) -> int:
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else o - 0xE0 + 27 if 0xE0 <= o <= 0xFF else 59


def class_table() -> np.ndarray:
    """Class of each code point below 256, capitals as small letters; others are class 59 if letters come in words, here always."""
    out = np.zeros(257, np.int64)
    for o in range(256):
        c = chr(o).lower()
        out[o] = char_class(c) if c.isalpha() else 0
    out[256] = 59
    return out


def stretches(texts) -> Iterator[str]:
    """The texts in order, small ones joined and long ones cut, so that no piece is much longer than STRETCH."""
    held: list[str] = []
    size = 0
    for text in texts:
        for lo in range(0, len(text or ""), STRETCH):
            held.append(text[lo : lo + STRETCH])
            size += len(held[-1])
            if size >= STRETCH:
                yield "\n".join(held)
                held, size = [], 0
    if held:
        yield "\n".join(held)


def count_trigrams(texts) -> np.ndarray:
    """Counts of class trigrams; every non-letter is an edge."""
    table, total = class_table(), np.zeros(CLASSES**3, np.int64)
    for text in stretches(texts):
        points = np.frombuffer((" " + text + " ").encode("utf-32-le"), "<u4")
        c = table[np.minimum(points, 256)]
        c = np.concatenate(([0, 0], c[~((c == 0) & (np.roll(c, 1) == 0))], [0]))
        total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    return total


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a class after two others, from all documents: each task counts, counts are added."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in sliced(batches):
            total += count_trigrams(b["text"].dropna())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES**3)
    for r in rows.collect():  # at most CLASSES ** 3 rows
        counts[r["at"]] = r["n"]
    return log_model(counts)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities from trigram counts, each context leaning on its shorter one."""
    three = np.asarray(counts, float).reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(0), three.sum((0, 1)) + 1.0
    lower = (two + 5 * one / one.sum()) / (two.sum(1, keepdims=True) + 5)
    return np.log((three + 5 * lower[None]) / (three.sum(2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each step of a token, what it may stand for and the log cost."""
    runs = [(c, len(list(r))) for c, r in groupby(token.lower())]
    steps = []
    for k, (c, n) in enumerate(runs):
        if c in SEPARATORS and 0 < k < len(runs) - 1:
            steps.append([("", 0.0), (" ", 0.0)])
        elif c.isalpha():
            steps.append([(c, 0.0)] if n == 1 else [(c, 0.0), (c * 2, 0.0 if n == 2 else DOUBLE)])
        elif c in LOOKALIKES:
            steps.append([(x * m, SWAP + (0.0 if m == 1 else DOUBLE)) for x in LOOKALIKES[c] for m in range(1, 1 + min(2, n))] + [(c * n, AS_IS)])
        else:
            steps.append([(c * n, 0.0)])
    return steps


def walk(model: list[float], state: tuple[int, int], out: str) -> tuple[float, tuple[int, int]]:
    """Log probability of the characters of `out` after a state, and the state they lead to. Non-letters in a row are one edge."""
    (x, y), total = state, 0.0
    for c in out:
        z = char_class(c) if c.isalpha() else 0
        if z or y:
            total += model[(x * CLASSES + y) * CLASSES + z]
            x, y = y, z
    return total, (x, y)


def viterbi(token: str, model: np.ndarray | list[float]) -> str:
    """The likeliest text behind a token. States are the last two classes; the best way to each is kept at every step."""
    flat = model if isinstance(model, list) else model.ravel().tolist()
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict] = []
    for options in lattice(token):
        after: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, score in best.items():
            for out, cost in options:
                gain, to = walk(flat, state, out)
                total = score + cost + gain
                if to not in after or total > after[to]:
                    after[to], came[to] = total, (state, out)
        best = after
        back.append(came)
    state = max(best, key=lambda x: best[x] + walk(flat, x, " ")[0])
    pieces = []
    for came in reversed(back):
        state, out = came[state]
        pieces.append(out)
    return "".join(reversed(pieces))


def squeezed(word: str) -> str:
    return _DOUBLE.sub(r"\1", word)


class Restorer:
    """Restores disguised tokens. `entries`: the lexicon, which tells tokens with doubled letters and inner separators worth a look."""

    def __init__(self, model: np.ndarray, entries: Iterable[str] = ()):
        self.model = model.ravel().tolist()
        words = [e for e in entries if len(e) >= 4]
        self.whole = {squeezed(e) for e in words if not e.endswith("*")}
        self.starts = {squeezed(e[:-1]) for e in words if e.endswith("*")}

    def listed(self, word: str) -> bool:
        """Whether a word without its doubled letters reaches an entry of the lexicon."""
        return word in self.whole or any(word[:n] in self.starts for n in range(3, 1 + min(max(PREFIXES), len(word))))

    def disguised(self, core: str) -> bool:
        if core.isalpha():
            return bool(_TRIPLE.search(core)) or bool(self.whole) and bool(_DOUBLE.search(core)) and self.listed(squeezed(core.lower()))
        letters, signs = _LETTERS.search(core), _SIGN.search(core)
        if signs and (letters or not core.isdigit() and len(set(core)) > 1 and all(c in LOOKALIKES for c in core)):
            return True
        if letters and (_TRIPLE.search(core) or _APART.fullmatch(core)):
            return True
        return bool(letters and self.whole) and self.listed(squeezed("".join(_LETTERS.findall(core.lower()))))

    def token(self, token: str) -> str:
        """A token between blanks, restored if it may be disguised."""
        core = token.strip(EDGES).rstrip("!")
        if not core or not self.disguised(core):
            return token
        at = token.index(core)
        return token[:at] + viterbi(core, self.model) + token[at + len(core) :]

    def apart(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(first, end) of stretches of three or more tokens that are one letter or look-alike each, two letters at least."""
        one = [len(c) == 1 and (c.isalpha() or c in LOOKALIKES) for c in (t if len(t) == 1 else t.strip(EDGES) for t in tokens)]
        out, at = [], 0
        for single, run in groupby(one):
            end = at + len(list(run))
            if single and end - at >= 3 and sum(map(str.isalpha, "".join(tokens[at:end]))) >= 2:
                out.append((at, end))
            at = end
        return out

    def words_apart(self, tokens: list[str]) -> list[str]:
        """Words that single letters spell."""
        return [w for lo, hi in self.apart(tokens) for w in viterbi(" ".join(t.strip(EDGES) or t for t in tokens[lo:hi]), self.model).split()]

    def text(self, text: str) -> str:
        pieces = re.split(r"(\s+)", text)
        tokens, blanks = pieces[::2], [*pieces[1::2], ""]
        out, at = [], 0
        for lo, hi in [*self.apart(tokens), (len(tokens), len(tokens))]:
            out += [self.token(t) + s for t, s in zip(tokens[at:lo], blanks[at:lo])]
            if hi > lo:
                out.append(" ".join(self.words_apart(tokens[lo:hi])) + blanks[hi - 1])
            at = hi
        return "".join(out)


def features(text: str) -> set[str]:
    """Words of a text, and their beginnings."""
    out = set()
    for w in _LETTERS.findall(text.lower()):
        out.add(w)
        out.update(w[:n] + "*" for n in PREFIXES if len(w) > n)
    return out


def many_single(tokens: list[str]) -> bool:
    return sum(map((1).__eq__, map(len, tokens))) >= 2


def lexicon(rows: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Words and beginnings with a log-odds of label 1 that holds two standard errors below its estimate."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        restorer, kept = Restorer(model), {}
        for b in sliced(batches):
            for text, label in zip(b["text"], b["label"]):
                tokens, own = text.split(), set()
                for t in set(tokens):
                    if t not in kept:
                        if len(kept) >= CACHE_WORDS:
                            kept.clear()
                        kept[t] = features(restorer.token(t))
                    own |= kept[t]
                if many_single(tokens):
                    own.update(*map(features, restorer.words_apart(tokens)))
                seen[label].update(own)
        keys = [*{**seen[0], **seen[1]}]
        for lo in range(0, len(keys), 50_000):
            part = keys[lo : lo + 50_000]
            yield pd.DataFrame({"feature": pd.Series(part, dtype=object), "bad": [seen[1][k] for k in part], "good": [seen[0][k] for k in part]})

    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    counted = rows.select("text", "label").mapInPandas(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good) - 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    # the sample bounds the lexicon
    return {r["feature"]: r["w"] for r in counted.filter("bad > 1").select("feature", odds.alias("w")).filter(F.col("w") > LEAST_WEIGHT).collect()}


class Weights(dict):
    """Weight of a token as it is written: the largest of its restored words and their beginnings. Each is restored once while it is kept."""

    def __init__(self, entries: dict[str, float], restorer: Restorer):
        super().__init__()
        self.entries, self.restorer = entries, restorer

    def of(self, text: str) -> float:
        return max((self.entries.get(x, 0.0) for x in features(text)), default=0.0)

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = w = self.of(self.restorer.token(token))
        return w


def evidence(text: str, weights: Weights) -> list[float]:
    """What the regression sees: the two largest weights, logarithms of the numbers of strong and of weighted words, and of the share of the latter."""
    tokens = text.split()
    distinct = set(tokens)
    found = [w for w in map(weights.__getitem__, distinct) if w]
    if many_single(tokens):
        found += [w for w in map(weights.of, set(weights.restorer.words_apart(tokens))) if w]
    found.sort()
    weighted = sum(w > WEAK for w in found)
    return [found[-1] if found else 0.0, found[-2] if len(found) > 1 else 0.0, log(1 + sum(w > STRONG for w in found)), log(1 + weighted), log((weighted + 0.5) / (len(distinct) + 50))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) / 100 + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) / 100 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, with_text: bool = False) -> DataFrame:
    """docs with _held_out, _score, _predicted and, if asked for, _restored."""
    rows = training_rows(docs, labels, label, sample, id_col, text_col)
    model = character_model(docs, text_col)
    entries = lexicon(rows.filter(F.col("fold") != CALIBRATION_FOLD), model)
    shared = docs.sparkSession.sparkContext.broadcast((model, entries))

    def ready() -> Weights:
        model_, entries_ = shared.value
        return Weights(entries_, Restorer(model_, entries_))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = ready()
        for b in sliced(batches):
            yield pd.DataFrame([[*evidence(t, weights), y] for t, y in zip(b["text"], b["label"])], columns=[*"abcde", "y"])

    held = rows.filter(F.col("fold") == CALIBRATION_FOLD).select("text", "label").mapInPandas(measure, "a double, b double, c double, d double, e double, y double").toPandas().to_numpy(float)
    y = held[:, EVIDENCE] if len(held) else np.zeros(0)
    constant = (y.sum() + 0.5) / (len(y) + 2)
    w = fit_logistic(held[:, :EVIDENCE], y) if 0 < y.sum() < len(y) else np.array([0.0] * EVIDENCE + [log(constant / (1 - constant))])

    def make():
        weights = ready()

        def judge(texts: list) -> list[list]:
            x = np.array([evidence(t or "", weights) for t in texts]).reshape(-1, EVIDENCE)
            found = [(1 / (1 + np.exp(-np.clip(x @ w[:EVIDENCE] + w[EVIDENCE], -30, 30)))).tolist()]
            return [*found, [weights.restorer.text(t or "") for t in texts]] if with_text else found

        return judge

    marked = with_columns(docs, text_col, make, {"_score": "double"} | ({"_restored": "string"} if with_text else {}))
    return marked.withColumn("_held_out", fold(id_col) == 0).withColumn("_predicted", (F.col("_score") >= 0.5).cast("int"))
