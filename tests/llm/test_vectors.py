"""Operators 12 and 13 against plain numpy and Python."""

import hashlib
import math
from decimal import Decimal

import numpy as np
import pytest

from corpusloom.llm import vector_codes, whitening
from tests.llm.cases import CLASHES


def table(spark, vectors, labels=None, ids=None):
    rows = [(ids[k] if ids else k, v, labels[k] if labels else None, *CLASHES) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in CLASHES if c not in ("id", "label")) + ", xid string, xlabel string")


def usable(vectors):
    return [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def whole(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for v in vectors], np.int64)


SPOILT = [None, [1.0, None, 0.0, 2.0, 1.0, 1.0], [math.nan] * 6, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], [0.0, -math.inf, 0.0, 0.0, 0.0, 0.0]]


def check_whitening(spark, vectors, wanted=8):
    rows, found = whitening.whiten(table(spark, vectors), wanted=wanted)
    out = whitening.report(rows, found).collect()
    x = whole(usable(vectors)) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(wanted, x.shape[1])
    assert len(out) == n * k and {r.n for r in out} == {n}
    exact = sorted(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x)
    assert sorted(r.deviation for r in out if r.component == 1) == exact
    assert all(r.deviation_exact == Decimal(r.deviation) for r in out)
    np.testing.assert_allclose(found.values, values[:k], rtol=1e-9, atol=1e-9 * values[0])
    return found, values, vectors_, out


def test_whitening_equals_a_full_decomposition(spark):
    draw = np.random.default_rng(4)
    vectors = (draw.standard_normal((300, 24)) * np.linspace(0.5, 0.1, 24) + 5).tolist() + [None]
    found, values, vectors_, out = check_whitening(spark, vectors)
    assert np.abs(np.abs((found.components * vectors_[:, :8]).sum(0)) - 1).max() < 1e-9
    assert found.identity_error < 1e-10
    centred = whole(usable(vectors)) + 100_000.0
    centred -= centred.mean(0)
    want = centred @ vectors_[:, :8] / np.sqrt(values[:8])
    for r in out:
        assert abs(abs(r.whitened) - abs(want[r.vec_id, r.component - 1])) < 1e-8
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9


def test_whitening_of_few_directions(spark):
    """Equal deviations end the recurrence early; constant and repeated entries have none."""
    square = np.eye(6)[np.repeat(np.arange(6), 20)] * 3
    found, *_ = check_whitening(spark, square.tolist())
    assert found.identity_error == pytest.approx(1, abs=1e-6)  # five directions only: the sixth has no deviation
    draw = np.random.default_rng(5)
    flat = draw.standard_normal((100, 3))
    found, _, _, out = check_whitening(spark, np.column_stack([flat, flat[:, 0], np.ones(100)]).tolist())
    assert all(r.whitened == 0 for r in out if r.component == 5) and (found.values > 0).sum() <= 4


def test_whitening_of_odd_tables(spark):
    draw = np.random.default_rng(6)
    check_whitening(spark, draw.standard_normal((40, 6)).tolist() + SPOILT)
    check_whitening(spark, [[1.0, 2.0, 3.0]] * 5)
    check_whitening(spark, [[1.0, 2.0, 3.0]])
    for none in ([], SPOILT):
        rows, found = whitening.whiten(table(spark, none))
        assert whitening.report(rows, found).count() == 0
    lengths, _ = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 1.0], [0.0, 5.0], [1.0], []]))
    assert lengths.count() == 3
    ids, _ = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 1.0], [2.0, 1.0]], ids=[None, 7, 7]))
    assert sorted(str(r.vec_id) for r in ids.collect()) == ["7", "7", "None"]


def test_deviations_beyond_a_long(spark):
    vectors = [[1e7, -1e7], [-1e7, 1e7], [0.0, 0.0]]
    rows, found = whitening.whiten(table(spark, vectors))
    out = {r.vec_id: r for r in whitening.report(rows, found).filter("component = 1").collect()}
    x = whole(vectors)
    exact = {k: sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0))) for k, row in enumerate(x)}
    assert {k: int(r.deviation_exact) for k, r in out.items()} == exact
    assert out[0].deviation is None and out[2].deviation == exact[2]


def plain_codes(ids, vectors, labels, rounds=4):
    x = whole(vectors).tolist()
    size = len(x[0]) // 4
    parts = [[row[k * size : (k + 1) * size] for row in x] for k in range(4)]
    first = sorted(range(len(x)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))[:256]
    books = [[list(p[k]) for k in first] for p in parts]
    apart = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    assign = lambda: [[min(range(len(b)), key=lambda e: (apart(row, b[e]), e)) for row in p] for p, b in zip(parts, books)]
    for _ in range(rounds):
        for p, b, a in zip(parts, books, assign()):
            for e in range(len(b)):
                mine = [row for row, i in zip(p, a) if i == e]
                if mine:
                    b[e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    errors = [sum(apart(parts[k][i], books[k][found[k][i]]) for k in range(4)) for i in range(len(x))]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for label, e in zip(labels, errors):
        total[label] = total.get(label, 0) + e
    return [(ids[i], "".join(f"{found[k][i]:02x}" for k in range(4)), errors[i], total[labels[i]], digest) for i in range(len(x))]


def codes(df):
    return sorted(map(tuple, vector_codes.report(*vector_codes.compress(df)).collect()), key=str)


def test_codes_equal_plain_rounds(spark):
    draw = np.random.default_rng(9)
    vectors = draw.standard_normal((400, 12)).round(1).tolist()
    vectors[300:340] = vectors[:40]  # ties and repeated rows
    ids, labels = draw.permutation(400).tolist(), [None if k % 7 == 0 else k % 3 for k in range(400)]
    spoilt = [v and v * 2 for v in SPOILT]
    df = table(spark, vectors + spoilt, labels + [1] * 5, ids + list(range(900, 905)))
    assert codes(df) == sorted(plain_codes(ids, vectors, labels), key=str)


def test_codes_of_odd_tables(spark):
    assert codes(table(spark, [])) == [] and codes(table(spark, SPOILT)) == []
    few = [[0.5, -0.5, 1.0, 2.0], [0.5, -0.5, 1.0, 2.0], [9.0, 1.0, 1.0, 1.0]]
    assert codes(table(spark, few, [1, 1, 1])) == sorted(plain_codes([0, 1, 2], few, [1, 1, 1]), key=str)
    large = (np.random.default_rng(1).standard_normal((30, 8)) * 40_000).tolist()
    assert codes(table(spark, large)) == sorted(plain_codes(list(range(30)), large, [None] * 30), key=str)
    odd, books = vector_codes.compress(table(spark, [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [0.0] * 6]))
    assert {r.error for r in odd.collect()} == {0}
    back = {r.vec_id: r.approx for r in vector_codes.decode(odd, books, 6).collect()}
    assert back == {0: [1024, 2048, 3072, 4096, 5120, 6144], 1: [0] * 6}


def test_transform_keeps_distances_and_order():
    draw = np.random.default_rng(3)
    x = draw.integers(-1000, 1000, (20, 11))
    t = vector_codes.transformed(x)
    for a in range(20):
        assert (((t[a] - t[0]) ** 2).sum()) == 16 * ((x[a] - x[0]) ** 2).sum()
    patterns = vector_codes.transformed(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(p) != 0).sum() for p in patterns] == list(range(8))


def test_nearest_takes_the_lowest_of_equals_even_in_long_integers():
    entries = np.array([[5, 5, 1], [0, 0, 0], [0, 0, 0], [2, 2, 2]])
    parts = np.array([[0, 0, 0], [1, 1, 1], [5, 5, 0]])
    for scale in (1, 10**6, 2**33):
        index, distance = vector_codes.nearest(parts * scale, entries * scale)
        assert index.tolist() == [1, 1, 0] and [int(d) for d in distance] == [0, 3 * scale**2, scale**2]
