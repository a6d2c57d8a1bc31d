"""Operator 11 against all pairs of fingerprints made by plain Python."""

import random
import re

import numpy as np
import xxhash

from corpusloom.llm import simhash
from tests.llm.cases import LONG, documents, empty


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{(id, fingerprint): lowest id}, from all pairs."""
    found = [(i, plain_fingerprint(t) if isinstance(t, str) or t is None else t) for i, t in rows]
    parent = list(range(len(found)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            if (found[a][1] ^ found[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(found):
        if i is not None:
            lowest[find(k)] = min(i, lowest.get(find(k), i))
    return [(i, f, lowest.get(find(k))) for k, (i, f) in enumerate(found)]


def got(docs):
    return sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.digests(simhash.classes(docs)).collect()), key=str)


def test_components_equal_all_pairs(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(1, 5)))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(draw.choice([1, 3, 4, 9, 60, 500]))]
        for _ in range(draw.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = word()
            rows.append((len(rows), draw.choice([" ", "\t", " \n "]).join(copy).title()))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(plain_components(rows), key=str)


def test_links_of_fingerprints_at_every_distance(spark, monkeypatch):
    """Balls around centres, in shards of one tree and of many, so that both searches find links."""
    draw = random.Random(6)
    for piece in (1024, 16):
        monkeypatch.setattr(simhash, "PIECE", piece)
        codes = set()
        for _ in range(12):
            centre = draw.getrandbits(64)
            for _ in range(40):
                code = centre
                for k in draw.sample(range(64), draw.randint(0, 7)):
                    code ^= 1 << k
                codes.add(code)
        rows = list(enumerate(sorted(codes)))
        signed = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for _, c in rows], "fp long")
        roots = {r.node: r.root for r in simhash.links(signed).collect()}
        group = {}
        for i, c, low in plain_components(rows):
            group.setdefault(low, set()).add(c)
        seen = {}
        for _, c in rows:
            s = c - (1 << 64) if c >> 63 else c
            seen.setdefault(roots.get(s, s), set()).add(c)
        assert sorted(map(sorted, seen.values())) == sorted(map(sorted, group.values()))


def test_forest_against_all_distances():
    draw = np.random.default_rng(2)
    codes = (draw.integers(0, 2**63, 60, dtype=np.uint64) & np.uint64(0xFF0F)).astype(np.uint64)
    groups = np.sort(draw.integers(0, 4, 60))
    x, y = simhash.Forest(codes, groups).within(codes, groups, 3)
    want = {(a, b) for a in range(60) for b in range(60) if groups[a] == groups[b] and int(codes[a] ^ codes[b]).bit_count() <= 3}
    # of equal codes a tree holds each, one below the other at distance 0
    assert set(zip(x.tolist(), y.tolist())) == want
    assert len(simhash.Forest(codes, groups).within(codes, groups + 9, 3)[0]) == 0


def test_every_pair_shares_a_shard():
    draw = random.Random(8)
    for n in (10, 10**7, 10**9):
        tables = simhash.masks(n)
        for _ in range(300):
            changed = sum(1 << k for k in draw.sample(range(64), 4))
            assert any(not changed & m for m in (t % (1 << 64) for t in tables))


def test_texts_longer_than_a_stretch(monkeypatch):
    text = LONG + " tail" * 3 + "\n" + "x" * 500 + " é😀 end"
    want = plain_fingerprint(text)
    for size in (7, 64, 1000, 1 << 20):
        monkeypatch.setattr(simhash, "STRETCH", size)
        assert simhash.fingerprint(text.encode()) == want
        assert simhash.fingerprint(b" two  Words ") == plain_fingerprint("two words")


def test_odd_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = got(docs)
    assert found == sorted(plain_components(rows), key=str)
    assert (2, 0, 2) in found and (3, 0, 2) in found and (7, 0, 2) in found
    assert simhash.classes(empty(spark)).count() == 0
    alone = simhash.classes(spark.createDataFrame([(None, "no ids here"), (None, "no ids here")], "doc_id long, text string")).collect()
    assert len(alone) == 2 and all(r.component_id is None for r in alone)
