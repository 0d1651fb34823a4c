"""Similarity join of n-gram sets against every pair."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from voxfield.llm import overlap as O
from voxfield.llm.jaccard import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, width=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85, width=4):
    sets = [grams(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: list(rng.choice(words, n))
    passage, out = text(60), []
    for i in range(40):
        out.append((i, text(int(rng.integers(1, 90))) + passage * int(rng.integers(0, 2))))
    for size in (6, 9, 40, 200, 700):  # copies with a few words changed, on both sides of the similarity
        base = text(size)
        for k in range(14):
            w = list(base)
            for p in rng.integers(0, size, int(rng.integers(0, max(2, size // 22)))):
                w[p] = f"x{rng.integers(1000)}"
            out.append((1000 + size * 20 + k, w + text(int(rng.integers(0, 4)))))
    chain = text(300)  # neighbours link, the ends do not
    for k in range(12):
        out.append((30000 - k, chain[8 * k :] + text(1)))
    out = [(i, " ".join(w)) for i, w in out]
    out += [(40000, ""), (40001, None), (40002, " \n"), (40003, "one two"), (39999, "One  TWO"), (40004, "one two three"), (None, "one two"), (None, None), (None, "never seen before words")]
    out += [out[50], out[50], (out[51][0], "other text under one id"), (50000, "long " * 4000 + out[60][1]), (50001, out[60][1].upper())]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, node int, gram string, size int")
    return collections.Counter(tuple(r) for r in O.join_classes(df, **kw).collect())


def test_classes_against_every_pair(spark, rows):
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({k[2] for k in want}) < len(want) - 25
    assert not run(spark, [])


def test_other_widths_blocks_and_one_hot_cell(spark, rows, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 500)
    monkeypatch.setattr(O, "SMALL", 100)
    monkeypatch.setattr(O, "_bucket", lambda h: np.zeros(len(h), np.int64))
    assert run(spark, rows, width=2, percent=70) == brute(rows, 70, 2)


def test_bitmaps_never_lose_a_pair(rows):
    sets = [s for s in shingle_sets(pa.array([t for _, t in rows]), 4) if len(s)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    size = np.array([len(s) for s in sets])
    sign = [O.bitmap(s) for s in sets]
    a, b = np.array(pairs).T
    hit = O.possible(size[a], size[b], [sign[i] for i in a], [sign[j] for j in b], 85)
    true = np.array([len(np.intersect1d(sets[i], sets[j])) >= O.needed(len(sets[i]) + len(sets[j]), 85) for i, j in pairs])
    assert true.sum() > 30 and not (true & ~hit).any() and hit.sum() < true.sum() + len(pairs) // 4


def test_linked_sets_share_a_listed_gram():
    for n in range(1, 400):
        for m in range(-(-85 * n // 100), n + 1):
            least = O.needed(n + m, 85)
            assert O.listed(n, 85) + least > n and (m < least or O.listed(m, 85) + least > m)


def test_fingerprint_pairs_are_verified_where_no_tile_is_open(spark, monkeypatch):
    """No two texts share an n-gram: the stage still takes the SimHash step, and keeps every row."""
    asked = []
    monkeypatch.setattr(O.simhash, "links", lambda fps, f=O.simhash.links: (asked.append(fps.count()), f(fps))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(5)] + [(9, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in O.first_rows(docs, 5, 80).collect()) == [0, 1, 2, 3, 4, 9]
    assert asked == [5]
    assert O.join_classes(docs).count() == 6 and asked == [5]
