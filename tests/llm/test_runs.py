"""Periodic runs against a brute-force search."""

import collections
import re
from fractions import Fraction

import numpy as np

from voxfield.llm import runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All runs by trying every lag and every maximal stretch."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            part = w[i : j + q]
            if n >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found)


def answer(text):
    w = WORD.findall(text or "")
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return len(w), tuple(found), best, " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = np.random.default_rng(3)
    out = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "aa a " * 9, "x\x0by z " * 40, "w" * 5000 + " v", "a" * 3 + " b" * 900]
    for letters in (2, 3, 5):
        out += [" ".join(rng.choice(list("abcdefgh")[:letters], int(n))) for n in rng.integers(1, 160, 60)]
    for _ in range(60):  # periods inside periods, runs that touch and overlap
        base = list(rng.choice(list("abc"), int(rng.integers(1, 6))))
        inner = base * int(rng.integers(1, 6)) + list(rng.choice(list("abc"), int(rng.integers(0, 3))))
        w = list(rng.choice(list("abc"), int(rng.integers(0, 9)))) + inner * int(rng.integers(1, 7)) + base * int(rng.integers(0, 7))
        out.append("  ".join(w[: len(w) - int(rng.integers(0, 3))]))
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    return out + [" ".join(fib[-1]), " ".join("abc" * 300 + "d" + "abc" * 300), " ".join(["p q r s t u v w x y"] * 50)]


def flat(r):
    return r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), tuple(r.strongest) if r.strongest else None, r.kept_text


def test_runs_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(1, rows[9][1]), (None, rows[9][1]), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in rows], "doc_id long, text string, runs string, kept_text string, start long").repartition(3)
    got = collections.Counter((r.doc_id, *flat(r)) for r in R.periodic_runs(docs).collect())
    assert got == collections.Counter((i, *answer(t)) for i, t in rows)
    assert sum(len(k[2]) for k in got) > 150
    assert R.periodic_runs(docs.where("false")).count() == 0


def test_long_text_and_equal_hashes(monkeypatch):
    import pyarrow as pa

    w = [f"w{i}" for i in range(70_000)] + ["a", "b", "c"] * 40_000 + ["z"] * 60_000
    n, found, best, kept = R._texts(pa.array([" ".join(w)]))
    assert (n[0], found[0]) == (len(w), [{"start": 70_000, "length": 120_000, "period": 3}, {"start": 190_000, "length": 60_000, "period": 1}])
    assert best[0]["period"] == 1 and kept[0].split(" ") == w[:70_003] + ["z"]

    # All words share one hash: the words themselves decide.
    class Flat(R.B.Words):
        def _hash(self):
            return np.ones(len(self.start), np.uint64)

    monkeypatch.setattr(R.B, "Words", Flat)
    texts = ["a b c d e f g h", "a b a b a b a b c", "q " * 9]
    n, found, _, kept = R._texts(pa.array(texts))
    assert [[tuple(r.values()) for r in f] for f in found] == [list(answer(t)[1]) for t in texts] and kept == [answer(t)[3] for t in texts]


def test_planted_texts(spark):
    import zlib

    from voxfield.llm.q_runs import planted

    rows = [(i, " ".join(f"v{i}_{j}" for j in range(i % 37))) for i in range(200)] + [(None, "a b c"), (33, None), (34, " \t")]
    got = {(r.doc_id, r.text) for r in planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and t is not None:
            if w:
                g = h // 10
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
            t = " ".join(w)
        want.add((i, t))
    assert got == want
