"""Periodic runs of words by seeding and extending diagonals.

A run is a stretch of consecutive words with smallest period q and a length of at least max(``SHORTEST``, ``TIMES`` * q) that neither
neighbour extends. On the diagonal of lag q (word i against word i + q) it is a stretch of at least max(5, 3 q) equal pairs.

Lags are taken in bands [2^j, 2^(j+1)). Every run of a band holds a pair of equal k-grams on its diagonal, k being the band's
guaranteed overlap: 5 words for lag 1, else 3 * 2^j. As k is at least the lag, inside a run the next occurrence of a k-gram is exactly
one smallest period away; so only neighbouring occurrences of one document are paired (linear in the text, however often a gram occurs),
and a pair's lag is the smallest period of what lies around it. A gram that occurs once ends the matter for all longer grams that begin
there, so few positions reach the higher bands.

Pairs are extended on their diagonal in both directions by comparing words. A table holds the furthest word that each lag has covered;
a pair that lies before it belongs to a run already found.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm import blocks as B

SHORTEST, TIMES = 6, 4
#: Text bytes that are taken apart at once.
SLICE = 4 << 20
RUN = "struct<start: bigint, length: bigint, period: bigint>"
OUT = f"doc_id bigint, n_words bigint, runs array<{RUN}>, strongest {RUN}, kept_text string"


def _joined(w: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where each begins (one more entry: the end)."""
    data = w.data.copy()
    data[w.end] = 32
    step = np.zeros(len(data) + 1, np.int8)
    step[w.start] += 1
    step[w.end + 1] -= 1
    held = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    return data[held], np.r_[0, np.cumsum(w.end - w.start + 1)]


def _next_same(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring occurrences (first, second) of equal keys, and the places whose key occurs more than once. ``at`` ascends."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    many = np.zeros(len(at), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    at, key = at[many], key[many]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return at[order[:-1][same]], at[order[1:][same]], at


def _forward(word: np.ndarray, i: int, lag: int, end: int) -> int:
    """The first place from ``i`` on whose word differs from the one ``lag`` further, ``end - lag`` at most."""
    step, last = 64, end - lag
    while i < last:
        stop = min(i + step, last)
        differs = word[i:stop] != word[i + lag : stop + lag]
        if differs.any():
            return i + int(differs.argmax())
        i, step = stop, 2 * step
    return last


def _backward(word: np.ndarray, i: int, lag: int, first: int) -> int:
    """The first of the places up to ``i`` from which on all words equal the one ``lag`` further."""
    step = 64
    while i > first:
        stop = max(i - step, first)
        differs = (word[stop:i] != word[stop + lag : i + lag])[::-1]
        if differs.any():
            return i - int(differs.argmax())
        i, step = stop, 2 * step
    return first


def runs_of(word: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. Text t holds the word identities ``word[first[t]:first[t + 1]]``."""
    n = len(word)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    salt = B.mix(text.astype(np.uint64) * B.MIX_B + B.MIX_A)
    grams, found = [B.mix(word + B.MIX_A)], []  # grams[m]: hash of the 2^m words from each place

    def gram(m: int) -> np.ndarray:
        while len(grams) <= m:
            g, half = grams[-1], 1 << (len(grams) - 1)
            grams.append(B.mix(g[:-half] * B.MIX_B + g[half:]) if len(g) > half else g[:0])
        return grams[m]

    at, j = np.arange(n), 0
    covered: dict[int, int] = {}
    while len(at):
        low, high = 1 << j, 2 << j
        k = 3 * low if j else SHORTEST - 1
        at = at[at + k <= end[at]]
        if not len(at):
            break
        whole, rest = (gram(j), gram(j + 1)[at + low]) if j else (gram(2), gram(0)[at + 4])
        a, b, at = _next_same(B.mix(whole[at] * B.MIX_A + rest ^ salt[at]), at)
        on = (b - a >= low) & (b - a < high)
        lag, a = (b - a)[on], a[on]
        order = np.lexsort((a, lag))
        lag, a = lag[order], a[order]
        # Pairs in a row on one diagonal are one seed.
        head = np.r_[True, (lag[1:] != lag[:-1]) | (a[1:] != a[:-1] + 1)] if len(a) else np.zeros(0, bool)
        for i, q in zip(a[head].tolist(), lag[head].tolist()):
            if i < covered.get(q, 0):
                continue
            t = text[i]
            start, stop = _backward(word, i, q, int(first[t])), _forward(word, i, q, int(first[t + 1]))
            covered[q] = stop
            if stop + q - start >= max(SHORTEST, TIMES * q):
                found.append((start, stop + q - start, q))
        j += 1
    return sorted((s, length, q) for s, length, q in found)


def _texts(t: pa.Array) -> tuple[np.ndarray, list, list, list]:
    """Number of words, runs, strongest run and kept words of each text."""
    w = B.Words(t)
    data, place = _joined(w)
    runs = runs_of(w.hash, w.first)
    if any(data[place[s] : place[s + n - q]].tobytes() != data[place[s + q] : place[s + n]].tobytes() for s, n, q in runs):
        # Different words with one hash: again, by the words themselves.
        number: dict[bytes, int] = {}
        exact = [number.setdefault(data[a : b - 1].tobytes(), len(number)) for a, b in zip(place[:-1], place[1:])]
        runs = runs_of(np.array(exact, np.uint64), w.first)
    mark = np.zeros(len(w) + 1, np.int64)
    listed: list[list] = [[] for _ in range(len(t))]
    for (s, n, q), doc in zip(runs, np.searchsorted(w.first, [s for s, _, _ in runs], "right") - 1):
        mark[s + q] += 1
        mark[s + n] -= 1
        listed[doc].append({"start": s - int(w.first[doc]), "length": n, "period": q})
    keep = np.cumsum(mark[:-1]) == 0
    size = np.r_[0, np.cumsum(np.where(keep, np.diff(place), 0))]
    left, ends = data[np.repeat(keep, np.diff(place))].tobytes(), size[w.first]
    kept = [left[a : max(b - 1, a)].decode() for a, b in zip(ends[:-1], ends[1:])]
    best = [max(r, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"]), default=None) for r in listed]
    return np.diff(w.first), listed, best, kept


def _slices(batch: pa.RecordBatch):
    size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE, prepend=0))
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(size)]):
        if b > a:
            yield batch.slice(a, b - a)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, strongest, kept_text) of every row of ``docs`` (doc_id, text; other columns are not read).

    ``runs`` are (start, length, period) in words, by start, then period. ``strongest`` has the greatest length / period (ties: smallest
    start, then period), null without a run. ``kept_text`` holds, joined by one space, the words that no run contains after its first
    period. One row per input row, equal rows and null ids included. A null, empty or blank text has no words, no runs and an empty
    kept_text. No shuffle: a text is read whole by one task, in time n log n and memory n for n words whatever its
    repetitions. An empty table gives an empty result.
    """
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches):
        for batch in batches:
            for part in _slices(batch):
                n, runs, best, kept = _texts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, run), pa.array(best, run.value_type), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "runs", "strongest", "kept_text"],
                )
            B.give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, OUT)
