"""Toxicity: a support vector machine on a gapped subsequence kernel with Nystroem landmarks.

The kernel of two strings counts their common subsequences of four letters, each occurrence weighted by a decay for the
characters that it spans: adjacent letters, one character inserted anywhere between them, or one between all of them (``GAPS``). So
an insult keeps most of its kernel value when characters are inserted. Landmarks are strings from labelled text; the Nystroem map turns a
string into its kernel values with them, whitened, and a linear machine is trained there on sentences: short windows of characters, from toxic documents the
one that looks worst (found anew in each round), from clean ones random windows and those that look worst.

The decision of a window is linear in its subsequence counts, so the landmarks fold into one table of weights by subsequence, and
scoring sums the weights of the subsequences that start in each window. A document's score is that of its worst window, as a
probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.quality import by_bytes

#: Labelled documents of either label that the machine is fitted on, at most.
SAMPLE = 1500
LANDMARKS = 160
#: Offsets of the four letters of a subsequence, and the weight of each form.
GAPS = (((0, 1, 2, 3), 1.0), ((0, 1, 2, 4), 0.6), ((0, 1, 3, 4), 0.6), ((0, 2, 3, 4), 0.6), ((0, 2, 4, 6), 0.4))
SPAN = 7
#: Subsequences that start within so many characters belong to one window.
WINDOW = 8
ROUNDS, STEPS, PENALTY = 6, 40, 0.05
#: Clean windows that each round adds to the landmarks.
HARD = 16
BATCH_BYTES = 1 << 21
LETTERS = 32
EDGE = 27
CELLS = LETTERS**4


def _code_table() -> np.ndarray:
    """Classes of characters: EDGE for what ends a word, 1 to 26 for a to z in either case, 28 to 31 for other letters."""
    out = np.full(1 << 16, EDGE, np.uint8)
    out[128:] = EDGE + 1 + np.arange(128, 1 << 16) % 4
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = 1 + i
    for upper, lower in zip(range(0xC0, 0xDF), range(0xE0, 0xFF)):
        out[upper] = out[lower]
    out[0x2000:0x2070] = out[0xA0] = EDGE
    return out


CODES = _code_table()


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all texts, each between one space and SPAN + WINDOW more, and the start of each text (texts + 1)."""
    pad = " " * (SPAN + WINDOW)
    joined = "".join([" " + t + pad for t in texts])
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64) + len(pad) + 1
    return CODES[np.minimum(raw, 0xFFFF)], np.concatenate([[0], np.cumsum(size)])


def cells(c: np.ndarray):
    """For each form: the cell of the subsequence at every start. A word's edge counts as a letter at either end, but not both; else the cell is 0."""
    n = max(len(c) - SPAN + 1, 0)
    wide = c.astype(np.int32)
    for (i, j, k, m), weight in GAPS:
        parts = [wide[o : o + n] for o in (i, j, k, m)]
        cell = ((parts[0] * LETTERS + parts[1]) * LETTERS + parts[2]) * LETTERS + parts[3]
        ok = (parts[1] != EDGE) & (parts[2] != EDGE) & ((parts[0] != EDGE) | (parts[3] != EDGE))
        yield np.where(ok, cell, 0), np.float32(weight)


def pull(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the weights of all subsequences that start in the window at each place."""
    at = np.zeros(max(len(c) - SPAN + 1, 0), np.float32)
    for cell, weight in cells(c):
        at += weight * table[cell]
    total = np.zeros(len(c), np.float32)
    for k in range(WINDOW):
        total[: len(at) - k] += at[k:]
    return total


def worst(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pull of the worst window of every text and the place of that window in it."""
    c, first = codes(texts)
    p = pull(c, table)
    high = np.maximum.reduceat(p, first[:-1]) if len(texts) else np.zeros(0, np.float32)
    hit = np.flatnonzero(p == np.repeat(high, np.diff(first)))
    owner = np.searchsorted(first, hit, side="right") - 1
    place = np.zeros(len(texts), np.int64)
    place[owner[::-1]] = hit[::-1]
    return high, place - first[:-1] - 1


def phi(strings: list[str]) -> list[dict[int, float]]:
    """Subsequence counts of short strings."""
    out = []
    for s in strings:
        c, _ = codes([s])
        got: dict[int, float] = {}
        for cell, weight in cells(c):
            for x in cell[cell > 0].tolist():
                got[x] = got.get(x, 0.0) + float(weight)
        out.append(got)
    return out


def kernel(a: list[dict[int, float]], b: list[dict[int, float]]) -> np.ndarray:
    rows: dict[int, list[tuple[int, float]]] = {}
    for j, other in enumerate(b):
        for x, v in other.items():
            rows.setdefault(x, []).append((j, v))
    out = np.zeros((len(a), len(b)))
    for i, own in enumerate(a):
        for x, v in own.items():
            for j, u in rows.get(x, ()):
                out[i, j] += v * u
    return out


def _starts(text: str) -> set[str]:
    """Beginnings of the words of a text, of four to six characters; a word of three as a whole."""
    return {w[:n] for w in text.lower().split() for n in (3, 4, 5, 6) if len(w) >= max(n, 4) or len(w) == n}


def landmarks(toxic: list[str], clean: list[str], size: int) -> tuple[list[str], np.ndarray]:
    """Word beginnings, with the space before them: three in four mark toxic texts, the rest are common in clean ones; how much each marks.

    Of beginnings that share their first three characters only the strongest few are taken.
    """
    seen: list[dict[str, int]] = [{}, {}]
    for side, texts in enumerate((clean, toxic)):
        for t in texts:
            for w in _starts(t):
                seen[side][w] = seen[side].get(w, 0) + 1
    n = [max(len(clean), 1), max(len(toxic), 1)]
    ratio = lambda w: float(np.log(((seen[1].get(w, 0) + 0.5) / n[1]) / ((seen[0].get(w, 0) + 0.5) / n[0])))
    mark = sorted(((v / n[1] * ratio(w), w) for w, v in seen[1].items() if v >= 2 and len(w) >= 4), reverse=True)
    common = sorted(((v, w) for w, v in seen[0].items() if len(w) >= 4), reverse=True)
    picked: list[str] = []
    for ranked, most, each in ((mark, size * 3 // 4, 4), (common, size, 3)):
        shared: dict[str, int] = {}
        for _, w in ranked:
            if len(picked) < most and w not in picked and shared.get(w[:3], 0) < each:
                shared[w[:3]] = shared.get(w[:3], 0) + 1
                picked.append(w)
    return [" " + w for w in picked], np.array([max(ratio(w), 0.0) for w in picked])


@dataclass
class Machine:
    """Weights by subsequence, and the line from a document's worst pull to its log-odds."""

    cell: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def table(self) -> np.ndarray:
        out = np.zeros(CELLS, np.float32)
        out[self.cell] = self.weight
        out[0] = 0.0
        return out

    def chance(self, worst_pull: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * worst_pull + self.offset, -40, 40)))


def _svm(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps; classes weigh alike. y: -1 or 1."""
    x = np.hstack([z, np.ones((len(z), 1))])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    ridge = np.full(x.shape[1], PENALTY / x.shape[1])
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        gap = 1.0 - y * (x @ w)
        on = gap > 0
        slope = ridge * w - (share * y * gap * on) @ x
        bend = (x * (share * on)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(bend, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], w[-1]


def _logistic(x: np.ndarray, y: np.ndarray, toxic_share: float) -> tuple[float, float]:
    """Slope and offset of the log-odds of y (0 or 1) where ``toxic_share`` of all texts are 1; targets are smoothed."""
    n1, n0 = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.where(y == 1, toxic_share / n1, (1 - toxic_share) / n0)
    f, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(STEPS):
        p = 1.0 / (1.0 + np.exp(-np.clip(f @ w, -30, 30)))
        bend = (f * (share * p * (1 - p))[:, None]).T @ f + 1e-6 * np.eye(2)
        w += np.clip(np.linalg.solve(bend, (share * (goal - p)) @ f), -5, 5)
    return float(w[0]), float(w[1])


def fit(toxic: list[str], clean: list[str], toxic_share: float = 0.1, seed: int = 3) -> Machine:
    """The machine of a sample, with chances for a table where ``toxic_share`` of the texts are toxic; without texts of both kinds every text gets the share of toxic ones."""
    if not toxic or not clean:
        share = len(toxic) / max(len(toxic) + len(clean), 1)
        return Machine(np.zeros(1, np.int64), np.zeros(1, np.float32), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(seed)
    names, marking = landmarks(toxic, clean, LANDMARKS)

    def mapped(names: list[str]):
        """Landmarks of unit length, the map that whitens kernel values with them, and the subsequences that they hold."""
        marks = [{x: v / (np.sqrt(sum(u * u for u in m.values())) or 1.0) for x, v in m.items()} for m in phi(names)]
        value, vector = np.linalg.eigh(kernel(marks, marks))
        good = value > 1e-6 * value.max()
        return marks, vector[:, good] / np.sqrt(value[good]), np.unique(np.array([x for m in marks for x in m], np.int64))

    marks, whiten, cell = mapped(names)

    def as_machine(beta: np.ndarray) -> Machine:
        weight = np.zeros(len(cell))
        for b, m in zip(beta, marks):
            np.add.at(weight, np.searchsorted(cell, list(m)), b * np.array(list(m.values())))
        return Machine(cell, weight.astype(np.float32), 1.0, 0.0)

    def cut(texts: list[str], places) -> list[str]:
        # As codes() puts a space before each string, the window starts one character later unless it starts with the text.
        return [t[max(p + 1, 0) : max(p, 0) + SPAN + WINDOW - 1] for t, p in zip(texts, places)]

    # The first guess of the worst window: likeness to the landmarks that mark toxic texts.
    machine = as_machine(np.where(marking > 2.0, marking, 0.0))
    negatives = cut(clean, [int(rng.integers(0, max(len(t) - SPAN, 1))) for t in clean])
    for _ in range(ROUNDS):
        table = machine.table()
        positives = cut(toxic, worst(toxic, table)[1])
        pulls, places = worst(clean, table)
        hard = cut(clean, places)
        negatives = negatives + hard
        # Clean windows that look worst become landmarks too, so that the machine can tell them apart.
        more = list(dict.fromkeys(hard[i] for i in np.argsort(-pulls, kind="stable")))[:HARD]
        names = names + [w for w in more if w not in names]
        marks, whiten, cell = mapped(names)
        strings = positives + negatives
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        w, _ = _svm(kernel(phi(strings), marks) @ whiten, y)
        machine = as_machine(whiten @ w)
    table = machine.table()
    high = np.concatenate([worst(toxic, table)[0], worst(clean, table)[0]]).astype(float)
    machine.slope, machine.offset = _logistic(high, np.r_[np.ones(len(toxic)), np.zeros(len(clean))], min(max(toxic_share, 0.01), 0.99))
    return machine


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` documents of each label of ``labels`` (doc_id, label 0 or 1), those with the smallest hashes of their ids.

    Rows with a null id or label, and labels of documents that ``docs`` lacks, do not count.
    """
    chosen = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    pick = lambda y: chosen.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    both = pick(0).unionByName(pick(1)).select(F.col("doc_id").alias("d"), "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(both), F.col("doc_id") == F.col("d")).where("text IS NOT NULL")
    got = rows.select("doc_id", "label", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, label = got.column("text").to_pylist(), got.column("label").to_pylist()
    share = chosen.agg(F.avg("label")).first()[0]
    return fit([t for t, y in zip(texts, label) if y], [t for t, y in zip(texts, label) if not y], share or 0.1)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs`` with ``score``: 0 to 1, higher for more toxic text.

    ``docs`` needs ``text``; nothing else is an input of the score. One row per input row, equal texts get equal scores. A null text counts
    as empty; an empty text has no subsequences, so its pull is 0. An empty table gives an empty result.
    """
    columns = docs.columns

    def run(batches):
        table = machine.table()
        for batch in batches:
            for part in by_bytes(batch, BATCH_BYTES):
                high, _ = worst([t or "" for t in part.column("text").to_pylist()], table)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(machine.chance(high.astype(float)))], names=[*columns, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double")
