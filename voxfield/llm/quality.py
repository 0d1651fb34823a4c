"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. The score of a line is linear in features of the line and of its two neighbours; a transition matrix
couples the labels of consecutive lines. Forward-backward gives each line's marginal probability of being good; a document's quality is
their mean, weighted by line length.

The field is fitted on a bounded sample of labelled documents (``SAMPLE``), each line labelled as its document: first the lines
alone (logistic regression by Newton steps), then the chain by gradient steps on the conditional likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.blocks import Words, give_back

#: Labelled documents that the field is fitted on, at most.
SAMPLE = 3000
#: A document is good from this score on.
THRESHOLD = 0.3
NEWTON, STEPS, RATE, RIDGE = 12, 60, 0.05, 1.0
#: Text bytes whose features are computed at once.
BATCH_BYTES = 2 << 20

_CLASSES = ("lower", "upper", "digit", "bang", "symbol", "bar", "stop", "other", "space", "high")


def _class_table() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), np.uint8)
    out[ord("a") : ord("z") + 1] = _CLASSES.index("lower")
    out[ord("A") : ord("Z") + 1] = _CLASSES.index("upper")
    out[ord("0") : ord("9") + 1] = _CLASSES.index("digit")
    out[[ord(c) for c in "!?"]] = _CLASSES.index("bang")
    out[[ord(c) for c in "*#%$&@^~=+<>{}[]\\"]] = _CLASSES.index("symbol")
    out[[ord(c) for c in "|_"]] = _CLASSES.index("bar")
    out[[ord(c) for c in ".,;:"]] = _CLASSES.index("stop")
    out[[9, 10, 11, 12, 13, 32]] = _CLASSES.index("space")
    out[128:] = _CLASSES.index("high")
    return out


CLASS = _class_table()


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word (lines x features), its length in bytes, and the first line of each text (texts + 1).

    Lines end at a line feed. Neighbours' features stand beside a line's own; outside the text they are 0.
    """
    w = Words(texts)
    n_texts = len(w.first) - 1
    if not len(w):
        return np.zeros((0, 3 * (len(_CLASSES) + 8) + 3)), np.zeros(0), np.zeros(n_texts + 1, np.int64)
    # A word opens a line if it is its text's first or a line feed lies before it.
    feeds = np.cumsum(w.data == 10, dtype=np.int32)
    text = w.text_of()
    opens = np.r_[True, (text[1:] != text[:-1]) | (feeds[w.start[1:]] != feeds[w.start[:-1]])]
    heads = np.flatnonzero(opens)
    line = np.cumsum(opens) - 1
    tails = np.r_[heads[1:], len(w)]
    begin, end = w.start[heads], w.end[tails - 1]
    size = (end - begin).astype(float)
    kinds = CLASS[w.data]
    share = []
    total = np.zeros(len(kinds) + 1, np.int32)
    for c in range(len(_CLASSES)):
        np.cumsum(kinds == c, out=total[1:])
        share.append((total[end] - total[begin]) / size)
    n_words = (tails - heads).astype(float)
    length = (w.end - w.start).astype(float)
    order = np.lexsort((w.hash, line))
    h, at = w.hash[order], line[order]
    distinct = np.bincount(at[np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])]], minlength=len(heads))
    again = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])]
    capital = kinds[w.start] == _CLASSES.index("upper")
    ragged = ~np.isin(kinds[w.end - 1], [_CLASSES.index(c) for c in ("lower", "upper", "digit", "high", "stop")])
    own = np.column_stack([
        *share,
        np.log1p(size) / 8.0,
        np.log1p(n_words) / 6.0,
        np.minimum(np.add.reduceat(length, heads) / n_words / 20.0, 3.0),
        distinct / n_words,
        np.add.reduceat(again.astype(float), heads) / n_words,
        np.add.reduceat(capital.astype(float), heads) / n_words,
        np.add.reduceat(ragged.astype(float), heads) / n_words,
        (kinds[end - 1] == _CLASSES.index("stop")).astype(float),
    ])
    owner = text[heads]
    first = np.searchsorted(owner, np.arange(n_texts + 1))
    has_before = np.r_[False, owner[1:] == owner[:-1]]
    has_after = np.r_[owner[1:] == owner[:-1], False]
    before = np.vstack([own[:1], own[:-1]]) * has_before[:, None]
    after = np.vstack([own[1:], own[:1]]) * has_after[:, None]
    return np.hstack([own, before, after, has_before[:, None], has_after[:, None], np.ones((len(own), 1))]), size, first


@dataclass
class Field:
    """weights: of a line's features towards good; step: log-potentials of (label, next label); prior: share of good documents."""

    weights: np.ndarray
    step: np.ndarray
    prior: float

    def marginals(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of every line; expected transitions (2 x 2); log of the partition function, summed over the texts."""
        pull = features @ self.weights
        return forward_backward(pull, self.step, first)


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(pull: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """All chains at once, line by line. ``pull`` is the log-potential of good (bad has 0); chain c has the lines first[c]:first[c + 1]."""
    unary = np.column_stack([np.zeros(len(pull)), pull])
    alpha, beta = unary.copy(), np.zeros_like(unary)
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    count, start = count[order], first[:-1][order]
    longest = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(longest + 1), side="left")  # chains with more than t lines: those before live[t]
    for t in range(1, longest):
        at = start[: live[t]] + t
        a = alpha[at - 1]
        alpha[at] += _log_add(a[:, :1] + step[0], a[:, 1:] + step[1])
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        b = beta[at + 1] + unary[at + 1]
        beta[at] = _log_add(step[:, 0] + b[:, :1], step[:, 1] + b[:, 1:])
    full = count > 0
    last = start[full] + count[full] - 1
    total = _log_add(alpha[last, 0], alpha[last, 1])
    norm = np.zeros(len(pull))
    norm[np.arange(len(pull))] = np.repeat(total[np.argsort(start[full], kind="stable")], count[full][np.argsort(start[full], kind="stable")]) if len(pull) else 0
    good = np.exp(alpha[:, 1] + beta[:, 1] - norm)
    inner = np.ones(len(pull), bool)
    inner[start[full]] = False
    at = np.flatnonzero(inner)
    moves = np.exp(alpha[at - 1][:, :, None] + step[None] + (unary[at] + beta[at])[:, None, :] - norm[at][:, None, None]).sum(0) if len(at) else np.zeros((2, 2))
    return good, moves, float(total.sum())


def fit(features: np.ndarray, first: np.ndarray, good: np.ndarray) -> Field:
    """The field of a sample: ``good`` is 0 or 1 per text."""
    prior = float(good.mean()) if len(good) else 0.5
    count = np.diff(first)
    y = np.repeat(good.astype(float), count)
    if not len(y) or y.min() == y.max():
        flat = np.zeros(features.shape[1])
        if features.shape[1]:
            flat[-1] = np.log((prior + 1e-3) / (1 - prior + 1e-3))
        return Field(flat, np.zeros((2, 2)), prior)
    w = np.zeros(features.shape[1])
    # Texts weigh alike in the start values, however many lines they have.
    weight = np.repeat(1.0 / np.maximum(count, 1), count) * len(y) / max((count > 0).sum(), 1)
    for _ in range(NEWTON):
        p = 1.0 / (1.0 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (weight * (y - p)) - RIDGE * w
        bend = (features * (weight * p * (1 - p))[:, None]).T @ features + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    inner = np.ones(len(y), bool)
    inner[first[:-1][count > 0]] = False
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (inner & (y == label)).sum()
    step = np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)]
    for i in range(1, STEPS + 1):
        marginal, moves, _ = forward_backward(features @ w, step, first)
        n = len(y)
        for j, (value, slope) in enumerate(((w, (features.T @ (y - marginal) - RIDGE * w) / n), (step, (seen - moves - RIDGE * step) / n))):
            state[2 * j] = 0.9 * state[2 * j] + 0.1 * slope
            state[2 * j + 1] = 0.99 * state[2 * j + 1] + 0.01 * slope**2
            value += RATE * (state[2 * j] / (1 - 0.9**i)) / (np.sqrt(state[2 * j + 1] / (1 - 0.99**i)) + 1e-9)
        # Long chains of one label would make the coupling drown the lines.
        np.clip(step, -1.0, 1.0, out=step)
    return Field(w, step, prior)


def quality(field: Field, texts: pa.Array) -> np.ndarray:
    """Score of every text: the length-weighted mean of its lines' marginals; the prior for a text without words."""
    features, size, first = line_features(texts)
    good, _, _ = field.marginals(features, first)
    total = np.concatenate([[0.0], np.cumsum(size * good)])[first]
    weight = np.concatenate([[0.0], np.cumsum(size)])[first]
    with np.errstate(invalid="ignore"):
        return np.clip(np.where(np.diff(weight) > 0, np.diff(total) / np.diff(weight), field.prior), 0.0, 1.0)


def by_bytes(batch: pa.RecordBatch, limit: int = BATCH_BYTES):
    """Parts of a batch of about ``limit`` text bytes each."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    done = np.cumsum(size) // limit
    heads = np.flatnonzero(np.r_[True, done[1:] != done[:-1]]) if len(size) else []
    for a, b in zip(heads, np.r_[heads[1:], len(size)].astype(int) if len(size) else []):
        yield batch.slice(a, b - a)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` documents of ``labels`` (doc_id, label 0 or 1), those with the smallest hashes of their ids.

    Rows with a null id or label, and labels of documents that ``docs`` lacks, do not count.
    """
    chosen = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("d"), "label")

    def features(batches):
        for batch in batches:
            for part in by_bytes(batch):
                f, _, first = line_features(part.column("text"))
                rows = [f[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "f"])
            give_back()

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("d")).select("doc_id", "label", "text")
    got = rows.mapInArrow(features, "doc_id bigint, label int, f binary").toArrow().sort_by([("doc_id", "ascending"), ("f", "ascending")])
    width = line_features(pa.array(["x"]))[0].shape[1]
    found = [np.frombuffer(f.as_py(), float).reshape(-1, width) for f in got.column("f")]
    first = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    return fit(np.vstack([np.zeros((0, width)), *found]), first, got.column("label").to_numpy())


def score(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of ``docs`` with ``score``: 0 to 1, higher for better text.

    ``docs`` needs ``text``; nothing else is an input of the score. One row per input row, equal texts get equal scores. A null text, an
    empty one and one without words get the share of good documents in the sample. An empty table gives an empty result.
    """
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(quality(field, part.column("text")))], names=[*columns, "score"])
            give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double")
