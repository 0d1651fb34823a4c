"""Language-model scoring with a hierarchical Pitman-Yor bigram model.

Every context word has a restaurant; the customers of restaurant u are the training tokens that follow u, its dishes are words, and each of its
tables sends one customer to the parent restaurant of single words that all contexts share; below that lies a uniform choice
among the known words and one for all unknown ones. Seating is sampled by Gibbs: dish after dish is seated anew given all other tables, from
the exact conditional (generalised Stirling numbers) up to ``EXACT`` customers, beyond that customer by customer in blocks of at most a tenth
of those seated. Predictive probabilities are averaged over ``SAMPLES`` seatings after ``BURN`` sweeps.

Blocks of documents (``blocks``) send each bucket of context words their distinct bigrams with training counts. A bucket holds whole restaurants
and samples them against its own copy of the parent, as its share of the franchise; the table counts of all buckets then meet by
word in the shared parent. Replies are whole numbers, one per distinct bigram or word of a block. Nothing is gathered on the driver; the totals of
the training data are one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm import blocks as B

U = np.uint64
#: Identities of the end of a text and of the context before its first word.
END, START = U(0x0123456789ABCDEF), U(0xFEDCBA9876543210)
BURN, SAMPLES = 2, 3
STRENGTH, PARENT_STRENGTH, PARENT_DISCOUNT = 1.0, 1.0, 0.75
#: Dishes of up to so many customers are seated from the exact conditional.
EXACT = 24
MESSAGE = "kind int, bucket int, block int, body binary"
TOTALS = "tokens double, types double, texts double, mass double, spread double"
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _bucket(word: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a word by the upper 48 bits of its hash."""
    return (B.mix((word >> U(16)) * B.MIX_A) % U(n)).astype(np.int64)


def _stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c, t up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 2), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, t] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - discount * t, 0.0)) + s[c, t])
    return s


def _seat(c, t, p, others, discount: float, strength: float, stirling, rng) -> np.ndarray:
    """New table counts of dishes with ``c`` customers: p their probability in the parent, others the tables of all other dishes there."""
    t = t.copy()
    for size in range(2, EXACT + 1):
        at = np.flatnonzero(c == size)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            count = np.arange(size)
            log = np.cumsum(np.log(strength + discount * (others[part, None] + count)) + np.log(p[part])[:, None], axis=1) + stirling[size, 1 : size + 1]
            chance = np.cumsum(np.exp(log - log.max(1, keepdims=True)), axis=1)
            t[part] = 1 + (chance < (rng.random(len(part)) * chance[:, -1])[:, None]).sum(1)
    at = np.flatnonzero(c > EXACT)
    seated, tables = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
    left = c[at].astype(np.int64)
    while True:
        on = np.flatnonzero(seated < left)
        if not len(on):
            break
        step = np.minimum(np.maximum(seated[on] // 10, 1), left[on] - seated[on])
        open_ = p[at[on]] * (strength + discount * (others[at[on]] + tables[on]))
        tables[on] += rng.binomial(step, open_ / (open_ + seated[on] - discount * tables[on]))
        seated[on] += step
    t[at] = tables
    return t


def _discount(c: np.ndarray) -> float:
    """Discount from the shares of dishes with one and with two customers."""
    one, two = int((c == 1).sum()), int((c == 2).sum())
    return float(np.clip(one / (one + 2.0 * two), 0.1, 0.95)) if one else 0.5


def seatings(context, dish, c, n_contexts: int, n_dishes: int, discount: float, seed: list[int]):
    """Table counts of every (context, dish) with ``c`` > 0 customers, one row per sample.

    The parent's probabilities come from the table counts of the same restaurants.
    """
    rng = np.random.default_rng(seed)
    stirling = _stirling(discount)
    t = np.ones(len(c), np.int64)
    many = np.flatnonzero(c > 1)
    out = np.ones((SAMPLES, len(c)), np.int64)
    for sweep in range(BURN + SAMPLES):
        if len(many):
            tables = np.bincount(context, t, n_contexts)
            customers = np.bincount(dish, t, n_dishes)
            known = max(int((customers > 0).sum()), 1)
            total = customers.sum() + PARENT_STRENGTH
            p = (np.maximum(customers[dish[many]] - PARENT_DISCOUNT, 0.0) + (PARENT_STRENGTH + PARENT_DISCOUNT * known) / (known + 1)) / total
            t[many] = _seat(c[many], t[many], p, tables[context[many]] - t[many], discount, STRENGTH, stirling, rng)
        if sweep >= BURN:
            out[sweep - BURN] = t
    return out


def _rows(kind, bucket, block, body) -> pa.Table:
    n = len(body)
    whole = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), n), pa.int32())
    return pa.table([whole(kind), whole(bucket), whole(block), pa.array(body, pa.binary())], names=["kind", "bucket", "block", "body"])


class _Block:
    """Tokens of a block: vocabulary ordered by (bucket, word), distinct bigrams ordered by (context, word)."""

    def __init__(self, payloads, n: int):
        self.rows = B.unpack(payloads)
        w = B.Words(self.rows.column("text"), lower=True)
        texts = len(w.first) - 1
        token = np.full(len(w) + texts, END, np.uint64)
        token[np.arange(len(w)) + w.text_of()] = w.hash
        self.first = w.first + np.arange(texts + 1)
        words = np.unique(np.concatenate([token, [END, START]]))
        bucket = _bucket(words, n)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = np.searchsorted(words, token)
        self.token = place[at]
        self.words = words[order]
        self.bounds = np.searchsorted(bucket[order], np.arange(n + 1))
        self.end, start = place[np.searchsorted(words, END)], place[np.searchsorted(words, START)]
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first[:-1]] = start
        del w, token, at
        pairs, self.pair = np.unique((before << 32) | self.token, return_inverse=True)
        self.context, self.word = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_bounds = np.searchsorted(self.context, self.bounds)

    def fill(self, replies: pa.Table, kind: int, name: str, bounds: np.ndarray) -> np.ndarray:
        """One reply column of all buckets, in this block's order."""
        out = np.zeros(bounds[-1])
        for k, b, m in zip(replies.column("kind").to_pylist(), replies.column("bucket").to_pylist(), replies.column("body")):
            if k == kind:
                out[bounds[b] : bounds[b + 1]] = B.arrays_from_bytes(m.as_py())[name]
        return out


def _merged(t: pa.Table):
    """Restaurants of a bucket from all messages: context ids, and per message entry its context and its dish."""
    order = np.argsort(t.column("block").to_numpy(), kind="stable")
    got = [B.arrays_from_bytes(t.column("body")[int(i)].as_py()) for i in order]
    names = np.concatenate([g["context"] for g in got])
    contexts, context_of = np.unique(names, return_inverse=True)
    size = np.concatenate([g["size"] for g in got])
    own = np.repeat(context_of, size)
    word = (np.concatenate([g["high"] for g in got]).astype(np.uint64) << U(32)) | np.concatenate([g["low"] for g in got]).astype(np.uint64)
    bits = U(max(int(len(contexts)).bit_length(), 16))
    # Contexts number fewer than 2^bits; a word is told from others of its context by the bits left.
    key = (own.astype(np.uint64) << (U(64) - bits)) | (word >> (bits - U(16)))
    by = np.argsort(key)
    heads = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]]) if len(key) else np.zeros(0, np.int64)
    kind = np.empty(len(key), np.int64)
    kind[by] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(key)]))
    c = np.bincount(kind, np.concatenate([g["count"] for g in got]), len(heads)).astype(np.int64)
    return order, got, contexts, context_of, kind, own[by][heads], word[by][heads], c


def score(docs: DataFrame, train, n_blocks: int | None = None, seed: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``docs`` needs ``doc_id`` and ``text``; ``train`` is a condition on it, true for the rows to learn from; held_out is true where it is
    false, and false where it is null (such rows are not learned from). Tokens are the words, A-Z lower-cased, and one end per text, so a null or empty text
    is one token. One row per input row. Base: add-one estimate of single tokens. Without training rows all tokens are unknown and score 0 (probability one for the unknown
    word). An empty table gives an empty result. Reruns on the same blocks agree.
    """
    n = n_blocks or B.parts(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train"))
    packed = B.pack(docs, n)

    def ask(t: pa.Table) -> pa.Table:
        b = _Block(t.column("payload"), n)
        learned = b.rows.column("train").fill_null(False).to_numpy(zero_copy_only=False)
        count = np.bincount(b.pair, np.repeat(learned, np.diff(b.first)), len(b.context)).astype(np.uint32)
        size = np.bincount(b.context, minlength=len(b.words)).astype(np.uint32)
        short = b.words[b.word] >> U(16)
        body, to = [], np.flatnonzero(b.bounds[1:] > b.bounds[:-1])
        for k in to:
            w, p = slice(b.bounds[k], b.bounds[k + 1]), slice(b.pair_bounds[k], b.pair_bounds[k + 1])
            body.append(B.arrays_to_bytes(context=b.words[w], size=size[w], low=(short[p] & U(0xFFFFFFFF)).astype(np.uint32), high=(short[p] >> U(32)).astype(np.uint16), count=count[p]))
        return _rows(0, to, t.column("block")[0].as_py(), body)

    def sampled(t: pa.Table):
        order, got, contexts, context_of, kind, context, word, c = _merged(t)
        on = np.flatnonzero(c > 0)
        dishes, dish = np.unique(word[on], return_inverse=True)
        discount = _discount(c[on])
        tables = seatings(context[on], dish, c[on], len(contexts), len(dishes), discount, [seed, int(t.column("bucket")[0].as_py())])
        return order, got, contexts, context_of, kind, context, c, on, dishes, dish, discount, tables

    def send_tables(t: pa.Table) -> pa.Table:
        """Table counts by dish, to the bucket of the dish."""
        *_, dishes, dish, _, tables = sampled(t)
        to = _bucket(dishes << U(16), n)
        order = np.argsort(to, kind="stable")
        sums = [np.bincount(dish, s, len(dishes)).astype(np.uint32)[order] for s in tables]
        bounds, dishes = np.searchsorted(to[order], np.arange(n + 1)), dishes[order]
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        body = []
        for k in full:
            p = slice(bounds[k], bounds[k + 1])
            body.append(B.arrays_to_bytes(low=(dishes[p] & U(0xFFFFFFFF)).astype(np.uint32), high=(dishes[p] >> U(32)).astype(np.uint16), **{f"s{i}": s[p] for i, s in enumerate(sums)}))
        return _rows(0, full, t.column("bucket")[0].as_py(), body)

    def reply(t: pa.Table) -> pa.Table:
        """Customers and tables of every bigram and context, to the blocks that asked."""
        order, got, contexts, context_of, kind, context, c, on, _, _, discount, tables = sampled(t)
        seated = np.zeros(len(c), np.uint32)
        seated[on] = tables.sum(0)
        of_context = np.bincount(context, c, len(contexts)).astype(np.uint32)
        all_tables = np.bincount(context, seated, len(contexts)).astype(np.uint32)
        body, a, p = [], 0, 0
        for g in got:
            own, pairs = context_of[a : a + len(g["context"])], kind[p : p + len(g["low"])]
            a, p = a + len(own), p + len(pairs)
            body.append(B.arrays_to_bytes(customers=c[pairs].astype(np.uint32), tables=seated[pairs], of_context=of_context[own], all_tables=all_tables[own], discount=np.full(len(own), discount)))
        return _rows(1, t.column("bucket")[0].as_py(), t.column("block").to_numpy()[order], body)

    def parent(t: pa.Table, sent: pa.Table) -> pa.Table:
        """Counts and parent customers less discounts of every word, to the blocks that asked; kind 3: the bucket's part of the totals."""
        if not t.num_rows:
            return _rows(2, 0, 0, []).append_column("totals", pa.array([], pa.list_(pa.float64())))
        order = np.argsort(t.column("block").to_numpy(), kind="stable")
        got = [B.arrays_from_bytes(t.column("body")[int(i)].as_py()) for i in order]
        names = np.concatenate([g["context"] for g in got])
        words, place = np.unique(names, return_inverse=True)
        ends = np.cumsum([len(g["context"]) for g in got])
        in_text = np.concatenate([np.diff(np.concatenate([[0], np.cumsum(g["count"], dtype=np.int64)])[np.concatenate([[0], np.cumsum(g["size"], dtype=np.int64)])]) for g in got])
        count = np.bincount(place, in_text, len(words)).astype(np.int64)
        texts = int(count[words == START].sum())
        count[(words == START) | (words == END)] = 0
        customers = np.zeros((SAMPLES, len(words)), np.int64)
        short = words >> U(16)
        for m in sent.column("body"):
            g = B.arrays_from_bytes(m.as_py())
            at = np.searchsorted(short, (g["high"].astype(np.uint64) << U(32)) | g["low"].astype(np.uint64))
            for s in range(SAMPLES):
                customers[s][at] += g[f"s{s}"]
        rng = np.random.default_rng([seed, 1, int(t.column("bucket")[0].as_py())])
        stirling, kept, mass, spread = _stirling(PARENT_DISCOUNT), np.zeros(len(words)), 0.0, 0.0
        for s in customers:
            on = np.flatnonzero(s > 0)
            tables = np.ones(len(on), np.int64)
            p = np.full(len(on), 1.0 / (len(on) * n + 1))
            for _ in range(BURN + 1):
                tables = _seat(s[on], tables, p, np.maximum(tables.sum() * n - tables, 0).astype(float), PARENT_DISCOUNT, PARENT_STRENGTH, stirling, rng)
            kept[on] += s[on] - PARENT_DISCOUNT * tables
            mass, spread = mass + s.sum(), spread + PARENT_DISCOUNT * tables.sum()
        body = [B.arrays_to_bytes(count=count[place[e - len(g["context"]) : e]].astype(np.uint32), kept=kept[place[e - len(g["context"]) : e]].astype(np.float32)) for g, e in zip(got, ends)]
        rows = _rows(2, t.column("bucket")[0].as_py(), t.column("block").to_numpy()[order], body)
        totals = _rows(3, t.column("bucket")[0].as_py(), -1, [b""])
        own = [[], [float(count.sum()), float((count > 0).sum()), float(texts), mass, spread]]
        kind = pa.list_(pa.float64())
        return pa.concat_tables([rows.append_column("totals", pa.array([None] * len(body), kind)), totals.append_column("totals", pa.array(own[1:], kind))])

    def finish(t: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])
        if not t.num_rows:
            return schema.empty_table()
        b = _Block(t.column("payload"), n)
        tokens, types, texts, mass, spread = (float(replies.column(c)[0].as_py()) for c in ("tokens", "types", "texts", "mass", "spread"))
        tokens, types = tokens + texts, types + (texts > 0)
        count = b.fill(replies, 2, "count", b.bounds)
        count[b.end] = texts
        base = np.log10((count + 1) / (tokens + types + 1))
        mass, spread = mass + SAMPLES * PARENT_STRENGTH, spread + SAMPLES * PARENT_STRENGTH
        single = (b.fill(replies, 2, "kept", b.bounds) + spread / (types + 1)) / mass
        customers, tables = b.fill(replies, 1, "customers", b.pair_bounds), b.fill(replies, 1, "tables", b.pair_bounds)
        of_context, all_tables, discount = (b.fill(replies, 1, c, b.bounds) for c in ("of_context", "all_tables", "discount"))
        below = STRENGTH + of_context
        back = (STRENGTH + discount * all_tables / SAMPLES) / below
        chance = np.maximum(customers - discount[b.context] * tables / SAMPLES, 0.0) / below[b.context] + back[b.context] * single[b.word]
        heads = b.first[:-1]
        learned = b.rows.column("train")
        held = pa.compute.fill_null(pa.compute.invert(learned), False)
        return pa.table(
            [
                b.rows.column("doc_id"), held, pa.array(np.diff(b.first)), pa.array(np.add.reduceat((count > 0)[b.token].astype(np.int64), heads)),
                pa.array(np.full(len(heads), int(tokens))), pa.array(np.add.reduceat(base[b.token], heads)), pa.array(np.add.reduceat(np.log10(chance)[b.pair], heads)),
            ],
            schema=schema,
        )

    by_block = packed.groupBy("block")
    asks = by_block.applyInArrow(ask, MESSAGE)
    by_bucket = asks.groupBy("bucket")
    tables = by_bucket.applyInArrow(send_tables, MESSAGE)
    judged = by_bucket.cogroup(tables.groupBy("bucket")).applyInArrow(parent, MESSAGE + ", totals array<double>")
    totals = judged.where("kind = 3").agg(*[F.sum(F.col("totals")[i]).alias(c.split()[0]) for i, c in enumerate(TOTALS.split(", "))])
    replies = by_bucket.applyInArrow(reply, MESSAGE).unionByName(judged.where("kind = 2").drop("totals"))
    # One row: what all buckets have seen.
    replies = replies.crossJoin(F.broadcast(totals))
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(finish, OUT)
