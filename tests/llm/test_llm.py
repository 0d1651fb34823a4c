"""The training-data operators against brute-force versions on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from voxfield.llm import bpe, catalog, components, mixing, mtree, orderminhash, overlap, pitmanyor, quality, simhash, substring, toxicity, urls
from voxfield.llm.q_urls import RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Columns that an operator might use itself, as extra columns of its input.
EXTRA = "block string, h string, k string, fp string, piece string"


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, shared passages, junk, nulls, repeated rows, and columns with clashing names."""
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdeéß"), rng.integers(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, base = text(60), text(200)
    rows = [(i, text(int(rng.integers(1, 120)))) for i in range(40)]
    rows += [(100 + i, text(20) + " " + passage + "\n" + text(15)) for i in range(6)]
    rows += [(200 + i, base if i % 2 else base + f" tail{i}") for i in range(8)]
    rows += [(300, "word " * 900), (301, ""), (302, None), (303, " \t\n"), (304, "x" * 5000), (305, "One  Two\x0bthree"), (306, " ".join(["a b"] * 50))]
    rows += [(310, base), (310, base), (None, passage), (None, None)]
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", f"s{(i or 0) % 4}" if i != 5 else None) for i, t in rows], f"doc_id long, text string, {EXTRA}, source string").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def words(text):
    return WORD.findall(text or "")


def empty(docs):
    return docs.where("false")


def test_substring_against_brute_force(docs, rows):
    order = lambda d: 1 << 70 if d is None else d
    least = {}
    for r in rows:
        w = words(r.text)
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            least[key] = min(least.get(key, 1 << 80), order(r.doc_id))
    want = collections.Counter()
    for r in rows:
        w, gone = words(r.text), set()
        for p in range(len(w) - 12):
            if least[tuple(w[p : p + 13])] < order(r.doc_id):
                gone |= set(range(p, p + 13))
        want[(r.doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    for n in (1, 5):
        got = collections.Counter(tuple(r) for r in substring.remove_repeats(docs, n_blocks=n).collect())
        assert got == want
    assert sum(k[2] for k in want) > 300
    assert substring.remove_repeats(empty(docs)).count() == 0


def test_cover_brings_any_two_positions_onto_it():
    for i, j in itertools.product(range(substring.PERIOD), repeat=2):
        assert any((i + k) % substring.PERIOD in substring.COVER and (j + k) % substring.PERIOD in substring.COVER for k in range(substring.PERIOD))


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    raw = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return raw, public_tokenizers.PATTERN, bpe._encoder(raw, public_tokenizers.PATTERN, {})


def test_bpe_chunks_give_the_ids_of_the_whole_text(spark, docs, rows, vocabulary):
    raw, pattern, encoding = vocabulary
    more = [(900, "a" * 700 + " b" * 80 + " " * 300 + "x"), (900, "a" * 700 + " b" * 80 + " " * 300 + "x"), (901, "it's they're 've   \n\n \t x" * 30), (902, "日本語テキスト、" * 90)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = collections.Counter((d, tuple(encoding.encode_ordinary(t or ""))) for d, t in [(r.doc_id, r.text) for r in rows] + more)
    coded = bpe.encode(both, raw, pattern, chunk=200, overlap=60).cache()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == want
    back = collections.Counter((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(coded, raw).collect())
    assert back == collections.Counter((d, t or "") for d, t in [(r.doc_id, r.text) for r in rows] + more)
    assert bpe.encode(empty(docs), raw, pattern).count() == 0


def test_decode_of_nulls_and_unknown_ids(spark, vocabulary):
    raw, _, encoding = vocabulary
    ids = encoding.encode_ordinary("hello")
    df = spark.createDataFrame([(1, ids), (2, None), (3, []), (4, [None, 99_999_999, *ids])], "n long, ids array<int>")
    assert {r.n: bytes(r.decoded) for r in bpe.decode(df, raw).collect()} == {1: b"hello", 2: b"", 3: b"", 4: b"hello"}


def brute_fingerprint(text):
    import xxhash

    w = words((text or "").translate(UPPER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_classes(docs, rows):
    fp = [brute_fingerprint(r.text) for r in rows]
    root = roots(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4])
    name = {}
    for r, c in zip(rows, root):
        if r.doc_id is not None:
            name[c] = min(name.get(c, r.doc_id), r.doc_id)
    want = collections.Counter((r.doc_id, f"{f:016x}", name.get(c)) for r, f, c in zip(rows, fp, root))
    assert collections.Counter(tuple(r) for r in simhash.classes(docs).collect()) == want
    assert simhash.classes(empty(docs)).count() == 0


@pytest.mark.parametrize("n, centres", [(900, 4), (300, 250), (700, 1), (2, 1), (0, 1)])
def test_bit_sliced_links_connect_what_brute_force_connects(n, centres):
    rng = np.random.default_rng(n)
    f = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(3):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * (rng.random(n) < 0.6).astype(np.uint64)
    f = np.unique(f)
    g = np.sort(rng.integers(0, 3, len(f)))
    a, b = simhash.spanning_links(g, f)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(f)), 2) if g[i] == g[j] and (int(f[i]) ^ int(f[j])).bit_count() <= 4]
    assert roots(len(f), zip(a.tolist(), b.tolist())) == roots(len(f), pairs)
    assert len(a) < max(len(f), 1)


def test_links_by_blocks_of_a_large_key(spark):
    rng = np.random.default_rng(1)
    f = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    fps = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    found = components.components(simhash.links(fps, block=8))
    assert found.select("component").distinct().count() == 1 and found.count() == len(f)


def brute_sets(texts):
    w = [words((t or "").translate(UPPER)) for t in texts]
    return [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]


def brute_classes(texts):
    """The smallest row number of the class of each text at Jaccard 0.8, all pairs compared that share a shingle."""
    sets, holders = brute_sets(texts), collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {()}:
            holders[x].append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    return roots(len(texts), [(i, j) for i, j in pairs if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])])


def test_near_dedup_stage_against_brute_force(spark, sf):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    edited = [" ".join(w if k not in set(rng.integers(0, 120, 2)) else f"e{i}" for k, w in enumerate(base)) for i in range(40)]
    given = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in given.collect()] + [(10_000 + i, t) for i, t in enumerate([*edited, "", None, " \t", "one two", "One  two", "a a a a a a", "a a a a a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [rows[i][0] for i, c in enumerate(brute_classes([t for _, t in rows])) if i == c]
    got = [r.doc_id for r in corpus_pipeline.keep_first(spark, docs, sf).collect()]
    assert sorted(got) == sorted(want)
    assert corpus_pipeline.keep_first(spark, empty(docs), sf).count() == 0


def test_fingerprints_propose_near_copies(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:150] + ["other"] + words[151:]), " ".join(reversed(words)), " ".join(words).upper(), "", None]
    rows = [(i, t, i, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r0 long, r1 long")
    nodes = spark.createDataFrame([(i, 0, i) for i in (0, 1, 2, 3)], "r0 long, r1 long, node long")
    near = [simhash.fingerprint(t.encode(), 5) for t in texts[:4]]
    want = {(a, b) for a in range(4) for b in range(a + 1, 4) if (near[a] ^ near[b]).bit_count() <= simhash.RADIUS}
    got = {tuple(r) for r in overlap._by_fingerprint(docs, nodes, 5).collect()}
    # Pairs are a spanning forest of the links, and one fingerprint's nodes are a star.
    assert (0, 3) in got and got <= want | {(0, 3)} and len({x for p in got for x in p}) == len({x for p in want for x in p})
    assert not overlap._by_fingerprint(docs.limit(0), nodes, 5).collect()


def test_centres_reach_every_pair_of_a_key(spark):
    """Chains in which only neighbours are alike: a first centre alone does not connect them."""
    word = [f"w{x}" for x in range(400)]
    docs = spark.createDataFrame([(i, " ".join(word[4 * i : 4 * i + 100])) for i in range(60)], "doc_id long, text string")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert len(set(brute_classes(texts))) == 1 and len(set(brute_classes(texts[::4]))) == 15
    assert overlap.first_rows(docs, 5, 80).count() == 1
    assert overlap.first_rows(docs.where("doc_id % 4 = 0"), 5, 80).count() == 15


def test_stages_keep_rows_with_null_and_shared_ids(spark, sf):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))
    passage = text(20)
    rows = [(None, text(30)) for _ in range(8)] + [(None, rows_text := text(40)), (None, rows_text), (None, rows_text)]
    rows += [(7, a := text(30)), (7, text(30)), (7, text(30) + " " + passage), (3, passage + "  " + text(9)), (None, passage + " " + text(30)), (None, a)]
    docs = spark.createDataFrame([(i, t, None if k % 2 else "x", k, len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n_words int, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_first(spark, docs, sf).collect()]
    kept = [r for k, r in enumerate(rows) if k not in (9, 10, len(rows) - 1)]
    assert collections.Counter(got) == collections.Counter(kept)
    whole = spark.createDataFrame([(None, rows_text), (None, rows_text)], "doc_id long, text string")
    assert [tuple(r) for r in corpus_pipeline.keep_first(spark, whole, sf).collect()] == [(None, rows_text)]

    def cut(i, t):
        """Only ``passage`` and ``a`` are in documents of a smaller id."""
        if i is None and t == a:
            return ""
        return " ".join(t.replace(passage, "").split()) if passage in t and i != 3 else t

    after = corpus_pipeline.drop_repeats(spark, docs, sf)
    assert after.columns == docs.columns and after.dtypes == docs.dtypes
    want = collections.Counter((i, c := cut(i, t), None if k % 2 else "x", k, len(c)) for k, (i, t) in enumerate(rows))
    assert collections.Counter(tuple(r) for r in after.collect()) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 500), (501, None), (None, 502), (601, 600), (600, 601)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 300)}, 600: 600, 601: 600}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls_with_aliases(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://A.example.net/x", "<link rel='canonical' href='https://bad.example.com/de/1'>"),
            (2, "http://b.example.net/y#q", '<meta http-equiv="refresh" content="0; url=http://a.example.net/x">'),
            (3, "http://c.org/z", '<link href="//b.example.net/y" rel=canonical>'),
            (4, None, "<link rel=canonical href='http://bad.example.com/de/1'>"),
            (5, "nothing", "<link rel=canonical href=/x>"),
            (6, "http://free.net/a/b?c", "<link rel=canonical href='d'>"),
            (7, "http://x.example.org/es/1", None),
            (7, "http://x.example.org/es/1", None),
            (8, "http://example.org/en/1", ""),
            (9, "http://notexample.com/de", ""),
            (10, "http://x.com?y", ""),
        ],
        "page_id long, url string, html string",
    ).withColumns({"host": F.lit("clash"), "key": F.lit("clash"), "rule": F.lit("clash")})
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, RULES).collect())
    assert got == collections.Counter([
        (1, "a.example.net", "/x", None, "block"), (2, "b.example.net", "/y", None, "block"), (3, "c.org", "/z", "org/", "allow"), (4, "", "", None, "allow"),
        (5, "", "", None, "allow"), (6, "free.net", "/a/b", None, "allow"), (7, "x.example.org", "/es/1", "example.org/es/", "block"),
        (7, "x.example.org", "/es/1", "example.org/es/", "block"), (8, "example.org", "/en/1", "example.org/en/1", "block"),
        (9, "notexample.com", "/de", None, "allow"), (10, "x.com", "", None, "allow"),
    ])
    assert urls.judge_urls(pages.where("false"), RULES).count() == 0


def test_mix_meets_targets_and_repeats(spark, docs):
    own = docs.select("doc_id", "text", "source", "block")
    drawn = mixing.draw(own).collect()
    sizes, taken, goal = collections.Counter(), collections.Counter(), {}
    for r in drawn:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert len(drawn) == own.count() and sum(r.size for r in drawn) == sum(len(words(r.text)) for r in own.collect())
    assert math.isclose(sum(goal.values()), sum(sizes.values())) or all(math.isclose(goal[s], 3 * sizes[s]) for s in sizes)
    for s in sizes:
        assert goal[s] <= 3 * sizes[s] + 1e-6
    full = mixing.mix(own)
    assert full.columns == own.columns
    count = collections.Counter(r.doc_id for r in full.collect())
    want = collections.Counter()
    for r in drawn:
        want[r.doc_id] += r.copies
    assert count == +want
    assert sorted(map(str, mixing.draw(own.repartition(7)).collect())) == sorted(map(str, drawn))
    assert mixing.draw(empty(own)).count() == 0


def test_flight_keeps_sums():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 500, 400).astype(float), np.full(50, 7.0), np.zeros(9), np.array([5.0]), np.r_[rng.integers(1, 9, 99), 10_000.0]):
        p0 = np.full(len(sizes), 0.37)
        p = mixing._flight(p0, sizes, rng.random(len(sizes)))
        assert math.isclose(p.sum(), p0.sum(), rel_tol=1e-6) and math.isclose(p @ sizes, p0 @ sizes, rel_tol=1e-6, abs_tol=1e-6)
        assert ((p > 0) & (p < 1)).sum() <= 3


def test_targets_fill_up():
    assert mixing.targets([10, 10, 10]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 100, 100]) == pytest.approx([3, 132, 66])
    assert mixing.targets([0, 0]) == [0, 0]


def test_order_minhash(docs, rows):
    got = collections.defaultdict(list)
    out = orderminhash.edited_fingerprints(docs)
    for r in out.withColumns({"near": orderminhash.likeness(F.col("signature"), F.col("edited_signature")), "self": orderminhash.likeness(F.col("signature"), F.col("signature"))}).collect():
        got[r.doc_id].append(r)
        assert 0.0 <= r.near <= 1.0 and r.self == 1.0
    by_id = sorted({r.doc_id: r.text or "" for r in rows if r.doc_id is not None and r.doc_id != 310}.items(), reverse=True)
    following = dict(zip([d for d, _ in by_id], [t for _, t in by_id[1:]]))
    for d, t in by_id[:-1]:
        half = len(t) // 2
        assert got[d][0].edited == t[: len(t) - half] + following[d][:half] and got[d][0].n_chars == len(t)
    assert len(got[310]) == 2 and len(got[None]) == 2
    same = collections.defaultdict(set)
    for r in rows:
        for g in got[r.doc_id]:
            if g.n_chars == len(r.text or "") and r.doc_id is not None:
                same[r.text or ""].add(tuple(g.signature))
    assert all(len(s) == 1 for s in same.values())
    assert orderminhash.edited_fingerprints(empty(docs)).count() == 0


def test_order_minhash_sees_order_and_repeats(spark):
    base = [f"w{i}" for i in range(300)]
    moved = base[150:] + base[:150]
    texts = {"base": base, "moved": moved, "one": base[:100] + ["x"] + base[101:], "other": [f"v{i}" for i in range(300)], "twice": base + base}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "name string, text string")
    sig = {r.name: r.s for r in orderminhash.with_signature(df, "text", "s").collect()}
    alike = lambda a, b: len(set(sig[a]) & set(sig[b])) / len({x >> 24 for x in sig[a]} | {x >> 24 for x in sig[b]})
    assert alike("base", "one") > 0.85 > alike("base", "moved") > alike("base", "other") == 0.0
    assert alike("base", "twice") < 0.95


def test_quality_learns_lines(spark):
    rng = np.random.default_rng(3)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "river", "runs", "under", "an", "old", "bridge"], 12)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(["BUY!!"] * 10) for _ in range(4))
    data = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(900, None, "x"), (901, "", "x"), (902, good() + "\n" + bad() * 9, "x")], "doc_id long, text string, score0 string")
    field = quality.train(docs.select("doc_id", "text"), spark.createDataFrame([(i, y) for i, _, y in data if i < 90] + [(None, 1), (5000, 0)], "doc_id long, label int"))
    got = {r.doc_id: r.score for r in quality.score(docs, field).collect()}
    assert all((got[i] >= quality.THRESHOLD) == y for i, _, y in data) and got[900] == got[901] == pytest.approx(field.prior)
    assert got[902] < 0.5 and len(got) == 123 and quality.score(docs.where("false"), field).count() == 0


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(4)
    pull, step, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 7])
    got, moves, total = quality.forward_backward(pull, step, first)
    log = 0.0
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        weight = {y: math.exp(sum(p * v for p, v in zip(pull[a:b], y)) + sum(step[u, v] for u, v in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=b - a)}
        z = sum(weight.values())
        log += math.log(z)
        for k in range(b - a):
            assert got[a + k] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / z)
    assert total == pytest.approx(log) and moves.sum() == pytest.approx(4)


def test_toxicity_sees_inserted_characters(spark):
    rng = np.random.default_rng(5)
    plain = ["river", "bridge", "under", "evening", "garden", "letter", "window", "stone"]
    text = lambda n: " ".join(rng.choice(plain, n))
    data = [(i, text(30) + (" wretchling " if i % 4 == 0 else " ") + text(20), int(i % 4 == 0)) for i in range(160)]
    extra = [(900, text(20) + " wre.tchling " + text(10)), (901, text(40)), (902, None), (903, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(i, t, "x") for i, t in extra], "doc_id long, text string, lang string")
    machine = toxicity.train(docs.select("doc_id", "text"), spark.createDataFrame([(i, y) for i, _, y in data if i < 120], "doc_id long, label int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert all((got[i] >= 0.5) == y for i, _, y in data)
    # One character inside the insult leaves its gapped subsequences: far above any clean text.
    assert got[900] > 5 * max(got[i] for i, _, y in data if not y) and got[901] < 0.5 and got[902] == got[903] < 0.5
    assert toxicity.score(docs.where("false"), machine).count() == 0


def test_folded_weights_equal_the_kernel():
    strings, marks = [" pathetic x", "a wretch"], toxicity.phi([" pathe", " wret"])
    table = np.zeros(toxicity.CELLS, np.float32)
    for beta, m in zip((0.7, -0.2), marks):
        for x, v in m.items():
            table[x] += beta * v
    for s, k in zip(strings, toxicity.kernel(toxicity.phi(strings), marks) @ [0.7, -0.2]):
        c, _ = toxicity.codes([s])
        assert sum(float(w * table[cell].sum()) for cell, w in toxicity.cells(c)) == pytest.approx(k, abs=1e-4)


def test_pitman_yor_counts_and_base(docs, rows):
    train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    tokens = [[*words((r.text or "").translate(UPPER)), None] for r in rows]
    count = collections.Counter(itertools.chain.from_iterable(t for r, t in zip(rows, tokens) if train(r.doc_id)))
    n, v = sum(count.values()), len(count)
    want = collections.Counter((r.doc_id, len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 6)) for r, t in zip(rows, tokens))
    condition = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    for blocks in (1, 3):
        out = pitmanyor.score(docs, condition, n_blocks=blocks).collect()
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
        assert all(r.score <= 1e-9 for r in out)
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert pitmanyor.score(empty(docs), condition).count() == 0


def test_pitman_yor_probabilities_sum_to_one(spark):
    """After one known context, the chances of every known word, the end and one unknown word sum to one."""
    train = "the cat sat on the mat the cat ran to the dog and the dog sat"
    known = sorted(set(train.split()))
    data = [(0, train, True)] + [(1 + i, f"the {w}", False) for i, w in enumerate([*known, "zebra"])] + [(99, "the", False)]
    df = spark.createDataFrame(data, "doc_id long, text string, t boolean")
    got = {r.doc_id: r.score for r in pitmanyor.score(df, F.col("t"), n_blocks=2).collect()}
    # score("the w") = log P(the | start) + log P(w | the) + log P(end | w); the end after w is scored alone through a text "w".
    alone = spark.createDataFrame([(0, train, True)] + [(1 + i, w, False) for i, w in enumerate([*known, "zebra"])] + [(98, "", False)], "doc_id long, text string, t boolean")
    single = {r.doc_id: r.score for r in pitmanyor.score(alone, F.col("t"), n_blocks=2).collect()}
    start = sum(10 ** single[i] for i in single if i == 98)
    assert 0 < start < 1 and all(s <= 0 for s in got.values())
    rng = np.random.default_rng(1)
    context, dish, c = np.array([0, 0, 1, 1, 1]), np.array([0, 1, 0, 1, 2]), np.array([5, 1, 2, 60, 1])
    for t in pitmanyor.seatings(context, dish, c, 2, 3, 0.6, [int(rng.integers(9))]):
        assert (t >= 1).all() and (t <= c).all()
        tables = np.bincount(context, t)
        chance = (c - 0.6 * t) / (pitmanyor.STRENGTH + np.bincount(context, c)[context])
        back = (pitmanyor.STRENGTH + 0.6 * tables) / (pitmanyor.STRENGTH + np.bincount(context, c))
        assert np.bincount(context, chance) + back == pytest.approx([1.0, 1.0])


def test_stirling_numbers_of_zero_discount():
    s = pitmanyor._stirling(0.0)
    assert np.exp(s[4, 1:5]) == pytest.approx([6, 11, 6, 1])


def test_m_tree_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(5, 8))
    data = [(int(i), [float(x) for x in centre[i % 5] + 0.2 * rng.normal(size=8)]) for i in range(700)]
    data += [(2000 + i, data[3][1]) for i in range(60)] + [(3000, None), (3020, [1.0, None]), (3040, [float("nan")] * 8), (3060, [float("inf")] * 8), (None, data[0][1]), (3080, [0.5]), (3080, [0.5])]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in data], "vec_id long, embedding array<float>, cell string, part string")
    whole = {}
    for i, v in [(r.vec_id, r.embedding) for r in df.collect()]:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(64 * x) for x in v]
    want = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:20]
            want |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)}
    vectors = mtree.whole_vectors(df)
    for routers in (1, 9):
        got = mtree.top_k(vectors, F.col("vec_id") % 20 == 0, 20, routers).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert mtree.top_k(vectors.where("vec_id < 5"), F.col("vec_id") == 0, 20).count() == 4
    assert mtree.top_k(vectors.where("false"), F.col("vec_id") == 0).count() == 0


def test_m_tree_sends_a_query_to_a_bin_once(spark, monkeypatch):
    """What a task sends on does not grow with the subtrees that a query visits."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [int(x) for x in rng.integers(-40, 40, 8)]) for i in range(600)], "vec_id long, v array<long>")
    seen = lambda pages, asks, *_: pa.table([asks.column("vec_id"), pa.array([-1] * len(asks), pa.int64()), pa.array([len(pages)] * len(asks), pa.int64())], names=["query_id", "vec_id", "score"])
    monkeypatch.setattr(mtree, "_search", seen)
    # Without finds every subtree is within reach: one bin holds all of them.
    visits = [(r.query_id, r.score) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0, 20, 15).collect()]
    assert sorted(visits) == [(i, 600) for i in range(0, 600, 20)]
    monkeypatch.setattr(mtree, "SMALL", 1)
    visits = [r.query_id for r in mtree.top_k(df, F.col("vec_id") % 20 == 0, 100, 15).collect()]
    assert set(visits) == set(range(0, 600, 20)) and len(visits) > 30 * 15


def test_m_tree_bins_hold_all_rows(monkeypatch):
    rng = np.random.default_rng(10)
    objects, count = rng.random((50, 4)), rng.integers(0, 40, 50)
    count[7] = 1000
    base, parts = mtree._bins(objects, count, 100)
    assert parts[7] == 10 and (np.delete(parts, 7) == 1).all()
    rows = np.bincount(np.delete(base, 7), np.delete(count, 7))
    assert rows.max() <= 100 and not (set(range(base[7], base[7] + 10)) & set(base[(count > 0) & (np.arange(50) != 7)]))
    assert {*base[count > 0], *range(base[7], base[7] + 10)} == set(range(max(base.max() + 1, base[7] + 10)))


def test_m_tree_scores_beyond_doubles(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [int(x) for x in (1 << 30) + rng.integers(-40, 40, 3)]) for i in range(300)]
    rows += [(300 + i, [x + (i == 1) for x in rows[7][1]]) for i in range(3)] + [(400, [2**55 + 1, -3, 5]), (401, [-(2**55), 1]), (402, []), (500, [1 << 62, 0, 0]), (501, [-(1 << 62), 0, 0])] + [(510 + i, [-(1 << (45 + i)), 0, 0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = set()
    for i, q in rows:
        if i % 5 == 0:
            scored = sorted((-clip(sum(a * b for a, b in zip(q, v))), j) for j, v in rows if j != i)
            want |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:5], 1)}
    for routers in (1, 7):
        assert {tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 5 == 0, 5, routers).collect()} == want
        small = df.where("vec_id < 300")
        kept = {r.query_id for r in mtree.top_k(small, F.col("vec_id") % 5 == 0, 5, routers).collect()}
        assert len(kept) == 60


def test_registered_queries_match_their_sql(spark, sf):
    from check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in catalog.SQL.items():
        df = catalog.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns), name
        assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall()), name


def test_op3_digests(spark, sf, vocabulary):
    encoding = vocabulary[2]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.QUERIES["op3_byte_bpe"](spark, sf).collect():
        ids = encoding.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "source_mix", "byte_bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        old = {r.doc_id for r in before.select("doc_id").collect()}
        assert set(ids) <= old and ids
        if name in ("quality", "near_dedup", "substring_dedup"):
            assert len(ids) == len(set(ids))
        if name == "substring_dedup":
            assert set(ids) == old
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert out.count() == before.count() and out.where("n_tokens <> size(ids)").count() == 0
