"""Duplicate operators against brute force: exact, near, passages, lines."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sedimenta.llm import common, components, exact_dedup, line_dedup, near_dedup, prefix_free, suffix_dedup

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
# a column whose name clashes with those the operators make for themselves
CLASH = StructType([*SCHEMA, StructField("gone", StringType()), StructField("body", StringType()), StructField("id", StringType())])


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *[None] * (len(schema) - 2)) for r in rows], schema)


def prose(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def corpus():
    """Copies of two to forty, edited copies, shared passages, odd rows."""
    rng = random.Random(5)
    rows, i = [], 0
    passage = prose(rng, 70)
    for n in (2, 3, 40):
        base = prose(rng, 150)
        for k in range(n):
            words = list(base)
            for _ in range(k % 9):
                words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            rows.append((i := i + 1, " ".join(words)))
    for _ in range(60):
        words = prose(rng, rng.randrange(1, 200))
        if rng.random() < 0.3:
            at = rng.randrange(len(words))
            words[at:at] = passage
        rows.append((i := i + 1, " ".join(words)))
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, ""), (903, "!!! ..."), (904, "two words"), (905, "Two, words!"), (906, "x " * 30000), (906, "x " * 30000), (907, "x " * 29000), (908, "naïve Ünï 漢字 " * 3), (909, "NAÏVE ünÏ 漢字 " * 3)]
    return rows


def words_of(text):
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower()).split()


def shingles(text, k=3):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_near(rows, threshold):
    known = [(i, t, shingles(t)) for i, t in rows if i is not None and t is not None]
    parent = {i: i for i, _, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, t, s) in enumerate(known):
        for j, u, v in known[a + 1 :]:
            if t == u or s and v and len(s & v) >= threshold * len(s | v):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, find(i)) for i in parent if find(i) != i)


def test_exact(spark, corpus):
    by_text = defaultdict(list)
    for i, t in corpus:
        if t is not None:
            by_text[t].append(i)
    want = []
    for ids in by_text.values():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        want += [(i, ids[0]) for i in ids[1:]]
    df = docs(spark, corpus, CLASH)
    assert got(exact_dedup.exact_duplicates(df)) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    assert got(exact_dedup.exact_duplicates(df, map_bits=1 << 15, prefix_chars=1)) == got(exact_dedup.exact_duplicates(df))
    assert exact_dedup.drop_exact_duplicates(docs(spark, [(1, "a"), (2, "a"), (3, "b"), (None, None)], CLASH)).count() == 3


def test_near_equals_brute_force(spark, corpus):
    df = docs(spark, corpus, CLASH)
    have = set(got(near_dedup.near_duplicates(df)))
    want = set(brute_near(corpus, 0.5))
    assert {i for i, _ in want} - {i for i, _ in have} == set() and have == want
    assert set(got(near_dedup.near_duplicates(df, block=3))) == want  # hot buckets in blocks
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(corpus) - len([1 for i, _ in corpus if i in dict(want)])


def test_near_rows_that_share_an_id(spark):
    one, two = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    rows = [(3, one), (5, one), (5, two), (9, two + " more"), (7, "alone here"), (7, "alone here")]
    assert got(near_dedup.near_duplicates(docs(spark, rows))) == [(5, 3), (9, 3)]
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs(spark, rows)).collect()) == [3, 7, 7]


def test_near_recall_of_pairs(spark):
    """Pairs at all similarities above the threshold, each alone: at least nine in ten are found."""
    rng = random.Random(11)
    rows = []
    for k in range(150):
        base = prose(rng, 120, 10**6)
        other = list(base)
        for at in rng.sample(range(120), 2 + k % 11):
            other[at] = f"z{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = set(brute_near(rows, 0.5))
    have = set(got(near_dedup.near_duplicates(docs(spark, rows))))
    assert have <= want and len(have) >= 0.9 * len(want) > 90


def test_bucket_of_unlike_documents(spark):
    """Form letters: a third of the words is theirs, so many share buckets, and few pairs among them are alike."""
    rng = random.Random(12)
    form, rows = prose(rng, 110), []
    for k in range(60):
        own = prose(rng, 50, 10**6)
        rows.append((2 * k, " ".join(form + own)))
        if k % 3 == 0:
            rows.append((2 * k + 1, " ".join(form + own[:45] + prose(rng, 5, 10**6))))
    want = brute_near(rows, 0.72)
    for block in (4, near_dedup.BLOCK):
        assert got(near_dedup.near_duplicates(docs(spark, rows), threshold=0.72, block=block)) == want
    assert len(want) == 20


def test_near_empty_and_equal(spark):
    assert got(near_dedup.near_duplicates(docs(spark, []))) == []
    assert got(exact_dedup.exact_duplicates(docs(spark, []))) == []
    df = spark.range(20_000).selectExpr("id as doc_id", "'one text that all of them have' as text")
    assert near_dedup.near_duplicates(df).where("keep_id = 0").count() == 19_999 == exact_dedup.exact_duplicates(df).where("keep_id = 0").count()
    same = spark.range(10_000).selectExpr("7L as doc_id", "'one text' as text")
    assert got(exact_dedup.exact_duplicates(same)) == [(7, 7)] * 9999


def test_no_window_holds_a_group(spark, corpus):
    """Hot groups are aggregated before the shuffle and joined back; nothing is ranked within them."""
    df = docs(spark, corpus)
    plan = exact_dedup.exact_duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") >= 2


def test_maps_grow_with_the_keys(spark):
    assert common.bits_for(10) == common.MAP_BITS and common.bits_for(10**7) == 1 << 27 and common.bits_for(10**12) == common.MOST_BITS
    keys = spark.range(40_000).selectExpr("xxhash64(id % 30000) as k")
    bitmap, bits = common.repeated_keys_map(keys, "k", least=1 << 15)
    assert bits == 1 << 17 and common.in_map(keys, F.col("k"), bitmap, bits).count() < 26_000


def test_bayes_bounds():
    need = near_dedup.least_matches(0.5, 0.001)
    assert all(0 < need[n] < n * 0.5 for n in need) and list(need) == [32, 64, 96, 128, 160]


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    other = [(rng.randrange(50), rng.randrange(50)) for _ in range(30)]
    edges = chain + other + [(7, 7), (100, 101)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    joined = {x for a, b in edges if a != b for x in (a, b)}
    have = got(components.components(spark.createDataFrame(edges, "u bigint, v bigint")))
    assert have == sorted((x, label[x]) for x in joined)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_passages(rows, n):
    seen, later = {}, defaultdict(dict)
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words_of(t)
        for p in range(len(w) - n + 1):
            first = seen.setdefault(tuple(w[p : p + n]), i)
            if (i, p) != (first, None) and seen.get(("at", tuple(w[p : p + n]))) not in (None, (i, p)):
                later[(i, t)][p] = first
            seen.setdefault(("at", tuple(w[p : p + n])), (i, p))
    out = []
    for (i, _), spots in later.items():
        run = None
        for p in sorted(spots):
            if run and p <= run[1]:
                run[1], run[2] = p + n, min([run[2], spots[p]], key=lambda x: (x is None, x or 0))
            else:
                run = [p, p + n, spots[p]]
                out.append((i, run))
    return sorted(((i, a, b, b - a, f) for i, (a, b, f) in out), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("n", [50, 12])
def test_passages(spark, corpus, n):
    rows = [r for r in corpus if r[0] is not None or r[1] is None] + [(2000, " ".join(f"r{k % 7}" for k in range(200)))]
    assert got(suffix_dedup.repeated_passages(docs(spark, rows, CLASH), min_words=n)) == brute_passages(rows, n)


@pytest.mark.parametrize("modulus", [1, 3, 8, 10**9])
def test_corpus_order_equals_a_plain_suffix_array(modulus):
    rng = random.Random(modulus)
    base = [rng.randrange(5) for _ in range(60)]
    seqs = [[], [3]] + [base[rng.randrange(60) :] + [rng.randrange(9) for _ in range(rng.randrange(6))] + base[: rng.randrange(60)] for _ in range(25)] + [base, base]
    first = np.cumsum([0, *map(len, seqs)])
    words = np.array([w for q in seqs for w in q], dtype=np.uint32)
    pfp = prefix_free.PrefixFreeParse(words, first, modulus)
    suffixes = [tuple([w + 1 for w in q[i:]] + [0]) for q in seqs for i in range(len(q) + 1)]
    order, common = pfp.order(np.arange(len(suffixes)))
    assert [suffixes[i] for i in order] == sorted(suffixes)
    for x, y, n in zip(order, order[1:], common[1:]):
        a, b = suffixes[x], suffixes[y]
        assert n == next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), len(a))
    assert modulus > 8 or len(pfp.entry) - 1 < len(pfp.start)  # phrases repeat


def test_passages_hot_long(spark, corpus, monkeypatch):
    rows = [r for r in corpus if r[0] is not None] + [(3000, " ".join(prose(random.Random(4), 3000) + corpus[0][1].split() * 3))]
    want = brute_passages(rows, 12)
    assert got(suffix_dedup.repeated_passages(docs(spark, rows), min_words=12, hot=3)) == want
    for text in (rows[-1][1], "x " * 5000):
        table = pa.RecordBatch.from_pydict({"id": [1], "body": [1], "text": [text]})
        whole = suffix_dedup.Parse(table["text"], 12)
        monkeypatch.setattr(suffix_dedup, "PIECE", 700)
        cut = list(suffix_dedup._parses(table, 12))
        monkeypatch.undo()
        starts = sorted(w + t - a for _, p, w in cut for t, lo, hi in zip(p.at, p.lo, p.hi) for a in range(lo, hi + 1))
        assert len(cut) > 5 and starts == sorted(t - a for t, lo, hi in zip(whole.at, whole.lo, whole.hi) for a in range(lo, hi + 1))


def test_passages_odd(spark, corpus):
    assert got(suffix_dedup.repeated_passages(docs(spark, []))) == []
    text = corpus[0][1]
    found = got(suffix_dedup.repeated_passages(docs(spark, [(None, text + " end"), (5, text), (5, text)])))
    assert found == [(None, 0, 150, 150, 5)]  # rows that repeat are one; NULL comes last


def brute_lines(rows):
    seen, out = set(), []
    for i, t in rows:
        lines = t.split("\n")
        hit = set()
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if key in seen:
                hit |= {p, p + 1, p + 2}
            seen.add(key)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in hit)))
    return out


def test_lines(spark):
    rng = random.Random(8)
    block = [f"shared {k}" for k in range(6)]
    rows = []
    for i in range(40):
        lines = [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(0, 8))]
        if i % 3 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = block[rng.randrange(3) :]
        rows.append((i, "\n".join(lines)))
    rows += [(100, "a\nb"), (101, "a\nb"), (102, "q\nq\nq\nq\nq"), (103, "\n\n\n\n"), (104, "\n".join(block)), (105, ""), (106, "漢\nß\n😀"), (107, "漢\nß\n😀\nend")]
    df = docs(spark, [*rows, (108, None), (None, None)], CLASH)
    out = line_dedup.line_dedup(df)
    assert out.columns == df.columns and out.count() == df.count()
    have = {r["doc_id"]: r["text"] for r in out.where("text is not null").collect()}
    assert have == dict(brute_lines(rows))
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    again = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, map_bits=1 << 15).where("text is not null").collect()}
    assert again == have


def test_lines_counts_and_repeats(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", None, None, 7), (2, "a\nb\nc", None, None, 5), (2, "a\nb\nc", None, None, 5), (None, "a\nb\nc\nx", None, None, None)], SCHEMA)
    out = [(r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.line_dedup(df).collect()]
    assert sorted(out, key=str) == sorted([(1, "a\nb\nc\nd", 7), (2, "", 0), (2, "", 0), (None, "x", 1)], key=str)
