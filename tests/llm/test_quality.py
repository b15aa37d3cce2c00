"""The classifier on held-out labels, and the pipeline stage by stage."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedimenta.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from sedimenta.llm.common import materialize
from sedimenta.llm.queries import ORACLES, QUERIES

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def held_out(spark):
    """Trained on three quarters of the labels, scored on the rest."""
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    apart = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 0
    heads = quality.train(docs, labels.where(~apart))
    scores = quality.score_documents(docs, heads).withColumnsRenamed({"quality": "p_quality", "toxic": "p_toxic"})
    return heads, scores.join(labels.where(apart), "doc_id").toPandas(), docs


def test_held_out_accuracy(held_out):
    _, r, _ = held_out
    good = r[(r.quality == 1) & (r.toxic == 0)]
    assert len(r) > 800 and good.keep.mean() > 0.97
    assert r[r.quality == 0].keep.mean() < 0.06
    assert r[(r.toxic == 1) & (r.quality == 1)].keep.mean() < 0.08


def test_calibrated(held_out):
    _, r, _ = held_out
    for head in ("quality", "toxic"):
        assert abs(r[f"p_{head}"].mean() - r[head].mean()) < 0.03


def test_filter_equals_scores(held_out, spark):
    heads, _, docs = held_out
    part = docs.limit(500).cache()
    kept = {r[0] for r in quality.score_documents(part, heads).where("keep").select("doc_id").collect()}
    out = quality.keep_good(part, heads)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept


def test_co_training_uses_the_other_view():
    """Few labels; each view alone tells the class. Pseudo-labels of one view teach the other."""
    rng = np.random.default_rng(0)
    n = 1200
    truth = rng.integers(0, 2, n)
    text = [np.unique(np.append(rng.integers(1000, 5000, 5), 10 + truth[i] * 50 + rng.integers(0, 50, 3))) for i in range(n)]
    page = [np.array([200 + truth[i] * 3, 300 + rng.integers(0, 5)]) for i in range(n)]
    sides = [(np.append(0, np.cumsum([len(x) for x in side])), np.concatenate(side)) for side in (text, page)]
    learner = quality.Learner(sides, np.where(np.arange(n) < 60, truth, -1), 1.0)
    rest = np.arange(60, n)
    pairs = [quality._rows_of(*side, rest) for side in sides]
    accuracy, taught = [], [None, None]
    for _ in range(3):
        learner.fit(taught)
        accuracy.append(((learner.views[0].scores(*pairs[0], len(rest)) > 0) == truth[rest]).mean())
        counts = [np.zeros((2, (1 << bits) + 1), dtype=np.int64) for bits in quality.BITS]
        quality.count_sure(pairs, len(rest), learner.teachers(), 0.9, counts)
        taught = [quality.lessons(c, z) for c, z in zip(counts, quality.LEAST_Z)]
    assert accuracy[-1] > accuracy[0] + 0.03 and accuracy[-1] > 0.95


def test_all_documents_without_labels_teach(spark):
    """However many there are, each round counts all that a view is sure of."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 20)) + (f" good{rng.integers(40)}" if i % 2 else f" bad{rng.integers(40)}"), f"src{i % 2}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    learners = {"quality": None, "toxic": quality.Learner([], np.zeros(0, np.int64), 0.0)}
    sample = quality._prepare(docs.where("doc_id < 400"), "doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    sides = [(np.searchsorted(row, np.arange(401)), col) for row, col in quality.features(sample)]
    learners["quality"] = quality.Learner(sides, np.arange(400) % 2, 1.0)
    learners["quality"].fit([None, None])
    taught = quality._exchange(quality._prepare(docs, "doc_id", "text"), learners, np.arange(400), 0.9)["quality"]
    assert all(t is not None and np.abs(t).max() > 3 for t in taught)
    heads = quality.train(docs, labels)
    assert quality.score_documents(docs, heads).where("keep = (doc_id % 2 = 1)").count() > 8990


def test_page_view_reads_no_text():
    def part(text, **other):
        cols = {"text": [text], "lang": ["en"], "source": ["s"], "n_chars": [7], "host": ["h"]} | {k: [v] for k, v in other.items()}
        return pa.RecordBatch.from_pydict(cols)

    one = quality.meta_features(part("some text"))[1].tolist()
    assert quality.meta_features(part("OTHER 12 !!"))[1].tolist() == one
    assert all(quality.meta_features(part("some text", **x))[1].tolist() != one for x in ({"lang": "de"}, {"source": "t"}, {"n_chars": 900}, {"host": "i"}))


def test_long_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"{'W' if x % 7 == 0 else 'w'}{x}é{'!' if x % 5 == 0 else ''}" for x in rng.integers(0, 60, 3000)]
    texts = pa.array([" ".join(np.repeat(words, rng.integers(1, 4, 3000)).tolist()) + ". the END\n"])
    whole = quality.text_features(texts)
    monkeypatch.setattr(quality, "PIECE", 900)
    assert all(np.array_equal(a, b) for a, b in zip(quality.text_features(texts), whole))


def test_rare_class_in_many_labels(spark):
    """Of 20,000 labels 40 are toxic; a sample of 500 holds one of them by chance."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 20)) + (" vile filth slur" if i % 500 == 0 else "") + (" spam junk" if i % 3 == 0 else ""), i % 3 > 0, i % 500 == 0) for i in range(20_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(q), int(t)) for i, _, q, t in rows], "doc_id bigint, quality int, toxic int")
    heads = quality.train(docs, labels, max_labelled=500)
    assert heads["toxic"].constant is None
    found = quality.score_documents(docs, heads).toPandas().set_index("doc_id").sort_index()
    toxic, good = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    assert not found.keep[toxic].any() and found.keep[good & ~toxic].mean() > 0.99
    assert abs(found.toxic.mean() - toxic.mean()) < 0.002 and abs(found.quality.mean() - good.mean()) < 0.03


def test_names_are_told_apart():
    names = ["https://a.com", "https://b.org", "commoncrawl-2023", "commoncrawl-2024", "", None, "a", "aa", "é", "x" * 100, "y" + "x" * 99]
    codes = quality._names(pa.array(names + names[::-1]))
    assert len(np.unique(codes)) == len(names) and np.array_equal(codes, codes[::-1])
    assert np.array_equal(codes[:4], quality._names(pa.array(names[:4])))
    assert len(quality._names(pa.array([], pa.string()))) == 0


def test_repeated_ids_take_one_place(spark, monkeypatch):
    """Two ids on 3,000 rows each don't fill the sample, with or without a label."""
    seen, real = [], quality.Learner
    monkeypatch.setattr(quality, "Learner", lambda sides, y, *rest: seen.append(y) or real(sides, y, *rest))
    docs = spark.range(400).unionByName(spark.range(6000).selectExpr("id % 2 * 200 as id")).selectExpr("id as doc_id", "concat('some text ', id) as text")
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 3 = 0 as int) as toxic")
    quality.train(docs, labels, max_labelled=200)
    assert [len(y) for y in seen] == [200, 200] and all((y >= 0).all() for y in seen)


def test_even_shares():
    assert [quality._even(*x) for x in (([], 10), ([3, 4], 10), ([3, 4, 100], 10), ([100, 2, 100], 10), ([5, 5], 10))] == [0, 4, 3, 4, 5]


def test_odd_rows(held_out, spark):
    heads, _, _ = held_out
    df = spark.createDataFrame([(None, "some text", "a"), (1, None, "b"), (2, "", "c"), (3, "word " * 60_000, "d"), (3, "word " * 60_000, "d")], "doc_id bigint, text string, keep string")
    rows = quality.score_documents(df, heads).collect()
    assert len(rows) == 5 and all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in rows)
    assert quality.keep_good(df, heads).columns == df.columns
    empty = df.limit(0)
    assert quality.score_documents(empty, heads).count() == 0
    none = quality.train(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert [(r["quality"], r["toxic"], r["keep"]) for r in quality.score_documents(df, none).collect()] == [(1.0, 0.0, True)] * 5
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, None), (1, None, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    assert quality.score_documents(df, quality.train(df, nulls)).count() == 5


def test_pipeline_stages(spark, sf):
    """Each stage is its operator over all that the one before kept, and run() is all of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]

    def ids(df):
        return sorted(r["doc_id"] for r in df.collect())

    heads = quality.train(docs, labels)
    kept = {r["doc_id"] for r in quality.score_documents(docs, heads).where("keep").collect()}
    now = materialize(corpus_pipeline.STAGES[0][1](spark, docs, sf), "t")
    assert now.columns == docs.columns and set(ids(now)) == kept and 0 < len(kept) < docs.count()
    lines = materialize(corpus_pipeline.STAGES[1][1](spark, now, sf), "t")
    assert lines.columns == docs.columns and sorted(map(tuple, lines.collect())) == sorted(map(tuple, line_dedup.line_dedup(now).collect()))
    gone = {r["doc_id"] for r in near_dedup.near_duplicates(lines).collect()}
    near = materialize(corpus_pipeline.STAGES[2][1](spark, lines, sf), "t")
    assert near.columns == docs.columns and set(ids(near)) == set(ids(lines)) - gone
    leaks = {r["doc_id"] for r in decontaminate.benchmark_leaks(near, bench).collect()}
    clean = materialize(corpus_pipeline.STAGES[3][1](spark, near, sf), "t")
    assert clean.columns == docs.columns and set(ids(clean)) == set(ids(near)) - leaks
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[4][1](spark, clean, sf).collect()}
    assert set(last) == set(ids(clean)) and all(r["round_trip"] for r in last.values())
    whole = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {k: r["input_ids"] for k, r in whole.items()} == {k: r["input_ids"] for k, r in last.items()}


def test_pipeline_odd_rows(spark, sf):
    """Stages keep what they say of NULLs, empty texts, repeated rows, columns with clashing names, and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, body string, id string, near_flag string, c0 int"
    lines = "one line\ntwo lines\nthree lines\nfour lines"
    rows = [(1, lines), (1, lines), (2, lines), (None, lines), (3, None), (4, ""), (5, ""), (None, None), (6, "a word " * 20000)]
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), "g", "b", "i", None, 7) for i, t in rows], schema)

    def left(stage, df):
        out = stage(spark, df, sf)
        assert out.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    (_, good), (_, lined), (_, near), (_, clean), (_, ids) = corpus_pipeline.STAGES
    kept = left(good, docs)
    assert all(kept.count(r) in (0, rows.count(r)) for r in rows)
    cut = [(i, "" if t == lines and i != 1 else t) for i, t in rows]
    assert left(lined, docs) == sorted(cut, key=str)
    assert left(near, docs) == sorted([(1, lines), (1, lines), (None, lines), (3, None), (4, ""), (None, None), rows[-1]], key=str)
    assert left(clean, docs) == sorted(rows, key=str)
    coded = [(r["doc_id"], r["n_tokens"] is None, r["n_tokens"] == 0) for r in ids(spark, docs, sf).collect()]
    assert sorted(coded, key=str) == sorted([(i, t is None, t == "") for i, t in rows], key=str)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_registered():
    assert sorted(QUERIES) == sorted(f"op{n}_{name}" for n, name in ((1, "quality_classifier"), (2, "suffix_array_dedup"), (3, "exact_dedup"), (4, "bpe_encode"), (5, "minhash_near_dedup"), (6, "license_scan"), (7, "secret_scan"), (8, "decontaminate"), (9, "line_dedup"), (10, "chat_format")))
    assert set(ORACLES) < set(QUERIES)


def test_queries_with_sql(spark, sf):
    from compare import connect, same

    duck = connect(sf)
    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, sf), duck, sql)
    assert bpe.encode_documents(spark.read.parquet(f"{sf}/documents.parquet")).where("not round_trip").count() == 0
