"""Steps that must do the whole job however large the tables are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import index as I
from trawl.operators import retrieve, scan
from trawl.plans.config import FieldSpec, IndexConfig
from trawl.queries import QUERIES


def test_terms_of_many_documents_at_once():
    rng = random.Random(5)
    for sizes in ((3,), (2, 3), (1, 2), (4,)):
        docs = [[(rng.choice([1.0, 1.25, 1.5]), "".join(rng.choice("abé ￿§-\U0001d4b3\0") for _ in range(rng.choice([0, 1, 3, 40])))) for _ in range(rng.choice([0, 1, 1, 2]))] for _ in range(60)]
        more = [rng.random() < 0.2 for _ in docs]
        own = I.count_terms(docs, more, sizes, 2)
        got = [{} for _ in docs]
        for d, t, c in zip(own.doc.tolist(), own.term.tolist(), own.tf.tolist()):
            assert own.names[t] not in got[d]
            got[d][own.names[t]] = c
        for parts, c, g in zip(docs, more, got):
            body = ("" if c else "￿" * 2) + "§".join(t for _, t in parts)
            assert g == I._weighed_counts(parts, body, sizes, 2, c)


@pytest.mark.parametrize("digits", [None, 4])
def test_scanned_documents_score_as_postings_do(spark, digits):
    """Ties, terms that most documents have, missing terms with near ones, and a query that finds nothing."""
    rng = random.Random(3)
    words = ["river", "rivet", "stone", "stones", "bridge", "old", "the", "salt", "sale"]
    docs = [(k, " ".join(["the"] + [rng.choice(words) for _ in range(rng.randint(0, 6))]) if k % 17 else None) for k in range(300)]
    docs += [(1000 + k, " ".join(rng.choice(words) + str(rng.randint(0, 60)) for _ in range(300))) for k in range(20)]
    queries = [("a", "river stone"), ("b", "rivel bridgs"), ("c", "the"), ("d", "qqqqqq"), ("e", "salty old stones"), ("f", " ".join(words[::-1]))]
    config = IndexConfig(most_expanded=None)
    own = I.prepare(spark.createDataFrame(docs, "key long, text string"), [FieldSpec("text")], "key")
    index = I.build_index(spark.createDataFrame(docs, "key long, text string"), [FieldSpec("text")], "key", config=config)
    wanted = retrieve.query_terms(retrieve.prepare_queries(spark.createDataFrame(queries, "query_id string, text string"), config), config)
    by_postings = retrieve.bm25_scores(wanted, index.terms, index.postings, index.lengths, index.stats, most=None)
    by_postings = by_postings if digits is None else by_postings.withColumn("score", F.round("score", digits))
    want = [(r.query_id, r["rank"], r.doc_id, r.score) for r in retrieve.top(by_postings, 7).collect()]
    got = [(r.query_id, r["rank"], r.doc_id, r.score) for r in retrieve.top(scan.top_of_texts(own, wanted, config, 7, digits), 7).collect()]
    assert len(want) == 35
    if digits is None:  # sums in another order
        assert sorted((q, r, round(s, 9)) for q, r, _, s in got) == sorted((q, r, round(s, 9)) for q, r, _, s in want)
    else:
        assert sorted(got) == sorted(want)


def test_best_of_many_ties():
    rng = np.random.default_rng(1)
    query, score, doc = rng.integers(0, 4, 5000), rng.integers(0, 6, 5000) / 2, rng.permutation(5000)
    found = scan._Best(4, 9)
    for at in range(0, 5000, 300):
        found.add(query[at : at + 300], score[at : at + 300], doc[at : at + 300])
    got = sorted(zip(found.query.tolist(), (-found.score).tolist(), found.doc.tolist()))
    every = sorted(zip(query.tolist(), (-score).tolist(), doc.tolist()))
    assert got == [r for q in range(4) for r in [e for e in every if e[0] == q][:9]]


def test_all_of_a_long_query_counts(spark, tmp_path):
    """Only the end of the text, beyond 128 terms, tells the documents apart."""
    head = " ".join(f"common{k}" for k in range(60))
    docs = [(k, f"{head} {end}") for k, end in enumerate(("granite", "basalt", "obsidian", "feldspar"))] + [(9, "something else entirely")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, f"{head} obsidian"), (2, f"{head} feldspar")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = QUERIES["bm25_batch_topk"](spark, str(tmp_path)).collect()
    assert {r.query_id: r.doc_key for r in rows if r["rank"] == 1} == {1: 2, 2: 3}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["candidate_tiers", "intersect_terms"])
def test_postings_are_not_broadcast(spark, sf_dir, name):
    """Their size is guessed from the names that they are made of; the terms of the queries are sent instead."""
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("BroadcastExchange") == 1
    assert "MapInArrow" not in text[text.index("BroadcastExchange") :]


def test_many_queries_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", 2)
    postings = spark.createDataFrame([("x", 1), ("y", 1), ("x", 2), ("z", 3)], "term string, doc_id long")
    wanted = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "w")], "query_id string, term string")
    found = retrieve.tiers(wanted, postings)
    assert "Broadcast" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 0), ("a", 2, 1), ("b", 3, 1)]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(8)
    words = ["river", "rivet", "stone", "stones", "bridge", "old", "in", "salt", "sale"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for k in range(200)]
    return I.build_index(spark.createDataFrame(docs, "key long, text string"), [FieldSpec("text")], "key")


def test_scan_and_postings_agree(spark, index, monkeypatch):
    queries = spark.createDataFrame([("a", "river stone"), ("b", "rivel bridgs"), ("c", "salt sale old"), ("d", "qqqqqq")], "query_id string, text string")
    wanted = retrieve.query_terms(retrieve.prepare_queries(queries, index.config), index.config)
    found = []
    for share in (-1, 1e9):
        monkeypatch.setattr(scan, "SCAN_SHARE", share)
        found.append(sorted(map(tuple, retrieve.top(scan.top_of_index(index, wanted, 6, 5), 6).collect())))
    assert found[0] == found[1] and len(found[0]) == 18


def test_first_candidates_of_words(spark, index):
    queries = spark.createDataFrame([("a", "riverr"), ("b", "in st"), ("c", "zzz"), ("d", "sal old")], "query_id string, text string")
    prepared = retrieve.prepare_queries(queries, index.config)
    every = {}
    for r in retrieve.word_candidates(prepared, index.words, index.deletes, index.config.words, index.word_idf).collect():
        every.setdefault(r.query_id, set()).add(r.doc_id)
    stage = spark.createDataFrame([(q, k << 20) for q in "abcd" for k in range(150, 200)], "query_id string, doc_id long")
    got = {}
    for r in retrieve.first_candidates(prepared, index.words, index.deletes, index.config.words, 8, stage, index.word_idf).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert set(every) == set(got) and "b" in got
    for q, own in every.items():
        assert got[q] <= own and {d for d in own if d >= 150 << 20} <= got[q] and set(sorted(own)[:8]) <= got[q]


def test_equal_texts_have_equal_features(spark):
    from trawl.operators import coverage

    rows = [("a", k, 0.0, "old stone", [("old", 1.0, 1.0), ("stone", 1.0, 1.0)], t) for k, t in enumerate(["old stone bridge", "Old stone bridge", None, "", "old stone bridge", "stone"] * 30)]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, base double, q string, tokens array<struct<token:string,gram_idf:double,word_idf:double>>, norm_text string").coalesce(1)
    query = coverage.Query("old stone", ["old", "stone"], [1.0, 1.0], [1.0, 1.0])
    for r in coverage.with_features(df).collect():
        assert {n: r[n] for n, _ in coverage.FEATURES} == coverage.features(query, rows[r.doc_id][5])
        assert r.doc_len == len(rows[r.doc_id][5] or "")
