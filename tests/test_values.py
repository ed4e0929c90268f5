"""Results by value: small libraries with known answers, and plain versions of what SQL can't say."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from trawl import jobs
from trawl.engine import SearchEngine
from trawl.functions import similarity as S
from trawl.operators import coverage, fuse, post, retrieve
from trawl.operators.segment import passages
from trawl.operators.synonyms import Synonyms
from trawl.plans import dsl
from trawl.plans.config import FieldSpec, IndexConfig
from trawl.queries import ASKED, QUERIES
from trawl.sources import shared, store

TEXT = "query_id string, text string"
#: key, genre, year, author, title, what it is about
BOOKS = [
    (1, "Fantasy", "1997", "J.K. Rowling", "Harry Potter and the Philosopher's Stone", "an orphan learns magic at a boarding school"),
    (2, "Fantasy", "1998", "J.K. Rowling", "Harry Potter and the Chamber of Secrets", "something below the school turns pupils to rock"),
    (3, "Fantasy", "2003", "J.K. Rowling", "Harry Potter and the Order of the Phoenix", "a secret club practises dark magic defence"),
    (4, "Fantasy", "2010", "Brandon Sanderson", "The Way of Kings", "soldiers haul bridges; knights had magic blades"),
    (5, "Fantasy", "2006", "Brandon Sanderson", "Mistborn: The Final Empire", "thieves burn metals against an emperor"),
    (6, "Horror", "1977", "Stephen King", "The Shining", "a caretaker goes mad in a winter hotel"),
    (7, "Horror", "1986", "Stephen King", "It", "a clown in the drains"),
    (8, "Science Fiction", "1965", "Frank Herbert", "Dune", "spice, worms and a noble house"),
    (9, "Thriller", "2012", "Gillian Flynn", "Gone Girl", "a wife is missed, a husband suspected"),
]
BOOK_FIELDS = [FieldSpec("title", "high"), FieldSpec("author", facetable=True), FieldSpec("year", "low", indexable=False, facetable=True), FieldSpec("genre", "low", facetable=True), FieldSpec("about")]


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    df = spark.createDataFrame(BOOKS, "doc_key long, genre string, year string, author string, title string, about string")
    return SearchEngine(store.save(df, str(tmp_path_factory.mktemp("books") / "index"), BOOK_FIELDS))


def keys_of(found, query):
    return [r.doc_key for r in sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])]


def test_library(spark, books):
    asked = {"potter": "harry potter", "stone": "stone philosopher", "king": "stephen king", "typo": "duen herbrt", "start": "mistb", "none": "xqzv", "empty": "", "null": None}
    got = books.search(spark.createDataFrame(list(asked.items()), TEXT), k=5, facets=True)
    found = got.records.collect()
    assert sorted(keys_of(found, "potter")[:3]) == [1, 2, 3]
    assert keys_of(found, "stone")[0] == 1
    assert sorted(keys_of(found, "king")[:2]) == [6, 7]
    assert keys_of(found, "typo")[0] == 8
    assert keys_of(found, "start")[0] == 5
    assert keys_of(found, "none") == []
    # without a text: the first documents by key, with the full score, and the facets of these
    assert keys_of(found, "empty") == keys_of(found, "null") == [1, 2, 3, 4, 5]
    assert {r.score for r in found if r.query_id == "empty"} == {post.FULL_SCORE}
    facets = {(r.field, r.value): r["count"] for r in got.facets.collect() if r.query_id == "empty"}
    assert facets == {
        ("author", "J.K. Rowling"): 3, ("author", "Brandon Sanderson"): 2, ("genre", "Fantasy"): 5,
        ("year", "1997"): 1, ("year", "1998"): 1, ("year", "2003"): 1, ("year", "2010"): 1, ("year", "2006"): 1,
    }
    # no facets, no browsing
    assert books.search(spark.createDataFrame([("e", "")], TEXT), k=5).records.count() == 0


def test_library_filters_and_boosts(spark, books):
    magic = spark.createDataFrame([("q", "magic")], TEXT)
    filter_ = "genre = 'Fantasy' AND year >= '2000'"
    got = books.search(magic, k=9, filter_=filter_, facets=True, boosts=[post.Boost("author = 'Brandon Sanderson'", "high")])
    assert keys_of(got.records.collect(), "q")[0] == 4 and set(keys_of(got.records.collect(), "q")) <= {3, 4, 5}
    assert {r.value for r in got.facets.where("field = 'year'").collect()} <= {"2003", "2010", "2006"}
    assert got.in_filter.first()[0] == 3 and got.boosted.first()[0] == 2
    pre = books.search(magic, k=1, filter_="author = 'J.K. Rowling' OR author = 'Stephen King'", filter_mode="pre", sort="year", ascending=False).records.collect()
    assert len(pre) == 1 and pre[0].doc_key in (1, 3)


def test_synonyms_both_ways(spark, tmp_path):
    docs = spark.createDataFrame([(1, "my car stands outside"), (2, "an automobile that is quick"), (3, "the lorry is heavy")], "doc_key long, content string")
    config = IndexConfig((4, 5, 6))
    engine = SearchEngine(store.save(docs, str(tmp_path / "i"), [FieldSpec("content")], config=config, synonyms=Synonyms([["car", "automobile"]])))
    found = engine.search(spark.createDataFrame([("a", "car"), ("b", "automobile"), ("c", "AUTOMOBILE")], TEXT)).records.collect()
    assert all(set(keys_of(found, q)) == {1, 2} for q in "abc")


def test_short_queries(spark, tmp_path):
    greek = spark.createDataFrame([(k + 1, w) for k, w in enumerate(["alpha", "beta", "gamma", "delta"])], "doc_key long, content string")
    things = spark.createDataFrame([(k + 1, w) for k, w in enumerate(["table", "chair", "desk", "lamp"])], "doc_key long, content string")
    a = SearchEngine(store.save(greek, str(tmp_path / "a"), [FieldSpec("content")])).search(spark.createDataFrame([("q", "a"), ("z", "z")], TEXT)).records.collect()
    assert keys_of(a, "q")[0] == 1 and sorted(keys_of(a, "q")) == [1, 2, 3, 4] and keys_of(a, "z") == []
    ab = SearchEngine(store.save(things, str(tmp_path / "b"), [FieldSpec("content")])).search(spark.createDataFrame([("q", "ab"), ("la", "la")], TEXT)).records.collect()
    assert keys_of(ab, "q")[0] == 1 and 3 not in keys_of(ab, "q") and keys_of(ab, "la")[0] == 4


def test_segments_are_one_result(spark, tmp_path):
    rows = [(1, 0, "opening part"), (1, 1, "Batman watches over Gotham"), (1, 2, "closing part"), (2, 0, "Robin and Batman win"), (2, 1, "what came of it"), (3, 0, "Superman is faster than a bullet"), (4, 0, "about animals"), (4, 1, "a brown fox jumps"), (4, 2, "summary")]
    engine = SearchEngine(store.save(spark.createDataFrame(rows, "doc_key long, seg int, content string"), str(tmp_path / "i"), [FieldSpec("content")], segment="seg"))
    found = engine.search(spark.createDataFrame([("b", "batman"), ("f", "fox")], TEXT)).records.collect()
    assert sorted(keys_of(found, "b")) == [1, 2] and keys_of(found, "f") == [4]
    assert {(r.doc_key, r.segment) for r in found if r.query_id == "f"} == {(4, 1)}


def test_begun_last_word_decides(spark):
    idf = {"the": 1.574, "matrix": 9.544, "rev": 9.515}
    text = "the matrix rev"
    asked = spark.createDataFrame([("q", k, 0.5, text, [(w, i, i) for w, i in idf.items()], d) for k, d in ((1, "The Matrix Reloaded"), (2, "The Matrix Revisited"))], "query_id string, doc_id long, base double, q string, tokens array<struct<token:string,gram_idf:double,word_idf:double>>, norm_text string")
    got = {r.doc_id: r.score for r in fuse.fuse(coverage.with_features(asked, coverage.CoverageConfig())).collect()}
    assert got[2] > got[1]


# ---- registered queries without SQL


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _lcs_row(row, x, b)
    return row[-1]


def _lcs_row(old, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(old[j] + 1 if x == y else max(old[j + 1], new[-1]))
    return new


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def jaro(a, b):
    if a == b:
        return 1.0
    window, used, pairs = max(max(len(a), len(b)) // 2 - 1, 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - window), min(len(b), i + window + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            pairs.append((i, j))
    if not pairs:
        return 0.0
    m, swaps = len(pairs), sum(x != b[j] for (i, _), x, j in zip(pairs, [a[i] for i, _ in pairs], sorted(used))) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def test_jaro_pairs(spark, sf_dir):
    rows = QUERIES["jaro_pairs"](spark, sf_dir).collect()
    assert len(rows) == 625
    for r in rows:
        a, b = r.a, r.b
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        p, m, least = min(4, same), lcs(a, b), min(len(a), len(b))
        assert r.lcs == m and r.jaro == pytest.approx(jaro(a, b)) and r.jaro_winkler == pytest.approx(jaro(a, b) + 0.1 * p * (1 - jaro(a, b)))
        assert r.autocomplete == pytest.approx(min(1, (0.5 * m * (m / len(a) + m / len(b)) + 0.1 * p) / max(least + 0.1 * min(4, least), 1)))
        d = levenshtein(a, b)
        swapped = d == 3 and same + 1 < least and a[same] == b[same + 1] and a[same + 1] == b[same] and levenshtein(a[same + 2 :], b[same + 2 :]) <= 1
        assert r.damerau == (2 if swapped else min(d, 3))


def test_edit_budget():
    for n in range(1, 40):
        rng = random.Random(n)
        beyond = sum(sum(rng.random() < 0.04 for _ in range(n)) > S.max_edits(n) for _ in range(4000)) / 4000
        assert beyond < 0.02
    assert [S.max_edits(n) for n in (0, 1, 4, 5, 10)] == [0, 1, 1, 2, 2]


def test_passages(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["passages"](spark, sf_dir).collect()
    per = {}
    for r in rows:
        per.setdefault(r.doc_key, {})[r.segment] = r.text
    assert set(per) == {k for k, t in docs.items() if t}
    for k, parts in per.items():
        text, own = docs[k], [parts[i] for i in range(len(parts))]
        assert own == passages(text) and len(own) <= max(1, round((len(text) + 40) / 160))
        at = 0
        for i, p in enumerate(own if all(text.find(p, text.find(p) + 1) < 0 for p in own) else []):  # in order, at word ends, nothing between them left out
            begin = text.index(p, at and at - len(own[i - 1]))
            assert i == 0 or not re.sub(r"[ \-/.,:;'`–—*&\\_(){}\[\]\t§]", "", text[min(at, begin) : begin])
            at = begin + len(p)


def test_searches_over_parts(spark, sf_dir):
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    words = lambda k: set(parts[k].p_name.lower().split())
    fused = QUERIES["fused_search"](spark, sf_dir).collect()
    asked = dict(ASKED)
    for q, text in asked.items():
        found = keys_of(fused, q)
        assert len(found) <= 20 and len(set(found)) == len(found)
        whole = sum(set(text.split()) <= words(k) for k in parts)
        if q in ("q1", "q4"):
            assert found and all(set(text.split()) <= words(k) for k in found[:whole])
    assert all(any(w.startswith("wid") for w in words(k)) for k in keys_of(fused, "q3"))
    assert "widget" in words(keys_of(fused, "q7")[0]) and {"small", "ring"} & words(keys_of(fused, "q2")[0])
    kept = QUERIES["filtered_search"](spark, sf_dir).collect()
    assert kept and all(parts[r.doc_key].p_type.lower() != "economy" for r in kept)
    assert {q for q in asked if keys_of(kept, q)} == {q for q in asked if keys_of(fused, q)}
    facets = QUERIES["search_facets"](spark, sf_dir).collect()
    per = {}
    for r in facets:
        per[r.query_id, r.field] = per.get((r.query_id, r.field), 0) + r["count"]
    for q in ("q1", "q3", "q7"):
        assert per[q, "p_brand"] == per[q, "p_type"] >= len(keys_of(fused, q))
    syn = QUERIES["synonym_search"](spark, sf_dir).collect()
    assert all("ring" in words(k) for k in keys_of(syn, "s2")) and keys_of(syn, "s2")
    assert {"small", "ring"} <= words(keys_of(syn, "s1")[0])


# ---- limits, changes, jobs


def test_limits_can_be_lifted(spark):
    vocabulary = [f"ab{c}d{e}" for c in "cdefghij" for e in "klmnop"]
    words = spark.createDataFrame([(w, k) for k, w in enumerate(vocabulary)], "word string, doc_id long")
    asked = spark.createDataFrame([("ab",), ("zz",), (None,)], "word string")
    assert retrieve.lookup_affixes(asked, words, most=5).count() == 5
    assert retrieve.lookup_affixes(asked, words, most=None).count() == len(vocabulary)
    terms = spark.createDataFrame([(w, 1, 1.0) for w in vocabulary], "term string, df long, idf double")
    posts, stats = words.withColumnRenamed("word", "term"), spark.createDataFrame([(48,)], "n_docs long")
    wanted = spark.createDataFrame([("abxdk",)], "term string")
    for most, n in ((3, 3), (None, 8)):
        assert retrieve.expand_missing(wanted, terms, posts, F.col("n_docs"), stats, most=most).count() == n
    from trawl.functions.text import query_terms

    long = spark.createDataFrame([(" ".join(f"word{k}" for k in range(200)),)], "t string")
    sizes = long.select(*(F.size(query_terms(F.col("t"), limit=n)).alias(f"n{n}") for n in (10, 128, None))).first()
    assert sizes[0] == 10 and sizes[1] == 128 and sizes[2] > 200
    more = long.select(F.size(query_terms(F.col("t"), limit=None, high_resolution=True))).first()[0]
    assert more > sizes[2]


def test_rank_many(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, k % 50, float(rng.randrange(6)), rng.randrange(2)) for k in range(700)]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, doc_key long, score double, tiebreaker int")
    want = {(r.query_id, r.doc_id): r["rank"] for r in post.rank(df).collect()}
    assert {(r.query_id, r.doc_id): r["rank"] for r in post.rank_many(df).collect()} == want and len(want) == 700
    assert post.rank_many(df.where("false")).count() == 0


def test_searches_meet_on_equality(spark, books):
    """No nested loop over documents or vocabulary: what is joined without a key is one row of statistics."""
    i = books.index
    prepared = retrieve.prepare_queries(spark.createDataFrame([("a", "harry potter"), ("b", "duen"), ("c", "s")], TEXT), i.config)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = plan(retrieve.word_candidates(prepared, i.words, i.deletes, i.config.words, i.word_idf))
    assert "NestedLoop" not in words and "CartesianProduct" not in words
    first = plan(books.first_stage(prepared, i.docs, 10, 3))
    loops = re.findall(r"BroadcastNestedLoopJoin.*", first)
    assert "CartesianProduct" not in first and all(re.search(r"Build(Left|Right), (Cross|Inner)$", x.strip()) for x in loops)  # one row of statistics, no condition


def test_stop_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, "common word" if k < 8 else "rare word") for k in range(10)], "doc_key long, content string")
    index = store.save(docs, str(tmp_path / "i"), [FieldSpec("content")], config=IndexConfig(stop_term_limit=8))
    terms = {r.term: r.df for r in index.terms.collect()}
    assert terms["common"] == 8 and terms["rare"] == 2 and "word" not in terms


def test_keys_without_a_number(spark, tmp_path):
    for k, (key, seg) in enumerate(((None, 0), (1 << 43, 0), (1, 1 << 20), (1, -1))):
        df = spark.createDataFrame([(key, seg, "red widget")], "doc_key long, seg int, content string")
        with pytest.raises(Exception, match="no document number"):
            store.save(df, str(tmp_path / str(k)), [FieldSpec("content")], segment="seg")
    ends = spark.createDataFrame([((1 << 43) - 1, (1 << 20) - 1, "a"), (-(1 << 43), None, "b")], "doc_key long, seg int, content string")
    index = store.save(ends, str(tmp_path / "ends"), [FieldSpec("content")], segment="seg")
    assert {(r.doc_key, r.segment) for r in index.docs.collect()} == {((1 << 43) - 1, (1 << 20) - 1), (-(1 << 43), 0)}


def test_a_step_writes_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(k, f"word{k} shared text") for k in range(300)], "doc_key long, content string")
    store.save(docs, path, [FieldSpec("content")])
    store.append(spark.createDataFrame([(1000, "one more text")], docs.schema), path)
    for name in ("docs", "postings", "lengths", "words", "prefixes", "terms", "vocabulary", "deletes", "variants", "champions"):
        assert spark.read.parquet(f"{path}/{name}/batch=2").count() < 80, name
    store.delete_keys(spark.createDataFrame([(5,), (None,), (-3,)], "doc_key long"), path)
    assert store.deleted_documents(spark, path).count() == 1 and not store.should_merge(spark, path) and store.should_merge(spark, path, after=1, share=0.0)
    assert {(r.doc_key, r.deleted) for r in store.all_segments(spark, path, 5).collect()} == {(5, True)}
    assert store.restore(spark.createDataFrame([(5,), (7,)], "doc_key long"), path)
    index = store.load(spark, path, check=True)
    assert index.docs.count() == 301 and {(r.doc_key, r.deleted) for r in store.all_segments(spark, path, 5).collect()} == {(5, False), (5, True)}
    assert {r.term: r.df for r in index.terms.collect()}["shared"] == 300
    store.compact(spark, path)
    assert store.load(spark, path, check=True).docs.count() == 301 and store.vacuum(spark, path)
    meta = store.index_info(spark, path)
    meta["n_docs"] += 1
    store.write_text(spark, f"{path}/meta/99.json", __import__("json").dumps(meta))
    with pytest.raises(store.IndexFormatError):
        store.load(spark, path, check=True)


def test_stored_filters(spark, tmp_path):
    path = str(tmp_path / "filter.json")
    dsl.save_filter(spark, "a = 1 AND b MATCHES 'x+'", path)
    assert dsl.load_filter(spark, path) == dsl.parse("a = 1 AND b MATCHES 'x+'") and dsl.is_stored_filter(spark, path)
    store.write_text(spark, str(tmp_path / "other"), "{}")
    assert not dsl.is_stored_filter(spark, str(tmp_path / "other")) and not dsl.is_stored_filter(spark, str(tmp_path / "none"))


def test_scratch_is_removed(spark):
    with shared.scratch():
        df = shared.cut(spark.range(5), "scratch-test")
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 5
    import os

    assert not os.path.exists(path)


def test_jobs(spark, tmp_path):
    assert jobs.Job(spark, lambda: spark.range(10).count()).result(60) == 10
    said = []
    job = jobs.Job(spark, lambda: spark.range(0, 8, 1, 8).selectExpr("java_method('java.lang.Thread', 'sleep', 300L + 0 * id)").collect(), on_progress=said.append, every=0.05)
    job.result(60)
    time.sleep(0.2)
    assert said[-1] == 1.0 and all(0 <= x <= 1 for x in said)
    slow = lambda: spark.range(0, 64, 1, 64).selectExpr("java_method('java.lang.Thread', 'sleep', 2000L + 0 * id)").collect()
    job = jobs.Job(spark, slow)
    assert not job.wait(1.0)
    job.cancel()
    assert job.wait(30)
    with pytest.raises(jobs.JobCancelled):
        job.result()
    with pytest.raises(TimeoutError):
        jobs.Job(spark, slow).result(0.5)
    with pytest.raises(ZeroDivisionError):
        jobs.Job(spark, lambda: 1 // 0).result(10)
