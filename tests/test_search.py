import os

import pytest
from pyspark.sql import functions as F

from trawl.engine import SearchEngine
from trawl.functions.similarity import damerau, edit_distance, jaro, jaro_winkler, lcs_length, max_edits
from trawl.operators import coverage, fuse, post
from trawl.operators.index import fold_weights, get_document, get_documents, term_counts
from trawl.operators.segment import passages
from trawl.operators.synonyms import Synonyms
from trawl.plans.config import CoverageConfig, FieldSpec, IndexConfig
from trawl.sources import store
from trawl.streaming.ingest import index_stream

SENTENCES = """The quick brown fox jumps over the lazy dog
A journey of a thousand miles begins with a single step
To be or not to be, that is the question
All that glitters is not gold
The fox was quick and clever in the forest
Batman and Robin fight crime in Gotham City
Superman flies faster than a speeding bullet
Spider-Man swings through New York City
Wonder Woman protects the innocent
The Flash runs at incredible speeds""".split("\n")
ONE = [FieldSpec("content")]


@pytest.fixture(scope="module")
def sentences(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i + 1, s) for i, s in enumerate(SENTENCES)], "doc_key long, content string")
    return store.save(docs, str(tmp_path_factory.mktemp("ten") / "index"), ONE)


def test_ten_sentences(spark, sentences):
    asked = {"batman": "batman", "fox": "qick fux", "far": "battamam", "york": "new york", "speed": "speeding", "none": "", "null": None, "odd": "zzzzqqq"}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    rows = SearchEngine(sentences).search(queries).records.orderBy("query_id", "rank").collect()
    found = {q: [r.doc_key for r in rows if r.query_id == q] for q in asked}
    assert found["batman"][0] == 6
    assert found["fox"][:2] == [5, 1]
    assert found["far"][0] == 6
    assert found["york"][0] == 8
    assert found["speed"][0] == 7
    assert found["none"] == found["null"] == found["odd"] == []
    # rows without precedence keep the score of the first stage
    assert all(r.score == pytest.approx(r.precedence + r.semantic) for r in rows if r.precedence)


def q(text, config=None):
    config = config or CoverageConfig()
    words = list(dict.fromkeys(w for w in text.lower().split() if len(w) >= config.min_word))
    return coverage.Query(text.lower(), words, [1.0] * len(words), [1.0] * len(words))


@pytest.mark.parametrize("query,doc,expected", [
    ("red ring", "Red Ring", {"terms_any": 2, "terms_strict": 2, "terms_prefix": 2, "word_hits": 2, "first_match": 0, "prefix_last": True, "perfect_doc": True, "lcs": 8}),
    ("spider man", "the spiderman", {"terms_any": 2, "terms_strict": 2, "word_hits": 2, "terms_prefix": 1}),
    ("spiderman", "spider man", {"terms_any": 1, "terms_strict": 1, "word_hits": 1}),
    ("mat", "The Matrix", {"terms_any": 1, "terms_strict": 0, "terms_prefix": 1, "first_match": 4, "last_has_prefix": True}),
    ("matrx", "The Matrix", {"terms_any": 1, "terms_prefix": 0}),
    ("xyz", "The Matrix", {"terms_any": 0, "word_hits": 0, "first_match": -1, "sum_ci": 0.0}),
    ("xyz", "", {"doc_tokens": 0, "word_hits": 0}), ("xyz", None, {"doc_tokens": 0}), ("", "abc", {"terms_count": 0, "coverage_score": 0}),
])
def test_features(query, doc, expected):
    got = coverage.features(q(query), doc)
    assert {k: got[k] for k in expected} == expected


def test_distances():
    assert edit_distance("kitten", "sitting", 5) == 3 and edit_distance("abc", "xyz", 1) == 2
    assert damerau("matrix", "amtrix", 1) == 1 and damerau("ab", "ba", 1) == 1 and damerau("abcd", "dcba", 2) == 3
    assert lcs_length("abcbdab", "bdcaba") == 4
    assert jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6) and jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert [max_edits(n) for n in (1, 4, 5, 10)] == [1, 1, 2, 2]


def test_weights_and_terms():
    assert fold_weights([1.5, 1.5, 1.25]) == 5 and fold_weights([1.25, 1.5]) == 2 and fold_weights([1.0] * 400) == 256
    got = term_counts([(1.25, "aab aab")], (3,), 2)
    assert got["aab"] == 4 and got["￿￿a"] == 1 and got["b a"] == 1
    assert set(term_counts([(1.25, "aab aab")], (3,), 2, True).values()) == {1}
    assert term_counts([], (3,), 2) == {}


def test_fuzzy_family(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The Mat"), (2, "The Matrix"), (3, "The Matriarx"), (4, "The Match"), (5, "The Meatrix")], "doc_key long, content string")
    engine = SearchEngine(store.save(docs, str(tmp_path / "i"), ONE))
    rows = engine.search(spark.createDataFrame([("a", "the matrx")], "query_id string, text string")).records.collect()
    rank = {r.doc_key: r.rank for r in rows}
    assert rank[2] < rank[1]


def test_stored_index_changes(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, 0, "Introduction chapter one", "x"), (1, 1, "Batman fights crime in Gotham City", "x"), (2, 0, "Batman and Robin save the day", "y"), (3, 0, "Superman flies", None)], "doc_key long, seg int, content string, kind string")
    fields = [FieldSpec("content"), FieldSpec("kind", indexable=False, facetable=True)]
    index = store.save(docs, path, fields, segment="seg", synonyms=Synonyms([["hero", "batman"]]))
    ask = lambda text, **kw: SearchEngine(store.load(spark, path)).search(spark.createDataFrame([("q", text)], "query_id string, text string"), **kw)
    assert {r.doc_key for r in ask("hero").records.collect()} == {1, 2}
    assert get_document(index, 1).first().segment == 0 and get_documents(index, 1).count() == 2 and get_documents(index, 1, 1).count() == 1
    got = ask("batman", facets=True, boosts=[post.Boost("kind = 'y'", "high")])
    assert [r.doc_key for r in got.records.orderBy("rank").collect()][0] == 2
    assert {(r.value, r["count"]) for r in got.facets.collect()} == {("x", 1), ("y", 1)}
    assert got.metadata.first().total_candidates == 2
    assert {r.doc_key for r in ask("batman", filter_="kind = 'x'", filter_mode="pre").records.collect()} == {1}
    store.delete_keys(spark.createDataFrame([(2,), (9,), (None,)], "doc_key long"), path)
    assert {r.doc_key for r in ask("batman").records.collect()} == {1}
    assert store.append(spark.createDataFrame([(2, 0, "Batman returns", "z")], docs.schema), path, epoch=0)
    assert not store.append(spark.createDataFrame([(2, 0, "Batman returns", "z")], docs.schema), path, epoch=0)
    before = {(r.doc_key, r.segment) for r in store.load(spark, path).docs.collect()}
    store.compact(spark, path)
    again = store.load(spark, path)
    assert {(r.doc_key, r.segment) for r in again.docs.collect()} == before == {(1, 0), (1, 1), (2, 0), (3, 0)}
    assert again.postings.join(again.docs, "doc_id", "left_anti").count() == 0
    assert store.vacuum(spark, path) and store.is_valid_index(spark, path) and not store.is_valid_index(spark, str(tmp_path / "no"))
    with pytest.raises(store.IndexFormatError):
        store.load(spark, str(tmp_path / "no"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i + 1, s) for i, s in enumerate(SENTENCES)]
    all_docs = spark.createDataFrame(rows, "doc_key long, content string")
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, all_docs.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    path = str(tmp_path / "index")
    store.save(all_docs.where("false"), path, ONE)
    stream = spark.readStream.schema(all_docs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    index_stream(stream, path, str(tmp_path / "check"), once=True).awaitTermination(200)
    streamed, batch = store.load(spark, path), store.save(all_docs, str(tmp_path / "batch"), ONE)
    for t in ("terms", "lengths", "word_idf"):
        rounded = [F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in streamed.tables[t].dtypes]
        a, b = streamed.tables[t].select(*rounded), batch.tables[t].select(*rounded)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_passages_cover_the_text():
    text = " ".join(f"word{i}" for i in range(400))
    got = passages(text, 200, 0.2)
    assert len(got) > 5 and all(p in text for p in got)
    assert set(w for p in got for w in p.split()) == set(text.split())
    assert passages("", 200) == [] and passages("short", 200) == ["short"] and passages("x" * 5000, 200) == ["x" * 5000]


def test_truncation_and_empty_tables(spark):
    rows = [("a", 1, 9.0, 2, 0), ("a", 2, 8.0, 1, 0), ("a", 3, 7.0, 2, 0), ("a", 4, 6.0, 0, 0), ("b", 1, 1.0, 0, 0)]
    df = spark.createDataFrame(rows, "query_id string, rank int, score double, word_hits int, lcs int")
    assert {(r.query_id, r["rank"]) for r in fuse.truncate(df).collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 1)}
    assert post.facets(spark.createDataFrame([], "lang string, tags array<string>"), [FieldSpec("lang", facetable=True), FieldSpec("tags", facetable=True)]).count() == 0
    tagged = spark.createDataFrame([("en", ["a", "b"]), ("en", ["a", None, ""]), (None, None)], "lang string, tags array<string>")
    got = {(r.field, r.value, r["count"]) for r in post.facets(tagged, [FieldSpec("lang", facetable=True), FieldSpec("tags", facetable=True)]).collect()}
    assert got == {("lang", "en", 2), ("tags", "a", 2), ("tags", "b", 1)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,year\n"One, two",1999\n')
    (tmp_path / "a.json").write_text('{"title": "x", "year": 3}\n')
    assert store.read_documents(spark, str(tmp_path / "a.csv")).first().asDict() == {"title": "One, two", "year": 1999}
    assert store.read_documents(spark, str(tmp_path / "a.json")).first().year == 3


def test_config_names():
    assert IndexConfig.named(100).gram_sizes == (2, 3) and IndexConfig.named(400).words is not None
    assert os.path.exists(__file__)
