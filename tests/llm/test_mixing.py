from trawl.llm import mixing


def test_rates_reach_weights(spark):
    rows = [(i, "w " * 10, "a" if i % 4 else "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df, {"a": 1, "b": 3})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["b"] / 1500 - 1) < 0.06 and abs(n["a"] / 500 - 1) < 0.2
    per = {r.doc_id: r["count"] for r in out.where("source = 'b'").groupBy("doc_id").count().collect()}
    assert set(per.values()) == {3} and len(per) == 500


def test_odd_rows(spark):
    rows = [(1, None, "a", 9), (1, None, "a", 9), (None, "x y", None, 9), (2, "", "b", 9), (3, "long " * 50000, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int")
    out = mixing.mix_sources(df, {"": 1.0, "a": 5.0})
    assert out.columns == ["doc_id", "text", "source", "copy_no"]
    got = sorted((str(r.doc_id), r.copy_no) for r in out.collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 1), ("None", 1)]
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(df, {}).where("source = 'a'").count() == 2


def test_no_weight_drops(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.copy_no) for r in mixing.mix_sources(df, {"a": 1}).orderBy("copy_no").collect()] == [(1, 1), (1, 2)]


def test_sql(same_as_sql):
    assert same_as_sql(mixing.query, mixing.SQL) > 0
