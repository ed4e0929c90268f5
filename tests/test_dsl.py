import pytest
from pyspark.sql import functions as F

from trawl.plans import dsl
from trawl.plans.dsl import And, Between, Compare, FilterParseError, If, In, IsNull, Literal, Not, Or, Text, from_json, parse, pretty, to_json

ROWS = [(1, "Apple", 5, 1.5, True), (2, "banana", None, 900.0, False), (3, None, 10, None, None), (4, "", 0, 2.0, True), (5, "a\nb", 42, 1e20, False)]
SCHEMA = "id long, name string, n int, x double, ok boolean"


@pytest.mark.parametrize("text,tree", [
    ("a = 'x'", Compare("a", "=", "x")), ("a!=3", Not(Compare("a", "=", "3"))), ("a between 1 and 2.5", Between("a", "1", "2.5")), ("a IN ('x' \"y\", 3)", In("a", ("x", "y", "3"))),
    ("a in ()", In("a", ())), ("a starts with 'p'", Text("a", "starts", "p")), ("a is not null", Not(IsNull("a"))), ("a='1' or b='2' and not c='3'", Or(Compare("a", "=", "1"), And(Compare("b", "=", "2"), Not(Compare("c", "=", "3"))))),
    ("(a=1||b=2)&c=3", And(Or(Compare("a", "=", "1"), Compare("b", "=", "2")), Compare("c", "=", "3"))), ("a=1 ? 'x' : b=2 ? 'y' : 3", If(Compare("a", "=", "1"), Literal("x"), If(Compare("b", "=", "2"), Literal("y"), Literal("3")))),
    ("!a MATCHES '^x+$'", Not(Text("a", "matches", "^x+$"))),
])
def test_parse_and_back(text, tree):
    assert parse(text) == tree
    assert from_json(to_json(tree)) == tree
    assert parse(pretty(tree)) == tree


@pytest.mark.parametrize("text", ["", "  ", "a", "a =", "a = b", "a = -1", "a = 'x", "(a = 1", "a = 1)", "a between 1", "a between 1 or 2", "a in (1", "a in 1", "a starts 'x'", "a is x", "a = 1 b = 2", "= 1", "a = 1 ? 'x'", "a matches '('", "a like", "and a = 1", "a # 1"])
def test_errors_have_a_place(text):
    with pytest.raises(FilterParseError) as e:
        parse(text)
    assert 0 <= e.value.position <= len(text) and e.value.expression == text


@pytest.mark.parametrize("text", ["{}", "[]", "x", '{"version": 2, "filter": {}}', '{"version": 1, "filter": {"node": "Evil"}}'])
def test_bad_stored_filters(text):
    with pytest.raises(ValueError):
        from_json(text)


@pytest.mark.parametrize("text,ids", [
    ("name = 'APPLE'", {1}), ("name != 'apple'", {2, 3, 4, 5}), ("n < 10", {1, 2, 4}), ("n <= 10", {1, 2, 3, 4}), ("n > 4", {1, 3, 5}), ("n >= 10", {3, 5}), ("not n < 10", {3, 5}),
    ("n between 0 and 5", {1, 4}), ("n = 5", {1}), ("n = '05'", set()), ("x = 900", {2}), ("x = '1.5'", {1}), ("x < 2", {1, 3}), ("name < 'b'", {1, 3, 4, 5}), ("name > 5", {1, 2, 5}),
    ("name in ('apple', 'BANANA')", {1, 2}), ("not name in ('apple')", {2, 3, 4, 5}), ("name contains 'AN'", {2}), ("name contains ''", {1, 2, 3, 4, 5}), ("name starts with 'AP'", {1}), ("name ends with 'E'", {1}),
    ("name like 'a%'", {1}), ("name like 'a_b'", set()), ("name like '_pple'", {1}), ("name like '%'", {1, 2, 3, 4}), ("name matches 'a.a'", {2}), ("name matches '^$'", {3, 4}), ("name is null", {3, 4}), ("n is null", {2}), ("name is not null", {1, 2, 5}),
    ("ok = 'TRUE'", {1, 4}), ("missing < 3", {1, 2, 3, 4, 5}), ("missing = 'x'", set()), ("missing is null", {1, 2, 3, 4, 5}), ("n > 4 ? name contains 'a' : name is null", {1, 4, 5}), ("n > 4 ? 'yes' : 'no'", set()),
    ("not (n > 4 ? 'yes' : 'no')", {1, 2, 3, 4, 5}), ("('x') and n = 5", {1}), ("'x' or n = 5", {1}), ("not 'x'", {1, 2, 3, 4, 5}), ("'x' ? n = 5 : n = 0", {1}), ("n = 5 and 'x'", set()), ("not (n = 5 and 'x')", {1, 2, 3, 4, 5}),
    ("(n > 4 ? 'a' : n = 0) and x = 2", {4}),
])
def test_rows_that_pass(spark, text, ids):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.id for r in dsl.where(df, text).collect()} == ids
    col = dsl.to_column(parse(text), dict(df.dtypes))
    assert df.where(col.isNull()).count() == 0


def test_values_and_custom(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    value = dsl.to_value(parse("n > 9 ? 'big' : n is null ? 'none' : n = 5"), dict(df.dtypes))
    assert [r[0] for r in df.orderBy("id").select(value).collect()] == ["true", "none", "big", "false", "big"]
    assert dsl.where(df, F.col("n") % 2 == 0).count() == 3
    assert dsl.where(df, dsl.Builder().where("n", 5).or_range("x", 2, 1000).build()).count() == 3
    with pytest.raises(TypeError):
        dsl.where(df.withColumn("name", F.array("name")), "name = 'x'")


def test_ranges_reach_the_scan(spark, sf_dir):
    plan = dsl.where(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity > 40 and l_orderkey = 7")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "EqualTo(l_orderkey,7)" in plan
