"""What follows ranking: one entry per key, filters, boosts, sorting, facets, and figures on the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions.text import net_string
from trawl.plans import dsl
from trawl.plans.config import FieldSpec
from trawl.sources.shared import cut

STRENGTHS = {"low": 1, "med": 2, "high": 3}
#: The score of every document when a query has no text.
FULL_SCORE = 65535.0


@dataclass(frozen=True)
class Boost:
    """Adds its strength to the score of the documents that pass the filter."""

    filter: object
    strength: str = "med"


def _order(*first: Column) -> list[Column]:
    return [*first, F.desc("score"), F.desc("tiebreaker"), F.asc("doc_key")]


def rank(results: DataFrame, k: int | Column | None = None, first: list[Column] | None = None) -> DataFrame:
    """results with their rank: by what comes first, else score, tiebreaker and the lower doc_key; the k best where k is given.

    Rows of equal keys go by doc_id.
    """
    ranked = results.drop("rank").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*_order(*(first or [])), "doc_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rank_many(results: DataFrame, first: list[Column] | None = None) -> DataFrame:
    """rank() where a query may have results without bound: no task sorts all of one query.

    Rows are range-partitioned by query and order and written in that order; a row's rank is its place in its partition, and the rows of its query in the
    partitions before. Only counts per query and partition, no more than queries and partitions together, go to every task. Rows that are
    equal in all of the order and in doc_id have ranks of their own.
    """
    order = [F.asc("query_id"), *_order(*(first or [])), F.asc("doc_id")]
    sorted_ = results.drop("rank").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    per = placed.groupBy(F.col("query_id").alias("__query"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__query").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("__query", "__p", "__first", before.alias("__before"))
    ranked = placed.join(per, F.col("query_id").eqNullSafe(F.col("__query")) & (F.col("__part") == F.col("__p")))
    return ranked.withColumn("rank", (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("long")).drop("__at", "__part", "__query", "__p", "__first", "__before")


def consolidate(results: DataFrame) -> DataFrame:
    """Of each query's rows with one doc_key the best: by score, tiebreaker, then the lower doc_id."""
    order = W.partitionBy("query_id", "doc_key").orderBy(F.desc("score"), F.desc("tiebreaker"), "doc_id")
    return results.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def apply_filter(results: DataFrame, docs: DataFrame, filter_: object) -> DataFrame:
    """The results whose document passes."""
    passing = dsl.where(docs, filter_).select("doc_id")
    return results.join(passing, "doc_id", "left_semi")


def count_in_filter(docs: DataFrame, filter_: object) -> DataFrame:
    """One row: how many documents of the corpus pass."""
    return dsl.where(docs, filter_).agg(F.count("*").alias("documents_in_filter"))


def boost_column(boosts: list[Boost], dtypes: dict[str, str]) -> Column:
    total = F.lit(0)
    for b in boosts:
        passes = F.coalesce(b.filter, F.lit(False)) if isinstance(b.filter, Column) else dsl.to_column(dsl.parse(b.filter) if isinstance(b.filter, str) else b.filter, dtypes)
        total = total + F.when(passes, STRENGTHS[b.strength]).otherwise(0)
    return total


def apply_boosts(results: DataFrame, docs: DataFrame, boosts: list[Boost]) -> DataFrame:
    """score raised by the strengths of the boosts whose filters the document passes."""
    if not boosts:
        return results
    own = docs.select("doc_id", boost_column(boosts, dict(docs.dtypes)).alias("__boost"))
    return results.join(own, "doc_id").withColumn("score", F.col("score") + F.col("__boost")).drop("__boost")


def max_boost(boosts: list[Boost]) -> int:
    return sum(STRENGTHS[b.strength] for b in boosts)


def count_boosted(docs: DataFrame, boosts: list[Boost]) -> DataFrame:
    """One row: how many documents of the corpus any boost applies to."""
    return docs.where(boost_column(boosts, dict(docs.dtypes)) > 0).agg(F.count("*").alias("documents_boosted"))


def sort_column(field: str, dtype: str, ascending: bool) -> Column:
    """Numbers, booleans and dates by value, all else as text; nulls lowest."""
    plain = dtype in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "string", "timestamp", "timestamp_ntz") or dtype.startswith("decimal")
    col = F.col(field) if plain else F.to_json(F.col(field)) if dtype.startswith(("array", "map", "struct")) else F.col(field).cast("string")
    return col.asc_nulls_first() if ascending else col.desc_nulls_last()


def sort_by(results: DataFrame, docs: DataFrame, field: str, ascending: bool = True, k: int | None = None, many: bool = False) -> DataFrame:
    """results ranked by a field of their documents instead of by score; many as in rank_many()."""
    own = docs.select("doc_id", F.col(field).alias("__sort"))
    first = [sort_column("__sort", dict(docs.dtypes)[field], ascending)]
    found = results.join(own, "doc_id")
    return (rank_many(found, first) if many else rank(found, k, first)).drop("__sort")


def _named(values: Column, name: str) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))


def facets(rows: DataFrame, fields: list[FieldSpec], by: list[str] | None = None, top: int = 100) -> DataFrame:
    """(by, field, value, count, rank): the values of the facetable fields and how many rows have each, the top ones of each field.

    Elements of arrays count one by one, nulls and empty values not at all. Of equal counts the lower value comes first.
    All fields are counted in one pass over rows.
    """
    by, dtypes = by or [], dict(rows.dtypes)
    pairs = []
    for f in (f for f in fields if f.facetable):
        kind = dtypes[f.name]
        values = F.col(f.name).cast("array<string>") if kind.startswith("array") else F.array(net_string(F.col(f.name), kind))
        pairs.append(_named(values, f.name))
    if not pairs:
        return rows.select(*by, F.lit("").alias("field"), F.lit("").alias("value"), F.lit(0).cast("long").alias("count"), F.lit(0).alias("rank")).where("false")
    one = rows.select(*by, F.explode(F.concat(*pairs)).alias("__p")).select(*by, "__p.field", "__p.value").where("value IS NOT NULL AND value <> ''")
    counted = one.groupBy(*by, "field", "value").agg(F.count("*").alias("count"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(*by, "field").orderBy(F.desc("count"), "value")))
    return ranked.where(F.col("rank") <= top)


def result_facets(results: DataFrame, docs: DataFrame, fields: list[FieldSpec], top: int = 100) -> DataFrame:
    """The facets of each query's results."""
    names = [f.name for f in fields if f.facetable]
    return facets(results.select("query_id", "doc_id").join(docs.select("doc_id", *names), "doc_id"), fields, ["query_id"], top)


def browse(docs: DataFrame, fields: list[FieldSpec], k: int, filter_: object = None) -> tuple[DataFrame, DataFrame]:
    """What a query without text gives: the first k documents that pass, all of one score, and the facets of these."""
    passing = docs if filter_ is None else dsl.where(docs, filter_)
    first = passing.orderBy("doc_key", "doc_id").limit(k)
    return first.select("doc_id", "doc_key", "segment", F.lit(FULL_SCORE).alias("score")), facets(first, fields)


def metadata(results: DataFrame, taken: DataFrame) -> DataFrame:
    """(query_id, total_candidates, truncation_index, truncation_score) of results and the ranked rows taken of them."""
    total = results.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
    last = taken.groupBy("query_id").agg((F.max("rank") - 1).alias("truncation_index"), F.max_by("score", "rank").alias("truncation_score"))
    return total.join(last, "query_id", "left")
