"""Sets of documents by filter, and their algebra: a mask is a table of doc_id, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.plans import dsl


def mask(docs: DataFrame, filter_: object) -> DataFrame:
    """The documents that pass; rows without a doc_id belong to no mask."""
    return dsl.where(docs, filter_).select("doc_id").where("doc_id IS NOT NULL").distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def complement(docs: DataFrame, a: DataFrame) -> DataFrame:
    return without(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), a)


def add(a: DataFrame, ids: DataFrame) -> DataFrame:
    """The mask with the doc_ids of ids too; nulls are none."""
    return either(a, ids.select("doc_id").where("doc_id IS NOT NULL"))


def contains(a: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(doc_id, ...) with in_filter, whether the mask has their document."""
    return rows.join(a.select("doc_id", F.lit(True).alias("__in")), "doc_id", "left").withColumn("in_filter", F.coalesce("__in", F.lit(False))).drop("__in")
