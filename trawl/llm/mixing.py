"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut, n_words, unit

SEED = "mix-1"
#: Up to so many sources their rates are broadcast (some 100 bytes each); beyond it the join is left to Spark.
BROADCAST_SOURCES = 200_000


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: source, tokens, rate. Rate is how often each of its documents is to appear.

    Tokens are words. The mixed corpus aims at epochs times all tokens, shared among the sources by weights; without
    weights, by the square roots of their tokens. A source without an entry in weights has weight 0; one without tokens has
    rate 1. A null source is a source of its own, named by the key "" in weights if no source is called so.
    """
    per = docs.select(F.col(source).alias("__mix_source"), n_words(F.col(text)).alias("__n")).groupBy("__mix_source").agg(F.sum("__n").alias("tokens"))
    if weights is None:
        weight = F.sqrt(F.col("tokens").cast("double"))
    else:
        known = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))) if weights else F.lit(None).cast("map<string,double>")
        weight = F.when(F.col("tokens") > 0, F.coalesce(F.try_element_at(known, F.coalesce("__mix_source", F.lit(""))), F.lit(0.0))).otherwise(0.0)
    both = per.select("*", weight.alias("__w"))
    total = both.agg(F.sum("tokens").alias("__all"), F.sum("__w").alias("__all_w"))
    share = F.col("__w") / F.col("__all_w") * F.lit(float(epochs)) * F.col("__all") / F.col("tokens")
    # one row per source meets one row
    return both.crossJoin(total).select("__mix_source", "tokens", F.when((F.col("tokens") > 0) & (F.col("__all_w") > 0), share).otherwise(1.0).alias("__mix_rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text", copy_col: str = "copy_no") -> DataFrame:
    """Emit each document floor(rate) times, and once more with probability rate - floor(rate).

    The draw is MD5 of seed and key, so a task that runs again draws alike and equal keys draw alike; a null key draws as
    "". Returns the columns of docs and copy_no from 1 on; a column of that name in docs is replaced. A null text has no
    tokens, repeated rows count and are emitted each. An empty table gives an empty table.

    Tokens per source are one aggregation with partial sums on the map side. Its rows are written and counted: of up to
    BROADCAST_SOURCES sources the rates are broadcast, so neither documents nor a hot source are shuffled.
    """
    columns = [c for c in docs.columns if c != copy_col]
    own = docs.select(*columns).withColumn("__mix_key", F.col(source))
    per = cut(rates(docs, weights, epochs, source, text).select("__mix_source", "__mix_rate"), "mix-rates")
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    rated = own.join(per, F.col("__mix_key").eqNullSafe(F.col("__mix_source")), "inner")
    rate = F.col("__mix_rate")
    copies = (F.floor(rate) + (unit(seed, F.col(key)) < rate - F.floor(rate)).cast("long")).cast("int")
    return rated.withColumn("__mix_n", copies).where("__mix_n > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias(copy_col))


def query(spark, sf_dir):
    from trawl.llm.common import table

    return mix_sources(table(spark, sf_dir, "documents"))


SQL = f"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(text, '\\S+'))) AS tokens FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN tokens > 0 THEN sqrt(tokens::DOUBLE) / (sum(sqrt(tokens::DOUBLE)) OVER ()) * (sum(tokens) OVER ()) / tokens ELSE 1.0 END AS rate FROM s),
d AS (SELECT documents.*, rate, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, 1 + (floor(rate)::INT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)))::INT AS copy_no FROM d
"""
