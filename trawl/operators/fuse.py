"""From coverage features to a rank: precedence bits before a semantic share, all of it Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What an intent signal adds to the semantic share of queries of three words or more.
INTENT_BONUS = 0.15


def _bit(condition: Column, value: int) -> Column:
    return F.when(condition, value).otherwise(0)


def _or(*parts: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def fuse(f: DataFrame) -> DataFrame:
    """f(query_id, doc_id, base, q_len, doc_len, features) to (query_id, doc_id, precedence, semantic, tiebreaker, score, word_hits, lcs)."""
    c = F.col
    n = F.when(c("query_tokens") > 0, c("query_tokens")).otherwise(c("terms_count"))
    single, some = n <= 1, c("terms_count") > 0
    complete, clean, exact = (some & (c(x) == c("terms_count")) for x in ("terms_any", "terms_prefix", "terms_strict"))
    at_start = c("first_match") == 0
    missing = c("terms_count") - c("terms_any")
    ratio = F.when(some, c("terms_any") / c("terms_count")).otherwise(0.0)
    partial = (ratio > 0) & (ratio < 1)
    last_matched = c("last_has_prefix") | complete
    usable = (last_matched | ~c("last_is_type_ahead")) & (c("total_idf") > 0)

    tier = F.when(~some, 0).when(missing <= 0, 3).when(missing == 1, 2).when(c("terms_any") * 2 >= c("terms_count"), 1).otherwise(0)
    strong_last = c("prefix_last") & some & (c("preceding_strict") == c("terms_count") - 1) & c("last_has_prefix")
    low = F.when(strong_last, 3).when(c("prefix_last"), 2).when(c("perfect_doc") | (c("anchor_stem") & (c("longest_prefix_run") >= 2)), 1).otherwise(0)
    low = low + F.when(c("query_tokens") > c("terms_count"), c("single_char_boost")).otherwise(0)
    stem = F.when(c("stem_evidence"), True).otherwise((missing == 1) & usable & (c("missing_idf") / F.nullif(c("total_idf"), F.lit(0.0)) < 1 - ratio))
    stem_bit = _bit(partial & (n >= 2) & F.coalesce(stem, F.lit(False)), 8)
    multi = _or(
        tier * 65536, _bit(clean & at_start & c("prefix_last") & complete, 32768), _bit((c("doc_tokens") > 0) & (c("word_hits") == c("doc_tokens")), 16384),
        _bit((c("terms_count") >= 2) & (c("dominant") | c("strong_anchor")), 8192), _bit((c("terms_count") >= 2) & c("dominant") & (missing == 1), 8), low,
    )
    lone_tier = F.when(~complete, 0).when(at_start & exact, 4).when(at_start & clean, 3).when(~at_start & exact, 2).when(~at_start & clean, 1).otherwise(0)
    lone = _or(_bit(complete, 131072), _bit(clean, 65536), lone_tier * 8)
    precedence = _or(F.when(single, lone).otherwise(multi), stem_bit)

    mean = F.when(some, c("sum_ci") / c("terms_count")).otherwise(0.0)
    covered = F.when(partial & (missing == 1) & usable & (c("idf_coverage") > ratio), c("idf_coverage")).otherwise(mean)
    dense = covered * c("word_hits") / F.greatest(c("doc_tokens"), F.lit(1))
    signals = c("anchor_stem").cast("int") + (c("suffix_prefix_run") >= 2).cast("int")
    dense = F.when((c("terms_count") >= 3) & (signals > 0), F.least(F.lit(1.0), dense + INTENT_BONUS * signals)).otherwise(dense)
    trailing = c("trailing_density") / 255.0
    dense = F.when((c("terms_count") >= 2) & (trailing > 0), dense + (1 - dense) * trailing).otherwise(dense)
    semantic = F.when(single, (mean + c("lexical_sim") / 255.0) / 2).when(c("doc_tokens") == 0, mean).otherwise(dense)
    semantic = F.when(partial & (c("base") >= 1 - ratio), ratio * semantic + (1 - ratio) * c("base")).otherwise(semantic)
    tie = F.when((n >= 2) & (c("doc_len") > 0), (F.least(F.lit(1.0), c("q_len") / F.greatest(c("doc_len"), F.lit(1))) * 255).cast("int")).otherwise(0)
    own = f.select("query_id", "doc_id", precedence.cast("int").alias("precedence"), F.greatest(F.lit(0.0), F.least(F.lit(0.999), semantic)).alias("semantic"), tie.alias("tiebreaker"), "word_hits", "lcs")
    return own.select("query_id", "doc_id", "precedence", "semantic", "tiebreaker", (c("precedence") + c("semantic")).alias("score"), "word_hits", "lcs")


def ranked_score(coverage: Column, whole_query: Column, first_word: Column, all_words: Column, type_ahead: Column) -> Column:
    """The older scheme of 16 bits: four precedence flags above the coverage byte."""
    return _or(_bit(whole_query, 128), _bit(first_word, 64), _bit(all_words, 32), _bit(type_ahead, 16)) * 256 + coverage


def truncate(ranked: DataFrame, score_limit: float = 254.0, min_hits: int = 1) -> DataFrame:
    """Of ranked(query_id, rank, score, word_hits, lcs), the rows up to the last one that has as many word hits as the best, a common
    beginning with the query, or a score of score_limit; all rows of a query that has no such row."""
    whole = W.partitionBy("query_id")
    enough = (F.col("word_hits") >= F.greatest(F.lit(min_hits), F.max("word_hits").over(whole))) | (F.col("lcs") > 0) | (F.col("score") >= score_limit)
    marked = ranked.withColumn("__good", enough)
    last = F.max(F.when(F.col("__good"), F.col("rank"))).over(whole)
    return marked.withColumn("__last", last).where(F.col("__last").isNull() | (F.col("rank") <= F.col("__last"))).drop("__good", "__last")
