"""Search: batches of queries against an index, ranked, filtered, boosted, sorted, with facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.operators import coverage, fuse, post, retrieve, scan, short
from trawl.operators.index import CHAMPIONS, Index, build_index
from trawl.plans import dsl
from trawl.plans.config import CoverageConfig, FieldSpec, IndexConfig
from trawl.sources.shared import cut

#: Queries of up to so many characters without a delimiter count as type-ahead.
TYPE_AHEAD = 3


@dataclass
class SearchResult:
    """records: query_id, rank, doc_key, segment, doc_id, score, precedence, semantic, tiebreaker; facets and metadata by query_id.

    in_filter has one row, documents_in_filter, for a search with a filter; boosted one row, documents_boosted, for one with boosts.
    """

    records: DataFrame
    facets: DataFrame | None
    metadata: DataFrame
    in_filter: DataFrame | None = None
    boosted: DataFrame | None = None


class SearchEngine:
    def __init__(self, index: Index, coverage_config: CoverageConfig | None = None):
        self.index, self.coverage_config = index, coverage_config or CoverageConfig()

    @staticmethod
    def build(docs: DataFrame, fields: list[FieldSpec], key: str = "doc_key", **kwargs) -> SearchEngine:
        return SearchEngine(build_index(docs, fields, key, **kwargs))

    @staticmethod
    def minimal(docs: DataFrame, fields: list[FieldSpec], key: str = "doc_key") -> SearchEngine:
        return SearchEngine(build_index(docs, fields, key, config=IndexConfig.named(103)), CoverageConfig.minimal())

    def first_stage(self, prepared: DataFrame, docs: DataFrame, depth: int, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) of the depth best documents of each query, by the way that its words allow.

        docs is the index's own docs table, or that part of it that a filter lets pass. One-letter queries for which the index holds k
        champions, or more, are answered by these.
        """
        i, all_docs = self.index, docs is self.index.docs
        kinds = {r.kind for r in prepared.select("kind").distinct().collect()}  # four at most
        ways = []
        if "grams" in kinds:
            ways.append(scan.top_of_index(i, retrieve.query_terms(prepared, i.config), depth, docs=None if all_docs else docs))
        if "single" in kinds:
            letters = prepared.where("kind = 'single'")
            if k and all_docs and k <= CHAMPIONS and "champions" in i.tables:
                ready = short.champion_search(letters, i.champions, k)
                ways.append(ready)
                letters = letters.join(ready.select("query_id").distinct(), "query_id", "left_anti")
            ways.append(short.single_char_search(letters, docs))
        if "short" in kinds or not ways:
            ways.append(short.short_search(prepared.where("kind = 'short'"), i.terms, i.postings, docs, i.config.min_word, i.config.start_pad))
        scored = ways[0]
        for w in ways[1:]:
            scored = scored.unionByName(w)
        return retrieve.top(scored, depth)

    def candidates(self, prepared: DataFrame, stage: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
        """(query_id, doc_id, base): the first stage with its share of the best score, and what words find besides.

        With config.limit_words there are no more than depth candidates in all: of those that only words find the lowest doc_ids.
        """
        i = self.index
        based = stage.select("query_id", "doc_id", (F.col("score") / F.nullif(F.max("score").over(W.partitionBy("query_id")), F.lit(0.0))).alias("base"))
        if i.config.words is None:
            return based
        if self.coverage_config.limit_words:  # of twice depth the first stage has half at most
            found = retrieve.first_candidates(prepared, i.words, i.deletes, i.config.words, 2 * depth, stage, i.word_idf, None if docs is i.docs else docs)
        else:
            found = retrieve.word_candidates(prepared, i.words, i.deletes, i.config.words, i.word_idf)
            if docs is not i.docs:
                found = found.join(docs.select("doc_id"), "doc_id", "left_semi")
        both = based.unionByName(found.select("query_id", "doc_id", F.lit(None).cast("double").alias("base")))
        one = both.groupBy("query_id", "doc_id").agg(F.max("base").alias("base"), F.count("*").alias("__n"))
        if not self.coverage_config.limit_words:
            return one.select("query_id", "doc_id", F.coalesce("base", F.lit(0.0)).alias("base"))
        extra = F.col("base").isNull()
        overlap = F.sum(F.when(F.col("__n") > 1, 1).otherwise(0)).over(W.partitionBy("query_id"))
        order = F.row_number().over(W.partitionBy("query_id", extra).orderBy("doc_id"))
        ranked = one.withColumn("__overlap", overlap).withColumn("__at", order)
        return ranked.where(~extra | (F.col("__at") <= depth - F.col("__overlap"))).select("query_id", "doc_id", F.coalesce("base", F.lit(0.0)).alias("base"))

    def search(
        self, queries: DataFrame, k: int = 10, depth: int = 500, use_coverage: bool = True, filter_: object = None, filter_mode: str = "post", boosts: list[post.Boost] | None = None,
        sort: str | None = None, ascending: bool = True, facets: bool = False, facet_top: int = 100,
    ) -> SearchResult:
        """The k best documents of each of queries(query_id, text).

        filter_mode "post" filters the k best, so fewer may come back; "pre" ranks only documents that pass. Boosts and sort apply to
        what is left then. Facets count all of that. Queries without text or whose text is null return nothing, but with facets the first k documents that pass
        the filter, by key, with the full score, as browse() does.
        """
        if filter_mode not in ("post", "pre"):
            raise ValueError("filter_mode is post or pre")
        i, config = self.index, self.coverage_config
        docs = dsl.where(i.docs, filter_) if filter_ is not None and filter_mode == "pre" else i.docs
        # the queries, and no more than depth rows for each: small beside the index, used many times
        prepared = cut(retrieve.prepare_queries(queries, i.config, i.synonyms), "search-queries")
        stage = cut(self.first_stage(prepared, docs, depth, k), "search-stage")
        names = docs.select("doc_id", "doc_key", "segment")
        plain = stage.join(names, "doc_id").select("query_id", "doc_id", "doc_key", "segment", "score", F.lit(0).alias("precedence"), F.lit(0.0).alias("semantic"), F.lit(0).alias("tiebreaker"))
        plain = post.consolidate(plain)
        if use_coverage:
            results = self._covered(prepared, stage, plain, docs, k, depth, config)
        else:
            results = plain
        results = post.rank(results, k)
        if facets and prepared.where("kind = 'empty'").limit(1).count():
            passing = dsl.where(i.docs, filter_) if filter_ is not None else i.docs
            first = passing.select("doc_id", "doc_key", "segment").orderBy("doc_key", "doc_id").limit(k)
            none = prepared.where("kind = 'empty'").select("query_id").crossJoin(F.broadcast(first))  # k rows
            zero = {"precedence": F.lit(0), "semantic": F.lit(0.0), "tiebreaker": F.lit(0), "score": F.lit(post.FULL_SCORE)}
            results = results.unionByName(post.rank(none.withColumns(zero)).select(*results.columns))
        results = cut(results, "search-best")
        if filter_ is not None and filter_mode == "post":
            results = post.apply_filter(results, i.docs, filter_)
        results = post.apply_boosts(results, i.docs, boosts or [])
        results = post.sort_by(results, i.docs, sort, ascending) if sort else post.rank(results)
        columns = ["query_id", "rank", "doc_key", "segment", "doc_id", "score", "precedence", "semantic", "tiebreaker"]
        results = results.select(*columns)
        counted = post.result_facets(results, i.docs, i.fields, facet_top) if facets else None
        in_filter = post.count_in_filter(i.docs, filter_) if filter_ is not None else None
        return SearchResult(results, counted, post.metadata(results, results), in_filter, post.count_boosted(i.docs, boosts) if boosts else None)

    def _covered(self, prepared, stage, plain, docs, k, depth, config):
        i = self.index
        rows = stage.groupBy("query_id").agg(F.count("*").alias("__rows"))
        kind = prepared.join(rows, "query_id", "left").withColumn("__rows", F.coalesce("__rows", F.lit(0)))
        ahead = (F.length("q") <= TYPE_AHEAD) & (F.size("words") == 1) & (F.length("q") == F.length(F.element_at("words", 1)))
        by_grams = F.col("kind") == "grams"
        # type-ahead queries that reach more documents are not looked at word by word
        most = config.short_covered
        few = F.lit(True) if most is None else F.col("__rows") <= most
        stays = (ahead & (F.col("__rows") >= k)) | (~by_grams & ~(ahead & (F.col("__rows") >= 1) & few)) | (ahead & ~few)
        looked_at = kind.where((F.col("kind") != "empty") & ~F.coalesce(stays, F.lit(False))).drop("__rows")
        found = self.candidates(looked_at, stage.join(looked_at.select("query_id"), "query_id", "left_semi"), docs, depth)
        if config.prescreen:
            words = looked_at.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
            kept = retrieve.prescreen(found.select("query_id", "doc_id"), words, i.words)
            found = found.join(kept, ["query_id", "doc_id"], "left_semi")
        tokens = retrieve.query_idf(looked_at, i.terms, i.word_idf, i.config, config.min_word)
        asked = looked_at.select("query_id", "q").join(tokens, "query_id", "left")
        texts = docs.select("doc_id", "norm_text")
        fused = cut(fuse.fuse(coverage.with_features(found.join(asked, "query_id").join(texts, "doc_id"), config)), "search-fused")
        names = docs.select("doc_id", "doc_key", "segment")
        covered = post.rank(post.consolidate(fused.join(names, "doc_id")))
        if config.truncate:
            covered = fuse.truncate(covered, config.truncation_score, config.min_word_hits)
        # queries that no document covers keep what the first stage found
        hits = covered.groupBy("query_id").agg(F.max("word_hits").alias("__hits")).where("__hits > 0").select("query_id")
        covered = covered.join(hits, "query_id", "left_semi").select(*plain.columns)
        return covered.unionByName(plain.join(hits, "query_id", "left_anti"))

    def browse(self, k: int = 10, filter_: object = None) -> tuple[DataFrame, DataFrame]:
        """What a query without text gives: the first documents that pass, and their facets."""
        return post.browse(self.index.docs, self.index.fields, k, filter_)
