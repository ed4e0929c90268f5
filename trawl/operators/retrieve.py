"""Candidates for batches of queries: BM25+ over grams and words, typo-tolerant expansion, word and affix lookup.

A query is a row. Every step carries query_id, so a thousand queries are one job. The sides made from queries are small beside
the index; Spark broadcasts them by their measured size, so postings are filtered where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators.index import idf, one_deleted
from trawl.plans.config import IndexConfig, WordMatchConfig
from trawl.sources.shared import cut

K1, B, DELTA = 1.2, 0.75, 1.0
#: A missing term of at least so many characters is expanded.
MIN_EXPANDED = 4


def prepare_queries(queries: DataFrame, config: IndexConfig, synonyms=None) -> DataFrame:
    """query_id, q (trimmed, normalised, lower case, synonyms by their class), words, kind and bm25_text.

    kind is empty, single (one character), short (all words shorter than a gram) or grams. Of a query with long and
    short words the long ones alone go to BM25.
    """
    own = queries.select("query_id", T.folded(F.trim(F.coalesce("text", F.lit("")))).alias("q"))
    own = own.withColumn("q", F.trim("q"))
    if synonyms is not None and len(synonyms):
        own = own.withColumn("q", synonyms.canonical_text(F.col("q")))
    own = own.withColumn("words", T.words(F.col("q")))
    long = F.filter("words", lambda w: F.length(w) >= config.min_word)
    kind = F.when(F.length("q") == 0, "empty").when(F.size(long) > 0, "grams").when(F.length("q") == 1, "single").otherwise("short")
    bm25 = F.when((F.size(long) > 0) & (F.size(long) < F.size("words")), F.array_join(long, " ")).otherwise(F.col("q"))
    return own.select("*", kind.alias("kind"), bm25.alias("bm25_text"))


def query_terms(prepared: DataFrame, config: IndexConfig) -> DataFrame:
    """(query_id, term), each once; of a long query the first config.query_terms, all where that is None."""
    return prepared.where("kind = 'grams'").select("query_id", F.explode(T.query_terms(F.col("bm25_text"), config.gram_sizes, config.start_pad, config.query_terms, config.high_resolution)).alias("term"))


def within_one(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, match) for each term of wanted: the words of vocabulary within Levenshtein distance 1, the term itself too.

    Two words within one edit have the word itself or a string with one character deleted in common, so both sides are
    spelled out that way and met on equality; the distance then decides. No pair of words meets otherwise.
    """
    spelled = lambda c: F.array_union(F.array(c), one_deleted(c))
    left = wanted.select("term").distinct().select("term", F.explode(spelled(F.col("term"))).alias("variant"))
    right = vocabulary.select(F.col("term").alias("match")).distinct().select("match", F.explode(spelled(F.col("match"))).alias("variant"))
    return left.join(right, "variant").where(F.levenshtein("term", "match", 1) >= 0).select("term", "match").distinct()


def near_terms(lacking: DataFrame, variants: DataFrame) -> DataFrame:
    """within_one() where the spelled-out vocabulary lies ready: variants(variant, term) is only read where a variant is asked for."""
    left = lacking.select("term", F.explode(F.array_union(F.array("term"), one_deleted(F.col("term")))).alias("variant"))
    found = left.join(variants.select("variant", F.col("term").alias("match")), "variant")
    return found.where(F.levenshtein("term", "match", 1) >= 0).select("term", "match").distinct()


def near_known(lacking: DataFrame, terms: DataFrame, variants: DataFrame | None, most: int | None) -> DataFrame:
    """(term, match): the terms of the index within one edit of each of lacking(term), the first `most` in the alphabet."""
    near = within_one(lacking, terms.where(F.length("term") >= MIN_EXPANDED - 1)) if variants is None else near_terms(lacking, variants).join(terms.select(F.col("term").alias("match")), "match", "left_semi")
    if most is not None:
        near = near.withColumn("__n", F.row_number().over(W.partitionBy("term").orderBy("match"))).where(F.col("__n") <= most)
    return near.select("term", "match")


def expand_missing(terms_wanted: DataFrame, terms: DataFrame, postings: DataFrame, n_docs: Column, stats: DataFrame, variants: DataFrame | None = None, most: int | None = 1024) -> DataFrame:
    """(term, doc_id, tf, idf) of the terms that the index lacks: the documents of all terms within one edit, as one term of tf 1.

    Of more than `most` such terms the first ones in the alphabet count; all where it is None.
    """
    lacking = terms_wanted.select("term").distinct().where(F.length("term") >= MIN_EXPANDED).join(terms.select("term"), "term", "left_anti")
    near = near_known(lacking, terms, variants, most)
    docs = near.join(postings.select(F.col("term").alias("match"), "doc_id"), "match").select("term", "doc_id").distinct()
    count = docs.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", idf(n_docs, F.col("df")).alias("idf"))
    return docs.join(count, "term").select("term", "doc_id", F.lit(1).cast("smallint").alias("tf"), "idf")


def bm25(tf: Column, idf_: Column, dl: Column, avgdl: Column) -> Column:
    """idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) + delta)."""
    norm = K1 * (1 - B + B * F.greatest(dl, F.lit(1)) / avgdl)
    return idf_ * (tf * (K1 + 1) / (tf + norm) + DELTA)


def bm25_scores(
    wanted: DataFrame, terms: DataFrame, postings: DataFrame, lengths: DataFrame, stats: DataFrame, expand: bool = True, variants: DataFrame | None = None, most: int | None = 1024,
) -> DataFrame:
    """(query_id, doc_id, score, n_terms) of every document that has a term of the query."""
    known = meet(wanted, terms.select("term", "idf"), "term")
    hits = meet(known, postings, "term").select("query_id", "doc_id", "tf", "idf")
    if expand:
        extra = expand_missing(wanted, terms, postings, F.col("n_docs"), stats, variants, most)
        hits = hits.unionByName(wanted.join(extra, "term").select("query_id", "doc_id", "tf", "idf"))
    scored = hits.join(lengths, "doc_id").crossJoin(F.broadcast(stats.select("avgdl")))
    one = bm25(F.col("tf").cast("double"), F.col("idf"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy("query_id", "doc_id").agg(F.sum(one).alias("score"), F.count("*").alias("n_terms"))


def top(scored: DataFrame, k: int | Column, by: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank: score first, then the lower doc_id."""
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k)


#: Rows of queries that are sent to every task; of more, both sides of a join are shuffled.
BROADCAST_ROWS = 1_000_000


def meet(asked: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """asked, a table made from queries, joined with a table of the index. What Python makes of few bytes Spark takes for few bytes too, so it would send all postings
    to the driver and on to every task: here it is the side of the queries that is sent, once it is counted, and never that of the index."""
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return held.join(F.broadcast(asked), on) if few else asked.join(held.hint("merge"), on)


def any_term(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, n_terms) of the documents with any term of the query, and how many of them."""
    return meet(wanted, postings, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n_terms"))


def tiers(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, tier): 0 for documents with all terms of the query, 1 for those with all but one, 2 for the rest."""
    sized = wanted.select("query_id", "term", F.count("*").over(W.partitionBy("query_id")).alias("n"))
    have = meet(sized, postings, "term").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("m"))
    return have.select("query_id", "doc_id", F.least(F.col("n") - F.col("m"), F.lit(2)).cast("int").alias("tier"))


def intersect(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents with all terms of the query."""
    return tiers(wanted, postings).where("tier = 0").select("query_id", "doc_id")


def prescreen(candidates: DataFrame, query_words: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates without any word of the query go, of queries all of whose words the index has, unless none would be left."""
    have = query_words.join(words, "word").select("query_id", "doc_id").distinct()
    unknown = query_words.join(words.select("word"), "word", "left_anti").select("query_id").distinct()
    kept = candidates.join(have, ["query_id", "doc_id"], "left_semi")
    screened = kept.select("query_id").distinct().join(unknown, "query_id", "left_anti")
    return kept.join(screened, "query_id", "left_semi").unionByName(candidates.join(screened, "query_id", "left_anti"))


def prefix_first(queries: DataFrame, prefixes: DataFrame, top_k: int) -> DataFrame:
    """(query_id, doc_id, only): the documents of the longest prefix of a query, up to three characters, that no more than
    10 * top_k documents have; only says that these are enough to be the sole candidates."""
    begun = queries.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("q"))), lambda n: F.substring(F.col("q"), F.lit(1), n))).alias("prefix"))
    found = begun.join(prefixes.select("prefix", "doc_id").distinct(), "prefix")
    sized = found.withColumn("n", F.count("*").over(W.partitionBy("query_id", "prefix"))).where(F.col("n") <= 10 * top_k)
    longest = sized.withColumn("longest", F.max(F.length("prefix")).over(W.partitionBy("query_id"))).where(F.length("prefix") == F.col("longest"))
    return longest.select("query_id", "doc_id", (F.col("n") >= min(2 * top_k, 100)).alias("only"))


def _vocabulary(words: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """(word), each once: from the counted vocabulary where there is one, else from the postings of words."""
    return words.select("word").distinct() if vocabulary is None else vocabulary.select("word")


def match_words(wanted: DataFrame, words: DataFrame, deletes: DataFrame, config: WordMatchConfig, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, match): the word itself, known or not, and the known words that symmetric deletes bring together with it.

    Those are words of the deletes table that lose one character to become the word, that the word loses one
    character to become, or that become the same when both lose one; the last holds for some words two edits apart too.
    """
    asked = wanted.select("word").distinct()
    may_delete = F.length("word").between(config.min_delete, config.max_delete)
    fit = lambda c: F.length(c).between(config.min_exact, config.max_exact)
    cut = asked.where(may_delete).select("word", F.explode(one_deleted(F.col("word"))).alias("variant"))
    known = _vocabulary(words, vocabulary).select(F.col("word").alias("match")).where(fit("match"))
    longer = deletes.select(F.col("variant"), F.col("word").alias("match"))
    found = asked.where(fit("word")).select("word", F.col("word").alias("match"))
    # a variant of the deletes table meets the word itself, or the word with a character left out: one look-up
    tried = cut.unionByName(asked.where(may_delete).select("word", F.col("word").alias("variant")))
    found = found.unionByName(tried.join(longer, "variant").select("word", "match"))
    found = found.unionByName(cut.join(known, F.col("variant") == F.col("match")).select("word", "match")).distinct()
    return found


def _documents(found: DataFrame, words: DataFrame) -> DataFrame:
    """(word, doc_id) of found(word, match), each once. Rows go to the task of their document before they are made distinct: few files may hold the words
    of very many documents, and a task that reads one would hold them all."""
    return meet(found, words.select(F.col("word").alias("match"), "doc_id"), "match").select("word", "doc_id").repartition("doc_id").distinct()


def lookup_words(wanted: DataFrame, words: DataFrame, deletes: DataFrame, config: WordMatchConfig, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, doc_id): documents with the word, or with one that symmetric deletes bring together with it; see match_words()."""
    return _documents(match_words(wanted, words, deletes, config, vocabulary), words)


def _by_affix(wanted: DataFrame, vocabulary: DataFrame, cut) -> DataFrame:
    """(word, match) where cut(match, length of word) is word. Each length that is asked for is one equality; there are no more of them than the
    longest wanted word has characters, so no word meets all of the vocabulary."""
    asked = wanted.select("word").distinct().where("word IS NOT NULL")
    sizes = asked.select(F.length("word").alias("n")).distinct()
    sizes = [r.n for r in sizes.collect()]  # lengths of words
    if not sizes:
        return asked.select("word", F.col("word").alias("match")).where("false")
    own = vocabulary.select(F.col("word").alias("match")).distinct() if vocabulary.columns != ["word"] else vocabulary.select(F.col("word").alias("match"))
    tried = own.select("match", F.explode(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda n: n <= F.length("match"))).alias("n")).select("match", cut(F.col("match"), F.col("n")).alias("word"))
    return asked.join(tried, "word").select("word", "match").distinct()


def by_prefix(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, match): words of vocabulary that begin with the wanted one."""
    return _by_affix(wanted, vocabulary, lambda c, n: F.substring(c, F.lit(1), n))


def by_suffix(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, match): words of vocabulary that end with the wanted one."""
    return _by_affix(wanted, vocabulary, lambda c, n: F.substring(c, F.length(c) - n + 1, n))


def match_affixes(wanted: DataFrame, words: DataFrame, min_word: int = 3, most: int | None = 4096, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, match): the known words that have the wanted one as prefix or suffix.

    Of more than `most` such words the first ones in the alphabet count; all where it is None.
    """
    known = _vocabulary(words, vocabulary).where(F.length("word") >= min_word)
    found = by_prefix(wanted, known).unionByName(by_suffix(wanted, known)).distinct()
    if most is not None:
        found = found.withColumn("__n", F.row_number().over(W.partitionBy("word").orderBy("match"))).where(F.col("__n") <= most)
    return found.select("word", "match")


def lookup_affixes(wanted: DataFrame, words: DataFrame, min_word: int = 3, most: int | None = 4096, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, doc_id): documents of the words that have the wanted one as prefix or suffix, of no more than `most` words; see match_affixes()."""
    return _documents(match_affixes(wanted, words, min_word, most, vocabulary), words)


def word_candidates(prepared: DataFrame, words: DataFrame, deletes: DataFrame, config: WordMatchConfig, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id): what any word of the query of two characters or more finds exactly, by one edit, or as an affix."""
    asked = prepared.select("query_id", F.explode(F.array_distinct("words")).alias("word")).where(F.length("word") >= 2)
    found = asked.join(word_matches(asked, words, deletes, config, vocabulary), "word").select(F.col("query_id").alias("word"), "match").distinct()
    return _documents(found, words).withColumnRenamed("word", "query_id")


#: Queries whose hits are marked in the bits of some columns at a time.
MASKED_QUERIES = 62 * 8


def first_candidates(prepared: DataFrame, words: DataFrame, deletes: DataFrame, config: WordMatchConfig, k: int, stage: DataFrame, vocabulary: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id) of word_candidates(): for each query all that are in stage(query_id, doc_id), and no fewer than the k others with the lowest doc_ids.

    A document has one row whose bits say which queries find it, so no row is made for each query, word and document that meet.
    """
    from trawl.operators.scan import lowest

    spark = prepared.sparkSession
    rows = prepared.select("query_id", F.explode(F.array_distinct("words")).alias("word")).where(F.length("word") >= 2)
    ids = [r.query_id for r in rows.select("query_id").distinct().collect()]  # the queries
    kind = prepared.schema["query_id"].dataType.simpleString()
    out = None
    for at in range(0, len(ids), MASKED_QUERIES):
        own = ids[at : at + MASKED_QUERIES]
        numbered = spark.createDataFrame([(i, n) for n, i in enumerate(own)], f"query_id {kind}, number long")
        asked = rows.join(F.broadcast(numbered), "query_id")  # the queries
        bits = [F.when(F.floor(F.col("number") / 62) == c, F.expr("shiftleft(1L, cast(number % 62 as int))")).otherwise(F.lit(0).cast("long")).alias(f"m{c}") for c in range(-(-len(own) // 62))]
        names = [f"m{c}" for c in range(len(bits))]
        each = lambda df, by: df.groupBy(by).agg(*(F.bit_or(n).alias(n) for n in names))
        of_word = each(asked.select("word", *bits), "word")
        of_match = cut(each(word_matches(asked, words, deletes, config, vocabulary).join(of_word, "word"), "match"), "matches")
        held = words.select(F.col("word").alias("match"), "doc_id")
        masks = meet(of_match, held if docs is None else held.join(docs.select("doc_id"), "doc_id", "left_semi"), "match")
        masks = cut(each(masks.select("doc_id", *names), "doc_id"), "word-hits")
        first = lowest(masks, len(own), k).join(F.broadcast(numbered), "number").select("query_id", "doc_id")
        bit = F.coalesce(*(F.when(F.floor(F.col("number") / 62) == c, F.expr(f"shiftright(m{c}, cast(number % 62 as int)) & 1")) for c in range(len(bits))))
        staged = stage.select("query_id", "doc_id").join(F.broadcast(numbered), "query_id").join(masks, "doc_id").where(bit == 1).select("query_id", "doc_id")
        found = first.unionByName(staged)
        out = found if out is None else out.unionByName(found)
    return stage.select("query_id", "doc_id").where("false") if out is None else out.distinct()


def word_matches(asked: DataFrame, words: DataFrame, deletes: DataFrame, config: WordMatchConfig, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, match): what each word of asked finds exactly, by one edit, or as an affix."""
    found = match_words(asked, words, deletes, config, vocabulary)
    if config.affix:
        found = found.unionByName(match_affixes(asked, words, config.min_affix, config.most_affixes, vocabulary))
    return found.distinct()


def query_idf(prepared: DataFrame, terms: DataFrame, by_word: DataFrame, config: IndexConfig, min_word: int) -> DataFrame:
    """(query_id, tokens: [(token, gram_idf, word_idf)]) in the order of the query.

    gram_idf is the mean over the token's grams that the index has, log2(length + 1) where it has none; word_idf is 0 for unknown words.
    """
    listed = prepared.select("query_id", F.posexplode(T.coverage_tokens(F.col("q"), min_word)).alias("at", "token"))
    cut = listed.select("query_id", "at", "token", F.explode_outer(F.concat(*(T.grams(F.col("token"), n) for n in config.gram_sizes))).alias("term"))
    mean = cut.join(terms.select("term", "idf"), "term", "left").groupBy("query_id", "at", "token").agg(F.avg("idf").alias("g"))
    both = mean.join(by_word.select(F.col("word").alias("token"), F.col("idf").alias("w")), "token", "left")
    one = F.struct("at", "token", F.coalesce("g", F.log2(F.length("token") + 1)).alias("gram_idf"), F.coalesce("w", F.lit(0.0)).alias("word_idf"))
    grouped = both.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return grouped.select("query_id", F.transform("t", lambda x: F.struct(x["token"].alias("token"), x["gram_idf"].alias("gram_idf"), x["word_idf"].alias("word_idf"))).alias("tokens"))


def query_weights(wanted: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, term, weight, byte) of wanted(query_id, term, tf): 1 + log10(N * tf / df) of each known term, scaled so that the squares of a
    query's weights add up to 1, and the same as a byte. Terms that the index lacks have weight 0."""
    from trawl.functions.similarity import quantise

    found = wanted.join(terms.select("term", "df"), "term", "left").crossJoin(F.broadcast(stats.select("n_docs")))
    raw = F.when(F.col("df").isNull(), 0.0).otherwise(1 + F.log10(F.col("n_docs") * F.col("tf") / F.col("df")))
    sized = found.select("query_id", "term", raw.alias("raw")).withColumn("__norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("query_id"))))
    weight = F.when(F.col("__norm") > 0, F.col("raw") / F.col("__norm")).otherwise(0.0)
    return sized.select("query_id", "term", weight.alias("weight"), quantise(weight).alias("byte"))
