"""Registered queries on stored indexes, their changes, and the steps of a search; see trawl.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import similarity as S
from trawl.functions import text as T
from trawl.operators import coverage, fuse, masks, post, retrieve, scan, short
from trawl.operators import index as I
from trawl.operators.synonyms import Synonyms
from trawl.plans import dsl
from trawl.plans.config import CoverageConfig, FieldSpec, IndexConfig
from trawl.queries import EVERY_TERM, IDF, PART_FIELDS, SQL, _bm25_ctes, _norm, _quoted, _words, query, stored, stored_parts, table
from trawl.sources import store
from trawl.sources.shared import cut, fresh
from trawl.streaming.ingest import index_stream

def _doc_key():
    return F.shiftright("doc_id", 20).alias("doc_key")


_TERM_DF = "SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM tm"


def _terms(index: I.Index) -> DataFrame:
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


# ---- stored indexes and their changes


@query(f"WITH {_bm25_ctes()} {_TERM_DF}")
def index_append(spark, sf_dir):
    """Half of the parts saved, the others appended in two steps."""
    parts, path = table(spark, sf_dir, "part"), fresh(spark, "index")
    store.save(parts.where("p_partkey % 2 = 0"), path, PART_FIELDS, "p_partkey", config=EVERY_TERM)
    store.append(parts.where("p_partkey % 4 = 1"), path)
    store.append(parts.where("p_partkey % 4 = 3"), path)
    return _terms(store.load(spark, path, check=True))


_CHANGED = """(SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, p_name || ' renewed' FROM part WHERE p_partkey % 7 = 0)"""


def _changed(spark, sf_dir) -> str:
    """Parts saved; those of keys ending in 3 deleted, every seventh replaced. Made anew for each query, since a merge changes it."""
    parts, path = table(spark, sf_dir, "part"), fresh(spark, "index")
    store.save(parts, path, PART_FIELDS, "p_partkey", config=EVERY_TERM)
    renewed = parts.where("p_partkey % 7 = 0").withColumn("p_name", F.concat("p_name", F.lit(" renewed")))
    store.change(spark, path, renewed, parts.where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("doc_key")), replace=True)
    return path


@query(f"WITH {_bm25_ctes(_CHANGED)} {_TERM_DF}")
def index_change(spark, sf_dir):
    return _terms(store.load(spark, _changed(spark, sf_dir), check=True))


@query(f"WITH {_bm25_ctes(_CHANGED)} {_TERM_DF}")
def merge_delta(spark, sf_dir):
    path = _changed(spark, sf_dir)
    store.compact(spark, path)
    store.vacuum(spark, path)
    return _terms(store.load(spark, path, check=True))


@query(f"WITH {_bm25_ctes(_CHANGED)} SELECT id AS doc_key, dl::BIGINT AS dl FROM dl")
def changed_lengths(spark, sf_dir):
    return store.load(spark, _changed(spark, sf_dir)).lengths.select(_doc_key(), "dl")


@query("SELECT p_partkey AS doc_key, p_partkey % 20 <> 3 AS deleted FROM part WHERE p_partkey % 10 = 3")
def index_restore(spark, sf_dir):
    """Keys ending in 3 deleted, half of them restored; all of them as they then are."""
    parts, path = table(spark, sf_dir, "part"), fresh(spark, "index")
    store.save(parts, path, PART_FIELDS, "p_partkey", config=EVERY_TERM)
    keys = parts.select(F.col("p_partkey").alias("doc_key"))
    store.delete_keys(keys.where("doc_key % 10 = 3"), path)
    store.restore(keys.where("doc_key % 20 = 3"), path)
    live = store.load(spark, path, check=True).docs.where("doc_key % 10 = 3").select("doc_key", F.lit(False).alias("deleted"))
    gone = store.deleted_documents(spark, path).select("doc_key").distinct().join(live.select("doc_key"), "doc_key", "left_anti")
    return live.unionByName(gone.withColumn("deleted", F.lit(True)))


@query("""WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1), live AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone))
SELECT lang, count(*) AS n, min(doc_id) AS lowest FROM live GROUP BY lang""")
def delete_compact(spark, sf_dir):
    """Documents saved, toxic ones deleted, the index compacted and loaded."""
    docs, path = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key"), fresh(spark, "index")
    store.save(docs.select("key", "lang"), path, [FieldSpec("lang", facetable=True)], "key")
    store.delete_keys(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc_key")), path)
    store.compact(spark, path)
    return store.load(spark, path, check=True).docs.groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_key").alias("lowest"))


@query(f"WITH {_bm25_ctes()} {_TERM_DF}")
def stream_index(spark, sf_dir):
    """The parts as a stream of three files into an empty index, with a merge on the way."""
    parts, path, files = table(spark, sf_dir, "part"), fresh(spark, "index"), fresh(spark, "stream")
    parts.repartition(3, "p_partkey").write.parquet(files)
    store.save(parts.where("false"), path, PART_FIELDS, "p_partkey", config=EVERY_TERM)
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(files)
    index_stream(stream, path, fresh(spark, "stream-state"), once=True, merge_after=1).awaitTermination()
    return _terms(store.load(spark, path, check=True))


@query(f"WITH {_bm25_ctes()} SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT sum(dl)::BIGINT FROM dl) AS total_length, (SELECT count(*) FROM tm) AS vocabulary, true AS valid, false AS elsewhere")
def index_info(spark, sf_dir):
    path = fresh(spark, "index")
    index = store.save(table(spark, sf_dir, "part"), path, PART_FIELDS, "p_partkey", config=EVERY_TERM)
    meta = store.index_info(spark, path)
    row = [F.lit(meta["n_docs"]).cast("long").alias("n_docs"), F.lit(meta["total_length"]).cast("long").alias("total_length")]
    said = [F.lit(store.is_valid_index(spark, path)).alias("valid"), F.lit(store.is_valid_index(spark, path + "-none")).alias("elsewhere")]
    return index.terms.agg(F.count("*").alias("vocabulary")).select(*row, "vocabulary", *said)


@query(f"WITH {_bm25_ctes()} SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS tf FROM p WHERE term IN (SELECT unnest({_words(f'lower({_norm("p_name")})')}) FROM part) GROUP BY term")
def stored_lookup(spark, sf_dir):
    """Postings of the words of the part names, from a stored index."""
    index = stored_parts(spark, sf_dir)
    wanted = table(spark, sf_dir, "part").select(F.explode(T.words(T.folded(F.col("p_name")))).alias("term")).distinct()
    return index.postings.join(wanted, "term").groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(F.col("tf").cast("long")).alias("tf"))


@query(f"""WITH d AS (SELECT p_partkey AS id, lower({_norm("p_name")}) AS t FROM part),
occ AS (SELECT id, substr(chr(65535) || chr(65535) || t, i::INT, 3) AS term FROM (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM d)
        UNION ALL SELECT id, substr(chr(65535) || chr(65535) || t, i::INT, 2) FROM (SELECT id, t, unnest(range(2, length(t) + 2)) AS i FROM d)
        UNION ALL SELECT id, w FROM (SELECT id, unnest({_words("t")}) AS w FROM d) WHERE length(w) >= 2)
SELECT id AS doc_key, count(*) AS n_terms, sum(tf)::BIGINT AS dl FROM (SELECT id, term, least(count(*), 256) AS tf FROM occ GROUP BY ALL) GROUP BY id""")
def index_without_words(spark, sf_dir):
    """The configuration of grams of two and three characters that looks no words up."""
    index = stored(spark, table(spark, sf_dir, "part"), PART_FIELDS, "p_partkey", config=IndexConfig.named(100))
    return index.postings.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum(F.col("tf").cast("long")).alias("dl")).select(_doc_key(), "n_terms", "dl")


_H, _L = f"lower({_norm('p_name')})", f"lower({_norm('p_type')})"


@query(f"""WITH d AS (SELECT p_partkey AS id, {_H} AS a, {_L} AS b FROM part),
g AS (SELECT id, i < 4 + length(a) AS high, substr(chr(65535) || chr(65535) || a || '§' || b, i::INT, 3) AS term FROM (SELECT *, unnest(range(1, length(a) + length(b) + 2)) AS i FROM d)),
w AS (SELECT id, true AS high, unnest({_words("a")}) AS term FROM d UNION ALL SELECT id, false, unnest({_words("b")}) FROM d),
c AS (SELECT id, term, count(*) FILTER (k = 1 AND high) AS gh, count(*) FILTER (k = 1 AND NOT high) AS gl, count(*) FILTER (k = 2 AND high) AS wh, count(*) FILTER (k = 2 AND NOT high) AS wl
      FROM (SELECT *, 1 AS k FROM g UNION ALL SELECT *, 2 FROM w WHERE length(term) >= 3) GROUP BY ALL)
SELECT id AS doc_key, term, (2 * gh + gl + CASE WHEN wh = 0 THEN 0 WHEN gl % 2 = 1 THEN 2 * wh - 1 ELSE 2 * wh END + wl)::INT AS tf FROM c""")
def weighted_postings(spark, sf_dir):
    """Names of high and types of low weight: an occurrence of weight 1.5 adds 2 to an even count and 1 to an odd one."""
    index = I.build_index(table(spark, sf_dir, "part"), [FieldSpec("p_type", "low"), FieldSpec("p_name", "high")], "p_partkey")
    return index.postings.select(_doc_key(), "term", F.col("tf").cast("int").alias("tf"))


@query("SELECT conv_id AS doc_key, min(turn)::INT AS segment, count(*) AS segments FROM conversations GROUP BY conv_id")
def segments_of_keys(spark, sf_dir):
    """The first segment of each key, and how many it has."""
    c = table(spark, sf_dir, "conversations")
    index = stored(spark, c.select("conv_id", "turn", "role"), [FieldSpec("role")], "conv_id", segment="turn")
    return I.first_segments(index).select("doc_key", "segment").join(index.docs.groupBy("doc_key").agg(F.count("*").alias("segments")), "doc_key")


@query("SELECT c_custkey, c_name, c_mktsegment, n FROM customer, (SELECT count(*) AS n FROM customer)")
def read_files(spark, sf_dir):
    """Customers written as CSV and as JSON, and read again."""
    own, csv, js = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), fresh(spark, "customers.csv"), fresh(spark, "customers.json")
    own.write.option("header", True).csv(csv)
    own.write.json(js)
    n = store.read_documents(spark, js).agg(F.count("c_custkey").alias("n"))
    return store.read_documents(spark, csv).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment").crossJoin(F.broadcast(n))


# ---- text


@query(f"""SELECT p_partkey, list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(chr(65535) || chr(65535) || t, i::INT, 3)), list_filter({_words("t")}, lambda x: length(x) >= 3)) AS terms
FROM (SELECT p_partkey, lower({_norm("p_name")}) AS t FROM part)""")
def index_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.index_terms(T.folded(F.col("p_name"))).alias("terms"))


@query("SELECT s_suppkey, translate(replace(replace(s_name, 'Supplier', 'S'), '#', 'no '), '0S', 'ot') AS norm FROM supplier")
def custom_normalise(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.normalize_with(F.col("s_name"), {"Supplier": "S", "#": "no "}, {"0": "o", "S": "t"}).alias("norm"))


@query(f"""WITH w AS (SELECT DISTINCT p_partkey, CASE x WHEN 'ring' THEN 'circlet' WHEN 'tiny' THEN 'small' ELSE x END AS word FROM (SELECT p_partkey, unnest({_words(f'lower({_norm("p_name")})')}) AS x FROM part))
SELECT word, count(*) AS df FROM w GROUP BY word""")
def synonym_words(spark, sf_dir):
    """Document counts of words that stand for their class."""
    index = I.build_index(table(spark, sf_dir, "part"), PART_FIELDS, "p_partkey", synonyms=Synonyms([["ring", "circlet"], ["tiny", "small"]]))
    return index.word_idf.select("word", "df")


@query(f"SELECT p_partkey, list_transform({_words(f'lower({_norm("p_name")})')}, lambda x: CASE x WHEN 'ring' THEN 'circlet' WHEN 'tiny' THEN 'small' ELSE x END) AS words FROM part")
def canonical_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", Synonyms([["ring", "circlet"], ["tiny", "small"]]).canonical_words(T.words(T.folded(F.col("p_name")))).alias("words"))


@query("SELECT coalesce(max(length(text)) > 2000, false) AS needed FROM documents")
def needs_splitting(spark, sf_dir):
    from trawl.operators.segment import needs_splitting as needed

    return needed(table(spark, sf_dir, "documents"), "text", 2000)


# ---- candidates

_CUT = "trim(substr(p_name, 1, p_partkey::INT % 12))"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, trim(lower({_norm(_CUT)})) AS q FROM part), w AS (SELECT *, {_words("q")} AS words FROM q), l AS (SELECT *, list_filter(words, lambda x: length(x) >= 3) AS long FROM w)
SELECT query_id, CASE WHEN length(q) = 0 THEN 'empty' WHEN len(long) > 0 THEN 'grams' WHEN length(q) = 1 THEN 'single' ELSE 'short' END AS kind,
       CASE WHEN len(long) > 0 AND len(long) < len(words) THEN array_to_string(long, ' ') ELSE q END AS bm25_text FROM l""")
def query_kinds(spark, sf_dir):
    """Beginnings of the part names as queries."""
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr("substring(p_name, 1, p_partkey % 12)").alias("text"))
    return retrieve.prepare_queries(q, IndexConfig()).select("query_id", "kind", "bm25_text")


def _batch_sql(k: int) -> str:
    return f"""WITH {_bm25_ctes("documents", "doc_id", "text")},
    b AS (SELECT item_id AS query_id, trim(lower({_norm("trim(coalesce(text, ''))")})) AS q FROM benchmark), bw AS (SELECT *, {_words("q")} AS words FROM b),
    bl AS (SELECT *, list_filter(words, lambda x: length(x) >= 3) AS long FROM bw),
    bt AS (SELECT query_id, long, CASE WHEN len(long) < len(words) THEN array_to_string(long, ' ') ELSE q END AS t FROM bl WHERE len(long) > 0),
    qt AS (SELECT DISTINCT query_id, unnest(list_concat(long, list_transform(range(1, length(t) + 1), lambda i: substr(chr(65535) || chr(65535) || t, i::INT, 3)))) AS term FROM bt),
    mt AS (SELECT DISTINCT term FROM qt WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM tm)),
    near AS (SELECT DISTINCT mt.term, p.id FROM mt JOIN tm ON levenshtein(mt.term, tm.term) <= 1 JOIN p ON p.term = tm.term),
    nt AS (SELECT term, {IDF} AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM near GROUP BY term), st),
    hit AS (SELECT query_id, id, tf, idf FROM qt JOIN tm USING (term) JOIN p USING (term) UNION ALL SELECT query_id, id, 1, idf FROM qt JOIN nt USING (term) JOIN near USING (term)),
    sc AS (SELECT query_id, id, round(sum(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / avgdl)) + 1)), 4) AS score FROM hit JOIN dl USING (id), st GROUP BY ALL)
    SELECT query_id, id AS doc_key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= {k}"""


@query(_batch_sql(10))
def bm25_batch_topk(spark, sf_dir):
    """Every benchmark text, all of its terms, as a query against all documents."""
    config = IndexConfig(query_terms=None, most_expanded=None)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    p = cut(retrieve.prepare_queries(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), config), "queries")
    scored = scan.top_of_texts(I.prepare(docs, [FieldSpec("text")], "key"), retrieve.query_terms(p, config), config, 10, 4, retrieve.MIN_EXPANDED)
    return retrieve.top(scored, 10).select("query_id", F.shiftright("doc_id", 20).alias("doc_key"), "score", F.col("rank").cast("long").alias("rank"))


_W = f"w AS (SELECT DISTINCT doc_key, word FROM (SELECT p_partkey AS doc_key, unnest({_words(f'lower({_norm("p_name")})')}) AS word FROM part))"


@query(f"""WITH {_W}, v AS (SELECT DISTINCT word FROM w WHERE length(word) >= 3), a AS (SELECT DISTINCT substr(word, 1, 2) AS q FROM w UNION SELECT DISTINCT substr(word, length(word) - 2) FROM w)
SELECT q AS word, count(DISTINCT doc_key) AS n_docs FROM a JOIN v ON starts_with(v.word, q) OR ends_with(v.word, q) JOIN w ON w.word = v.word GROUP BY q""")
def affix_lookup(spark, sf_dir):
    index = stored_parts(spark, sf_dir)
    asked = index.word_idf.select(F.substring("word", 1, 2).alias("word")).unionByName(index.word_idf.select(F.expr("substring(word, greatest(length(word) - 2, 1))").alias("word"))).distinct()
    return retrieve.lookup_affixes(asked, index.words, 3, None, index.word_idf).groupBy("word").agg(F.count("*").alias("n_docs"))


@query(f"""WITH {_W}, v AS (SELECT DISTINCT word FROM w), q AS (SELECT DISTINCT p_type AS query_id, unnest({_words("lower(p_type)")}) AS word FROM part UNION SELECT * FROM (VALUES ('x', 'widgte'), ('x', 'rng'), ('x', 'gea'), ('y', 'ed')) t(a, b)),
dq AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM q WHERE length(word) BETWEEN 3 AND 8)),
dv AS (SELECT DISTINCT word AS match, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM v WHERE length(word) BETWEEN 3 AND 8)),
m AS (SELECT word, word AS match FROM q WHERE length(word) BETWEEN 2 AND 8 UNION SELECT q.word, match FROM q JOIN dv ON dv.c = q.word WHERE length(q.word) BETWEEN 3 AND 8 UNION SELECT dq.word, match FROM dq JOIN dv ON dv.c = dq.c
  UNION SELECT dq.word, v.word FROM dq JOIN v ON v.word = dq.c WHERE length(v.word) BETWEEN 2 AND 8 UNION SELECT q.word, v.word FROM q JOIN v ON (starts_with(v.word, q.word) OR ends_with(v.word, q.word)) AND length(v.word) >= 3 WHERE length(q.word) >= 2)
SELECT query_id, count(DISTINCT doc_key) AS n_docs FROM q JOIN m ON m.word = q.word JOIN w ON w.word = m.match WHERE length(q.word) >= 2 GROUP BY query_id""")
def word_candidates(spark, sf_dir):
    """Documents that the words of each part type, and some with typos, find."""
    index = stored_parts(spark, sf_dir)
    more = spark.createDataFrame([("x", "widgte rng gea"), ("y", "ed")], "query_id string, text string")
    asked = table(spark, sf_dir, "part").select(F.col("p_type").alias("query_id"), F.col("p_type").alias("text")).distinct().unionByName(more)
    found = retrieve.word_candidates(retrieve.prepare_queries(asked, index.config), index.words, index.deletes, index.config.words, index.word_idf)
    return found.groupBy("query_id").agg(F.count("*").alias("n_docs"))


@query(f"""WITH d AS (SELECT p_partkey AS id, unnest({_words(f'lower({_norm("p_name")})')}) AS w FROM part), p AS (SELECT DISTINCT substr(w, 1, n::INT) AS prefix, id FROM (SELECT *, unnest(range(1, least(3, length(w)) + 1)) AS n FROM d)),
q AS (SELECT DISTINCT p_brand AS query_id, lower(p_brand) AS q FROM part UNION SELECT DISTINCT p_type, lower(p_type) FROM part), c AS (SELECT query_id, substr(q, 1, n::INT) AS prefix FROM (SELECT *, unnest(range(1, least(3, length(q)) + 1)) AS n FROM q)),
f AS (SELECT query_id, c.prefix, id, count(*) OVER (PARTITION BY query_id, c.prefix) AS n FROM c JOIN p ON p.prefix = c.prefix), s AS (SELECT *, max(length(prefix)) OVER (PARTITION BY query_id) AS longest FROM f WHERE n <= 20000)
SELECT query_id, id AS doc_key, n >= 100 AS only FROM s WHERE length(prefix) = longest""")
def prefix_first(spark, sf_dir):
    """Candidates by the longest prefix of the part types and brands as queries."""
    parts = table(spark, sf_dir, "part")
    asked = parts.select(F.col("p_brand").alias("query_id")).union(parts.select("p_type")).distinct().select("query_id", F.lower("query_id").alias("q"))
    return retrieve.prefix_first(asked, stored_parts(spark, sf_dir).prefixes, 2000).select("query_id", _doc_key(), "only")


_ASKED_WORDS = [("a", "red"), ("a", "widget"), ("b", "red"), ("b", "zzz"), ("c", "gear"), ("d", "brass")]
_AW = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ASKED_WORDS) + ") v(query_id, word))"


@query(f"""WITH {_W}, {_AW}, c AS (SELECT i.query_id, p_partkey AS doc_key FROM part, (SELECT DISTINCT query_id FROM q) i WHERE p_size < 10), h AS (SELECT DISTINCT c.query_id, c.doc_key FROM c JOIN q ON q.query_id = c.query_id JOIN w ON w.word = q.word AND w.doc_key = c.doc_key),
u AS (SELECT query_id FROM q WHERE word NOT IN (SELECT word FROM w)), s AS (SELECT query_id FROM h EXCEPT SELECT query_id FROM u)
SELECT query_id, doc_key FROM h WHERE query_id IN (SELECT query_id FROM s) UNION ALL SELECT query_id, doc_key FROM c WHERE query_id NOT IN (SELECT query_id FROM s)""")
def prescreen(spark, sf_dir):
    """Small parts as candidates of four queries, one of which has an unknown word."""
    index = stored_parts(spark, sf_dir)
    asked = spark.createDataFrame(_ASKED_WORDS, "query_id string, word string")
    small = table(spark, sf_dir, "part").where("p_size < 10").select((F.col("p_partkey") * I.SEGMENTS).alias("doc_id"))
    found = small.crossJoin(F.broadcast(asked.select("query_id").distinct()))  # four rows
    return retrieve.prescreen(found, asked, index.words).select("query_id", _doc_key())


@query(f"WITH {_bm25_ctes()}, {_AW} SELECT query_id, id AS doc_key, count(*) AS n_terms FROM q JOIN p ON p.term = q.word GROUP BY ALL")
def disjunctive(spark, sf_dir):
    """Documents with any of the words of a query, and how many of them."""
    asked = spark.createDataFrame(_ASKED_WORDS, "query_id string, term string")
    return retrieve.any_term(asked, stored_parts(spark, sf_dir).postings).select("query_id", _doc_key(), "n_terms")


@query(f"""WITH df AS (SELECT word, count(DISTINCT doc_id)::DOUBLE AS df FROM (SELECT doc_id, unnest({_words(f'lower({_norm("text")})')}) AS word FROM documents) GROUP BY word), n AS (SELECT count(*) AS n FROM documents),
q AS (SELECT item_id AS query_id, word, count(*) AS tf FROM (SELECT item_id, unnest({_words(f'lower({_norm("text")})')}) AS word FROM benchmark) GROUP BY ALL),
r AS (SELECT query_id, word, coalesce(1 + log10(n * tf / df), 0.0) AS raw FROM q LEFT JOIN df USING (word), n), s AS (SELECT query_id, word, raw, sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS norm FROM r)
SELECT query_id, word AS term, round(CASE WHEN norm > 0 THEN raw / norm ELSE 0.0 END, 6) AS weight FROM s""")
def query_weights(spark, sf_dir):
    own = I.prepare(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key"), [FieldSpec("text")], "key")
    terms = I.word_table(own).groupBy(F.col("word").alias("term")).agg(F.count("*").alias("df"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.words(T.folded(F.col("text")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    return retrieve.query_weights(asked, terms, own.agg(F.count("*").alias("n_docs"))).select("query_id", "term", F.round("weight", 6).alias("weight"))


# ---- short queries

_SHORT = [("a", "ri"), ("b", "r"), ("c", "la br"), ("d", "zq"), ("e", "g"), ("f", "s r")]


@query(f"""WITH {_bm25_ctes()}, q AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _SHORT)}) v(query_id, q)),
pt AS (SELECT DISTINCT query_id, q, pattern FROM (SELECT query_id, q, repeat(chr(65535), greatest(2 - i, 0)::INT) || substr(q, 1, least(length(q), i + 1)::INT) AS pattern FROM q, range(0, 3) r(i) UNION ALL SELECT query_id, q, ' ' || q FROM q) WHERE length(pattern) >= least(3, length(q) + 1)),
h AS (SELECT DISTINCT query_id, term FROM pt JOIN tm ON starts_with(term, pattern)), nr AS (SELECT query_id, id, 10 * sum(tf) AS points FROM h JOIN p USING (term) GROUP BY ALL),
poor AS (SELECT query_id, q FROM q WHERE (SELECT count(*) FROM nr WHERE nr.query_id = q.query_id) < 100), ch AS (SELECT DISTINCT query_id, c FROM (SELECT query_id, unnest(string_split(q, '')) AS c FROM poor) WHERE c NOT IN ('', ' ')),
bt AS (SELECT query_id, term, max(CASE WHEN contains(term, ' ' || c) THEN 2 ELSE 1 END) AS times FROM ch JOIN tm ON contains(term, c) GROUP BY ALL), wd AS (SELECT query_id, id, sum(tf * times) AS points FROM bt JOIN p USING (term) GROUP BY ALL),
e AS (SELECT query_id, id, sum(points) AS points FROM (SELECT * FROM nr UNION ALL SELECT * FROM wd) GROUP BY ALL),
x AS (SELECT e.*, q, t, {_words("q")} AS asked, {_words("t")} AS w, points / max(points) OVER (PARTITION BY query_id)::DOUBLE AS share FROM e JOIN q USING (query_id) JOIN d USING (id)),
y AS (SELECT *, len(list_filter(asked, lambda a: list_contains(w, a))) AS have FROM x)
SELECT query_id, id AS doc_key, round(share + CASE WHEN len(asked) >= 2 THEN CASE WHEN have = len(asked) THEN 8 + CASE WHEN len(w) <= len(asked) + 1 THEN 2 ELSE 0 END WHEN have > 0 THEN 4 ELSE 0 END
  ELSE CASE WHEN list_contains(w, q) THEN 1 ELSE 0 END + CASE WHEN starts_with(t, q) THEN 2 ELSE 0 END + CASE WHEN coalesce(w[1] = q, false) THEN 4 ELSE 0 END + CASE WHEN t = q THEN 8 ELSE 0 END END, 6) AS score FROM y""")
def short_query(spark, sf_dir):
    """Queries of one- and two-letter words over the part names."""
    i = stored_parts(spark, sf_dir)
    asked = spark.createDataFrame(_SHORT, "query_id string, q string")
    return short.short_search(asked, i.terms, i.postings, i.docs).select("query_id", _doc_key(), F.round("score", 6).alias("score"))


@query(SQL["champions"].replace("SELECT c AS prefix, id AS doc_key, score, rank FROM", "SELECT c AS query_id, id AS doc_key, score FROM").replace("WHERE rank <= 64", "WHERE rank <= 10 AND c IN (SELECT c FROM s GROUP BY c HAVING count(*) >= 10)"))
def champion_search(spark, sf_dir):
    """One-letter queries answered by what a stored index holds ready."""
    index = stored_parts(spark, sf_dir)
    letters = spark.range(97, 123).select(F.char("id").alias("query_id"), F.char("id").alias("q"))
    return short.champion_search(letters, index.champions, 10).select("query_id", _doc_key(), F.round("score", 6).alias("score"))


@query(f"""WITH d AS (SELECT p_partkey AS id, {_words(f'lower({_norm("p_name")})')} AS w FROM part), o AS (SELECT id, w[i] AS word, i - 1 AS position FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d))
SELECT id AS doc_key, position::INT AS position FROM o WHERE starts_with(word, 're') AND position = 0""")
def prefix_positions(spark, sf_dir):
    return short.prefix_lookup(stored_parts(spark, sf_dir).prefixes, "re", True).select(_doc_key(), "position")


# ---- coverage

_COVERED = [("a", "red"), ("b", "small ring"), ("c", "ring blue zzz"), ("d", "gear"), ("e", "zz")]


def _covered(spark, sf_dir, words: int | None = None) -> DataFrame:
    """Every part name under some queries, those of so many words where it is given, words matched whole."""
    rows = [(i, t, [(w, 1.0, 1.0) for w in t.split()]) for i, t in _COVERED if words is None or len(t.split()) == words]
    asked = spark.createDataFrame(rows, "query_id string, q string, tokens array<struct<token:string,gram_idf:double,word_idf:double>>")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("norm_text"))
    every = docs.crossJoin(F.broadcast(asked)).withColumn("base", F.lit(0.0))  # five rows at most
    return coverage.with_features(every, CoverageConfig(joined=False, affix=False, fuzzy=False))


_COVER = f"""q AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _COVERED)}) v(query_id, q)), d AS (SELECT p_partkey AS doc_id, lower(p_name) AS t, {_words("lower(p_name)")} AS w FROM part),
x AS (SELECT *, string_split(q, ' ') AS tok, list_distinct(list_filter(w, lambda y: length(y) >= 2)) AS u0, len(list_filter(w, lambda y: length(y) >= 2)) AS doc_tokens,
      len(list_filter(range(1, least(length(q), length(t)) + 1), lambda i: substr(q, 1, i::INT) = substr(t, 1, i::INT))) AS pre FROM q, d),
f AS (SELECT *, list_filter(tok, lambda y: list_contains(u0, y)) AS hit, list_filter(w, lambda y: length(y) >= 2) AS dw FROM x),
g AS (SELECT *, len(hit) AS n_hit, CASE WHEN contains(t, q) THEN length(q) WHEN pre = 0 THEN 0 ELSE least(pre + CASE WHEN length(q) >= 5 THEN floor(length(q) * 0.2) ELSE 0 END, length(q), length(t)) END AS lcs,
      coalesce(list_min(list_transform(hit, lambda y: strpos(' ' || t || ' ', ' ' || y || ' ') - 1)), -1) AS first_match FROM f)"""


@query(f"""WITH {_COVER} SELECT query_id, doc_id, len(tok)::INT AS terms_count, n_hit::INT AS terms_any, n_hit::INT AS terms_strict, n_hit::INT AS terms_prefix, n_hit::INT AS word_hits, first_match::INT AS first_match, doc_tokens::INT AS doc_tokens, lcs::INT AS lcs,
round(CASE WHEN len(tok) = 1 AND lcs > 0 THEN greatest(n_hit, least(1.0, lcs / length(q)::DOUBLE)) ELSE n_hit END, 6)::DOUBLE AS sum_ci, round(n_hit / len(tok)::DOUBLE, 6) AS idf_coverage FROM g""")
def coverage_whole(spark, sf_dir):
    names = ["terms_count", "terms_any", "terms_strict", "terms_prefix", "word_hits", "first_match", "doc_tokens", "lcs"]
    return _covered(spark, sf_dir).select("query_id", "doc_id", *names, F.round("sum_ci", 6).alias("sum_ci"), F.round("idf_coverage", 6).alias("idf_coverage"))


@query(f"WITH {_COVER} SELECT query_id, doc_id, (CASE WHEN n_hit = 1 THEN 196608 + CASE WHEN first_match = 0 THEN 32 ELSE 16 END ELSE 0 END)::INT AS precedence, 0 AS tiebreaker FROM g WHERE len(tok) = 1")
def fused_precedence(spark, sf_dir):
    """Precedence of one-word queries: the word is there, as itself, and where."""
    return fuse.fuse(_covered(spark, sf_dir, 1).where("terms_count = 1")).select("query_id", "doc_id", "precedence", "tiebreaker")


# ---- after ranking


@query("""WITH f AS (SELECT * FROM part WHERE p_size BETWEEN 10 AND 20 ORDER BY p_partkey LIMIT 25), c AS (SELECT 'p_brand' AS field, p_brand AS value, count(*) AS count FROM f GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM f GROUP BY ALL)
SELECT field, value, count, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS rank FROM c""")
def empty_query_facets(spark, sf_dir):
    """A query without text: the first 25 parts that pass, and their facets."""
    from trawl.engine import SearchEngine

    fields = [*PART_FIELDS, FieldSpec("p_size", indexable=False)]
    engine = SearchEngine(stored(spark, table(spark, sf_dir, "part"), fields, "p_partkey"))
    found = engine.search(spark.createDataFrame([("e", " ")], "query_id string, text string"), k=25, filter_="p_size BETWEEN 10 AND 20", facets=True)
    return found.facets.select("field", "value", "count", F.col("rank").cast("long").alias("rank"))


_BOOSTS = [post.Boost("lang = 'en'", "high"), post.Boost("n_chars > 5000", "low"), post.Boost("source CONTAINS '1'")]


@query("SELECT count(*) FILTER (lower(lang) = 'de') AS documents_in_filter, count(*) FILTER (lower(lang) = 'en' OR n_chars > 5000 OR contains(lower(source), '1')) AS documents_boosted, 6 AS max_boost FROM documents")
def filter_and_boost_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # two rows of one count each
    return post.count_in_filter(docs, "lang = 'de'").crossJoin(post.count_boosted(docs, _BOOSTS)).withColumn("max_boost", F.lit(post.max_boost(_BOOSTS)))


def _ranked(spark, sf_dir) -> DataFrame:
    """Conversations as queries, their turns as ranked results."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), F.col("turn").alias("doc_key"), F.length("text").cast("double").alias("score"), F.lit(0).alias("tiebreaker"), (F.length("text") % 3).alias("word_hits"), F.lit(0).alias("lcs"))
    return post.rank(rows)


_RANKED = "(SELECT conv_id, turn, length(text) AS score, length(text) % 3 AS hits, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations)"


@query(f"""WITH r AS (SELECT * FROM {_RANKED}), m AS (SELECT *, max(hits) OVER (PARTITION BY conv_id) AS best FROM r), l AS (SELECT *, max(CASE WHEN hits >= greatest(1, best) OR score >= 254 THEN rank END) OVER (PARTITION BY conv_id) AS last FROM m)
SELECT conv_id, turn, rank FROM l WHERE last IS NULL OR rank <= last""")
def truncation(spark, sf_dir):
    return fuse.truncate(_ranked(spark, sf_dir)).select(F.col("query_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT conv_id AS query_id, count(*) AS total_candidates, max(rank) - 1 AS truncation_index, arg_max(score, rank)::DOUBLE AS truncation_score FROM {_RANKED} GROUP BY conv_id")
def result_metadata(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    return post.metadata(r, r).withColumn("truncation_index", F.col("truncation_index").cast("long"))


@query("""SELECT l_orderkey, l_linenumber, ((CASE WHEN l_returnflag = 'R' THEN 128 ELSE 0 END | CASE WHEN l_linestatus = 'O' THEN 64 ELSE 0 END | CASE WHEN l_discount > 0.05 THEN 32 ELSE 0 END | CASE WHEN l_tax > 0.03 THEN 16 ELSE 0 END) * 256 + l_quantity::INT)::INT AS score FROM lineitem""")
def ranked_score(spark, sf_dir):
    c = F.col
    score = fuse.ranked_score(c("l_quantity").cast("int"), c("l_returnflag") == "R", c("l_linestatus") == "O", c("l_discount") > 0.05, c("l_tax") > 0.03)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.cast("int").alias("score"))


@query("""WITH a AS (SELECT p_partkey FROM part WHERE p_size < 20), b AS (SELECT p_partkey FROM part WHERE lower(p_type) = 'economy'), r AS (SELECT p_partkey FROM a INTERSECT SELECT p_partkey FROM b),
u AS (SELECT p_partkey FROM a UNION SELECT p_partkey FROM b), n AS (SELECT p_partkey FROM part EXCEPT SELECT p_partkey FROM u)
SELECT 'and' AS set, p_partkey FROM r UNION ALL SELECT 'or', p_partkey FROM u UNION ALL SELECT 'not', p_partkey FROM n""")
def filter_masks(spark, sf_dir):
    docs = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
    a, b = masks.mask(docs, "p_size < 20"), masks.mask(docs, "p_type = 'economy'")
    sets = {"and": masks.both(a, b), "or": masks.either(a, b), "not": masks.complement(docs, masks.either(a, b))}
    rows = [s.select(F.lit(n).alias("set"), F.col("doc_id").alias("p_partkey")) for n, s in sets.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ---- filters in other forms

_KEPT = "SELECT p_partkey FROM part WHERE (p_size BETWEEN 5 AND 15 OR p_size IS NULL) AND (coalesce(lower(p_type) = 'economy', false) OR contains(lower(p_name), 'ring')) AND NOT coalesce(lower(p_brand) = 'brand#2', false)"
_FILTER = "p_size BETWEEN 5 AND 15 AND (p_type = 'economy' OR p_name CONTAINS 'ring') AND NOT p_brand = 'Brand#2'"


@query(_KEPT)
def dsl_stored(spark, sf_dir):
    """A filter written to a file and read again."""
    path = fresh(spark, "filter")
    dsl.save_filter(spark, _FILTER, path)
    return dsl.where(table(spark, sf_dir, "part"), dsl.load_filter(spark, path)).select("p_partkey")


@query(_KEPT)
def dsl_pretty(spark, sf_dir):
    """A filter spelled out from its tree, and parsed again."""
    return dsl.where(table(spark, sf_dir, "part"), dsl.pretty(dsl.parse(_FILTER))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (lower(p_type) = 'economy' AND p_size BETWEEN 5 AND 15) OR p_size BETWEEN 40 AND 45")
def dsl_builder(spark, sf_dir):
    built = dsl.Builder().where("p_type", "economy").and_range("p_size", 5, 15).or_range("p_size", 40, 45).build()
    return dsl.where(table(spark, sf_dir, "part"), built).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 = 1")
def dsl_derived(spark, sf_dir):
    """A condition that is a Column."""
    return dsl.where(table(spark, sf_dir, "part"), F.col("p_partkey") % 3 == 1).select("p_partkey")


# ---- similarities


@query("""WITH n AS (SELECT DISTINCT length(p_name) AS n FROM part UNION SELECT DISTINCT length(n_name) FROM nation), d AS (SELECT n, unnest(range(0, 12)) AS d FROM n),
c AS (SELECT n, d, list_sum(list_transform(range(0, d + 1), lambda k: CASE WHEN k > n THEN 0 ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) * pow(0.04, k) * pow(0.96, n - k) END)) AS p FROM d)
SELECT n AS length, min(d)::INT AS edits FROM c WHERE p >= 0.99 GROUP BY n""")
def edit_budget(spark, sf_dir):
    """How many edits words of a length are allowed."""
    n = table(spark, sf_dir, "part").select(F.length("p_name").cast("long").alias("length")).union(table(spark, sf_dir, "nation").select(F.length("n_name").cast("long"))).distinct()
    return n.select("length", S.max_edits_column(F.col("length").cast("int")).alias("edits"))
