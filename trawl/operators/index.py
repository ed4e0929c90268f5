"""From documents to index tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators.synonyms import Synonyms
from trawl.plans.config import FieldSpec, IndexConfig, WordMatchConfig

#: How many documents of each short prefix are kept ready for one-letter queries.
CHAMPIONS = 64


@dataclass
class Index:
    """The tables of an index, lazily made or read from storage.

    docs      doc_id, doc_key, segment, norm_text (normalised, case kept), lower_text, first_token, token_count, and the fields
    texts     doc_id, segment, parts: the weighted texts that the terms are counted of
    postings  term, doc_id, tf
    terms     term, df, idf
    lengths   doc_id, dl
    stats     one row: n_docs, avgdl
    word_idf  word, df, idf
    words     word, doc_id: words that may be looked up
    deletes   variant, word: words with one character left out
    variants  variant, term: terms, and terms with one character left out
    prefixes  prefix, doc_id, position
    champions prefix, doc_id, score, rank: of each first character of a word the best documents; only in a stored index without deletions
    """

    tables: dict[str, DataFrame]
    fields: list[FieldSpec]
    config: IndexConfig
    synonyms: Synonyms = field(default_factory=Synonyms)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)), and 0 where the ratio is not positive."""
    ratio = (n - df + 0.5) / (df + 0.5)
    return F.when(ratio <= 0, F.lit(0.0)).otherwise(F.log(ratio + 1))


#: doc_id is doc_key * SEGMENTS + segment.
SEGMENTS = 1 << 20


def with_ids(docs: DataFrame, key: str, segment: str | None = None) -> DataFrame:
    """doc_key, segment and doc_id, which is made from the two, so that a rebuild gives the same ids.

    An id stands for one row, so (key, segment) must be unique. A row with a null key, a key outside -2**43 to 2**43 - 1, or a segment outside 0 to
    2**20 - 1 could not be told from others or found again: it raises an error when the index is made. A null segment is 0.
    """
    seg = F.coalesce(F.col(segment).cast("int"), F.lit(0)) if segment else F.lit(0)
    own = docs.withColumn("doc_key", F.col(key).cast("long")).withColumn("segment", seg)
    k, limit = F.col("doc_key"), 1 << 43
    wrong = k.isNull() | (k < -limit) | (k >= limit) | (F.col("segment") < 0) | (F.col("segment") >= SEGMENTS)
    said = F.concat(F.lit("no document number for key "), F.coalesce(k.cast("string"), F.lit("null")), F.lit(", segment "), F.col("segment").cast("string"))
    return own.withColumn("doc_id", F.when(wrong, F.raise_error(said).cast("long")).otherwise(k * SEGMENTS + F.col("segment")))


def prepare(docs: DataFrame, fields: list[FieldSpec], key: str, segment: str | None = None, synonyms: Synonyms | None = None) -> DataFrame:
    """The docs table: ids, the weighted texts (parts), and the joined text in its forms."""
    parts = T.searchable(fields, dict(docs.dtypes))
    plain = synonyms is None or not len(synonyms)
    fold, fold_all = ((lambda c: c),) * 2 if plain else (synonyms.canonical_text, synonyms.canonical_texts)
    kept = [f.name for f in fields if f.name not in ("doc_key", "segment", "doc_id")]
    own = with_ids(docs, key, segment).select("doc_id", "doc_key", "segment", *kept, parts.alias("__raw"))
    norm = F.transform("__raw", lambda p: F.struct(p["weight"].alias("weight"), T.normalize(p["text"]).alias("text")))
    own = own.withColumn("parts", norm).drop("__raw")
    own = own.withColumn("norm_text", fold(F.array_join(F.transform("parts", lambda p: p["text"]), T.FIELD_MARK)))
    own = own.withColumn("__texts", fold_all(F.transform("parts", lambda p: F.lower(p["text"]))))
    own = own.withColumn("parts", F.transform("__texts", lambda t, i: F.struct(F.element_at("parts", i + 1)["weight"].alias("weight"), t.alias("text")))).drop("__texts")
    own = own.withColumn("lower_text", F.array_join(F.transform("parts", lambda p: p["text"]), T.FIELD_MARK))
    listed = T.words(F.col("lower_text"))
    return own.withColumn("first_token", F.try_element_at(listed, F.lit(1))).withColumn("token_count", F.size(listed))


def fold_weights(weights: list[float]) -> int:
    """What occurrences of the given weights add up to: each is added and rounded half to even, until it exceeds 255."""
    total = 0
    for w in weights:
        if total > 255:
            break
        total = round(total + w)
    return total


_STEPS = {1.0: (1, 1), 1.25: (1, 1), 1.5: (2, 2)}


def _weighed_counts(parts: list[tuple[float, str]], body: str, sizes: tuple[int, ...], pad: int, continued: bool) -> dict[str, int]:
    """term_counts() of a document whose fields have several weights, occurrence by occurrence."""
    seen: dict[str, list[float]] = {}
    ends, at = [], 0 if continued else pad
    for w, t in parts:
        at += len(t) + 1
        ends.append((at, w))
    for n in sizes:
        k = 0
        for i in range(len(body) - n + 1):
            while k + 1 < len(ends) and i >= ends[k][0]:
                k += 1
            if (gram := body[i : i + n]) != T.PAD * n:
                seen.setdefault(gram, []).append(ends[k][1])
    for w, t in parts:
        for x in _WORD.findall(t):
            if len(x) >= sizes[0]:
                seen.setdefault(x, []).append(w)
    return {t: fold_weights(ws[:1] if continued else ws) for t, ws in seen.items()}


_WORD = re.compile("[^" + re.escape(T.DELIMITERS) + "]+")
#: By code point; all above are none.
_IS_DELIMITER = np.zeros(max(map(ord, T.DELIMITERS)) + 2, bool)
_IS_DELIMITER[[ord(c) for c in T.DELIMITERS]] = True


@dataclass
class Counted:
    """Terms of some documents: the distinct terms, and an entry (document, number of the term, tf) for each document and term of it."""

    names: list[str]
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def count_terms(docs: list[list[tuple[float, str]]], continued: list[bool], sizes: tuple[int, ...], pad: int) -> Counted:
    """term_counts() of many documents at once: all their grams are numbers in one array, counted together with the document's place.

    Of a document with fields of several weights, or with a NUL, the terms are counted one by one.
    """
    bodies, slow = [], {}
    first, step = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
    for at, (parts, more) in enumerate(zip(docs, continued)):
        body = ("" if more else T.PAD * pad) + T.FIELD_MARK.join([t for _, t in parts])
        weights = {w for w, _ in parts}
        if len(weights) > 1 or "\0" in body or max(sizes) > 3:  # no room for more in a number; and a NUL would end a numpy string
            slow[at] = _weighed_counts(parts, body, sizes, pad, more)
            body, parts = "", []
        first[at], step[at] = _STEPS[next(iter(weights), 1.25)]
        if more:
            step[at] = 0
        bodies.append(body)
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    text = "".join(bodies)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = points.astype(np.uint64)
    doc = np.repeat(np.arange(len(docs)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
    # words: runs without a delimiter, with one more place before each document, where its words end; padding belongs to no word
    apart = np.ones(len(points) + len(docs) + 1, bool)
    apart[np.arange(len(points)) + doc + 1] = _IS_DELIMITER[np.minimum(points, len(_IS_DELIMITER) - 1)]
    starts = np.cumsum(lengths) - lengths
    padded = np.flatnonzero(~np.array(continued, bool) & (lengths > 0))
    for k in range(pad):
        apart[starts[padded] + padded + 1 + k] = True
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    begins, size = edges[::2], edges[1::2] - edges[::2]
    long = size >= sizes[0]
    begins, size = begins[long], size[long]
    of_word_doc = np.searchsorted(starts + np.arange(len(docs)), begins, "left") - 1
    begins = begins - of_word_doc - 1
    flat = [text[a : a + n] for a, n in zip(begins.tolist(), size.tolist())]
    names: list[str] = []
    of_doc, of_term = [], []
    for n in (n for n in sizes if n <= 3):
        at = np.flatnonzero(left >= n)
        codes = chars[at]
        for k in range(1, n):
            codes = codes << np.uint64(21) | chars[at + k]
        real = codes != np.uint64(sum(ord(T.PAD) << 21 * k for k in range(n)))
        found = pa.array(codes[real]).dictionary_encode()
        values = found.dictionary.to_numpy(zero_copy_only=False)
        spelled = np.empty((len(values), n), np.uint32)
        for k in range(n):
            spelled[:, k] = values >> np.uint64(21 * (n - 1 - k)) & np.uint64((1 << 21) - 1)
        of_doc.append(doc[at[real]])
        of_term.append(found.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(names))
        names += spelled.view(f"<U{n}")[:, 0].tolist() if len(values) else []
    numbers = {t: k for k, t in enumerate(names)}
    found = pa.array(flat, pa.string()).dictionary_encode()
    of_word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found.dictionary.to_pylist()), np.int64)
    of_doc.append(of_word_doc)
    of_term.append(of_word[found.indices.to_numpy(zero_copy_only=False)])
    wide = max(len(numbers), 1)
    key = np.concatenate(of_doc) * wide + np.concatenate(of_term)
    key = np.sort(key.astype(np.int32) if wide * len(docs) < 1 << 31 else key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.append(at, len(key)))
    doc, term = np.divmod(key[at].astype(np.int64), wide)
    tf = np.minimum(first[doc] + (times - 1) * step[doc], 256)
    if slow:
        rows = [(at, numbers.setdefault(t, len(numbers)), c) for at, own in slow.items() for t, c in own.items()]
        more = np.array(rows, np.int64).reshape(-1, 3)
        doc, term, tf = (np.concatenate([a, more[:, k]]) for k, a in enumerate((doc, term, tf)))
    return Counted(list(numbers), doc, term, tf)


def term_counts(parts: list[tuple[float, str]], sizes: tuple[int, ...], pad: int, continued: bool = False) -> dict[str, int]:
    """{term: tf} of one document. Grams run over all fields' texts; each has the weight of the field in which it begins.

    A word as long as a gram is the same term and counts with it. In the continuation of a passage each term counts once.
    """
    own = count_terms([parts], [continued], sizes, pad)
    return {own.names[t]: c for t, c in zip(own.term.tolist(), own.tf.tolist())}


#: Characters, and documents, whose terms are counted at a time.
COUNTED_CHARS, COUNTED_DOCS = 1 << 19, 1 << 14


def counted_batches(batches, sizes: tuple[int, ...], pad: int):
    """(doc_ids, Counted) of Arrow batches (doc_id, segment, parts), no more than about COUNTED_CHARS characters at a time."""
    for batch in batches:
        ids, segments, parts = batch.columns
        listed = parts.flatten()
        weights, texts = listed.field("weight").to_pylist(), [t or "" for t in listed.field("text").to_pylist()]
        ends = np.cumsum(parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        docs, begin, chars, at = [], 0, 0, 0
        continued = [bool(s) for s in segments.to_pylist()]
        for k, end in enumerate(ends):
            own = list(zip(weights[at:end], texts[at:end]))
            docs.append(own)
            chars += sum(len(t) for _, t in own)
            at = end
            if chars >= COUNTED_CHARS or len(docs) >= COUNTED_DOCS or k == len(ends) - 1:
                yield ids.slice(begin, len(docs)), count_terms(docs, continued[begin : k + 1], sizes, pad)
                docs, begin, chars = [], k + 1, 0


def postings(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(term, doc_id, tf), already summed per document where the document is read; the text itself is never shuffled."""
    sizes, pad = config.gram_sizes, config.start_pad

    def run(batches):
        for ids, own in counted_batches(batches, sizes, pad):
            terms = pa.array(own.names, pa.string()).take(pa.array(own.term))
            yield pa.RecordBatch.from_arrays([terms, ids.take(pa.array(own.doc)), pa.array(own.tf.astype(np.int16))], ["term", "doc_id", "tf"])

    return docs.select("doc_id", "segment", "parts").mapInArrow(run, "term string, doc_id bigint, tf smallint")


def counted_rows(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(term, doc_id, tf, n_terms): the postings, and a row without a term for each document that has any, whose tf is its length. Both come of one count of the text."""
    sizes, pad, names = config.gram_sizes, config.start_pad, ["term", "doc_id", "tf", "n_terms"]

    def run(batches):
        for ids, own in counted_batches(batches, sizes, pad):
            n, dl = np.bincount(own.doc, minlength=len(ids)).astype(np.int32), np.bincount(own.doc, own.tf, len(ids)).astype(np.int64)
            some = np.flatnonzero(n)
            terms = pa.array(own.names, pa.string()).take(pa.array(own.term))
            yield pa.RecordBatch.from_arrays([terms, ids.take(pa.array(own.doc)), pa.array(own.tf.astype(np.int64)), pa.nulls(len(own.doc), pa.int32())], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), ids.take(pa.array(some)), pa.array(dl[some]), pa.array(n[some])], names)

    return docs.select("doc_id", "segment", "parts").mapInArrow(run, "term string, doc_id bigint, tf bigint, n_terms int")


def doc_lengths(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(doc_id, n_terms, dl): how many terms a document has, and the sum of their tf; one row a document with terms, without a shuffle."""
    sizes, pad = config.gram_sizes, config.start_pad

    def run(batches):
        for ids, own in counted_batches(batches, sizes, pad):
            n, dl = np.bincount(own.doc, minlength=len(ids)), np.bincount(own.doc, own.tf, len(ids)).astype(np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(n[some]), pa.array(dl[some])], ["doc_id", "n_terms", "dl"])

    return docs.select("doc_id", "segment", "parts").mapInArrow(run, "doc_id bigint, n_terms bigint, dl bigint")


def word_table(docs: DataFrame) -> DataFrame:
    """(word, doc_id), each once."""
    return docs.select(F.explode(F.array_distinct(T.words(F.col("lower_text")))).alias("word"), "doc_id")


def one_deleted(word: Column) -> Column:
    """The word with each of its characters left out once."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def delete_table(vocabulary: DataFrame, config: WordMatchConfig) -> DataFrame:
    """(variant, word) of vocabulary(word) for words of the lengths that config names."""
    long = vocabulary.where(F.length("word").between(config.min_delete, config.max_delete))
    return long.select(F.explode(one_deleted(F.col("word"))).alias("variant"), "word")


def variant_table(terms: DataFrame, least: int = 3) -> DataFrame:
    """(variant, term) of terms(term) of at least that many characters: the term itself, and with one character left out."""
    return terms.where(F.length("term") >= least).select(F.explode(F.array_union(F.array("term"), one_deleted(F.col("term")))).alias("variant"), "term")


def prefix_table(docs: DataFrame) -> DataFrame:
    """(prefix, doc_id, position) of the prefixes of one to three characters of each word; position counts words from 0.

    No two rows are equal: the prefixes of one word differ in length.
    """
    placed = docs.select("doc_id", F.posexplode(T.words(F.col("lower_text"))).alias("position", "word"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(3), F.length("word")))
    return placed.select(F.explode(F.transform(sizes, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("prefix"), "doc_id", "position")


def stats_table(lengths: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl, over all documents, those without terms too."""
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(lengths.agg(F.sum("dl").alias("__dl"))).select("n_docs", (F.coalesce("__dl", F.lit(0)) / F.greatest("n_docs", F.lit(1))).alias("avgdl"))


def derive(docs: DataFrame, post: DataFrame, lengths: DataFrame, config: IndexConfig) -> dict[str, DataFrame]:
    """The tables that follow from docs, postings and lengths."""
    stats = stats_table(lengths, docs)
    n, size = F.col("n_docs"), docs.agg(F.count("*").alias("n_docs"))
    # one row, for which no text need be counted
    terms = post.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= config.stop_term_limit).crossJoin(F.broadcast(size)).select("term", "df", idf(n, F.col("df")).alias("idf"))
    listed = word_table(docs)
    by_word = listed.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).select("word", "df", idf(n, F.col("df")).alias("idf"))
    return {
        "terms": terms, "lengths": lengths, "stats": stats, "word_idf": by_word, "words": listed, "variants": variant_table(terms.select("term")),
        "deletes": delete_table(by_word.select("word"), config.words or WordMatchConfig()), "prefixes": prefix_table(docs),
    }


def build_index(docs: DataFrame, fields: list[FieldSpec], key: str = "doc_key", segment: str | None = None, config: IndexConfig | None = None, synonyms: Synonyms | None = None) -> Index:
    """The index of docs. Nothing runs until a table is used; write it once with trawl.sources.store.save and search what is read back."""
    config, synonyms = config or IndexConfig(), synonyms or Synonyms()
    own = prepare(docs, fields, key, segment, synonyms)
    post, lengths = postings(own, config), doc_lengths(own, config)
    texts, own = own.select("doc_id", "segment", "parts"), own.drop("parts")
    return Index({"docs": own, "texts": texts, "postings": post} | derive(own, post, lengths, config), fields, config, synonyms)


def get_document(index: Index, key: int) -> DataFrame:
    """The first segment of the key that is there."""
    return index.docs.where(F.col("doc_key") == key).orderBy("segment").limit(1)


def first_segments(index: Index) -> DataFrame:
    """The first segment of every key."""
    return index.docs.join(index.docs.groupBy(F.col("doc_key").alias("__key")).agg(F.min("doc_id").alias("__first")), F.col("doc_id") == F.col("__first"), "left_semi")


def get_documents(index: Index, key: int, segment: int | None = None) -> DataFrame:
    found = index.docs.where(F.col("doc_key") == key)
    return found if segment is None else found.where(F.col("segment") == segment)


def statistics(index: Index) -> DataFrame:
    """One row: documents and size of the vocabulary."""
    return index.stats.select("n_docs").crossJoin(index.terms.agg(F.count("*").alias("vocabulary")))


def champions(docs: DataFrame, k: int = CHAMPIONS) -> DataFrame:
    """(prefix, doc_id, score, rank): for each first character of a word the k best documents by the one-letter score.

    The score is trawl.operators.short.single_char_score where a word begins with the character; it is summed up from the words here, so a document is
    read once for all characters.
    """
    c = F.col
    alone = F.length("word") == 1
    placed = docs.select("doc_id", "token_count", (F.length("lower_text") == 1).alias("__one"), F.posexplode(T.words(c("lower_text"))).alias("position", "word"))
    per = placed.groupBy("doc_id", F.substring("word", 1, 1).alias("prefix")).agg(
        F.count("*").alias("starts"), F.min("position").alias("at"), F.max(alone.cast("int")).alias("word"), F.max((alone & (c("position") == 0)).cast("int")).alias("first"),
        F.max("__one").alias("one"), F.max("token_count").alias("n"),
    )
    bits = F.lit(128) + F.when(c("at") == 0, 64).otherwise(0) + 32 * c("word") + 16 * c("first") + F.when(c("one"), 8).otherwise(0)
    bits = bits.bitwiseOR(F.when(c("n") <= 3, 32).otherwise(0))
    by_word = F.greatest(F.lit(0), F.least(F.lit(255), 255 - F.least(16 * c("at"), F.lit(240)) + F.least(8 * c("starts"), F.lit(32))))
    return best_champions(per.select("prefix", "doc_id", (bits + by_word / 255.0).alias("score")), k)


def best_champions(scored: DataFrame, k: int = CHAMPIONS) -> DataFrame:
    return scored.select("prefix", "doc_id", "score").withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
