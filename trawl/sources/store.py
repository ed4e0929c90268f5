"""Index tables on shared storage: Parquet in immutable batches, and a small description that says which of them count.

    <path>/meta/<n>.json               the n-th state of the index; the highest n holds
    <path>/docs/batch=<n>              documents added by state n
    <path>/postings, lengths, words, prefixes/batch=<n>   what follows from these documents, row by row
    <path>/terms, vocabulary/batch=<n> by how much state n changes the document counts of terms and words, deletions included
    <path>/deletes, variants/batch=<n> words and terms of state n with a character left out
    <path>/champions/batch=<n>         the best documents of state n for each one-character query
    <path>/gone/batch=<n>              rows (doc_key, doc_id, of_batch) that state n deletes

A state writes only what its own documents and deletions make, so its cost goes with them and not with the index; loading adds the counts up and
leaves out rows that are gone. Documents, average length and the like are sums in the description. compact() makes one batch of all.

A state is written whole before its description is, under another name first, so readers see either all of it or none; a job
that fails or is run again leaves files that no description names. Tables lie sorted by what they are looked up by, so a lookup reads few row groups.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from trawl.operators import index as I
from trawl.operators.index import Index, postings, prepare
from trawl.operators.synonyms import Synonyms
from trawl.plans.config import FieldSpec, IndexConfig, WordMatchConfig
from trawl.sources.shared import remove

FORMAT, VERSION = "trawl-index", 2
#: By what each table is sorted, so that lookups by it skip row groups.
SORTED_BY = {
    "docs": "doc_key", "postings": "term", "lengths": "doc_id", "words": "word", "prefixes": "prefix", "terms": "term", "vocabulary": "word", "deletes": "variant", "variants": "variant", "gone": "doc_id",
}
#: Tables whose rows belong to one document each.
OF_DOCUMENTS = ("docs", "postings", "lengths", "words", "prefixes")
#: A merge is called for once so many documents came or went since the last one, and they are such a share of the index; or after so many
#: batches. By the share the work of all merges together stays in proportion to the documents.
MERGE_AFTER, MERGE_SHARE, MERGE_BATCHES = 1000, 0.1, 64


class IndexFormatError(ValueError):
    pass


class _Files:
    """Small files through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        p = self._p(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._p(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Fails where the file is there already: two writers can't make the same state."""
        hidden = self._p(name.replace("meta/", "meta/."))
        out = self.fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self._p(name)) or not self.fs.rename(hidden, self._p(name)):
            raise FileExistsError(f"{name}: another job has changed the index")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    folder, name = path.rstrip("/").rsplit("/", 1)
    files = _Files(spark, folder)
    out = files.fs.create(files._p(name), True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    folder, name = path.rstrip("/").rsplit("/", 1)
    files = _Files(spark, folder)
    if not files.fs.exists(files._p(name)):
        raise FileNotFoundError(path)
    return files.read(name)


def _states(files: _Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names("meta") if n.endswith(".json") and n[:-5].isdigit())


def index_info(spark: SparkSession, path: str) -> dict:
    """The description of the index at path; IndexFormatError where there is none that this version reads."""
    files = _Files(spark, path)
    states = _states(files)
    if not states:
        raise IndexFormatError(f"no index at {path}")
    try:
        meta = json.loads(files.read(f"meta/{states[-1]}.json"))
    except ValueError as e:
        raise IndexFormatError(f"the description can't be read: {e}") from None
    if meta.get("format") != FORMAT or meta.get("version") != VERSION:
        raise IndexFormatError(f"format {meta.get('format')!r}, version {meta.get('version')!r}")
    return meta


def is_valid_index(spark: SparkSession, path: str) -> bool:
    try:
        index_info(spark, path)
    except IndexFormatError:
        return False
    return True


def _config(d: dict) -> IndexConfig:
    own = d | {"gram_sizes": tuple(d["gram_sizes"]), "words": WordMatchConfig(**d["words"]) if d["words"] else None, "segment": tuple(d["segment"]) if d["segment"] else None}
    return IndexConfig(**own)


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    out = df if by is None else df.repartitionByRange(by).sortWithinPartitions(by)
    out.write.mode("overwrite").parquet(path, compression="zstd")


def _together(*steps) -> None:
    """Run independent writes at once, so that small ones do not wait for each other; the first error is raised when all have ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        for done in [pool.submit(inheritable_thread_target(s)) for s in steps]:
            done.result()


def _parts(spark: SparkSession, path: str, table: str, batches: list[int]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{table}").parquet(*(f"{path}/{table}/batch={b}" for b in batches))


def _gone(spark: SparkSession, path: str, meta: dict) -> DataFrame | None:
    """(doc_id, of_batch) of the documents that are deleted; restored ones have their batch taken off again."""
    if not meta["gone"]:
        return None
    return _parts(spark, path, "gone", meta["gone"]).select(F.col("doc_id").alias("__id"), F.col("of_batch").alias("__b")).distinct()


def _live(spark: SparkSession, path: str, meta: dict, name: str) -> DataFrame:
    """The rows of a table of documents that are not deleted, with their batch."""
    rows = _parts(spark, path, name, meta["batches"])
    gone = _gone(spark, path, meta)
    return rows if gone is None else rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("batch") == F.col("__b")), "left_anti")


def _counts(df: DataFrame, by: str, sign: int) -> DataFrame:
    return df.groupBy(by).agg((F.count("*") * sign).alias("df"))


def _derived(spark: SparkSession, path: str, meta: dict, dead: DataFrame | None) -> None:
    """Write what follows from the documents of this state, and from those that it deletes (docs rows)."""
    n, config = meta["state"], _config(meta["config"])
    terms, vocabulary = [], []
    if meta["batches"] and meta["batches"][-1] == n:
        at = f"batch={n}"
        docs = spark.read.parquet(f"{path}/docs/{at}")
        # texts are counted once; what is sorted is read from there, as sorting by range reads its rows twice
        counted = f"{path}/counted/{at}"

        def of_counts() -> None:
            _write(I.counted_rows(docs, config), counted)
            rows = spark.read.parquet(counted)
            _together(
                lambda: _write(rows.where("term IS NOT NULL").select("term", "doc_id", F.col("tf").cast("smallint").alias("tf")), f"{path}/postings/{at}", "term"),
                lambda: _write(rows.where("term IS NULL").select("doc_id", F.col("n_terms").cast("long").alias("n_terms"), F.col("tf").alias("dl")), f"{path}/lengths/{at}", "doc_id"),
            )
            remove(spark, counted)

        _together(of_counts, lambda: _write(I.word_table(docs), f"{path}/words/{at}", "word"), lambda: _write(I.prefix_table(docs), f"{path}/prefixes/{at}", "prefix"))
        post = spark.read.parquet(f"{path}/postings/{at}")
        terms.append(_counts(post, "term", 1))
        vocabulary.append(_counts(spark.read.parquet(f"{path}/words/{at}"), "word", 1))
        meta["n_docs"] += docs.count()
        meta["total_length"] += spark.read.parquet(f"{path}/lengths/{at}").agg(F.sum("dl")).first()[0] or 0
    if dead is not None:
        # the texts are short of what was stored: they are counted again, which costs what the deleted documents do
        post = postings(dead, config).persist(StorageLevel.DISK_ONLY)
        terms.append(_counts(post, "term", -1))
        vocabulary.append(_counts(I.word_table(dead), "word", -1))
        meta["n_docs"] -= dead.count()
        meta["total_length"] -= post.agg(F.sum(F.col("tf").cast("long"))).first()[0] or 0

    def counts(name: str, by: str, parts: list) -> None:
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        _write(every.groupBy(by).agg(F.sum("df").alias("df")).where("df <> 0"), f"{path}/{name}/batch={n}", by)

    if terms:
        _together(lambda: counts("terms", "term", terms), lambda: counts("vocabulary", "word", vocabulary))
        meta["counted"] = [*meta["counted"], n]
    if meta["batches"] and meta["batches"][-1] == n:
        _spelled(spark, path, n, config, docs)
    if dead is not None:
        post.unpersist()


def _spelled(spark: SparkSession, path: str, n: int, config: IndexConfig, docs: DataFrame) -> None:
    """What is made of the words, terms and prefixes of batch n."""
    at = f"batch={n}"
    words, terms = (spark.read.parquet(f"{path}/{t}/{at}").where("df > 0") for t in ("vocabulary", "terms"))
    _together(
        lambda: _write(I.delete_table(words.select("word"), config.words or WordMatchConfig()), f"{path}/deletes/{at}", "variant"),
        lambda: _write(I.variant_table(terms.select("term")), f"{path}/variants/{at}", "variant"),
        lambda: _write(I.champions(docs), f"{path}/champions/{at}", "prefix"),
    )


def _publish(spark: SparkSession, path: str, meta: dict) -> None:
    _Files(spark, path).write(f"meta/{meta['state']}.json", json.dumps(meta))


def _add(docs: DataFrame, path: str, meta: dict, made: bool = False) -> None:
    """Write docs as the batch of this state; made says that they are rows of a docs table already."""
    own = docs if made else prepare(docs, _fields(meta), meta["key"], meta["segment"], Synonyms.of_pairs(meta["synonyms"]))
    _write(own, f"{path}/docs/batch={meta['state']}", "doc_key")
    meta["batches"] = [*meta["batches"], meta["state"]]


def _fields(meta: dict) -> list[FieldSpec]:
    return [FieldSpec(**f) for f in meta["fields"]]


def save(docs: DataFrame, path: str, fields: list[FieldSpec], key: str = "doc_key", segment: str | None = None, config: IndexConfig | None = None, synonyms: Synonyms | None = None) -> Index:
    """Build the index of docs at path, in place of one that may be there, and load it.

    Rows with a null key, or one that no document number can be made of (see with_ids), raise an error.
    """
    spark, config = docs.sparkSession, config or IndexConfig()
    path = path.rstrip("/")
    state = max(_states(_Files(spark, path)), default=0) + 1
    meta = {
        "format": FORMAT, "version": VERSION, "state": state, "batches": [], "counted": [], "gone": [], "pending": 0, "n_docs": 0, "total_length": 0, "epoch": -1, "fields": [asdict(f) for f in fields], "key": key,
        "segment": segment, "config": asdict(config), "synonyms": (synonyms or Synonyms()).as_pairs(),
    }
    _add(docs, path, meta)
    _derived(spark, path, meta, None)
    _publish(spark, path, meta)
    return load(spark, path)


def load(spark: SparkSession, path: str, check: bool = False) -> Index:
    """The index at path as it now is. With check every table's rows are counted against the description; IndexFormatError where they differ."""
    path, meta = path.rstrip("/"), index_info(spark, path)
    config = _config(meta["config"])
    tables = {name: _live(spark, path, meta, name).drop("batch") for name in OF_DOCUMENTS}
    tables["texts"], tables["docs"] = tables["docs"].select("doc_id", "segment", "parts"), tables["docs"].drop("parts")
    # three numbers of the description
    stats = spark.range(1).select(F.lit(meta["n_docs"]).cast("long").alias("n_docs"), (F.lit(float(meta["total_length"])) / F.lit(float(max(meta["n_docs"], 1)))).alias("avgdl"))

    def counted(name: str, by: str) -> DataFrame:
        rows = _parts(spark, path, name, meta["counted"])
        rows = rows.select(by, "df") if len(meta["counted"]) == 1 else rows.groupBy(by).agg(F.sum("df").alias("df"))
        return rows.where("df > 0").withColumn("idf", I.idf(F.lit(float(meta["n_docs"])), F.col("df")))

    tables |= {"stats": stats, "word_idf": counted("vocabulary", "word"), "terms": counted("terms", "term").where(F.col("df") <= config.stop_term_limit)}
    for name in ("deletes", "variants"):
        rows = _parts(spark, path, name, meta["batches"]).drop("batch")
        tables[name] = rows if len(meta["batches"]) == 1 else rows.distinct()
    if not meta["gone"]:  # with deletions the stored ones may be too few
        best = _parts(spark, path, "champions", meta["batches"]).drop("batch")
        tables["champions"] = best if len(meta["batches"]) == 1 else I.best_champions(best)
    index = Index(tables, _fields(meta), config, Synonyms.of_pairs(meta["synonyms"]))
    if check:
        found = (index.docs.count(), index.lengths.agg(F.sum("dl")).first()[0] or 0)
        if found != (meta["n_docs"], meta["total_length"]):
            raise IndexFormatError(f"documents and total length are {found}, the description says {(meta['n_docs'], meta['total_length'])}")
    return index


def _bury(spark: SparkSession, path: str, meta: dict, keys: DataFrame) -> DataFrame:
    """Mark the live documents of keys(doc_key) as deleted by this state; returns their docs rows."""
    keys = keys.select(F.col("doc_key").cast("long").alias("__key")).where("__key IS NOT NULL").distinct()
    earlier = meta | {"batches": [b for b in meta["batches"] if b != meta["state"]]}
    at = f"{path}/gone/batch={meta['state']}"
    hit = _live(spark, path, earlier, "docs").join(keys, F.col("doc_key") == F.col("__key"), "left_semi")
    _write(hit.select("doc_key", "doc_id", F.col("batch").alias("of_batch")), at, "doc_id")
    marked = spark.read.parquet(at).select(F.col("doc_id").alias("__id"), F.col("of_batch").alias("__b"))
    dead = _parts(spark, path, "docs", earlier["batches"]).join(marked, (F.col("doc_id") == F.col("__id")) & (F.col("batch") == F.col("__b")), "left_semi")
    meta["gone"] = [*meta["gone"], meta["state"]]
    return dead


def change(spark: SparkSession, path: str, added: DataFrame | None = None, deleted: DataFrame | None = None, replace: bool = False, epoch: int | None = None) -> bool:
    """One step: the keys deleted(doc_key) go, then the documents added come; with replace those of an equal key go too.

    A step with an epoch that is not above the last one does nothing, so a stream may deliver a batch twice. Says whether it did anything.
    Only tables of the step itself are written.
    """
    path, meta = path.rstrip("/"), index_info(spark, path)
    if epoch is not None and epoch <= meta["epoch"]:
        return False
    meta["state"] += 1
    keys = [d.select(F.col("doc_key").cast("long").alias("doc_key")) for d in (deleted,) if d is not None]
    if replace and added is not None:
        keys.append(added.select(F.col(meta["key"]).cast("long").alias("doc_key")))
    dead = _bury(spark, path, meta, keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])) if keys else None
    if added is not None:
        _add(added, path, meta)
    if epoch is not None:
        meta["epoch"] = epoch
    meta["pending"] += sum(spark.read.parquet(f"{path}/{t}/batch={meta['state']}").count() for t, on in (("docs", added is not None), ("gone", bool(keys))) if on)
    _derived(spark, path, meta, dead)
    _publish(spark, path, meta)
    return True


def append(docs: DataFrame, path: str, replace: bool = False, epoch: int | None = None) -> bool:
    """Add documents; their keys with segments must be new, or replace."""
    return change(docs.sparkSession, path, docs, replace=replace, epoch=epoch)


def delete_keys(keys: DataFrame, path: str) -> bool:
    """Documents of keys(doc_key), all their segments, are no longer found."""
    return change(keys.sparkSession, path, deleted=keys)


def deleted_documents(spark: SparkSession, path: str) -> DataFrame:
    """The docs rows, without parts, that are deleted and not yet compacted away, with the batch that they were of."""
    path, meta = path.rstrip("/"), index_info(spark, path)
    rows, gone = _parts(spark, path, "docs", meta["batches"]), _gone(spark, path, meta)
    found = rows.where("false") if gone is None else rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("batch") == F.col("__b")), "left_semi")
    return found.drop("parts")


def all_segments(spark: SparkSession, path: str, key: int) -> DataFrame:
    """The docs rows of a key, those deleted and not yet compacted away too, as column deleted says."""
    live = load(spark, path).docs.where(F.col("doc_key") == key).withColumn("deleted", F.lit(False))
    return live.unionByName(deleted_documents(spark, path).drop("batch").where(F.col("doc_key") == key).withColumn("deleted", F.lit(True)))


def restore(keys: DataFrame, path: str) -> bool:
    """Bring deleted documents of keys(doc_key) back, as they last were, unless the key and segment is there; what compact() has removed can't come back."""
    spark = keys.sparkSession
    path, meta = path.rstrip("/"), index_info(spark, path)
    wanted = keys.select(F.col("doc_key").cast("long").alias("__key")).where("__key IS NOT NULL").distinct()
    gone = _gone(spark, path, meta)
    if gone is None:
        return False
    dead = _parts(spark, path, "docs", meta["batches"]).join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("batch") == F.col("__b")), "left_semi").join(wanted, F.col("doc_key") == F.col("__key"), "left_semi")
    last = dead.groupBy(F.col("doc_id").alias("__doc")).agg(F.max("batch").alias("__last"))
    live = _live(spark, path, meta, "docs").select(F.col("doc_id").alias("__there"))
    back = dead.join(last, (F.col("doc_id") == F.col("__doc")) & (F.col("batch") == F.col("__last")), "left_semi").join(live, F.col("doc_id") == F.col("__there"), "left_anti").drop("batch")
    meta["state"] += 1
    _add(back, path, meta, made=True)
    meta["pending"] += spark.read.parquet(f"{path}/docs/batch={meta['state']}").count()
    _derived(spark, path, meta, None)
    _publish(spark, path, meta)
    return True


def should_merge(spark: SparkSession, path: str, after: int = MERGE_AFTER, share: float = MERGE_SHARE, batches: int = MERGE_BATCHES) -> bool:
    """Whether so many documents came or went since the last merge that they are that share of the index, or there are so many batches."""
    meta = index_info(spark, path)
    return meta["pending"] >= max(after, share * meta["n_docs"]) or len(meta["batches"]) + len(meta["gone"]) >= batches


def compact(spark: SparkSession, path: str) -> None:
    """All live documents into one batch, with one batch of each table; what is deleted goes for good."""
    path, meta = path.rstrip("/"), index_info(spark, path)
    tables = {t: _live(spark, path, meta, t).drop("batch") for t in OF_DOCUMENTS}
    meta["state"] += 1
    at, config = f"batch={meta['state']}", _config(meta["config"])
    _together(*(lambda name=name, rows=rows: _write(rows, f"{path}/{name}/{at}", SORTED_BY[name]) for name, rows in tables.items()))
    read = lambda t: spark.read.parquet(f"{path}/{t}/{at}")
    _together(*(lambda name=name, of=of, by=by: _write(_counts(read(of), by, 1), f"{path}/{name}/{at}", by) for name, of, by in (("terms", "postings", "term"), ("vocabulary", "words", "word"))))
    _spelled(spark, path, meta["state"], config, read("docs"))
    meta |= {"batches": [meta["state"]], "counted": [meta["state"]], "gone": [], "pending": 0}
    _publish(spark, path, meta)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove batches and descriptions that the last state does not use; no reader may use an earlier one."""
    path, meta, files = path.rstrip("/"), index_info(spark, path), _Files(spark, path)
    used = dict.fromkeys((*OF_DOCUMENTS, "deletes", "variants", "champions"), meta["batches"]) | dict.fromkeys(("terms", "vocabulary"), meta["counted"]) | {"gone": meta["gone"]}
    old = [f"{t}/{n}" for t, own in used.items() for n in files.names(t) if n.startswith("batch=") and int(n[6:]) not in own]
    old += [f"meta/{n}.json" for n in _states(files)[:-1]]
    for name in old:
        files.fs.delete(files._p(name), True)
    return old


def read_documents(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Documents of CSV with a header, JSON by line or whole, Parquet, ORC or text; the format follows from the name where it is not given."""
    format = format or next((f for f in ("csv", "json", "parquet", "orc") if path.rstrip("/*").endswith(f) or f".{f}" in path), "text")
    given = {"csv": {"header": True, "multiLine": True, "escape": '"', "inferSchema": True}}.get(format, {})
    return spark.read.format(format).options(**given | options).load(path)
