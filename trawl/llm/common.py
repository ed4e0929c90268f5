"""What the operators of this subpackage share."""

from __future__ import annotations

import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one round of array work holds; its arrays take about 40 times as much.
SLICE_BYTES = 400_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local master gets one of its own, as in tests; a cluster gets an error,
    since a machine-local folder would be another one on each executor."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trawl-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("trawl_llm_made", default=None)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor then costs no recomputation.

    The reader checks the schema only, so a table that holds no rows comes back with its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def final(spark: SparkSession, work: Callable[[], DataFrame], name: str) -> DataFrame:
    """What work() makes, written; the tables that were cut on the way to it are removed again."""
    made: list[str] = []
    token = _made.set(made)
    try:
        got = work()
    except BaseException:
        _made.reset(token)
        _remove(spark, made)
        raise
    _made.reset(token)
    out = cut(got, name)
    _remove(spark, made)
    return out


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Give memory that is free back to the system: Arrow's pool and the C library keep what a task has used, and idle Python workers stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with what is free released before it begins and after it ends."""

    def tidied(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def n_words(text: Column | str) -> Column:
    """Maximal runs of characters that are not white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def unit(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and keys; nulls count as the empty string."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word is a maximal run of a-z, 0-9 and any character beyond ASCII, after lower casing.
    """

    def __init__(self) -> None:
        self.up, self.down = _powers(1 << 16)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data: UTF-8 bytes of all texts; offsets: where each begins, and the end.

        Returns the words' hashes, the first bytes of the words, and for each text (and the end) its first word's place.
        """
        n = len(data)
        if n >= len(self.up):
            self.up, self.down = _powers(2 * n)
        is_word = np.zeros(n + 1, np.int8)
        is_word[:n] = _WORD[data]
        # a word ends where its text does, though the next begins with a word character
        edge = np.flatnonzero(np.diff(is_word, prepend=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        inner = offsets[1:-1]
        inside = inner[(inner > 0) & (inner < n)]
        inside = inside[(is_word[inside] == 1) & (is_word[inside - 1] == 1)]
        if len(inside):
            inside = np.unique(inside)
            starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts])
        return hashes, starts, np.searchsorted(starts, offsets)


def slices(texts: pa.Array, lower: bool = True):
    """(first, last, bytes, offsets) for runs of texts of about SLICE_BYTES, before lower-casing, which holds one run at a time; a null text counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = raw_parts(texts)[1]
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        run = texts.slice(at, end - at)
        data, own = raw_parts(pc.utf8_lower(run) if lower else run)
        yield at, end, data[own[0] : own[-1]], own - own[0]
        at = end


def raw_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of bytes of large strings, and their offsets in it."""
    _, offsets, raw = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one text's words; a text of fewer words is one gram, one of none has none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)
