"""Substring dedup by difference-cover anchors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import WordHasher, cut, mix, slices, table

#: Every passage of so many words that occurs twice is found.
MIN_WORDS = 50
#: A perfect difference set: each nonzero residue mod PERIOD is the difference of exactly one pair, so of any two places one same
#: step of less than PERIOD leads both to a cover position.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Hashes that one task holds.
BUCKET_HASHES = 1 << 22
#: Hashes that are sorted out at once before the shuffle.
CHUNK_HASHES = 1 << 20


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words, by sums of words times powers; len(words) - n + 1 of them."""
    up, down = _powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def _powers(n: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if held.get("n", -1) < n:
        base = 0xD6E8FEB86659FD93
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(2 * n + 1, b, np.uint64)
            p[0] = 1
            held[name] = np.multiply.accumulate(p)
        held["n"] = 2 * n
    return held["up"][:n], held["down"][:n]


def _texts(batch, hasher: WordHasher, min_words: int, text_at: int = 1):
    """(row, word hashes) of each text of at least min_words words."""
    for at, end, data, off in slices(batch.column(text_at)):
        words, _, first = hasher(data, off)
        for i in range(end - at):
            if first[i + 1] - first[i] >= min_words:
                yield at + i, words[first[i] : first[i + 1]]


class _Chunk:
    """Hashes of the windows of many documents, sorted out before they are shuffled.

    What occurs twice in the chunk is repeated, so its places are known, and one token is sent for it: a hash in all documents puts a row per chunk into its
    bucket, not one per document. What occurs once is sent with its place.
    """

    def __init__(self, buckets: int):
        self.buckets, self.ids, self.hashes, self.places, self.n = buckets, [], [], [], 0

    def add(self, ident: int, hashes: np.ndarray, places: np.ndarray) -> bool:
        """Says whether the chunk is full."""
        if len(hashes):
            self.ids.append((ident, len(hashes)))
            self.hashes.append(hashes)
            self.places.append(places.astype(np.int32))
            self.n += len(hashes)
        return self.n >= CHUNK_HASHES

    def rows(self) -> pa.RecordBatch:
        """(bucket, id, hashes, places): places without hashes are known to be repeated, hashes without places are tokens."""
        cols: list[list] = [[], [], [], []]
        if self.n:
            hashes, places = np.concatenate(self.hashes), np.concatenate(self.places)
            ids, counts = np.array([i for i, _ in self.ids], np.int64), np.array([c for _, c in self.ids])
            doc = np.repeat(np.arange(len(ids)), counts)
            order = np.argsort(hashes, kind="stable")
            own = hashes[order]
            same = own[1:] == own[:-1]
            twice = np.zeros(len(own), bool)
            twice[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            tokens = own[np.concatenate([[False], same]) & ~np.concatenate([[False, False], same[:-1]])[: len(own)]]
            self._put(cols, doc[~twice], ids, hashes[~twice], places[~twice])
            self._put(cols, np.zeros(len(tokens), np.int64), np.zeros(1, np.int64), tokens, None)
            known, at = doc[twice], places[twice]
            cuts = np.flatnonzero(np.diff(known, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(known)]):
                ident = int(ids[known[a]])
                self._row(cols, ident * 0x9E3779B1 % self.buckets, ident, b"", at[a:b].tobytes())
        self.ids, self.hashes, self.places, self.n = [], [], [], 0
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["bucket", "id", "hashes", "places"])

    def _put(self, cols, doc, ids, hashes, places) -> None:
        bucket = ((hashes >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        bucket, doc, hashes = bucket[order], doc[order], hashes[order]
        places = None if places is None else places[order]
        cuts = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            self._row(cols, int(bucket[a]), int(ids[doc[a]]), hashes[a:b].tobytes(), b"" if places is None else places[a:b].tobytes())

    @staticmethod
    def _row(cols, *values) -> None:
        for col, x in zip(cols, values):
            col.append(x)


_SPREAD = "bucket int, id bigint, hashes binary, places binary"


def _repeated(spread: DataFrame, buckets: int) -> DataFrame:
    """(id, places): of each row of documents the places whose hash occurs twice or more in all."""

    def raw(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
        _, off, data = col.buffers()
        off = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1]
        return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if data is not None else np.zeros(0, kind), np.diff(off) // np.dtype(kind).itemsize

    def run(batches):
        parts = []
        for b in batches:
            n_hashes = pc.binary_length(b.column(2))
            known = b.filter(pc.equal(n_hashes, 0))
            if known.num_rows:
                yield known.select(["id", "places"])
            rest = b.filter(pc.greater(n_hashes, 0))
            if rest.num_rows:
                parts.append(rest)
        if not parts:
            return
        ids = np.concatenate([b.column(1).to_numpy() for b in parts])
        hashes, counts = (np.concatenate(x) for x in zip(*(raw(b.column(2), np.uint64) for b in parts)))
        places, n_places = (np.concatenate(x) for x in zip(*(raw(b.column(3), np.int32) for b in parts)))
        order = np.argsort(hashes, kind="stable")
        own = hashes[order]
        same = own[1:] == own[:-1]
        again = np.zeros(len(own), bool)
        again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        placed = np.repeat(n_places > 0, counts)
        # a token stands for several places
        token = np.unique(hashes[~placed])
        if len(token):
            again |= token[np.minimum(np.searchsorted(token, hashes), len(token) - 1)] == hashes
        again = again[placed]
        ids, counts = ids[n_places > 0], counts[n_places > 0]
        ends = np.cumsum(counts)
        kept = np.concatenate([[0], np.cumsum(again)])
        per = kept[ends] - kept[ends - counts]
        places, rows = places[again], np.flatnonzero(per)
        at = np.concatenate([[0], np.cumsum(per[rows])])
        for lo in range(0, len(rows), 10_000):
            hi = min(lo + 10_000, len(rows))
            out = [places[at[k] : at[k + 1]].tobytes() for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[lo:hi]]), pa.array(out, pa.binary())], ["id", "places"])

    return spread.repartitionById(buckets, "bucket").mapInArrow(run, "id bigint, places binary")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start_word, end_word): the parts of documents that occur elsewhere too, as maximal runs of words, end exclusive.

    A word is in such a part if a passage of min_words words around it occurs at two or more places, in other documents or in the same
    one; passages may overlap. Words are runs of a-z, 0-9 and characters beyond ASCII, in lower case, so case, punctuation and white
    space make no difference. Null texts and texts of fewer than min_words words have none; rows with a null key are left out; the key
    must be a whole number. Repeated rows are places of their own, and rows that share a key are reported together. An empty table gives
    no spans; other columns are ignored.

    Two equal passages are at some places i and j; the cover has a step of less than PERIOD by which both are cover positions. So both
    have there an anchor, the hash of min_words - PERIOD + 1 words, and the two are equal. Only one position in five is anchored; anchors
    that occur once are dropped; around the others the passages that contain them are hashed whole, and again only what occurs twice
    stays. Both steps count hashes by range and never pair documents up. What a chunk of documents holds twice is settled there, and only a token of it is
    sent on, so a bucket gets a row per chunk, not per document, of a passage that all documents share.
    """
    width = min_words - PERIOD + 1
    if width < 1:
        raise ValueError(f"min_words must be at least {PERIOD}")
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # five characters a word at least, but for the shortest: a bound for memory alone
    buckets = max(8, math.ceil(size / 5 * len(COVER) / PERIOD / BUCKET_HASHES))
    cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches):
        hasher, chunk = WordHasher(), _Chunk(buckets)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, words in _texts(batch, hasher, min_words):
                hashes = _windows(words, width)
                at = np.flatnonzero(cover[np.arange(len(hashes)) % PERIOD])
                if chunk.add(int(ids[i]), hashes[at], at):
                    yield chunk.rows()
        yield chunk.rows()

    anchored = _repeated(docs.mapInArrow(anchors, _SPREAD), buckets)
    of_doc = cut(anchored.groupBy(F.col("id").alias("__id")).agg(F.collect_list("places").alias("places")), "substring-anchors")

    def passages(batches):
        hasher, chunk = WordHasher(), _Chunk(buckets)
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), batch.column(2)
            for i, words in _texts(batch, hasher, min_words):
                hashes = _windows(words, min_words)
                at = np.concatenate([np.frombuffer(x, np.int32) for x in found[i].as_py()])
                edge = np.zeros(len(hashes) + PERIOD + 1, np.int64)
                # an anchor at p lies in the passages that begin from p - (PERIOD - 1) to p
                np.add.at(edge, np.maximum(at[at < len(hashes) + PERIOD] - (PERIOD - 1), 0), 1)
                np.add.at(edge, at[at < len(hashes) + PERIOD] + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[: len(hashes)] > 0)
                if chunk.add(int(ids[i]), hashes[starts], starts):
                    yield chunk.rows()
        yield chunk.rows()

    near = docs.join(of_doc, F.col("id") == F.col("__id")).select("id", "text", "places")
    whole = _repeated(near.mapInArrow(passages, _SPREAD), buckets).groupBy("id").agg(F.collect_list("places").alias("places"))

    def spans(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in found])).astype(np.int64)
                new = np.concatenate([[True], np.diff(at) > min_words])
                ends = at[np.concatenate([new[1:], [True]])] + min_words
                for a, b in zip(at[new].tolist(), ends.tolist()):
                    for col, x in zip(out, (i, a, b)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [key, "start_word", "end_word"])

    return whole.mapInArrow(spans, f"`{key}` bigint, start_word bigint, end_word bigint")


def query(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + {MIN_WORDS}], ' ')) AS h FROM (SELECT *, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS i FROM w WHERE len(w) >= {MIN_WORDS})),
r AS (SELECT DISTINCT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span
      FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {MIN_WORDS} THEN 0 ELSE 1 END AS new FROM r))
SELECT doc_id, min(i) AS start_word, max(i) + {MIN_WORDS} AS end_word FROM s GROUP BY doc_id, span
"""
