"""Exact Jaccard join of documents over their word n-grams, and classes of near copies.

Documents are sets of hashed word n-grams in the metric space of the Jaccard distance d = 1 - J. Two sets join if d <= eps = 1 - threshold.
A set goes by the 64-bit hash of all its n-grams (sid), so equal sets are one set, whatever their keys, and one key may have several.

1. Pivots. Each set has SKETCHES sketches of SKETCH_HASHES min-hashes. Of the sets that share a sketch the one with the most copies is
   proposed as pivot to the others. Any choice would be exact; this one finds the middle of a group of copies.
2. Voronoi regions. A set belongs to the region of the pivot proposed to it if its true distance is at most eps / 2, else it is a pivot by itself
   (lone). By the triangle inequality any two sets of a region join, so they are counted, not compared.
3. Candidates. Two joined sets share keys among the first (1 - t) * size + 1 of both, in any common order of keys; here frequent
   n-grams come last. First keys are spread over buckets by range of keys, and sets of different regions that share enough of them are candidates: the
   one of the later region is a boundary document, replicated to the other's region. Lone candidates meet in the region of the
   lowest of them that each is a candidate with. Distances alone can't find them: most documents are at distance 1 from any pivot.
4. Windows. In a region each boundary set has its distance to the pivot measured: members x with d(x, p) + d(y, p) <= eps join it, those with
   |d(x, p) - d(y, p)| > eps don't, and only those between are compared. Where many are between, the members farther from the pivot get a
   pivot of their own among them, and both parts go on recursively.
5. Cells. Large regions are cut into cells of bounded size, each side by hash, so that no task holds a whole group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import WordHasher, cut, final, grams, mix, slices, table, tidy

GRAM, THRESHOLD = 3, 0.55
#: A chunk of so many keys that holds one n-gram in so many documents makes it a frequent one. At most HOT_KEYS are kept, the
#: most frequent; which they are has no bearing on the result.
CHUNK_KEYS, CHUNK_TIMES, HOT_KEYS = 2_000_000, 3, 1_000_000
#: Sketches of a set, and min-hashes of each.
SKETCHES, SKETCH_HASHES = 4, 3
#: Sets measured against one pivot in one task.
MEASURED = 200_000
#: Keys in common in one bucket that make a pair a candidate without a look at the other buckets.
STRONG = 4
#: First keys that one task holds.
BUCKET_KEYS = 1 << 22
#: Pairs that share one key, held at a time.
BLOCK_PAIRS = 1 << 19
#: Bytes of sets after which they are sent on.
SENT_BYTES = 1 << 23
#: Bytes that a row takes besides its keys until it is sent.
ROW_BYTES = 160
#: Sets and keys of one side of a cell, about: the larger, the less often a set is sent. Sets of one side that are compared at once.
CELL_SETS, CELL_KEYS, BLOCK_SETS = 4096, 1 << 21, 512
#: Undecided pairs that are compared at once, without another pivot.
AT_ONCE = 1 << 16
#: Sets of this many rows or fewer are looked up by a broadcast (some 50 bytes each), beyond it by a shuffled join.
BROADCAST_DOCS = 1_000_000
#: What distances may be off by.
TINY = 1e-9

_SALTS = mix(np.arange(1, SKETCHES * SKETCH_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _ceil(x):
    return np.ceil(x - TINY).astype(np.int64)


def first_keys(size, t: float):
    """How many first keys of a set of that size are compared."""
    return size - _ceil(t * size) + 1


def _least_shared(a, b, t: float):
    """How many of the first keys two joined sets of sizes a and b share at least.

    They have ceil(t / (1 + t) * (a + b)) keys in common; of these, no more than ceil(t * size) - 1 lie beyond the first keys of
    the set whose first keys end first.
    """
    return _ceil(t / (1 + t) * (a + b)) - np.maximum(_ceil(t * a), _ceil(t * b)) + 1


def _sets(batch, hasher: WordHasher, n: int, text_at: int = 1):
    """(row, sorted distinct n-gram hashes) of each text that has words."""
    for at, end, data, off in slices(batch.column(text_at)):
        words, _, first = hasher(data, off)
        for i in range(end - at):
            if first[i + 1] > first[i]:
                yield at + i, np.unique(grams(words[first[i] : first[i + 1]], n))


def _sid(keys: np.ndarray) -> int:
    total = (keys * np.uint64(0xD1342543DE82EF95) ^ (keys >> np.uint64(29))).sum(dtype=np.uint64)
    return int(mix(np.array([int(total) + len(keys) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


def _sketches(keys: np.ndarray) -> np.ndarray:
    low = np.full(len(_SALTS), ~np.uint64(0))
    for at in range(0, len(keys), 1 << 16):
        np.minimum(low, (keys[None, at : at + (1 << 16)] * _SALTS[:, None]).min(1), out=low)
    out = np.zeros(SKETCHES, np.uint64)
    for k in range(SKETCH_HASHES):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + low[k::SKETCH_HASHES])
    return out.view(np.int64)


def _frequent(keys: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that come at least so many times, and how often; keys are sorted in place, besides them it takes a byte a key."""
    keys.sort()
    hot = np.unique(keys[: len(keys) - times + 1][keys[: len(keys) - times + 1] == keys[times - 1 :]]) if len(keys) >= times else keys[:0]
    return hot, np.searchsorted(keys, hot, "right") - np.searchsorted(keys, hot)


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: id, sid, size and sketches of each document with words; kind 1: n-grams frequent in a chunk (as id), and how often (as size)."""

    def run(batches):
        hasher, held, n_held = WordHasher(), np.empty(CHUNK_KEYS, np.uint64), 0

        def frequent():
            hot, times = _frequent(held[:n_held], CHUNK_TIMES)
            return out(1, hot.view(np.int64), np.zeros(len(hot), np.int64), times, [None] * len(hot))

        def out(kind, a, b, c, d):
            cols = [pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(c), pa.array(d, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["kind", "id", "sid", "size", "sketches"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows, sids, sizes, sketches = [], [], [], []
            for i, keys in _sets(batch, hasher, n):
                rows.append(i)
                sids.append(_sid(keys))
                sizes.append(len(keys))
                sketches.append(_sketches(keys))
                if n_held + len(keys) > len(held):  # the set that ends a chunk belongs to it
                    held = np.concatenate([held[:n_held], keys])
                else:
                    held[n_held : n_held + len(keys)] = keys
                n_held += len(keys)
                if n_held >= CHUNK_KEYS:
                    yield frequent()
                    held, n_held = held if len(held) == CHUNK_KEYS else np.empty(CHUNK_KEYS, np.uint64), 0
            if rows:
                yield out(0, ids[rows].astype(np.int64), np.array(sids, np.int64), np.array(sizes, np.int64), sketches)
        if n_held:
            yield frequent()

    return docs.mapInArrow(tidy(run), "kind tinyint, id bigint, sid bigint, size bigint, sketches array<bigint>")


def _small(df: DataFrame, spread_over: int = BROADCAST_DOCS) -> DataFrame:
    """df, to be broadcast if it has been counted and is small."""
    return F.broadcast(df) if df.count() <= spread_over else df


def _proposals(reps: DataFrame) -> DataFrame:
    """(sid, pivot): to each set that shares a sketch with one of more copies (or of equally many and a higher sid) the best such set."""
    one = reps.select("sid", F.struct("n", "sid").alias("rank"), F.posexplode("sketches").alias("k", "sketch"))
    best = one.groupBy("k", "sketch").agg(F.max("rank").alias("best"), F.count("*").alias("c")).where("c > 1").select("k", "sketch", "best")
    to = cut(one.join(best, ["k", "sketch"]).where("best.sid <> sid").groupBy("sid").agg(F.max("best")["sid"].alias("pivot")), "jaccard-proposed")
    for _ in range(2):  # ranks rise from step to step
        on = to.select(F.col("sid").alias("pivot"), F.col("pivot").alias("next"))
        to = to.join(on, "pivot", "left").select("sid", F.coalesce("next", "pivot").alias("pivot"))
    return cut(to.join(to.select(F.col("sid").alias("pivot")), "pivot", "left_anti").select("sid", "pivot"), "jaccard-pivots")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, tags, keys) of wanted(id, sid, tags): the n-grams of the text of that id that has that sid, a row for each row that has it."""
    found = docs.join(_small(wanted.select(F.col("id").alias("__id"), "sid", "tags")), F.col("id") == F.col("__id")).select("id", "text", "sid", "tags")

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            sids, rows, out, held = batch.column(2).to_numpy(), [], [], 0
            for i, keys in _sets(batch, hasher, n):
                if _sid(keys) == sids[i]:
                    rows.append(i)
                    out.append(keys.tobytes())
                    held += len(out[-1])
                    if held > SENT_BYTES:
                        yield sent(batch, rows, out)
                        rows, out, held = [], [], 0
            yield sent(batch, rows, out)

    def sent(batch, rows, out):
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at), pa.array(out, pa.binary())], ["sid", "tags", "keys"])

    tags = wanted.schema["tags"].dataType.simpleString()
    return found.mapInArrow(tidy(run), f"sid bigint, tags {tags}, keys binary")


def _homes(docs: DataFrame, reps: DataFrame, n: int, t: float) -> DataFrame:
    """(sid, home) of the sets within eps / 2 of the pivot proposed to them, and of these pivots."""
    to = _proposals(reps)
    salts = to.groupBy("pivot").agg((F.floor(F.count("*") / MEASURED) + 1).cast("int").alias("salts"))
    mine = to.join(salts, "pivot").select("sid", F.struct("pivot", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role")).alias("tag"))
    theirs = salts.select(F.col("pivot").alias("sid"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    every = mine.unionByName(theirs.select("sid", F.struct("pivot", "salt", F.lit(0).alias("role")).alias("tag")))
    wanted = cut(every.groupBy("sid").agg(F.collect_list("tag").alias("tags")).join(reps.select("sid", "id"), "sid").select("id", "sid", "tags"), "jaccard-measured")
    rows = _sets_of(docs, wanted, n).select("sid", F.explode("tags").alias("t"), "keys").select("t.pivot", "t.salt", "t.role", "sid", "keys")
    rows = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")

    def run(batches):
        now, middle = None, np.zeros(0, np.uint64)
        for batch in batches:
            keys, ends = _binary(batch.column(4)), np.cumsum(_lengths(batch.column(4)) // 8)
            out = []
            for k, (p, role, sid) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)))):
                own = keys[(ends[k - 1] if k else 0) : ends[k]]
                if role == 0:
                    now, middle = p, own.copy()
                elif p == now and float(_distances(middle, [own])[0]) <= (1 - t) / 2 - TINY:
                    out.append((sid, p))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["sid", "home"])

    near = cut(rows.mapInArrow(tidy(run), "sid bigint, home bigint").distinct(), "jaccard-near")
    return near.unionByName(near.select(F.col("home").alias("sid"), "home").distinct())


def _spread(docs: DataFrame, hot, n: int, t: float, buckets: int) -> DataFrame:
    """The first keys of each document, a row for each bucket that has any; in a bucket four bytes tell keys apart well enough."""
    share = 1 - t

    def run(batches):
        hasher, known, seen = WordHasher(), hot.value, set()
        top = np.uint64(1) << np.uint64(63)
        for batch in batches:
            cols, held = ([], [], [], []), 0
            for _, grams_ in _sets(batch, hasher, n):
                sid = _sid(grams_)
                if sid in seen:  # a set of this task that has been sent
                    continue
                if len(seen) < 1 << 20:
                    seen.add(sid)
                keys = grams_ >> np.uint64(1)
                if len(known):
                    keys[known[np.minimum(np.searchsorted(known, grams_), len(known) - 1)] == grams_] |= top
                keys.sort()
                own = keys[: int(first_keys(np.int64(len(keys)), t))]
                # first keys fill the lowest part of the range, as far as their share; nine tenths of the buckets are for it
                u = (own & ~top).astype(np.float64) / 2.0**63
                place = np.where(u < share, 0.9 * u / share, 0.9 + 0.1 * (u - share) / (1 - share + 1e-300))
                bucket = np.minimum((place * buckets).astype(np.int64), buckets - 1)
                order = np.argsort(bucket, kind="stable")
                bucket, short = bucket[order], mix(own[order]).astype(np.uint32)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(own)]):
                    for col, x in zip(cols, (bucket[a], sid, len(keys), short[a:b].tobytes())):
                        col.append(x)
                held += 4 * len(own) + ROW_BYTES * len(cuts)
                if held > SENT_BYTES:
                    yield sent(cols)
                    cols, held = ([], [], [], []), 0
            yield sent(cols)

    def sent(cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:3]), pa.array(cols[3], pa.binary())], ["bucket", "sid", "size", "keys"])

    return docs.mapInArrow(tidy(run), "bucket int, sid bigint, size bigint, keys binary")


def _count_pairs(codes: np.ndarray, group: np.ndarray, n: int):
    """(i, j, how many keys they have in common) of all i < j of n owners of different groups with a key in common; group ascends with the owner.

    codes are the keys in the upper, their owners in the lower 32 bits; they are sorted in place. Pairs
    come in blocks of ascending i, each with all its pairs, so memory is that of a block however many pairs there are in all.
    """
    codes.sort()
    keys = (codes >> np.uint64(32)).astype(np.uint32)
    same = keys[1:] == keys[:-1]
    # keys of one owner alone make no pairs
    again = np.zeros(len(codes), bool)
    again[1:] |= same
    again[:-1] |= same
    keys, owner = keys[again], codes[again].astype(np.uint32).astype(np.int64)
    del same, again
    if not len(keys):
        return
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    cuts = np.flatnonzero(new_key)
    ends = np.concatenate([cuts[1:], [len(keys)]]).astype(np.int64)
    own_group = group[owner]
    parts = np.flatnonzero(new_key | np.concatenate([[True], own_group[1:] != own_group[:-1]]))
    part_ends = np.concatenate([parts[1:], [len(keys)]]).astype(np.int64)
    # where the owners of its key that come after its group begin, and how many they are
    begin = np.repeat(part_ends, part_ends - parts)
    later = np.repeat(ends, ends - cuts) - begin
    del keys, cuts, ends, own_group, parts, part_ends, new_key
    places = np.flatnonzero(later)
    places = places[np.argsort(owner[places], kind="stable")]
    work, of = np.cumsum(later[places]), owner[places]
    at = 0
    while at < len(places):
        done = work[at - 1] if at else 0
        end = max(int(np.searchsorted(work, done + BLOCK_PAIRS, "right")), at + 1)
        # an owner's pairs stay together
        end = int(np.searchsorted(of, of[end - 1], "right"))
        own = places[at:end]
        times = later[own]
        first = np.repeat(np.cumsum(times) - times, times)
        other = np.repeat(begin[own], times) + np.arange(int(times.sum())) - first
        codes, counts = np.unique(np.repeat(of[at:end].astype(np.int64), times) * n + owner[other], return_counts=True)
        yield codes // n, codes % n, counts
        at = end


def _candidates(spread: DataFrame, t: float, buckets: int) -> DataFrame:
    """kind 0: region and a boundary set b of it; kind 1: region of lone sets and a set b of it; kind 2: sets a and b of different regions (a's, or
    none if both are lone) with counts n of keys that they share in a bucket, to be added up and held against least."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        sids, size = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in (1, 2))
        lone = np.concatenate([b.column(4).is_null().to_numpy(zero_copy_only=False) for b in parts])
        home = np.where(lone, sids, np.concatenate([b.column(4).fill_null(0).to_numpy() for b in parts]))
        n_keys = np.concatenate([_lengths(b.column(3)) for b in parts]) // 4
        own = np.unique(sids, return_index=True)[1]
        own = own[np.lexsort((sids[own], home[own], lone[own]))]  # the lone ones last
        n, nobody = len(own), np.uint32(0xFFFFFFFF)
        rank = np.full(len(sids), nobody)
        rank[own] = np.arange(n, dtype=np.uint32)
        keys = np.concatenate([_binary(b.column(3), np.uint32) for b in parts])
        del parts
        codes = keys.astype(np.uint64) << np.uint64(32)
        del keys
        codes |= np.repeat(rank, n_keys)
        if n < len(sids):
            codes = codes[codes.astype(np.uint32) != nobody]
        sids, size, lone, home = sids[own], size[own], lone[own], home[own]
        group = np.cumsum(np.concatenate([[True], lone[1:] | (home[1:] != home[:-1])]))
        pivot, lones, others = np.arange(n), [], []
        pairs = _count_pairs(codes, group, n)
        del own, rank, n_keys
        for a, b, shared in pairs:
            ok = np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - TINY
            a, b, shared = a[ok], b[ok], shared[ok]
            least = _least_shared(size[a], size[b], t)
            strong = (shared * buckets >= least) & (shared >= STRONG)
            weak = (shared < STRONG) & (least < STRONG * buckets)
            both = strong & lone[a]  # then b is lone too
            # a ascends from block to block: after its own block the pivot of a is final
            np.minimum.at(pivot, b[both], a[both])
            lones.append(np.unique(np.concatenate([pivot[a[both]] * n + a[both], pivot[a[both]] * n + b[both]])))
            some = strong & ~lone[a]
            others.append(np.unique(np.searchsorted(group, group[a[some]]) * n + b[some]))
            if weak.any():
                a, b = a[weak], b[weak]
                yield batch(2, pa.array(home[a], mask=lone[a]), sids[a], sids[b], shared[weak], least[weak])
        for kind, got in ((0, others), (1, lones)):
            got = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
            none = np.zeros(len(got), np.int64)
            yield batch(kind, pa.array(home[got // n]), none, sids[got % n], none, none)

    def batch(kind, region, a, b, shared, least):
        cols = [pa.array(np.full(len(a), kind, np.int8)), region, pa.array(a), pa.array(b), pa.array(shared.astype(np.int32)), pa.array(least.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["kind", "region", "a", "b", "n", "least"])

    return spread.mapInArrow(tidy(run), "kind tinyint, region bigint, a bigint, b bigint, n int, least int")


def _regions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, sid) of boundary sets, and of the sets of regions of lone ones; each once."""
    pairs = found.where("kind = 2").groupBy("region", "a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least")
    pairs = cut(pairs.select("region", "a", "b"), "jaccard-weak")
    across = found.where("kind = 0").select("region", F.col("b").alias("sid")).unionByName(pairs.where("region IS NOT NULL").select("region", F.col("b").alias("sid")))
    single = pairs.where("region IS NULL").select("a", "b")
    lowest = single.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("pivot"))
    placed = single.join(lowest, "a", "left").select(F.coalesce("pivot", "a").alias("region"), "a", "b")
    summed = placed.select("region", F.explode(F.array("a", "b")).alias("sid"))
    return across.distinct(), found.where("kind = 1").select("region", F.col("b").alias("sid")).unionByName(summed).distinct()


def _binary(col: pa.Array, kind=np.uint64) -> np.ndarray:
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if data is not None else np.zeros(0, kind)


def _lengths(col: pa.Array) -> np.ndarray:
    _, off, _ = col.buffers()
    return np.diff(np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1]).astype(np.int64)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many keys each set of left has in common with each of right."""
    if len(left) == 1 or len(right) == 1:
        one, many = (left[0], right) if len(left) == 1 else (right[0], left)
        every = np.concatenate(many)
        hit = np.zeros(len(every) + 1, np.int64)
        if len(one):
            np.cumsum(one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every, out=hit[1:])
        ends = np.cumsum([len(s) for s in many])
        counts = hit[ends] - hit[ends - [len(s) for s in many]]
        return counts.reshape(1, -1) if len(left) == 1 else counts.reshape(-1, 1)
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    total = np.zeros((len(left), len(right)))
    if not len(shared):
        return total.astype(np.int64)
    placed = []
    for keys, owner in sides:
        at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
        on = shared[at] == keys
        order = np.argsort(at[on], kind="stable")
        placed.append((at[on][order], owner[on][order]))
    for lo in range(0, len(shared), 4096):
        blocks = []
        for (at, owner), k in zip(placed, (len(left), len(right))):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            block = np.zeros((k, min(4096, len(shared) - lo)), np.float32)
            block[owner[a:b], at[a:b] - lo] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[1].T
    return np.rint(total).astype(np.int64)


def _similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    common = _common(left, right)
    return common / (np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - common)


def _distances(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    return 1 - _similarities([one], sets)[0] if len(sets) else np.zeros(0)


def window_join(left: list[np.ndarray], right: list[np.ndarray], to_left: np.ndarray, to_right: np.ndarray, t: float, at_once: int = AT_ONCE, depth: int = 8) -> np.ndarray:
    """Which sets of left join which of right, given the distances of all to one pivot: decided by the windows as far as they go.

    Where more than at_once pairs are left, the farthest set of left becomes a second pivot, and the sets of left nearer to it than to the first go on with it.
    """
    eps = 1 - t
    joined = to_left[:, None] + to_right[None, :] <= eps - TINY
    unsure = ~joined & (np.abs(to_left[:, None] - to_right[None, :]) <= eps + TINY)
    rows, cols = np.flatnonzero(unsure.any(1)), np.flatnonzero(unsure.any(0))
    if not len(rows):
        return joined
    part_l, part_r, dl, dr = [left[i] for i in rows], [right[j] for j in cols], to_left[rows], to_right[cols]
    if len(rows) * len(cols) > at_once and depth:
        far = part_l[int(np.argmax(dl))]
        new_l, new_r = _distances(far, part_l), _distances(far, part_r)
        near = new_l < dl
        if near.any() and not near.all():
            for own, a, b in ((np.flatnonzero(near), new_l, new_r), (np.flatnonzero(~near), dl, dr)):
                joined[np.ix_(rows[own], cols)] |= window_join([part_l[i] for i in own], part_r, a[own], b, t, at_once, depth - 1)
            return joined
    joined[np.ix_(rows, cols)] |= _similarities(part_l, part_r) >= t
    return joined


class _Links:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
        return a != b


def _cells(docs: DataFrame, reps: DataFrame, homes: DataFrame | None, across: DataFrame, lone: DataFrame, n: int) -> DataFrame:
    """Rows (kind, region, i, j, side, sid, n, regions, keys) of all cells, those of a cell together in one partition."""
    sized = reps.select("sid", "size")
    pieces = lambda: F.ceil(F.greatest(F.count("*") / CELL_SETS, F.sum("size") / CELL_KEYS)).cast("int")
    spot = lambda kind, side, mine, others: F.struct(F.lit(kind).alias("kind"), "region", side.alias("side"), F.col(mine).alias("mine"), F.col(others).alias("others"))
    in_lone = lone.join(sized, "sid").groupBy("region").agg(pieces().alias("mine"))
    spots = lone.join(in_lone, "region").select("sid", spot(1, F.lit(0), "mine", "mine").alias("tag"))
    if homes is not None:
        met = across.join(sized, "sid").groupBy("region").agg(pieces().alias("theirs"))
        members = homes.select("sid", F.col("home").alias("region")).join(met, "region")
        sizes = cut(members.join(sized, "sid").groupBy("region", "theirs").agg(pieces().alias("ours")), "jaccard-sizes")
        side = F.when(F.col("sid") == F.col("region"), 2).otherwise(0)
        spots = spots.unionByName(members.drop("theirs").join(sizes, "region").select("sid", spot(0, side, "ours", "theirs").alias("tag")))
        spots = spots.unionByName(across.join(sizes, "region").select("sid", spot(0, F.lit(1), "theirs", "ours").alias("tag")))
    wanted = spots.groupBy("sid").agg(F.collect_list("tag").alias("spots")).join(reps.select("sid", "id", "n"), "sid")
    wanted = cut(wanted.select("id", "sid", F.struct("n", "spots").alias("tags")), "jaccard-wanted")
    whole = _sets_of(docs, wanted, n)
    regions = F.transform(F.filter("tags.spots", lambda s: s["kind"] == 1), lambda s: s["region"])
    one = whole.select("sid", F.col("tags.n").alias("n"), regions.alias("regions"), "keys", F.explode("tags.spots").alias("s"))
    one = one.select("sid", "n", F.when(F.col("s.kind") == 1, F.col("regions")).alias("regions"), "keys", "s.*").withColumn("c", F.pmod(F.xxhash64("sid"), F.col("mine")).cast("int"))
    c, side = F.col("c"), F.col("side")
    up = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    at = lambda i, j, s: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), s.cast("int").alias("side"))
    every = (
        F.when(F.col("kind") == 1, F.transform(up("mine"), lambda k: at(F.least(c, k), F.greatest(c, k), F.when(k >= c, 0).otherwise(1))))
        .when(side == 0, F.transform(up("others"), lambda k: at(c, k, side)))
        .when(side == 1, F.transform(up("others"), lambda k: at(k, c, side)))
        .otherwise(F.flatten(F.transform(up("mine"), lambda i: F.transform(up("others"), lambda j: at(i, j, F.lit(2))))))
    )
    placed = one.select("kind", "region", F.explode(every).alias("at"), "sid", "n", "regions", "keys").select("kind", "region", "at.i", "at.j", "at.side", "sid", "n", "regions", "keys")
    return placed.repartition("kind", "region", "i", "j").sortWithinPartitions("kind", "region", "i", "j", "side", "sid")


def _cell_groups(batches):
    """((kind, region, i, j), {side: (sids, copies, regions, sets)}) of rows that come sorted; a set that comes twice counts once."""
    now, sides, last = None, {}, None
    for batch in batches:
        data, ends = _binary(batch.column(8)), np.cumsum(_lengths(batch.column(8)) // 8)
        for k, (*cell, side, sid, n, regions) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(8)))):
            if cell != now:
                if sides:
                    yield now, sides
                now, sides, last = cell, {}, None
            if (side, sid) == last:
                continue
            last = (side, sid)
            for col, x in zip(sides.setdefault(side, ([], [], [], [])), (sid, n, set(regions or ()), data[(ends[k - 1] if k else 0) : ends[k]].copy())):
                col.append(x)
    if sides:
        yield now, sides


_NOBODY: tuple[list, list, list, list] = ([], [], [], [])


def _lone_pairs(cell, sides, t: float):
    """(sid, copies) of both and the similarity of each pair of a cell of lone sets that belongs to this region: the lowest one that has both."""
    _, region, i, j = cell
    left, right = sides.get(0, _NOBODY), sides.get(1, _NOBODY) if i != j else None
    others = left if right is None else right
    if not left[0] or not others[0]:
        return
    for lo in range(0, len(left[0]), BLOCK_SETS):
        sim = _similarities(left[3][lo : lo + BLOCK_SETS], others[3])
        for a, b in zip(*np.nonzero(sim >= t)):
            a_ = int(a) + lo
            if (right is not None or a_ < b) and min(left[2][a_] & others[2][b]) == region:
                yield left[0][a_], left[1][a_], others[0][b], others[1][b], float(sim[a, b])


def _pairs_in(cells: DataFrame, t: float) -> DataFrame:
    """(a, b, jaccard) of all joined pairs of sets, each once; no set may have a home."""

    def run(batches):
        for cell, sides in _cell_groups(batches):
            rows = [(min(a, b), max(a, b), s) for a, _, b, _, s in _lone_pairs(cell, sides, t)]
            if rows:
                a, b, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "jaccard"])

    return cells.mapInArrow(tidy(run), "a bigint, b bigint, jaccard double")


def _links_in(cells: DataFrame, t: float) -> DataFrame:
    """(a, null, links): how many documents of other regions, or lone ones, a joins, in parts; (a, b, 0): edges that connect what the cell's pairs connect."""

    def run(batches):
        for (kind, *cell), sides in _cell_groups(batches):
            links: dict[int, int] = {}
            edges = []
            if kind == 1:
                forest = _Links()
                for a, na, b, nb, _ in _lone_pairs((kind, *cell), sides, t):
                    links[a], links[b] = links.get(a, 0) + nb, links.get(b, 0) + na
                    if forest.join(a, b):
                        edges.append((a, b))
            elif 1 in sides and 2 in sides:
                (pivot,), middle = sides[2][0], sides[2][3][0]
                ours, theirs = sides.get(0, _NOBODY), sides[1]
                # the pivot is a member too, of one cell in each row of cells
                lead = cell[1] == 0
                members = ([pivot] * lead + ours[0], sides[2][1] * lead + ours[1], [middle] * lead + ours[3])
                if members[0]:
                    to_pivot = _distances(middle, members[2])
                    ys = _distances(middle, theirs[3])
                    keep = np.flatnonzero(ys <= to_pivot.max() + 1 - t + TINY)
                    for lo in range(0, len(keep), BLOCK_SETS):
                        part = keep[lo : lo + BLOCK_SETS]
                        joined = window_join(members[2], [theirs[3][k] for k in part], to_pivot, ys[part], t)
                        for k, x in zip(joined @ np.array([theirs[1][k] for k in part]), members[0]):
                            if k:
                                links[x] = links.get(x, 0) + int(k)
                        for k, y in zip(np.array(members[1]) @ joined, part):
                            if k:
                                links[theirs[0][y]] = links.get(theirs[0][y], 0) + int(k)
                                edges.append((pivot, theirs[0][y]))
            a = [*links, *(e[0] for e in edges)]
            if a:
                b = [None] * len(links) + [e[1] for e in edges]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*links.values(), *(0 for _ in edges)], pa.int64())], ["a", "b", "links"])

    return cells.mapInArrow(tidy(run), "a bigint, b bigint, links bigint")


def _prepare(df: DataFrame, key: str, text: str, n: int, t: float, regions: bool) -> dict[str, DataFrame | None]:
    """docs(id, text), copies(sid, id), reps(sid, id, n, size, sketches), homes(sid, home), across and lone (region, sid)."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    survey = cut(_survey(docs, n), "jaccard-survey")
    total = survey.where("kind = 0").agg(F.sum("size")).first()[0] or 0
    frequent = survey.where("kind = 1").groupBy("id").agg(F.sum("size").alias("times")).orderBy(F.desc("times"), "id").limit(HOT_KEYS).select("id").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(frequent["id"].to_numpy().view(np.uint64)))
    copies = cut(survey.where("kind = 0").groupBy("sid", "id").agg(F.first("size").alias("size"), F.first("sketches").alias("sketches")), "jaccard-copies")
    reps = cut(copies.groupBy("sid").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sketches").alias("sketches")), "jaccard-sets")
    homes = cut(_homes(docs, reps, n, t), "jaccard-homes") if regions else None
    buckets = max(8, math.ceil(total * (1 - t) / BUCKET_KEYS))
    spread = _spread(docs, hot, n, t, buckets)
    spread = spread.withColumn("home", F.lit(None).cast("long")) if homes is None else spread.join(_small(homes), "sid", "left")
    spread = spread.select("bucket", "sid", "size", "keys", "home").repartitionById(buckets, "bucket")
    across, lone = _regions(cut(_candidates(spread, t, buckets), "jaccard-candidates"))
    return {"docs": docs, "copies": copies.select("sid", "id"), "reps": reps, "homes": homes, "across": cut(across, "jaccard-across"), "lone": cut(lone, "jaccard-lone")}


def similar_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (doc_a, doc_b, jaccard) of documents, doc_a < doc_b, whose Jaccard similarity is at least threshold.

    A document is the set of its word n-grams: words are runs of a-z, 0-9 and characters beyond ASCII, in lower case; a text of
    fewer than n words is one gram. Texts that are null or without words join nothing, and rows with a null key are left out. The
    key must be a whole number. Repeated rows are one document; of rows that share a key but not the text each is compared by itself, a pair of keys
    counts once with its highest similarity, and no key pairs with itself. An empty table gives no pairs; other columns are ignored.

    Spells out all pairs, so its rows grow with the square of a group; classes() does not.
    """
    p = _prepare(df, key, text, n, threshold, False)
    pairs = cut(_pairs_in(_cells(p["docs"], p["reps"], None, p["across"], p["lone"], n), threshold), "jaccard-pairs")
    left, right = p["copies"].select(F.col("sid").alias("a"), F.col("id").alias("x")), p["copies"].select(F.col("sid").alias("b"), F.col("id").alias("y"))
    across = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard").where("doc_a < doc_b")
    within = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return across.unionByName(within).groupBy("doc_a", "doc_b").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the lowest id of the component of each id in edges (a, b); by alternating large and small stars.

    Null ends and loops are left out, repeated edges count once, an empty table has no components. Lowest neighbours come from an aggregation that is joined
    back, so that the neighbours of one id need not meet in one task.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v AND a IS NOT NULL AND b IS NOT NULL").distinct(), "stars")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not seen[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state, now = seen, final(edges.sparkSession, lambda now=now: _stars(now), "stars")


def _stars(now: DataFrame) -> DataFrame:
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "stars")
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _classes(df: DataFrame, key: str, text: str, n: int, t: float) -> DataFrame:
    """(id, sid, root, n_links) of each document with a link; a class is that of its root."""
    return final(df.sparkSession, lambda: _class_rows(df, key, text, n, t), "jaccard-classes")


def _class_rows(df: DataFrame, key: str, text: str, n: int, t: float) -> DataFrame:
    p = _prepare(df, key, text, n, t, True)
    found = cut(_links_in(_cells(p["docs"], p["reps"], p["homes"], p["across"], p["lone"], n), t), "jaccard-links")
    homes, reps = p["homes"], p["reps"].select("sid", "n")
    # two sets of a region join
    total = homes.join(reps, "sid").groupBy("home").agg(F.sum("n").alias("total"))
    within = homes.join(total, "home").join(reps, "sid").select("sid", (F.col("total") - F.col("n")).alias("links"))
    counted = found.where("b IS NULL").select(F.col("a").alias("sid"), "links").unionByName(within).groupBy("sid").agg(F.sum("links").alias("links"))
    linked = reps.join(counted, "sid", "left").select("sid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")).where("n_links > 0")
    # a region is one vertex
    to = homes.select(F.col("sid").alias("b"), F.col("home").alias("__home"))
    edges = found.where("b IS NOT NULL").select("a", "b").join(to, "b", "left").select("a", F.coalesce("__home", "b").alias("b"))
    roots = components(edges)
    placed = linked.join(homes, "sid", "left").withColumn("v", F.coalesce("home", "sid")).join(roots.select(F.col("id").alias("v"), "root"), "v", "left")
    return placed.select("sid", F.coalesce("root", "v").alias("root"), "n_links").join(p["copies"], "sid").select("id", "sid", "root", "n_links")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, n_links): one row for each document that joins another one, as similar_pairs() has it: its class, by the lowest key in it, and
    how many documents it joins. Classes are the components of the pairs. A document without a row is a class by itself and has no links.

    Every link counts, those to exact copies too; pairs are not spelled out, so rows grow with the documents. Documents as in similar_pairs(): null or wordless
    texts and null keys have no row; repeated rows are one document; of rows that share a key but not the text each is a document by itself, the rows of a key
    and class are added up, and classes of one lowest key have one name. An empty table gives no rows; other columns are ignored.
    """
    got = _classes(df, key, text, n, threshold)
    lowest = got.groupBy("root").agg(F.min("id").alias("class_id"))
    return got.join(lowest, "root").groupBy(F.col("id").alias(key), "class_id").agg(F.sum("n_links").alias("n_links"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """df with one document of each class of near copies, the one of the lowest key; columns stay as they are.

    Rows with a null key, and texts that are null or without words, stay. Of repeated rows (equal key and text) one stays; of rows that share a
    key but not the text each stays or goes by its own text.
    """
    got = _classes(df, key, text, n, threshold)
    stays = got.groupBy("root").agg(F.min(F.struct("id", "sid")).alias("first"))
    gone = cut(got.join(stays, "root").where("first.id <> id OR first.sid <> sid").select(F.col("id").alias("__gone"), F.col("sid").alias("__gone_sid")), "jaccard-gone")
    twice = cut(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__twice")).count().where("count > 1").select("__twice"), "jaccard-twice")
    kept = df.join(gone.join(twice, F.col("__gone") == F.col("__twice").cast("long"), "left_anti"), F.col(key).cast("long") == F.col("__gone"), "left_anti")
    single = kept.join(twice, F.col(key) == F.col("__twice"), "left_anti")
    several = kept.join(twice, F.col(key) == F.col("__twice"), "left_semi").dropDuplicates([key, text])

    @F.arrow_udf("bigint")
    def sid_of(texts: pa.Array) -> pa.Array:
        out: list = [None] * len(texts)
        for i, keys in _sets(pa.RecordBatch.from_arrays([texts], ["t"]), WordHasher(), n, 0):
            out[i] = _sid(keys)
        return pa.array(out, pa.int64())

    several = several.withColumn("__sid", sid_of(F.col(text)))
    several = several.join(gone, (F.col(key).cast("long") == F.col("__gone")) & (F.col("__sid") == F.col("__gone_sid")), "left_anti").drop("__sid")
    return single.unionByName(several)


def query(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < {GRAM} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {GRAM} + 2), lambda i: array_to_string(w[i:i + {GRAM - 1}], ' ')) END)) AS gram FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common / (x.n + y.n - common)::DOUBLE >= {THRESHOLD}),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a)
SELECT p.a AS doc_id, class_id, count(*) AS n_links FROM p JOIN c ON c.a = p.a GROUP BY ALL
"""
