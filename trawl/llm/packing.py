"""Best-two-fit packing of documents into sequences of a fixed length."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut, n_words, table

LENGTH = 2048
#: Tokens of a group, about; groups are packed apart, each leaves at most a few bins that are not full.
GROUP_TOKENS = 1 << 23
#: Rows of one key that make up more than this share of a group are spread over the groups row by row.
HOT_SHARE = 1 / 16


def best_two_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of indices into sizes (each from 1 to length).

    Fill a bin greedily: the largest document left that fits, until none fits. If there is a gap, take out the bin's smallest
    document and look for two documents left that together are larger than it and fit; of such pairs take the
    one that leaves the smallest gap, and among equals the one with the largest document; the smallest goes back. Documents
    of one size are taken in their order.

    Sizes with documents left are bits of one integer, so the largest that fits is one shift away.
    """
    left: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        left[sizes[i]].append(i)
    mask = 0
    for s in left:
        mask |= 1 << s
    bins = []

    def take(s: int) -> int:
        nonlocal mask
        own = left[s]
        i = own.pop()
        if not own:
            mask ^= 1 << s
        return i

    while mask:
        gap, own = length, []
        while fits := mask & ((2 << gap) - 1):
            s = fits.bit_length() - 1
            own.append(take(s))
            gap -= s
        if gap and own:
            small = sizes[own[-1]]  # greedy takes never grow
            room, best, pair = gap + small, small, None
            fits = mask & ((1 << small) - 1)
            while fits and best < room:
                a = fits.bit_length() - 1
                if 2 * a <= best:
                    break
                rest = mask & ((2 << min(a, room - a)) - 1)
                if len(left[a]) < 2 and rest >> a & 1:
                    rest ^= 1 << a
                if rest and a + (b := rest.bit_length() - 1) > best:
                    best, pair = a + b, (a, b)
                fits ^= 1 << a
            if pair:
                i = own.pop()
                own += [take(pair[0]), take(pair[1])]
                if not left[small]:
                    mask |= 1 << small
                left[small].append(i)
        bins.append(own)
    return bins


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: bin_id, slot (from 0), key, start and n_tokens in words.

    A document of more than length words is cut into pieces of length words and a rest; a full piece is a bin of its own.
    Documents without words (null or empty texts) have one row with null bin_id and slot. Repeated rows are packed each; a null
    key is packed like any other; pieces of one size go by key as text, then by start, and rows that are equal in both
    are interchangeable. An empty table gives an empty table; other columns are ignored.

    Groups are by hash of the key, their number all tokens over group_tokens, so work and memory of a task stay the same at any size; with another
    number of groups, or another group_tokens, other documents meet, so bins differ. Rows of a key that has many (null, or copies) are spread by
    their place in the written table of sizes, and documents without words go to no group, so neither makes a group large.
    Only key and token count are shuffled.
    """
    sizes = cut(df.select(F.col(key).alias("__key"), n_words(F.col(text)).alias("__n"), F.monotonically_increasing_id().alias("__row")), "pack")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    key_type = sizes.schema["__key"].dataType
    full = sizes.where("__n > 0")
    by_key, by_row = (F.pmod(F.xxhash64(*c), F.lit(groups)) for c in (["__key"], ["__key", "__row"]))
    if groups > 1:
        # no more keys than total / (group_tokens * HOT_SHARE) can be so large: 16 for each group
        hot = full.groupBy(F.col("__key").alias("__hot")).agg(F.sum("__n").alias("__of")).where(F.col("__of") > group_tokens * HOT_SHARE).select("__hot", F.lit(True).alias("__is"))
        full = full.join(hot, F.col("__key").eqNullSafe(F.col("__hot")), "left")
        grouped = full.select("__key", "__n", F.when(F.col("__is"), by_row).otherwise(by_key).alias("__group"))
    else:
        grouped = full.select("__key", "__n", by_key.alias("__group"))

    def run(one: pa.Table) -> pa.Table:
        keys, ns, group = one["__key"], one["__n"].to_pylist(), one["__group"][0].as_py()
        names = keys.cast(pa.string()).to_pylist()
        order = sorted(range(len(ns)), key=lambda i: (names[i] is not None, names[i] or "", ns[i]))
        rows: list[tuple[int, int, int, int, int]] = []
        n_bins, rests = 0, []
        for i in order:
            for at in range(0, ns[i] - length + 1, length):
                rows.append((n_bins, 0, i, at, length))
                n_bins += 1
            if rest := ns[i] % length:
                rests.append((i, ns[i] - rest, rest))
        for b in best_two_fit([r for _, _, r in rests], length):
            rows += [(n_bins, slot, *rests[j]) for slot, j in enumerate(b)]
            n_bins += 1
        b, slot, at, start, n = zip(*rows)
        ids = pa.array([group << 32 | x for x in b], pa.int64())
        return pa.table({"bin_id": ids, "slot": pa.array(slot, pa.int32()), key: keys.take(pa.array(at)), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    schema = f"bin_id bigint, slot int, `{key}` {key_type.simpleString()}, start bigint, n_tokens bigint"
    packed = grouped.groupBy("__group").applyInArrow(run, schema)
    none = sizes.where("__n = 0").select(F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("slot"), F.col("__key").alias(key), F.lit(0).cast("long").alias("start"), "__n")
    return packed.unionByName(none.withColumnRenamed("__n", "n_tokens"))


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
