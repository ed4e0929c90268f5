"""Similarities of strings: Column expressions where Spark has them, Arrow functions where it has not."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein(a: Column, b: Column, most: int | None = None, ignore_case: bool = False) -> Column:
    """The edit distance; beyond `most` it is most + 1."""
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    if most is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def within(a: Column, b: Column, k: int) -> Column:
    return F.levenshtein(a, b, k) >= 0


def dynamic_threshold(n: Column) -> Column:
    return F.when(n <= 5, 1).when(n <= 10, 2).otherwise(3)


def prefix_distance(prefix: Column, word: Column) -> Column:
    """The least edit distance between prefix and any prefix of word; for short words."""
    cuts = F.sequence(F.lit(0), F.length(word))
    return F.array_min(F.transform(cuts, lambda n: F.levenshtein(prefix, F.substring(word, F.lit(1), n))))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1), n.cast("long"))).cast("int")


def lcs_tolerant(q: Column, r: Column, tolerance: Column | int) -> Column:
    """len(q) if r contains q, else the common prefix and tolerance more, within both lengths; 0 without a common prefix."""
    tolerance = F.lit(tolerance) if isinstance(tolerance, int) else tolerance
    p = common_prefix(q, r)
    return F.when(F.contains(r, q), F.length(q)).when(p == 0, 0).otherwise(F.least(p + tolerance, F.length(q), F.length(r)))


def jaccard_chars(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; two empty strings are alike."""
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda v: v != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def jaccard_all_chars(a: Column, b: Column) -> Column:
    """Jaccard similarity of the multisets of characters."""
    chars = F.array_distinct(F.filter(F.split(F.concat(a, b), ""), lambda v: v != ""))
    count = lambda c, v: F.length(c) - F.length(F.replace(c, v, F.lit("")))
    common = F.aggregate(chars, F.lit(0), lambda s, v: s + F.least(count(a, v), count(b, v)))
    union = F.length(a) + F.length(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def quantise(v: Column) -> Column:
    return F.bround(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def dequantise(b: Column) -> Column:
    return b / 255.0


def binomial_cdf(d: int, n: int, p: float) -> float:
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(d + 1))


def max_edits(length: int, p: float = 0.04, alpha: float = 0.01) -> int:
    """The smallest number of edits that a word of that length exceeds with a chance of alpha at most, each character going wrong with p; 0 for none."""
    if length <= 0:
        return 0
    return next((d for d in range(length + 1) if binomial_cdf(d, length, p) >= 1 - alpha), length)


def max_edits_column(length: Column, longest: int = 128, p: float = 0.04, alpha: float = 0.01) -> Column:
    known = [max_edits(n, p, alpha) for n in range(longest + 1)]
    return F.element_at(F.array(*map(F.lit, known)), F.least(F.greatest(length, F.lit(0)), F.lit(longest)) + 1)


# plain functions, which the coverage kernel uses too


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 where it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    prev = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        prev = row
    return min(prev[-1], most + 1)


def damerau(a: str, b: str, most: int) -> int:
    """Levenshtein distance; one over the limit, a swap of two neighbours at the first difference may make it one less."""
    d = edit_distance(a, b, most + 1) if abs(len(a) - len(b)) <= most else most + 1
    if d <= most:
        return d
    if abs(len(a) - len(b)) > most or d > most + 1:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if i + 1 < min(len(a), len(b)) and a[i] == b[i + 1] and a[i + 1] == b[i]:
        rest = edit_distance(a[i + 2 :], b[i + 2 :], most)
        if rest + 1 <= most:
            return rest + 1
    return most + 1


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = row & places.get(c, 0)
        row = (row + u) | (row - u)
    return len(a) - (row & full).bit_count()


def _matches(a: str, b: str, window: int) -> tuple[int, list[bool], list[bool]]:
    in_a, in_b, n = [False] * len(a), [False] * len(b), 0
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not in_b[j] and b[j] == c:
                in_a[i] = in_b[j] = True
                n += 1
                break
    return n, in_a, in_b


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    m, in_a, in_b = _matches(a, b, max(max(len(a), len(b)) // 2 - 1, 1))
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip((c for c, k in zip(a, in_a) if k), (c for c, k in zip(b, in_b) if k))) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    j, p = jaro(a, b), 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + p * scale * (1 - j)


def autocomplete_score(a: str, b: str) -> float:
    """How well a may be meant by b: their common subsequence over both lengths and their common prefix up to 4, within 0 and 1."""
    if not a or not b:
        return 0.0
    m, p, least = lcs_length(a, b), 0, min(len(a), len(b))
    while p < min(4, least) and a[p] == b[p]:
        p += 1
    return min(1.0, max(0.0, (0.5 * m * (m / len(a) + m / len(b)) + 0.1 * p) / max(least + 0.1 * min(4, least), 1)))


def _pairwise(fn, kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], arrow)

    return run


def damerau_column(a: Column, b: Column, most: int) -> Column:
    return _pairwise(lambda x, y: damerau(x, y, most), "int", pa.int32())(a, b)


def lcs_column(a: Column, b: Column) -> Column:
    return _pairwise(lcs_length, "int", pa.int32())(a, b)


def jaro_column(a: Column, b: Column) -> Column:
    return _pairwise(jaro, "double", pa.float64())(a, b)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler, "double", pa.float64())(a, b)


def autocomplete_column(a: Column, b: Column) -> Column:
    return _pairwise(autocomplete_score, "double", pa.float64())(a, b)


def complete(queries, vocabulary, k: int = 10):
    """(query_id, word, distance, rank): the k words of vocabulary(word, weight) that best complete each query(query_id, q).

    Distance is that of the query to the nearest prefix of the word and at most 1, 2 or 3 by the query's length; of equal distances the
    heavier word comes first. A word counts by no more than its beginning, as long as the query and those edits: distances are
    taken once for each distinct query and each distinct beginning, and the words come back by equality.
    """
    from pyspark.sql import Window as W

    asked = queries.select("q").distinct().withColumn("allowed", dynamic_threshold(F.length("q"))).withColumn("size", F.length("q") + F.col("allowed"))
    begun = vocabulary.crossJoin(F.broadcast(asked.select("size").distinct()))  # sizes are no more than the lengths of queries
    begun = begun.withColumn("head", F.substring(F.col("word"), F.lit(1), F.col("size"))).where(F.length("head") >= F.col("size") - 6)
    heads = begun.select("size", "head").distinct()
    near = asked.join(heads, "size").withColumn("distance", prefix_distance(F.col("q"), F.col("head"))).where(F.col("distance") <= F.col("allowed"))
    found = queries.join(near, "q").join(begun, ["size", "head"])
    order = W.partitionBy("query_id").orderBy("distance", F.desc("weight"), "word")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "word", "distance", "rank")
