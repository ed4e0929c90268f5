"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import WordHasher, raw_parts, slices, table, tidy

STATS = ("symbols_per_word", "upper_share", "wordless_share", "repeated_word_share", "repeated_line_share")
#: At most so many good labelled documents fit the forest: those of the lowest hashes of the key. Its threshold is calibrated on all.
FIT_ROWS = 20_000
#: Scores, from 0 to 1, are counted in so many steps.
SCORE_STEPS = 1_000_000
#: Each rate counts as if the text had so many more plain words of five letters, or lines: rates of short texts are noisy.
SMOOTH_WORDS, SMOOTH_LINES = 30, 3
TREES, TREE_ROWS, SEED = 128, 256, 7
#: So many times as bad as a share of bad rows kept is the same share of good rows rejected.
GOOD_COST = 20.0

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.zeros((256, 6))
_CLASS[[*range(97, 123), *range(65, 91), *range(192, 256)], 0] = 1  # letters; a character beyond ASCII counts once, by its lead byte
_CLASS[[*range(97, 123)], 1] = 1
_CLASS[[*range(65, 91)], 2] = 1
_CLASS[[*range(48, 58)], 3] = 1
_CLASS[[ord(c) for c in ".,;:'\"-?()=@+/_"], 4] = 1
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()=@+/_"], 5] = 1


def rule_stats(texts: pa.Array, hasher: WordHasher) -> np.ndarray:
    """A row of STATS for each text; a text without words has 0 in all of them."""
    out = np.zeros((len(texts), len(STATS)))
    for (at, end, data, off), (_, _, low, low_off) in zip(slices(texts, lower=False), _same(texts)):
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        begins = np.flatnonzero(space[:-2] & ~space[1:-1])
        heads = off[:-1][off[:-1] < off[1:]]
        begins = np.union1d(begins, heads[~space[1:-1][heads]])
        words = np.diff(np.searchsorted(begins, off))
        hashes, _, first = hasher(low, low_off)
        same = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]])[: len(hashes)], out=same[1:])
        lexical = np.diff(first)
        for i in range(end - at):
            n = int(words[i])
            if not n:
                continue
            own = data[off[i] : off[i + 1]]
            letters, lower, upper, digits, marks, symbols = np.bincount(own, minlength=256) @ _CLASS
            seen = letters + digits + marks + symbols
            a, b = first[i], first[i + 1]
            again = int(same[b] - same[min(a + 1, b)]) if b > a else 0
            lines = [x for x in own.tobytes().split(b"\n") if x.strip()]
            m, chars = n + SMOOTH_WORDS, seen + 5 * SMOOTH_WORDS
            out[at + i] = (
                symbols / m, upper / (chars - seen + lower + upper), max(0, n - int(lexical[i])) / m, again / m,
                (len(lines) - len(set(lines))) / (len(lines) + SMOOTH_LINES),
            )
    return out


def _same(texts: pa.Array):
    """slices() of the lower-cased texts, cut where the texts themselves are."""
    import pyarrow.compute as pc

    cuts = [(a, b) for a, b, _, _ in slices(texts, lower=False)]
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    for a, b in cuts:
        data, o = raw_parts(pc.utf8_lower(filled.slice(a, b - a)))
        yield a, b, data[o[0] : o[-1]], o - o[0]


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """The mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Isolation trees in arrays: node 2k+1 and 2k+2 are below k; feature -1 marks a leaf, whose length is in cut."""

    feature: np.ndarray
    cut: np.ndarray
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected length): near 1 for what random splits isolate at once."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut in zip(self.feature, self.cut):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[every, np.maximum(f, 0)] >= cut[at]
                at = np.where(inner, 2 * at + 1 + go, at)
            total += cut[at]
        return np.exp2(-total / len(self.feature) / max(float(mean_path(self.rows)), 1e-9))


def grow(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Isolation trees over random rows of x. A split is uniform over the node's range, widened by a quarter to both sides,
    so that what lies outside all rows is split off early."""
    rng = np.random.default_rng(seed)
    rows = min(tree_rows, len(x))
    depth = max(1, math.ceil(math.log2(max(rows, 2))))
    feature, cut = np.full((trees, 2 ** (depth + 1) - 1), -1, np.int64), np.zeros((trees, 2 ** (depth + 1) - 1))
    low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
    pad = np.maximum((high - low) * 0.25, 1e-3)
    for t in range(trees):
        stack = [(0, 0, x[rng.choice(len(x), rows, replace=False)], low - pad, high + pad)] if rows else []
        while stack:
            node, level, own, lo, hi = stack.pop()
            if level == depth or len(own) <= 1:
                cut[t, node] = level + float(mean_path(len(own)))
                continue
            f = int(rng.integers(x.shape[1]))
            c = float(rng.uniform(lo[f], hi[f]))
            feature[t, node], cut[t, node] = f, c
            go = own[:, f] >= c
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[f], right_lo[f] = c, c
            stack += [(2 * node + 1, level + 1, own[~go], lo, left_hi), (2 * node + 2, level + 1, own[go], right_lo, hi)]
    return Forest(feature, cut, rows)


def calibrate(scores: np.ndarray, good: np.ndarray, cost: float = GOOD_COST, counts: np.ndarray | None = None) -> float:
    """The threshold (scores above it are rejected) with the most of: share of bad rows rejected less cost times the share of
    good rows rejected. Of equals the highest; without bad rows the highest score of a good one; without good rows infinite.
    counts says how many rows each score stands for, one if not given."""
    if not good.any():
        return math.inf
    counts = np.ones(len(scores)) if counts is None else counts
    at, where = np.unique(scores, return_inverse=True)
    top, low = (np.bincount(where[g], counts[g], len(at)) for g in (good, ~good))
    at = at[: np.flatnonzero(top)[-1] + 1]
    gain = (low.sum() - np.cumsum(low)) / max(low.sum(), 1) - cost * (top.sum() - np.cumsum(top)) / top.sum()
    return float(at[len(at) - 1 - int(np.argmax(gain[: len(at)][::-1]))])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, cost: float = GOOD_COST, key: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[Forest, float]:
    """A forest grown on at most fit_rows good labelled documents, and the threshold calibrated on all labelled ones.

    All documents are scored where they lie, so that no text is shuffled; keys and scores meet the labels. Scores that differ by less than
    1 / SCORE_STEPS count as the highest of them, so at most that many reach the driver.
    """
    picked = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).select(F.col(key).alias("__key"), (F.col(quality) > 0).alias("__good")).distinct()
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__key").isNotNull())
    order = [F.xxhash64("__key"), "__key"]
    sample = picked.where("__good").join(own.select("__key"), "__key", "left_semi").orderBy(*order).limit(fit_rows)
    known = own.join(F.broadcast(sample), "__key")  # fit_rows keys at most; several documents may have the same
    got = with_stats(known, "__text", keep=["__key"]).orderBy(*order, *STATS).limit(fit_rows).orderBy("__key", *STATS).toArrow()
    x = np.column_stack([got[s].to_numpy() for s in STATS]) if got.num_rows else np.zeros((0, len(STATS)))
    forest = grow(x)
    if not len(x):
        return forest, math.inf
    scored = with_stats(own, "__text", ["__key"], forest).select("__key", "score").join(picked, "__key")
    step = F.floor(F.col("score") * SCORE_STEPS)
    per = scored.groupBy(step.alias("__step"), "__good").agg(F.max("score").alias("score"), F.count("*").alias("n")).toArrow()
    # the good and the bad rows of a step have one score, the highest
    _, where = np.unique(per["__step"].to_numpy(), return_inverse=True)
    top = np.zeros(where.max() + 1)
    np.maximum.at(top, where, per["score"].to_numpy())
    return forest, calibrate(top[where], per["__good"].to_numpy(zero_copy_only=False).astype(bool), cost, per["n"].to_numpy())


def with_stats(df: DataFrame, text: str, keep: list[str], forest: Forest | None = None, threshold: float = math.inf) -> DataFrame:
    """The columns keep, STATS and, given a forest, score and keep of each row."""
    scored = [] if forest is None else ["score double", "keep boolean"]
    own = df.select(*keep, F.col(text).alias("__rule_text"))
    fields = [f for f in own.schema.fields if f.name != "__rule_text"]

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            x = rule_stats(batch.column(batch.num_columns - 1), hasher)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(c) for c in x.T]
            names = [f.name for f in fields] + list(STATS)
            if forest is not None:
                s = forest.scores(x)
                cols, names = [*cols, pa.array(s), pa.array(s <= threshold)], [*names, "score", "keep"]
            yield pa.RecordBatch.from_arrays(cols, names)

    from pyspark.sql.types import StructType

    schema = StructType([*fields])
    for s in [*(f"{s} double" for s in STATS), *scored]:
        schema = schema.add(*s.split(" "))
    return own.mapInArrow(tidy(run), schema)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """One row per document: key, STATS, score and keep (score no higher than the threshold).

    A null or empty text has all statistics 0 and is judged by them like any other; equal texts get equal scores. Without
    good labelled rows everything is kept. An empty table gives an empty table. Labels of unknown keys, null keys and null
    labels are left out; extra columns of either table are ignored.
    """
    forest, threshold = fit(docs, labels, key=key, text=text, **fitting)
    return with_stats(docs, text, [key], forest, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """The rows of docs that the forest keeps, with all columns of docs, those named like a statistic too.

    As in judge(): null and empty texts have statistics 0 and are judged by them, long texts are read whole, repeated rows and equal texts share their fate,
    scores equal to the threshold stay, and without good labelled rows all stay. An empty table gives an empty table.
    """
    forest, threshold = fit(docs, labels, key=key, text=text, **fitting)

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        return pa.array(forest.scores(rule_stats(texts, WordHasher())) <= threshold)

    return docs.where(passes(F.col(text)))


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
