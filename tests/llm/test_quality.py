import numpy as np
import pyarrow as pa

from trawl.llm import quality
from trawl.llm.common import WordHasher, table


def walk(forest, t, x, node=0):
    f = forest.feature[t, node]
    if f < 0:
        return forest.cut[t, node]
    return walk(forest, t, x, 2 * node + 1 + (x[f] >= forest.cut[t, node]))


def test_scores_are_mean_paths():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    f = quality.grow(x, trees=20, tree_rows=64)
    probe = np.vstack([x[:20], [[9, 9, 9, 9]]])
    want = [2 ** (-np.mean([walk(f, t, p) for t in range(20)]) / float(quality.mean_path(64))) for p in probe]
    got = f.scores(probe)
    assert np.allclose(got, want)
    assert got[-1] > np.quantile(f.scores(x), 0.99)


def plain_stats(text):
    words = (text or "").split()
    import re

    n = len(words)
    if not n:
        return [0.0] * 5
    lex = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    seen = [c for c in text if not c.isspace()]
    symbols = sum(c in "!#$%&*<>[\\]^`{|}~" for c in seen)
    up = sum("A" <= c <= "Z" for c in seen)
    low = sum("a" <= c <= "z" for c in seen)
    letters = up + low + sum(ord(c) > 127 for c in seen)
    chars = len(seen) + 5 * quality.SMOOTH_WORDS
    m = n + quality.SMOOTH_WORDS
    lines = [x for x in text.split("\n") if x.strip()]
    return [symbols / m, up / (chars - len(seen) + low + up), max(0, n - len(lex)) / m, sum(a == b for a, b in zip(lex, lex[1:])) / m, (len(lines) - len(set(lines))) / (len(lines) + quality.SMOOTH_LINES)]


def test_rule_stats_equal_plain_ones(spark, sf_dir):
    texts = [r.text for r in table(spark, sf_dir, "documents").select("text").collect()]
    texts += [None, "", " \n ", "a", "Ünd ünd UND", "x|| x\nx|| x\n", "!" * 1000, "word " * 600000, "b"]
    got = quality.rule_stats(pa.array(texts), WordHasher())
    assert np.allclose(got, [plain_stats(t) for t in texts])


def test_judges_labelled_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = quality.judge(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in out if r.quality], [r for r in out if not r.quality]
    assert sum(r.keep for r in good) / len(good) > 0.99
    assert sum(not r.keep for r in bad) / len(bad) > 0.9
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == quality.judge(docs, labels).where("keep").count()


def test_labels_of_other_documents_use_up_nothing(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels").select("doc_id", "quality")
    other = spark.range(10**9, 10**9 + 20000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    n = labels.count()
    forest, threshold = quality.fit(docs, labels, fit_rows=n)
    again, same = quality.fit(docs, labels.unionByName(other), fit_rows=n)
    assert threshold == same < 1 and np.array_equal(forest.cut, again.cut) and np.array_equal(forest.feature, again.feature)


def test_threshold_is_of_all_labelled_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    forest, threshold = quality.fit(docs, labels, fit_rows=40)
    assert forest.rows == 40
    rows = docs.join(labels.where("quality IS NOT NULL").select("doc_id", "quality").distinct(), "doc_id").collect()
    scores = forest.scores(quality.rule_stats(pa.array([r.text for r in rows]), WordHasher()))
    good = np.array([r.quality > 0 for r in rows])
    gain = lambda t: np.mean(scores[~good] > t) - quality.GOOD_COST * np.mean(scores[good] > t)
    best = max(gain(t) for t in scores)
    assert abs(gain(threshold) - best) < 1e-9 and threshold == max(t for t in scores if t <= scores[good].max() and gain(t) >= best - 1e-9)


def test_counts_stand_for_rows():
    rng = np.random.default_rng(3)
    scores, good, n = rng.integers(0, 30, 200) / 30, rng.random(200) < 0.7, rng.integers(1, 5, 200)
    assert quality.calibrate(scores, good, 2.0, n) == quality.calibrate(np.repeat(scores, n), np.repeat(good, n), 2.0)


def test_threshold_ties_and_missing_sides():
    assert quality.calibrate(np.array([0.2, 0.4, 0.4, 0.6]), np.array([True, True, False, False]), 1.0) == 0.4  # of a good and a bad row with one score
    assert quality.calibrate(np.array([0.3, 0.5]), np.array([True, True])) == 0.5 and quality.calibrate(np.array([0.3]), np.array([False])) == float("inf")
    assert quality.calibrate(np.array([0.3, 0.3, 0.3]), np.array([True, False, False]), 1.0) == 0.3
    rng = np.random.default_rng(1)
    for cost in (0.5, 3.0):
        scores, good = rng.integers(0, 12, 60) / 12, rng.random(60) < 0.6
        gain = lambda t: np.mean(scores[~good] > t) - cost * np.mean(scores[good] > t)  # noqa: B023, E731
        at = [t for t in sorted(set(scores)) if t <= scores[good].max()]
        best = max(map(gain, at))
        assert quality.calibrate(scores, good, cost) == max(t for t in at if gain(t) > best - 1e-12)


def test_driver_rows_stay_bounded(spark):
    """A labelled key that a third of the documents have brings no more than fit_rows rows to the driver."""
    docs = spark.createDataFrame([(1 if k % 3 == 0 else k, f"plain words number {k} of a text") for k in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int")
    forest, threshold = quality.fit(docs, labels, fit_rows=50)
    assert forest.rows == 50 and threshold < 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "a b c", 0.5), (2, "a b c", 0.5), (3, "!!! " * 90000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(2, 1), (2, 1), (None, 1), (3, None), (99, 1), (3, 0)], "doc_id long, quality int")
    assert quality.judge(docs, none).where("keep").count() == 5
    got = quality.judge(docs, some)
    assert got.columns == ["doc_id", *quality.STATS, "score", "keep"]
    assert {str(r.doc_id): r.keep for r in got.collect()}["3"] is False
    assert got.count() == 5 and quality.keep_good(docs, some).columns == docs.columns
    assert quality.judge(docs.limit(0), some).count() == 0
