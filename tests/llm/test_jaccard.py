import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from trawl.llm import common, jaccard


def brute(rows, n, t):
    sets = []
    for i, text in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        if w and i is not None:
            sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}))
    out = {}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        s = len(a & b) / len(a | b)
        if i != j and s >= t:
            out[min(i, j), max(i, j)] = max(s, out.get((min(i, j), max(i, j)), 0))
    return {k: round(v, 6) for k, v in out.items()}


def texts(rng, n):
    vocab = [f"w{i}" for i in range(300)]
    line = "licensed under the same old terms as all others here"
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 or not out:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 20, 80]))]
        else:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 2, max(1, len(w) // 8)])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return [x + " " + line if rng.random() < 0.3 else x for x in out]


def brute_classes(pairs):
    """{document: (lowest of its class, links)} of the pairs."""
    links, seen = jaccard._Links(), {}
    for a, b in pairs:
        links.join(a, b)
        for x in (a, b):
            seen[x] = seen.get(x, 0) + 1
    return {x: (links.root(x), k) for x, k in seen.items()}


def as_classes(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("t,n,seed", [(0.55, 3, 1), (0.8, 1, 2), (0.3, 2, 3), (1.0, 3, 4)])
def test_all_pairs(spark, monkeypatch, t, n, seed):
    for name, small in (("CHUNK_TIMES", 4), ("CELL_SETS", 8), ("BLOCK_SETS", 5), ("AT_ONCE", 4), ("MEASURED", 3)):
        monkeypatch.setattr(jaccard, name, small)
    rows = [*enumerate(texts(random.Random(seed), 160))]
    rows += [(k + 1000, x) for k, x in rows[:30]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_pairs(df, n=n, threshold=t).collect()}
    want = brute(rows, n, t)
    assert got == want and got
    assert as_classes(jaccard.classes(df, n=n, threshold=t)) == brute_classes(want)


def near_family(rng, size, words=120, edits=9):
    """A text, exact copies of it, and copies with words replaced."""
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = [" ".join(base)] * 3
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cell", [1024, 6])
def test_large_group(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL_SETS", cell)
    rng = random.Random(cell)
    rows = [*enumerate(near_family(rng, 120) + near_family(rng, 20, 60, 4) + near_family(rng, 20, 300, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = jaccard._prepare(df, "doc_id", "text", 3, 0.55, True)
    assert p["homes"].count() > 60 and p["across"].count() > 0  # regions with members, and boundary documents
    assert as_classes(jaccard.classes(df)) == brute_classes(brute(rows, 3, 0.55))


@pytest.mark.parametrize("at_once,t", [(1, 0.55), (50, 0.8), (10**9, 0.3)])
def test_windows(at_once, t):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2000, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < q], rng.integers(0, 2000, int(300 * (1 - q))).astype(np.uint64)])) for q in rng.random(80)]
    left, right = sets[:50], sets[50:]
    got = jaccard.window_join(left, right, jaccard._distances(base, left), jaccard._distances(base, right), t, at_once)
    want = [[len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) >= t for b in right] for a in left]
    assert got.tolist() == want and got.any() and not got.all()


def test_one_key_of_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_a, r.doc_b) for r in jaccard.similar_pairs(df).collect()} == {(1, 2), (1, 3), (1, 4), (2, 4)}
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(df).collect()) == [(1, 1, 3), (2, 1, 2), (3, 1, 1), (4, 1, 2)]
    assert sorted((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()) == sorted([(1, a), (1, b)])


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60000))
    rows = [(1, None, 0), (2, "", 0), (3, "...", 0), (None, "a b c d", 1), (4, "a b c d", 1), (5, "A, b; c d!", 1), (5, "A, b; c d!", 1), (6, long, 2), (7, long + " y", 2), (8, "a", 3), (9, "a", 3), (9, "q r s t", 4), (10, "q r s t", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links int")
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_pairs(df).collect()}
    assert got == brute([(i, t) for i, t, _ in rows], 3, 0.55)
    assert set(got) == {(4, 5), (6, 7), (8, 9), (9, 10)}
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(df).collect())
    assert found == [(4, 4, 1), (5, 4, 1), (6, 6, 1), (7, 6, 1), (8, 8, 1), (9, 8, 1), (9, 9, 1), (10, 9, 1)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, 4, 6, 8, 9]))
    for made in (jaccard.similar_pairs, jaccard.classes, jaccard.keep_one):
        assert made(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    links = jaccard._Links()
    for a, b in edges:
        links.join(a, b)
    got = {r.id: r.root for r in jaccard.components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()}
    assert got == {x: links.root(x) for x in {y for e in edges for y in e} if links.root(x) != x}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sql(same_as_sql):
    assert same_as_sql(jaccard.query, jaccard.SQL) > 0


def test_boundary_documents_with_default_settings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = jaccard._prepare(docs, "doc_id", "text", jaccard.GRAM, jaccard.THRESHOLD, True)
    assert p["homes"].count() > 0 and p["across"].count() + p["lone"].count() > 0


class Caught:
    """Stands for a table, to get at the function that its tasks would run."""

    def mapInArrow(self, run, schema):
        return run


def documents(rng, n, words):
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([" ".join(f"W{x}" for x in rng.integers(0, 40, words)) for _ in range(n)])], ["id", "text"])


@pytest.mark.parametrize("chunk", [1, 700, 5000, 10**6])
def test_frequent_grams_of_chunks(monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_KEYS", chunk)
    batches = [documents(np.random.default_rng(k), 12, words) for k, words in enumerate((200, 3, 900, 1))]
    got = [(b["id"].to_pylist(), b["size"].to_pylist()) for b in jaccard._survey(Caught(), 1)(iter(batches)) if 1 in b["kind"].to_pylist() or not b.num_rows]
    want, held = [], []
    sets = [keys for b in batches for _, keys in jaccard._sets(b, common.WordHasher(), 1)]
    for k, keys in enumerate(sets):
        held.append(keys)
        if sum(map(len, held)) >= chunk or k == len(sets) - 1:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            want.append((found[times >= jaccard.CHUNK_TIMES].view(np.int64).tolist(), times[times >= jaccard.CHUNK_TIMES].tolist()))
            held = []
    assert got == want


def test_survey_holds_a_chunk_once(monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_KEYS", 400_000)
    monkeypatch.setattr(common, "SLICE_BYTES", 10_000)
    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([" ".join(map(str, rng.integers(0, 10**6, 1000))) for _ in range(500)])], ["id", "text"])
    tracemalloc.start()
    assert sum(b.num_rows for b in jaccard._survey(Caught(), 3)(iter([batch]))) >= 500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 8 * 400_000


def test_lower_case_of_one_run_at_a_time():
    texts = pa.array(["Ab, \u0130X " * 200, None, ""] * 5_000)
    low = b"".join(data.tobytes() for _, _, data, _ in common.slices(texts))
    assert low == "".join(pc.utf8_lower(texts.fill_null("")).to_pylist()).encode()
    texts = texts.fill_null("")
    before, most = pa.total_allocated_bytes(), 0
    for _ in common.slices(texts):
        most = max(most, pa.total_allocated_bytes() - before)
    assert most < texts.nbytes / 4


def test_tasks_release_what_is_free(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))
    assert list(common.tidy(lambda batches: (seen.append(b) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert seen == ["released", 1, 2, "released"]
    begun = common.tidy(lambda batches: (b for b in batches))(iter([1, 2]))
    next(begun)
    begun.close()
    assert seen[4:] == ["released", "released"]
