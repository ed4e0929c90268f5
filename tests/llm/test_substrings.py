import collections
import random
import re

import numpy as np

from trawl.llm import substrings


def brute(rows, m):
    places = collections.defaultdict(list)
    for k, (i, text) in enumerate(rows):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        for p in range(len(w) - m + 1):
            if i is not None:
                places[tuple(w[p : p + m])].append((i, p))
    starts = collections.defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                starts[i].add(p)
    out = []
    for i, ps in starts.items():
        covered = sorted({p + k for p in ps for k in range(m)})
        begin = prev = covered[0]
        for x in covered[1:] + [None]:
            if x != prev + 1:
                out.append((i, begin, prev + 1))
                begin = x
            prev = x
    return sorted(out)


def test_cover():
    for a in range(substrings.PERIOD):
        for b in range(substrings.PERIOD):
            assert any((a + s) % substrings.PERIOD in substrings.COVER and (b + s) % substrings.PERIOD in substrings.COVER for s in range(substrings.PERIOD))


def test_windows():
    w = np.random.default_rng(0).integers(0, 9, 400).astype(np.uint64)
    h = substrings._windows(w, 3)
    same = {}
    for k in range(398):
        same.setdefault(tuple(w[k : k + 3]), set()).add(int(h[k]))
    assert all(len(v) == 1 for v in same.values()) and len({*map(frozenset, same.values())}) == len(same)


def test_same_as_all_windows(spark):
    for seed, m in ((1, 50), (2, 33)):
        rng = random.Random(seed)
        word = lambda: f"w{rng.randrange(5000)}"
        shared = [[word() for _ in range(rng.choice([m - 1, m, m + 1, m + 40, 3 * m]))] for _ in range(12)]
        rows = []
        for i in range(120):
            w = [word() for _ in range(rng.randrange(0, 150))]
            for _ in range(rng.choice([0, 0, 1, 2])):
                s = rng.choice(shared)
                a = rng.randrange(0, max(1, len(s) - m + 2))
                at = rng.randrange(len(w) + 1)
                w[at:at] = s[a:]
            rows.append((i, rng.choice([" ", ", "]).join(w)))
        rows += [(200, "la " * (m + 30)), (201, "x y " * m), (202, rows[3][1]), (203, rows[3][1])]
        got = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=m)
        want = brute(rows, m)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"x{i}" for i in range(50000))
    rows = [(1, None, 0), (2, "", 0), (None, p, 0), (3, p + " tail", 0), (4, f"Start {p.upper()}!", 0), (5, "a b c", 0), (5, "a b c", 0), (6, long, 0), (7, long[:-7] + p, 0), (8, long, 0), (9, p[:150], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_word int")
    got = sorted(map(tuple, substrings.repeated_spans(df).collect()))
    assert got == brute([(i, t) for i, t, _ in rows], 50)
    assert (3, 0, 60) in got and (4, 1, 61) in got and {g[0] for g in got} == {3, 4, 6, 7, 8}
    assert substrings.repeated_spans(df.limit(0)).count() == 0


def test_sql(same_as_sql):
    assert same_as_sql(substrings.query, substrings.SQL, "/root/testdata/sf0.01") > 0
