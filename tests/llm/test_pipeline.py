import collections
import hashlib
import itertools
import math
import re

import corpus_pipeline
from trawl.llm import packing, quality, secrets
from trawl.llm.common import table


def groups(rows):
    """Kept row indices by brute force over all pairs."""
    sets = {}
    for k, r in enumerate(rows):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (r.text or "").lower())
        if w:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.55 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.55:
            a, b = sorted((root(a), root(b)), key=lambda k: rows[k].doc_id)
            up[b] = a
    return [k for k in range(len(rows)) if k not in sets or root(k) == k]


def test_each_stage_against_plain_versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    (_, first), (_, second), (_, third), (_, fourth), (_, fifth) = corpus_pipeline.STAGES
    kept = first(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    judged = {r.doc_id: r.keep for r in quality.query(spark, sf_dir).collect()}
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(i for i, k in judged.items() if k)
    single = second(spark, spark.createDataFrame(rows, docs.schema), sf_dir)
    want = sorted(rows[k] for k in groups(rows))
    assert sorted(single.collect()) == want and single.columns == docs.columns
    clean = third(spark, single, sf_dir)
    scanner = secrets.Scanner()
    texts = {r.doc_id: scanner.mask(r.text) for r in want}
    got = sorted(clean.collect())
    assert {r.doc_id: r.text for r in got} == texts and all(r.n_chars == len(r.text) for r in got)
    mixed = fourth(spark, clean, sf_dir)
    assert mixed.columns == docs.columns
    tokens = collections.Counter()
    for r in got:
        tokens[r.source] += len(r.text.split())
    total, roots = sum(tokens.values()), sum(math.sqrt(n) for n in tokens.values())
    copies = {}
    for r in got:
        rate = math.sqrt(tokens[r.source]) / roots * total / tokens[r.source]
        u = int(hashlib.md5(f"mix-1|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        copies[r.doc_id] = int(rate) + (u < rate - int(rate))
    assert dict(collections.Counter(r.doc_id for r in mixed.collect())) == {i: n for i, n in copies.items() if n}
    packed = fifth(spark, mixed, sf_dir).collect()
    per, fill = collections.Counter(), collections.Counter()
    for r in packed:
        per[r.doc_id] += r.n_tokens
        fill[r.bin_id] += r.n_tokens
    assert per == {i: n * len(texts[i].split()) for i, n in copies.items() if n}
    assert max(fill.values()) <= packing.LENGTH


def test_run_equals_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect()))


def test_odd_tables(spark, tmp_path):
    long = " ".join(f"x{i % 977}y{i}" for i in range(30000))
    rows = [(1, None, "en", "a", None), (None, "some plain words here", None, None, 4), (2, "", "en", "a", 0), (3, long, "en", None, 9), (3, long, "en", None, 9), (4, "plain words of no import", "en", "a", 24)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, rest = table(spark, str(tmp_path), "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        rest.append(sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    whole = sorted(((r[0], r[1], r[3]) for r in rows), key=str)
    assert rest[0] == whole  # without labels all stay
    assert rest[1] == sorted({*whole}, key=str) == rest[2]  # the repeated row goes, nulls stay
    assert {str(i) for i, *_ in rest[3]} >= {"1", "2"}  # sources without tokens keep their rate of 1
    per = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        per[str(r.doc_id)] += r.n_tokens
    want = collections.Counter()
    for i, t, _ in rest[3]:
        want[str(i)] += len((t or "").split())
    assert per == want
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
