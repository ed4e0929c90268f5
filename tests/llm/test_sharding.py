import math

import pytest

from trawl.llm import sharding


def brute(keys, shards, vnodes, load, seed):
    """Key by key in waves, with no grouping by arc."""
    places, owners = sharding.ring(shards, vnodes, seed)
    import hashlib

    n, cap = len(keys), math.ceil(load * len(keys) / len(set(owners)))
    state = []
    for i, k in enumerate(keys):
        text = "" if k is None else str(k)
        pos = int(hashlib.md5(f"{seed}|{text}".encode()).hexdigest()[:15], 16)
        arc = next((a for a, p in enumerate(places) if p >= pos), 0)
        state.append((arc, pos, text, i))
    state.sort()
    out, used, hop = {}, dict.fromkeys(owners, 0), 0
    while len(out) < n:
        for arc, pos, text, i in state:
            if i not in out and used[s := owners[(arc + hop) % len(owners)]] < cap:
                used[s] += 1
                out[i] = (s, hop)
        hop += 1
    return [out[i] for i in range(n)], cap


@pytest.mark.parametrize("load", [1.0, 1.1, 2.0])
def test_same_as_key_by_key(spark, load):
    keys = [*range(150), None, None, 7, 7, 7, ""]
    df = spark.createDataFrame([(None if k is None else str(k), i, "x", 1.0) for i, k in enumerate(keys)], "doc_id string, i int, shard string, hops double")
    got = sharding.assign(df, shards=5, vnodes=3, load=load)
    assert got.columns == ["doc_id", "i", "shard", "hops"]
    want, cap = brute(keys, 5, 3, load, sharding.SEED)
    rows = got.collect()
    assert sorted((str(r.doc_id), r.shard, r.hops) for r in rows) == sorted((str(k), s, h) for k, (s, h) in zip(keys, want))
    assert max(sum(r.shard == s for r in rows) for s in map(str, range(5))) <= cap


def test_little_moves_when_a_shard_joins(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.shard for r in sharding.assign(df, shards=10, vnodes=64, load=1.25).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(df, shards=11, vnodes=64, load=1.25).collect()}
    assert sum(a[k] != b[k] for k in a) < 2000 * 2.5 / 11


def test_empty_and_bad(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long")).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(spark.range(3), key="id", load=0.9)


def test_sql(same_as_sql):
    assert same_as_sql(sharding.query, sharding.SQL) > 0
