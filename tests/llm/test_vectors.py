import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklake.llm.ann import search
from ticklake.llm.embed_dedup import near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, ids=None):
    ids = ids or list(range(len(vectors)))
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids, vectors)], SCHEMA)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clusters(seed, d=16):
    rng = np.random.default_rng(seed)
    base = unit(rng.normal(size=(60, d)))
    rows = [base]
    for i, n in ((0, 90), (1, 5), (2, 3), (3, 12)):
        noise = rng.normal(size=(n, d)) * rng.uniform(0.02, 0.12, size=(n, 1))
        rows.append(base[i] + noise)
    rows.append(np.repeat(base[5:6], 20, axis=0))
    rows.append(base[6:7] * 3)
    return np.concatenate(rows).astype(np.float32)


def brute(x):
    u = unit(x.astype(np.float64))
    adj = u @ u.T >= 0.95
    np.fill_diagonal(adj, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(adj, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            return adj.sum(axis=1), comp
        comp = new


@pytest.mark.parametrize("block", [1024, 8])
def test_near_dedup_equals_brute_force(spark, monkeypatch, block):
    import ticklake.llm.embed_dedup as m
    monkeypatch.setattr(m, "BLOCK", block)
    x = clusters(3)
    links, comp = brute(x)
    got = {r["vec_id"]: r for r in near_dedup(frame(spark, x)).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == comp.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


BAD = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1.0, 2.0]]


def test_near_dedup_edges(spark):
    good = [[1, 0, 0, 0], [1, 0, 0, 0], [1e-30, 1e-31, 0, 0], [0, 1, 0, 0], [-1, 0, 0, 0]]
    df = frame(spark, BAD + good + [[0, 0, 1, 0]], [*range(12), None]).withColumn("rep", F.lit("x")).withColumn("pivot", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_dedup(df).collect()}
    assert all(got[i] == (0, i, True) for i in range(7))
    assert [got[i] for i in range(7, 12)] == [(2, 7, True), (2, 7, False), (2, 7, False), (0, 10, True), (0, 11, True)]
    assert got[None] == (0, None, False)
    assert near_dedup(df.where("false")).count() == 0
    assert near_dedup(df.where("vec_id = 0")).collect()[0]["kept"]


@pytest.mark.parametrize("d", [2, 32])
def test_near_dedup_finds_the_links_of_a_dense_group(spark, d):
    rng = np.random.default_rng(5)
    spread = 0.19 if d == 32 else 0.3  # d = 32: mutual cosine about 0.965
    group = unit(rng.normal(size=(1, d))) + rng.normal(size=(3000, d)) * spread / math.sqrt(d)
    x = np.concatenate([rng.normal(size=(1000, d)), group]).astype(np.float32)
    links, _ = brute(x)
    rows = sorted(near_dedup(frame(spark, x), pivot_count=700).collect(), key=lambda r: r["vec_id"])
    got = np.array([r["n_links"] for r in rows])
    assert (got <= links).all() and got.sum() >= 0.999 * links.sum()


def nearest(x, q, k):
    u = unit(x.astype(np.float64))
    s = u @ u[q]
    s[q] = -9
    order = np.lexsort((np.arange(len(x)), -s))[:k]
    return [(int(i), s[i]) for i in order]


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    df = frame(spark, x)
    rows = search(df, df.where("vec_id % 50 = 0"), k=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    hit = 0
    for q in range(0, 6000, 50):
        own = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        want = nearest(x, q, 5)
        hit += len({i for i, _ in want} & {r["vec_id"] for r in own})
        for r in own:
            a, b = x[q].astype(float), x[r["vec_id"]].astype(float)
            assert math.isclose(r["score"], a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel_tol=1e-12, abs_tol=1e-12)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
    assert hit / (120 * 5) >= 0.9


@pytest.mark.parametrize("alike", [0.965, 0.8])
def test_search_recall_beside_a_tight_group(spark, alike):
    rng = np.random.default_rng(9)
    d, n, hot = 64, 4000, 1333
    axis = unit(rng.normal(size=(1, d)))
    off = rng.normal(size=(hot, d))
    off = unit(off - (off @ axis.T) * axis)
    x = np.concatenate([math.sqrt(alike) * axis + math.sqrt(1 - alike) * off, unit(rng.normal(size=(n - hot, d)))]).astype(np.float32)
    df = frame(spark, x)
    by = {}
    for r in search(df, df.where("vec_id % 20 = 0"), k=5).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = {q: len({i for i, _ in nearest(x, q, 5)} & by[q]) / 5 for q in range(0, n, 20)}
    assert np.mean([h for q, h in hit.items() if q >= hot]) >= 0.9
    assert np.mean([h for q, h in hit.items() if q < hot]) >= 0.9


def test_search_small_tables_are_exact(spark):
    random.seed(2)
    good = [[random.choice([-1, 0, 1, 2]) for _ in range(4)] for _ in range(30)]
    good = [g if any(g) else [1, 1, 1, 1] for g in good]
    df = frame(spark, BAD + good).withColumn("b", F.lit(1)).withColumn("score", F.lit("x"))
    x = np.array(good, np.float64)
    got = {}
    for r in search(df, df.where("vec_id % 5 = 0"), k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"] - 7, r["score"])
    for q in range(10, 37, 5):
        want = nearest(x, q - 7, 5)
        assert [round(s, 12) for _, s in want] == [round(got[q][k][1], 12) for k in range(1, 6)]
    assert set(got) == set(range(10, 37, 5))
    few = frame(spark, [[1, 0], [0, 1], [1, 1]])
    assert sorted(r["vec_id"] for r in search(few, few.where("vec_id = 0"), k=5).collect()) == [1, 2]
    assert search(few, few.where("false")).count() == 0 and search(few.where("false"), few).count() == 0
