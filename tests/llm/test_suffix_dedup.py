import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import ticklake.llm.suffix_dedup as sd
from ticklake.llm.suffix_dedup import remove_repeats

from .conftest import words


def brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                hit[i:i + width] = True
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out.append((len(b), int(hit.sum()), int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}
    return [rows[i] for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    passages = [" ".join(words(rng, n)) for n in (20, 34, 35, 36, 37, 60, 200)]
    texts = []
    for i in range(60):
        parts = [" ".join(words(rng, rng.randrange(0, 60))) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randrange(4), rng.choice(passages))
        if i % 7 == 0:
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts.insert(rng.randrange(4), p[cut:])
        texts.append("".join(parts))
    twice = " ".join(words(rng, 50))
    texts += [texts[3], texts[3], twice + " mid " + twice, "é" * 300, "x" * 500, "ab" * 300, "ab" * 120, "", None, "y" * 199, "y" * 199, "z" * 200]
    near = texts[5]
    texts += [near[:150] + "!" + near[150:], near[:-1], "q" + near]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_every_byte_equals_brute_force(docs_of, seed):
    texts = corpus(seed)
    assert got(remove_repeats(docs_of(texts))) == brute(texts, 200)


def test_grams_with_many_surroundings(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "LIMIT", 3)
    texts = corpus(3)
    assert got(remove_repeats(docs_of(texts), width=100)) == brute(texts, 100)


def test_heavy_grams_and_small_shards(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "HEAVY", 2)
    monkeypatch.setattr(sd, "SHARD", 3000)
    monkeypatch.setattr(sd, "CHUNK", 1500)
    texts = corpus(4)
    assert got(remove_repeats(docs_of(texts).repartition(3))) == brute(texts, 200)


def test_text_and_edges(docs_of):
    rng = random.Random(9)
    p = " ".join(words(rng, 80))
    docs = docs_of([(1, "alone é " + p), (None, "other " + p), (2, "same"), (2, "same"), (3, None)]).withColumn("key", F.lit(5)).withColumn("want", F.lit(5))
    rows = sorted(((r["doc_id"], r["kept_text"]) for r in remove_repeats(docs).collect()), key=str)
    # the space before the passage is shared too
    assert rows == sorted([(1, "alone é"), (None, "other"), (2, "same"), (2, "same"), (3, "")], key=str)
    assert remove_repeats(docs_of([]).where("false")).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, width=10)


def test_columns_are_carried_and_unlike_texts_of_one_id_share_nothing(spark):
    import random
    rng = random.Random(8)
    a, b, c = (" ".join(str(rng.randrange(10**9)) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (None, c, "u")]
    got = {r["tag"]: (r["doc_id"], r["kept_text"]) for r in remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string, tag string"), keep=["tag"], by_content=True).collect()}
    assert got == {"x": (1, ""), "y": (1, b), "z": (2, ""), "u": (None, c)}


def test_no_task_runs_two_python_processes_in_a_row(spark):
    import re

    from ticklake.llm.suffix_dedup import _dealt_out
    rows = spark.createDataFrame([], "key long, doc_id long, text string, want array<struct<gram: long, around: long, whole: boolean>>")
    plan = _dealt_out(rows, 200)._jdf.queryExecution().optimizedPlan().toString()
    names = [re.search(r"\w+", line).group() for line in plan.splitlines() if re.search(r"\w", line)]
    names = [n for n in names if n not in ("Project", "Filter")]
    assert "MapInArrow" in names and ("MapInArrow", "MapInArrow") not in list(zip(names, names[1:]))
