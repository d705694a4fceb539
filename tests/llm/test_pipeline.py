import os
import random
import shutil
import tempfile

import pytest

import corpus_pipeline
from ticklake.llm.queries import ORACLE, QUERIES

from .conftest import SCHEMA, edited, words
from .test_bpe_packing import check_layout
from .test_minhash import brute as near_brute
from .test_suffix_dedup import brute as repeat_brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    base = words(rng, 400)
    passage = " ".join(words(rng, 70))
    texts = [" ".join(base), " ".join(edited(rng, base, 0.01)), " ".join(words(rng, 90)) + " " + passage, " ".join(words(rng, 90)) + " " + passage + " tail",
             " ".join(words(rng, 50)) + " password=abcdef123456", "", None, "12345 !!", " ".join(words(rng, 60)), " ".join(words(rng, 2000))]
    folder = tempfile.mkdtemp(prefix="ticklake-pipeline-")
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    yield folder, texts
    shutil.rmtree(folder, ignore_errors=True)


def test_stages_against_brute_force(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {i: t for i, t in enumerate(texts)}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append((name, docs))
    rows = {name: {r["doc_id"]: r for r in df.collect()} for name, df in kept[:-1]}
    assert [n for n, _ in kept] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "secret_scan", "best_fit_packing"]
    assert all(df.columns == corpus_pipeline.COLUMNS for _, df in kept[:-1])
    # no text or no letter: rejected; clean documents stay
    held = {i: t for i, t in held.items() if t and any(c.isalpha() for c in t)}
    assert set(rows["language_id"]) == set(held)
    held = {i: t for i, t in held.items() if near_brute(held, 5)[i][1] == i}
    assert 1 not in held and set(rows["minhash_near_dedup"]) == set(held)
    ids = sorted(held)
    for i, (size, gone, _, _) in zip(ids, repeat_brute([held[i] for i in ids], 200)):
        assert len(rows["suffix_array_dedup"][i]["text"].encode()) == size - gone
    assert rows["secret_scan"][4]["text"].endswith("[assign]")
    assert all(r["n_chars"] == len(r["text"]) for r in rows["secret_scan"].values())
    pieces = kept[-1][1].collect()
    check_layout(pieces, 1024)
    assert {r["doc_id"] for r in pieces} == set(rows["secret_scan"])


def test_run_is_the_stages(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    check_layout(out, 1024)
    assert {r["doc_id"] for r in out} == {0, 2, 3, 4, 8, 9}


def test_stages_take_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_null_and_repeated_ids_lose_and_mix_nothing(spark):
    rng = random.Random(4)
    a, b, c, d, e, f = (" ".join(words(rng, 90)) for _ in range(6))
    rows = [(None, a), (None, b), (7, c), (7, c), (8, d), (8, e), (None, f), (9, f)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)
    want = {(None, a, "s0"), (None, b, "s1"), (7, c, "s2"), (7, c, "s3"), (8, d, "s4"), (8, e, "s5"), (9, f, "s7")}
    for name in ("minhash_near_dedup", "suffix_array_dedup"):
        docs = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        assert len(got) == 6 and set(got) <= want and {t for _, t, _ in got} == {a, b, c, d, e, f}


def test_an_unlabelled_table_keeps_every_text_with_a_letter(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 30)), None, "s", 1) for i in range(20)] + [(20, "123 !", None, "s", 1), (21, None, None, "s", 1)]
    docs = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r["doc_id"] for r in docs} == set(range(20)) and {r["lang"] for r in docs} == {None}


def test_every_numbered_query_is_registered(spark):
    import __spark_entry__
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(QUERIES) <= set(found) and "pipeline" in found
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_sql_twins(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.description]
        got = [tuple(r[c] for c in names) for r in QUERIES[name](spark, SF).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)), name
