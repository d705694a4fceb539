import base64
import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticklake.llm.bpe import decode, digests, encode
from ticklake.llm.packing import pack, pack_documents, pieces, sweep

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    parts = ["'s", "'LL", "'ll", "'", "'re", "'r", "'ve", "x", " ", "  ", "\t", "\n", "\r\n", "a", "1", "²", "½", " ", " ",
             "　", "\x1c", "_", "-", "$", "é", "你", "🙂", "the", "Ing", "aaaa"]
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            out.append("".join(rng.choice(parts) for _ in range(rng.randrange(60))))
        elif kind == 1:
            out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(40)))
        elif kind == 2:
            out.append(rng.choice("ab -") * rng.randrange(1, 50))
        else:
            out.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz  \n") for _ in range(200)))
    return out


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s(docs_of, reference):
    texts = odd_texts(4000) + ["", None, "x" * 50_000, "long word " * 20_000]
    got = {r["doc_id"]: list(r["ids"]) for r in encode(docs_of(texts), MULTI).collect()}
    for i, t in enumerate(texts):
        assert got[i] == reference.encode_ordinary(t or ""), t[:100]


def test_round_trip_and_digests(docs_of, reference):
    texts = odd_texts(400, 2) + ["", None]
    docs = docs_of(texts)
    back = {r["doc_id"]: bytes(r["data"]) for r in decode(encode(docs, MULTI), MULTI).collect()}
    got = {r["doc_id"]: r for r in digests(docs, MULTI, shard_bytes=1000).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        ids = reference.encode_ordinary(t or "")
        assert back[i] == raw
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_pieces_match_tokenizers(docs_of):
    texts = odd_texts(800, 3) + ["word " * 5000, "", None, "a b " * 512]
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    got = {}
    for r in pieces(docs_of(texts), JSON, keep_ids=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(got[i], key=lambda r: r["piece"])
        assert [x for r in parts for x in r["ids"]] == ids
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // 1024)))
        at = 0
        for k, r in enumerate(parts):
            assert r["start"] == at and r["length"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
            assert k == 0 or r["length"] == 1024
            at += r["length"]


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            min(fit)[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins)


def test_packing_equals_best_fit_decreasing(spark):
    rng = random.Random(4)
    for lengths in ([rng.randrange(1, 65) for _ in range(700)], [33] * 500 + [31] * 200 + [1] * 50, [64] * 9, [7]):
        df = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, sequence string")
        rows = pack(df, capacity=64).collect()
        assert sorted(r["length"] for r in rows) == sorted(lengths)
        # opening whole runs of new sequences at once can differ by a little from one-by-one best fit
        assert check_layout(rows, 64) <= best_fit_decreasing(lengths, 64) + 1
        assert rows[0]["sequence"] == "x"


def test_sweep_is_bounded_by_lengths_not_rows():
    counts = {n: 10**9 + n for n in range(1, 257)}
    plan = sweep(counts, 256)
    assert sum(p[2] for p in plan) == sum(counts.values())
    assert len(plan) < 256 * 256


def test_pack_documents_edges(spark, docs_of):
    assert pack_documents(docs_of([]).where("false"), JSON).count() == 0
    docs = docs_of([(None, "null id"), (3, None), (3, None), (4, ""), (5, "many words " * 4000)]).withColumn("piece", F.lit("clash")).withColumn("length", F.lit(-1))
    rows = pack_documents(docs, JSON).collect()
    check_layout(rows, 1024)
    assert sum(r["doc_id"] == 3 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    with pytest.raises(Exception):
        pack(spark.createDataFrame([(1, 0, 99)], "doc_id long, piece int, length long"), capacity=64).count()


def thue_morse(bits: int) -> tuple[str, str]:
    """Two words that every polynomial hash modulo a power of two takes for one."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_in_polynomial_hashes(docs_of, reference):
    one, other = thue_morse(11)
    texts = [one, other, f"{one} {other}", f"{other} {one} {other}"]
    got = {r["doc_id"]: list(r["ids"]) for r in encode(docs_of(texts), MULTI).collect()}
    assert [got[i] for i in range(4)] == [reference.encode_ordinary(t) for t in texts]


def test_matches_of_one_hash_stay_apart(monkeypatch, reference):
    """Even if all words had one hash."""
    import numpy as np

    from ticklake.llm import bpe
    from ticklake.llm.common import texts_of
    import pyarrow as pa
    monkeypatch.setattr(bpe, "word_hashes", lambda codes, start, end: np.zeros(len(start), np.uint64))
    texts = odd_texts(60, 4) + ["", "the lake the lake"]
    shard = bpe.Shard(bpe.Ranks.load(MULTI))
    shard.add(*texts_of(pa.array(texts)))
    assert [ids.tolist() for ids in shard.encode()] == [reference.encode_ordinary(t) for t in texts]


def test_added_tokens_in_texts_are_the_library_s(docs_of):
    tok = Tokenizer.from_file(JSON)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "plain", "<|endoftext", "", None, "é<|endoftext|>\n x"]
    got = {r["doc_id"]: list(r["ids"]) for r in pieces(docs_of(texts), JSON, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [*tok.encode(t or "", add_special_tokens=False).ids, 2], t
