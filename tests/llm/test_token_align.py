import hashlib
import random
from collections import defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_bpe_packing import odd_texts
from ticklake.llm.packing import _byte_alphabet
from ticklake.llm.token_align import Aligner, align

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(texts):
    """(A tokens, B tokens) of each text as (id, bytes), by the libraries on whole texts."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = _byte_alphabet()
    out = []
    for t in texts:
        want = (" " + (t or "")).encode()
        enc = tok.encode(" " + (t or ""), add_special_tokens=False)
        a = [(i, bytes(alphabet[c] for c in tok.id_to_token(i))) for i in enc.ids]
        b = [(i, bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
             for i, p in ((i, model.id_to_piece(i)) for i in model.encode(t or ""))]
        whole = t and b"".join(x for _, x in a) == want == b"".join(x for _, x in b)
        out.append((a, b) if whole else ([], []))
    return out


def spans(side):
    out, at = [], 0
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def expected(texts):
    held, docs_with = [], defaultdict(set)
    for d, (a, b) in enumerate(tokens(texts)):
        a, b = spans(a), spans(b)
        links, lo = [], 0
        for i, s, e in a:
            while lo < len(b) and b[lo][2] <= s:
                lo += 1
            k = lo
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                docs_with[links[-1]].add(d)
                k += 1
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(a) and a[i][2] <= c:
                ga.append(a[i][0])
                i += 1
            while j < len(b) and b[j][2] <= c:
                gb.append(b[j][0])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        held.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (i, _), ds in docs_with.items():
        top[i] = max(top[i], len(ds))
    return [(na, nb, len(groups), len(links), sum(len(docs_with[x]) == top[x[0]] for x in links), sum(len(docs_with[x]) for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "") for na, nb, groups, links in held]


def check(docs, texts, **options):
    got = {r["doc_id"]: tuple(r[k] for k in NAMES) for r in align(docs, A, B, **options).collect()}
    want = expected(texts)
    assert len(got) == len(want)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i][:80] if texts[i] else texts[i]


def test_links_groups_and_counts_equal_whole_text_encoding(docs_of):
    rng = random.Random(5)
    vocab = ["the", "lake", "tokenizer", "Donau", "übermäßig", "naïve", "12345", "ab-cd", "e.g.", "ﬁn", "🙂", "x_y", "日本語", "foo\nbar", "  two", "\ttab"]
    texts = odd_texts(300, 7) + [" ".join(rng.choices(vocab, k=rng.randrange(1, 80))) for _ in range(200)]
    texts += ["", None, " ", "  ", "a ", " a", "a▁b", "<|endoftext|> plain <s> </s> <unk> <0x41>", "x" * 5000, "word " * 4000, "\x00\x01", "é"]
    texts += texts[300:320]  # repeated texts
    check(docs_of(texts), texts)


def test_shards_of_any_size_give_the_same(docs_of):
    texts = odd_texts(200, 9) + ["same words again " * 30] * 40
    for size in (1, 5000):
        check(docs_of(texts).repartition(3), texts, shard_bytes=size)


def test_empty_table_and_extra_columns(spark, docs_of):
    assert align(docs_of([]), A, B).collect() == []
    rows = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, shard long, pair long")
    assert align(rows, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert align(rows, A, B).first()["n_a"] == 2


def test_identity_map_is_by_bytes():
    al = Aligner(A, B)
    held = [(a, b) for a, b in enumerate(al.same.tolist()) if b >= 0]
    assert len(held) > 5000
    assert all(al.a.tokens[a] == al.b.tokens[b] for a, b in held)
