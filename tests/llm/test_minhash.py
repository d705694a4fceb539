import random
import re

from pyspark.sql import functions as F

from ticklake.llm.minhash import near_dedup

from .conftest import edited, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts: dict, k: int, percent: int = 80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in texts}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                u, v = find(i), find(j)
                comp[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_groups_of_near_copies(docs_of):
    rng = random.Random(5)
    texts = []
    # copies edited so that their mutual similarity lies on both sides of the threshold
    for share in (0.02, 0.05, 0.08):
        base = words(rng, 150)
        texts += [" ".join(edited(rng, base, share)) for _ in range(60)]
    texts += [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(80)]
    texts += [texts[0]] * 5 + [texts[200].upper()] * 2 + ["", None, " \n ", "one", "One", "one two", "two one"]
    rng.shuffle(texts)
    want = brute(dict(enumerate(texts)), 2)
    got = near_dedup(docs_of(texts), words=2)
    assert result(got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_five_words_is_the_default(docs_of):
    rng = random.Random(6)
    base = words(rng, 300)
    texts = [" ".join(edited(rng, base, s)) for s in [0.0, 0.01, 0.02, 0.03, 0.05, 0.2] * 4] + ["a b c", "a b c", "a b c d"]
    assert result(near_dedup(docs_of(texts))) == brute(dict(enumerate(texts)), 5)


def test_one_hot_key_in_blocks(docs_of, monkeypatch):
    import ticklake.llm.minhash as m
    monkeypatch.setattr(m, "BLOCK", 16)
    rng = random.Random(7)
    base = words(rng, 120)
    texts = [" ".join(edited(rng, base, 0.07)) for _ in range(150)]
    assert result(near_dedup(docs_of(texts), words=2)) == brute(dict(enumerate(texts)), 2)


def test_edges(spark, docs_of):
    assert near_dedup(docs_of([]).where("false")).count() == 0
    odd = docs_of([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None), (9, None)])
    odd = odd.withColumn("key", F.lit(1)).withColumn("regs", F.lit("x")).withColumn("n", F.lit(2))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup(odd).collect()), key=str)
    assert got == sorted([(None, None, False), (7, 7, True), (7, 7, True), (9, 9, True), (9, 9, True)], key=str)
    long = " ".join(f"v{i}" for i in range(200_000))
    assert result(near_dedup(docs_of([long, long + " tail", "short"]))) == {0: (199_996, 0), 1: (199_997, 0), 2: (1, 2)}


def test_words_that_collide_in_polynomial_hashes(docs_of):
    from .test_bpe_packing import thue_morse
    one, other = thue_morse(11)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(docs_of([one, other, one]), words=2).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
