"""MinHash near-duplicate detection with HyperMinHash registers.

1. Sketch.  Each document becomes its set of word shingles (64-bit hashes).
   The top bits of a hash name one of 256 buckets; a bucket keeps only its
   smallest hash, compressed to a leading-zero count (6 bits) and the 10
   mantissa bits after the leading one: 512 bytes a document.
2. Classes.  Documents with equal sets form a class; only the class's
   smallest id (representative) goes on, so thousands of copies cost one.
3. Banding.  Empty buckets borrow from others by a fixed probing order
   (densification); 42 bands of 6 registers give the keys under which
   representatives meet.  A pair of similarity 0.8 meets in at least one
   band with probability 1 - (1 - 0.8^6)^42 = 0.999997.
4. Stars.  In each shared key every member is paired with one of them, the
   key's head, drawn by hash.  Pairs pass a size test, then the collision-corrected Jaccard estimate
   from the registers (five standard deviations below the threshold still
   pass), then the exact comparison of the full sets.
5. Rest.  Keys whose members are in one component need nothing more.  In the
   others the members are compared in bounded blocks, pairs from different
   components only: estimated first, then by their full sets.  So every pair
   that meets in a key is either verified or already connected, and no group
   is ever expanded into rows for all its pairs.

Hot keys: copies collapse in step 2; a key with very many near copies is met
by an aggregate with map-side combine and by a join that adaptive execution
splits; blocks in step 5 are dealt out by (key, block, block).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm import common
from ticklake.llm.common import bounded_batches, components, cut, doc_chunks, mix64, process_cache, release, texts_of

BUCKETS, BANDS, ROWS = 256, 42, 6
CHUNK = 1 << 19
BLOCK = 2048
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the lower-cased words of documents laid end to end, and each document's first word (n + 1).

    A word is a run of bytes other than space and 9 to 13; only A-Z change case.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    solid = np.ones(256, bool)
    solid[[32, 9, 10, 11, 12, 13]] = False
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = lower[data]
    word = solid[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    opens[edge] = word[edge]
    closes = np.empty(n, bool)
    closes[:-1] = word[:-1] & ~word[1:]
    closes[-1] = word[-1]
    inner = edge[edge > 0]
    closes[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return common.word_hashes(data, start, end), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """Each document's sorted distinct shingle hashes."""
    for i, j in doc_chunks(offsets, CHUNK):
        lo = offsets[i]
        h, at = word_hashes(data[lo:offsets[j]], offsets[i:j + 1] - lo)
        m = max(len(h) - words + 1, 0)
        sh = np.zeros(m, np.uint64)
        for k in range(words):
            sh += h[k:k + m] * np.uint64(int(_ODD) * (2 * k + 1) % (1 << 64))
        sh = mix64(sh)
        for k in range(j - i):
            a, b = at[k], at[k + 1]
            if b - a >= words:
                s = np.sort(sh[a:b - words + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                part = (h[a:b] * (_ODD * np.arange(1, 2 * (b - a), 2, dtype=np.uint64))).sum(dtype=np.uint64)
                yield mix64(np.array([part + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: 0 for an empty bucket, else 1 + (leading zeros, 10 mantissa bits)."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(s):
        bucket = (s >> np.uint64(56)).astype(np.int64)
        first = np.ones(len(s), bool)
        np.not_equal(bucket[1:], bucket[:-1], out=first[1:])
        low = ((s[first] & np.uint64((1 << 56) - 1)) >> np.uint64(8)).astype(np.float64)  # 48 bits: exact
        m, e = np.frexp(low)
        zeros = 48 - e
        mantissa = np.where(low > 0, (2 * m - 1) * 1024, 0).astype(np.int64)
        out[bucket[first]] = (zeros.astype(np.int64) << 10 | mantissa) + 1
    return out


def _probes() -> np.ndarray:
    return process_cache("hyper-probes", lambda: np.argsort(
        mix64(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, BUCKETS), axis=1))


def densify(regs: np.ndarray) -> np.ndarray:
    """Fills empty registers of each row from the first non-empty bucket in the bucket's probing order."""
    out = regs.astype(np.uint64)
    row, col = np.nonzero((regs == 0) & (regs.any(axis=1))[:, None])
    probes = _probes()
    for t in range(BUCKETS):
        if not len(row):
            break
        donor = probes[col, t]
        v = regs[row, donor]
        hit = v > 0
        out[row[hit], col[hit]] = v[hit].astype(np.uint64) + np.uint64(65536) * (donor[hit].astype(np.uint64) + np.uint64(1))
        row, col = row[~hit], col[~hit]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, bands) keys of densified registers."""
    full = densify(regs)[:, :BANDS * ROWS].reshape(len(regs), BANDS, ROWS)
    odd = _ODD * np.arange(1, 2 * ROWS, 2, dtype=np.uint64)
    key = mix64((mix64(full) * odd).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """Collision-corrected Jaccard estimate of register rows, and its standard deviation at similarity 0.8.

    Equal registers of different hashes happen with probability about
    0.17 * 2^-10 per bucket, weighted by how alike the set sizes are.
    """
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    ratio = na / np.maximum(nb, 1)
    by_chance = 0.1699195 * BUCKETS / 1024 * 4 * ratio / (1 + ratio) ** 2
    used = np.maximum(used, 1)
    return (same - by_chance) / used, np.sqrt(0.16 / used)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2`` (128-bit key of the whole set) and ``regs``."""

    def run(batches):
        for b in batches:
            n, k, regs = [], [], []
            for s in shingle_sets(*texts_of(b.column("text")), words):
                n.append(len(s))
                k.append((int(s.sum(dtype=np.uint64)), int((mix64(s) * _ODD).sum(dtype=np.uint64))))
                regs.append(registers(s).tobytes() if len(s) else None)
            k = np.array(k, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "regs"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, regs binary")


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                key = band_keys(_regs(part.column("regs")))
                rep = np.repeat(part.column("rep").to_numpy(), BANDS)
                n = np.repeat(part.column("n").to_numpy(), BANDS)
                yield pa.record_batch([pa.array(key.ravel()), pa.array(rep), pa.array(n)], names=["key", "rep", "n"])

    return reps.select("rep", "n", "regs").mapInArrow(run, "key long, rep long, n long")


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate does not rule the threshold out."""
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches):
        for x in batches:
            if x.num_rows:
                j, sd = estimate(_regs(x.column("ra")), _regs(x.column("rb")), x.column("na").to_numpy(), x.column("nb").to_numpy())
                x = x.filter(pa.array(j >= percent / 100 - 5 * sd))
            yield x.select(["a", "b"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(batches):
        for x in batches:
            for i in range(0, x.num_rows, 512):
                part = x.slice(i, 512)
                ta, tb = part.column("ta").to_pylist(), part.column("tb").to_pylist()
                each = list(dict.fromkeys(ta + tb))
                sets = dict(zip(each, shingle_sets(*texts_of(pa.array(each, pa.large_string())), words)))
                ok = []
                for p, q in zip(ta, tb):
                    p, q = sets[p], sets[q]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").mapInArrow(run, "a long, b long")


def _open_pairs(t: pa.Table, percent: int):
    """Pairs of a block that may still link two components: (row, later rows) one row at a time.

    A pair counts only in the first band in which it meets, so each is
    looked at in one block.
    """
    rep, comp, n, own = (t.column(c).to_numpy() for c in ("rep", "comp", "n", "own"))
    crossed = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
    regs = _regs(t.column("regs"))
    keys = np.concatenate([band_keys(regs[i:i + 1024]) for i in range(0, len(regs), 1024)])
    band = int(np.flatnonzero(keys[0] == t.column("key")[0].as_py())[0])
    keys = np.ascontiguousarray(keys[:, :band])
    for i in range(len(rep)):
        ok = (comp != comp[i]) & (rep > rep[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if crossed:
            ok &= own != own[i]
        j = np.flatnonzero(ok)
        j = j[~(keys[j] == keys[i]).any(axis=1)] if len(j) and band else j
        if len(j):
            e, sd = estimate(regs[i][None, :], regs[j], n[i], n[j])
            j = j[e >= percent / 100 - 5 * sd]
            if len(j):
                yield i, j


def _rest(members: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between different components whose documents share a key.

    ``members``: (key, rep, comp, c) of keys that hold several components.
    A key of c members is cut into ceil(c / BLOCK) blocks by a hash of the id;
    each pair of blocks is one group of at most about two blocks.  A first
    pass keeps the members that have an open pair, a second one compares
    their full sets and returns a spanning forest of the links, so that rows
    grow with members and not with pairs.
    """
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    dealt = (
        members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "comp"))
    dealt = dealt.join(reps.select("rep", "n", "regs"), "rep").select("key", "lo", "hi", "own", "rep", "comp", "n", "regs")

    def narrow(_, t):
        hit = np.zeros(t.num_rows, bool)
        for i, j in _open_pairs(t, percent):
            hit[i] = True
            hit[j] = True
        return t.filter(pa.array(hit))

    left = cut(dealt.groupBy("key", "lo", "hi").applyInArrow(narrow, dealt.schema), "open-members")

    def compare(_, t):
        sets = list(shingle_sets(*texts_of(t.column("text")), words))
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
        at = np.cumsum(size) - size
        rep = t.column("rep").to_numpy()
        root = np.arange(len(rep))
        a, b = [], []
        mark = np.zeros(flat.max(initial=0) + 1, bool)
        for i, j in _open_pairs(t, percent):
            mark[flat[at[i]:at[i] + size[i]]] = True
            both = np.add.reduceat(mark[flat], at, dtype=np.int64) if len(flat) else size
            mark[flat[at[i]:at[i] + size[i]]] = False
            for k in j[100 * both[j] >= percent * (size[j] + size[i] - both[j])]:
                if root[i] != root[k]:
                    root[root == root[k]] = root[i]
                    a.append(rep[i])
                    b.append(rep[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = left.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    out = full.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")
    out.open_members = left
    return out


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Links join documents whose shingle sets have a Jaccard similarity of at
    least ``percent`` / 100; ``component_id`` is the smallest id reachable.
    Null or empty texts have empty sets and stand alone.  A document with
    fewer words than a shingle is one shingle.  Rows that share a doc_id are
    one vertex; a null doc_id gives a null component and ``kept`` false.
    """
    src = bounded_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    sk = cut(sketch(src, words), "sketch")
    named = sk.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # (written first, so that both sides of the next join are plain shuffles, which adaptive execution can split)
    heads = cut(named.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")), "heads")
    member = cut(named.select("doc_id", "n_shingles", "k1", "k2").join(heads, ["n_shingles", "k1", "k2"]).select("doc_id", "rep").distinct(), "member")
    only = heads.select(F.col("rep").alias("doc_id"), "n_shingles", "k1", "k2")
    reps = cut(named.join(only, ["doc_id", "n_shingles", "k1", "k2"], "left_semi").select(
        F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "regs").dropDuplicates(["rep", "n", "regs"]), "reps")
    sizes = cut(sk.select("doc_id", "n_shingles"), "sizes")
    release(sk, heads)
    bands = cut(_bands(reps), "bands")
    # a key's head is drawn by hash: a document that meets others in many bands is held against many of them
    lot = F.struct(F.xxhash64("key", "rep").alias("lot"), "rep", "n")
    keys = bands.groupBy("key").agg(F.min(lot).alias("head"), F.count("*").alias("c")).where("c > 1")
    shared = cut(bands.join(keys, "key").select("key", "rep", "n", "c", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n")), "shared")
    release(bands)
    close = F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * percent
    stars = shared.where((F.col("rep") != F.col("head")) & close).select(
        F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")).distinct()
    stars = cut(_plausible(stars, reps, percent), "stars")
    wanted = shared.where("c > 2").select(F.col("rep").alias("doc_id")).union(stars.select("a")).union(stars.select("b")).distinct()
    texts = cut(src.join(wanted, "doc_id", "left_semi"), "texts")
    same_id = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = cut(_verified(stars, texts, words, percent), "links")
    comp = components(links.union(same_id.join(reps.select(F.col("rep").alias("a")), "a", "left_semi")), "cc1")
    placed = shared.where("c > 2").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", "c", F.coalesce("component", "rep").alias("comp"))
    placed = cut(placed, "placed")
    release(shared, stars)
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    more = _rest(placed.join(mixed, "key", "left_semi"), reps, texts, words, percent)
    first, links = links, cut(links.union(more), "links")
    release(first, placed, texts, reps, more.open_members)
    comp = components(links.union(same_id), "cc")
    out = sizes.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    final = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", final.alias("component_id"),
        F.coalesce(F.col("doc_id") == final, F.lit(False)).alias("kept"))
