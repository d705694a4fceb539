"""Alignment of two tokenizers over whole texts, with an identity map as the fast path.

Tokenizer A is a byte-level BPE file read with a space before the text,
tokenizer B a SentencePiece model that adds that space itself.  Byte offsets
at which tokens of both end cut a text into groups; in a group every A token
is linked with every B token whose byte range it overlaps.

* ``Identity`` precomputes, for each A id, the B id that stands for the same
  bytes.  Links of an id with its identity - nearly all of them exact
  one-to-one groups - are counted in vectors as long as A's vocabulary, one
  per task; only the other pairs of irregular groups are shuffled.
* Documents are encoded once, in shards of bounded size; what is written is
  one row per document with its distinct links.  The corpus-wide counts of
  irregular pairs come from one row per (shard, pair), so that a pair that
  every document holds costs a row per shard and no task more than others.
* The counts go back to the shards that asked for them, and each shard scores
  its documents.  Vectors indexed by A id (counts of identities, highest count
  of each id) are bounded by the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import bounded_batches, cut, process_cache, ranges, release, texts_of
from ticklake.llm.packing import _byte_alphabet, _WordIds

#: A run of spaces and the text up to the next one: no B piece spans two of them.
CHUNK = re.compile(r" *[^ ]+| +")
SPACE_MARK = "▁"

LINKS = "shard long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
        "same array<int>, same_n array<int>, pair array<long>, pair_n array<int>"


class Vocabulary:
    """Byte strings of an id range, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.offs = np.cumsum(self.lens) - self.lens

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.offs[ids], self.lens[ids])]


def byte_level(path: str) -> Vocabulary:
    """Tokens of a byte-level file, as bytes."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    vocab = dict(held["model"]["vocab"])
    vocab.update({t["content"]: t["id"] for t in held.get("added_tokens", [])})
    alphabet = _byte_alphabet()
    special = {t["content"] for t in held.get("added_tokens", [])}
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        tokens[i] = t.encode() if t in special else bytes(alphabet[c] for c in t)
    return Vocabulary(tokens)


def pieces_of(path: str):
    """The model and its pieces as bytes (the space mark as a space, byte pieces as their byte)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        tokens.append(bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode())
    return model, Vocabulary(tokens)


class Identity:
    """``of[a]``: the B id with the bytes of A id ``a``, or -1.  A plain piece goes before a byte piece, then the smaller id."""

    def __init__(self, a: Vocabulary, b: Vocabulary, is_byte):
        named: dict[bytes, int] = {}
        for i in sorted(range(len(b.tokens)), key=lambda i: (is_byte(i), i)):
            named.setdefault(b.tokens[i], i)
        self.of = np.array([named.get(t, -1) if t else -1 for t in a.tokens], np.int64)


class Aligner:
    """Both tokenizers, prepared once per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.path_a = path_a
        self.a = byte_level(path_a)
        self.model, self.b = pieces_of(path_b)
        self.same = Identity(self.a, self.b, self.model.is_byte).of
        self.lone_space = self.model.piece_to_id(SPACE_MARK)
        if any(SPACE_MARK in p[i:] and p[i] != SPACE_MARK for p in map(self.model.id_to_piece, range(len(self.b.tokens)))
               for i in range(len(p))):
            raise ValueError("a piece of the model spans a word border: texts cannot be encoded word by word")
        size = max(len(self.a.tokens), len(self.b.tokens))
        width = len(str(size - 1)) + 1
        self.digits = np.zeros((size, width), np.uint8)
        for i in range(size):
            s = str(i).encode()
            self.digits[i, :len(s)] = np.frombuffer(s, np.uint8)
        self.n_digits = (self.digits > 0).sum(axis=1)

    @classmethod
    def load(cls, path_a: str, path_b: str) -> "Aligner":
        return process_cache(("aligner", path_a, path_b), lambda: cls(path_a, path_b))

    def chunk_ids(self, chunk: str) -> list[int]:
        """B ids of a run that begins with a space (the model adds that one)."""
        return self.model.encode(chunk[1:], num_threads=1) if len(chunk) > 1 else [self.lone_space]

    def text_of(self, a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digits of groups (an, bn: tokens of each group) as ``a1,a2|b1;a3|b2``, and the end of each group in it (its ``;`` included)."""
        n = an + bn
        at = np.cumsum(n) - n
        ids = np.empty(len(a) + len(b), np.int64)
        ids[ranges(at, an)] = a
        ids[ranges(at + an, bn)] = b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[at + an - 1] = ord("|")
        mark[at + n - 1] = ord(";")
        slots = self.digits[ids]
        slots[np.arange(len(ids)), self.n_digits[ids]] = mark
        size = np.cumsum(self.n_digits[ids] + 1)
        return slots[slots > 0], size[at + n - 1]


class _Shard:
    """Documents of a task, up to a bounded number of bytes, with their A and B ids."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.words = aligner, _WordIds(aligner.path_a)
        self.number: dict[str, int] = {}
        self.docs: list[np.ndarray] = []
        self.raw: list[np.ndarray] = []
        self.ids: list[pa.Array] = []

    @property
    def bytes(self):
        return self.words.bytes

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        data, offsets = texts_of(spaced)
        self.words.add(data, offsets)
        number = self.number
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            raw = data[lo:hi]
            runs = CHUNK.findall(raw.tobytes().decode("utf-8"))
            self.docs.append(np.fromiter((number.setdefault(r, len(number)) for r in runs), np.int32, len(runs)))
            self.raw.append(raw)
        self.ids.append(doc_ids)

    def aligned(self, group_bytes: int = 1 << 20):
        """Yields (index range of documents, one ``_Aligned``), about ``group_bytes`` of text at a time."""
        al = self.aligner
        each = [al.chunk_ids(r) for r in self.number]
        size = np.fromiter(map(len, each), np.int64, len(each))
        at = np.cumsum(size) - size
        flat = np.fromiter((i for e in each for i in e), np.int64, int(size.sum()))
        a_of = self.words.encode()
        i = 0
        while i < len(self.docs):
            j, held, a, b = i, 0, [], []
            while j < len(self.docs) and (j == i or held + len(self.raw[j]) <= group_bytes):
                a.append(next(a_of).astype(np.int64))
                b.append(flat[ranges(at[self.docs[j]], size[self.docs[j]])])
                held += len(self.raw[j])
                j += 1
            yield i, j, _Aligned(al, self.raw[i:j], a, b)
            i = j


class _Aligned:
    """Groups and links of a few documents laid end to end."""

    def __init__(self, al: Aligner, raw: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]):
        # documents whose joined bytes differ have no tokens
        for k in range(len(raw)):
            if not (np.array_equal(al.a.bytes_of(a[k]), raw[k]) and np.array_equal(al.b.bytes_of(b[k]), raw[k])):
                a[k] = b[k] = np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        self.na, self.nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = np.concatenate([none, *a]), np.concatenate([none, *b])
        a_end, b_end = np.cumsum(al.a.lens[self.a]), np.cumsum(al.b.lens[self.b])
        a_start, b_start = a_end - al.a.lens[self.a], b_end - al.b.lens[self.b]
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        self.ga = np.diff(np.searchsorted(a_end, both, side="right"), prepend=0)
        self.gb = np.diff(np.searchsorted(b_end, both, side="right"), prepend=0)
        doc_of_a = np.repeat(np.arange(len(a)), self.na)
        self.group_doc = doc_of_a[np.cumsum(self.ga) - 1] if len(both) else none
        self.n_groups = np.bincount(self.group_doc, minlength=len(a))
        # the fast path: exact one-to-one groups, looked up in the identity array
        lone = (self.ga == 1) & (self.gb == 1)
        first_a, first_b = np.cumsum(self.ga) - self.ga, np.cumsum(self.gb) - self.gb
        la, lb, ld = self.a[first_a[lone]], self.b[first_b[lone]], self.group_doc[lone]
        # irregular groups: every overlapping pair of occurrences
        in_odd = np.repeat(~lone, self.ga)
        at = np.flatnonzero(in_odd)
        lo = np.searchsorted(b_end, a_start[at], side="right")
        n = np.searchsorted(b_start, a_end[at], side="left") - lo
        oa, ob, od = np.repeat(self.a[at], n), self.b[ranges(lo, n)], np.repeat(doc_of_a[at], n)
        pa_, pb, pd = np.concatenate([la, oa]), np.concatenate([lb, ob]), np.concatenate([ld, od])
        self.n_links = np.bincount(pd, minlength=len(a))
        same = al.same[pa_] == pb
        self.same = _counted(pd[same], pa_[same], len(a))
        self.pair = _counted(pd[~same], pa_[~same] << 20 | pb[~same], len(a))

    def digests(self, al: Aligner) -> list[str]:
        text, ends = al.text_of(self.a, self.ga, self.b, self.gb)
        last = np.cumsum(self.n_groups)
        stop = np.concatenate([[0], ends])[last]
        out, lo = [], 0
        for n, hi in zip(self.n_groups.tolist(), stop.tolist()):
            out.append(hashlib.sha256(text[lo:hi - 1].tobytes()).hexdigest() if n else "")
            lo = hi
        return out


def _counted(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each document with their number of occurrences, and where each document's begin (n + 1)."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    return key[at], times, np.searchsorted(doc[at], np.arange(n + 1))


def _list(values: np.ndarray, starts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, kind))


def links(docs: DataFrame, path_a: str, path_b: str, shard_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: token, group and link counts, the groups' digest, and its distinct links.

    ``same`` / ``same_n``: A ids linked with their identity and how often;
    ``pair`` / ``pair_n``: the other links as ``a * 2**20 + b``.  ``shard``
    numbers the runs of documents that were encoded together.
    """

    def run(batches):
        al = Aligner.load(path_a, path_b)
        task, count = TaskContext.get().partitionId(), 0
        shard = _Shard(al)

        def flush():
            ids = pa.chunked_array(shard.ids, pa.int64()).combine_chunks() if shard.ids else pa.array([], pa.int64())
            for i, j, x in shard.aligned():
                yield pa.record_batch([
                    pa.array(np.full(j - i, (task << 24) + count, np.int64)), ids.slice(i, j - i),
                    *(pa.array(v, pa.int64()) for v in (x.na, x.nb, x.n_groups, x.n_links)), pa.array(x.digests(al), pa.string()),
                    _list(x.same[0], x.same[2], pa.int32()), _list(x.same[1], x.same[2], pa.int32()),
                    _list(x.pair[0], x.pair[2], pa.int64()), _list(x.pair[1], x.pair[2], pa.int32()),
                ], names=["shard", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pair", "pair_n"])

        for b in batches:
            for k in range(b.num_rows):  # a batch may hold more than a shard does
                if shard.bytes >= shard_bytes:
                    yield from flush()
                    shard, count = _Shard(al), count + 1
                if k % 64 == 0:
                    shard.add(b.column("doc_id").slice(k, 64), b.column("text").slice(k, 64))
        yield from flush()

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bounded_batches(src).mapInArrow(run, LINKS)


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False)


def identity_counts(held: DataFrame, size: int) -> DataFrame:
    """``(a, n)``: documents that hold A id ``a`` linked with its identity; one vector per task, summed by id."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(_flat(b, "same"), minlength=size)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at])], names=["a", "n"])

    return held.select("same").mapInArrow(run, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))


def asked_pairs(held: DataFrame, most: int = 1 << 21) -> DataFrame:
    """``(shard, pair, n)``: documents of a shard that hold an irregular pair.

    A shard's documents lie in a row of the written table, so each task sums
    a shard before it shuffles (a shard that two tasks read gives a row from
    each, as does one above ``most`` waiting pairs; the sums are the same).
    """

    def run(batches):
        now, waiting, size = None, [], 0

        def flush():
            if waiting:
                pair, n = np.unique(np.concatenate(waiting), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(pair), now, np.int64)), pa.array(pair), pa.array(n.astype(np.int64))],
                                      names=["shard", "pair", "n"])

        for b in batches:
            shard = b.column("shard").to_numpy()
            off = np.asarray(b.column("pair").offsets)
            flat = _flat(b, "pair")
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi == lo:
                    continue
                if shard[lo] != now or size > most:
                    yield from flush()
                    now, waiting, size = shard[lo], [], 0
                part = flat[off[lo] - off[0]:off[hi] - off[0]]
                waiting.append(part)
                size += len(part)
        yield from flush()

    return held.select("shard", "pair").mapInArrow(run, "shard long, pair long, n long")


def align(docs: DataFrame, path_a: str, path_b: str, shard_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A link's count is the number of documents that hold its id pair linked
    anywhere; ``count_sum`` adds the counts of all links of a document,
    ``n_best`` is how many of them have the highest count of their A id.
    Null and empty texts and texts that one of the tokenizers cannot give
    back byte by byte have zeros and an empty digest.  Repeated rows are
    documents of their own; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    al = Aligner(path_a, path_b)
    size, same_of = len(al.a.tokens), al.same
    held = cut(links(docs, path_a, path_b, shard_bytes), "token-links")
    same = np.zeros(size, np.int64)
    for r in identity_counts(held, size).collect():  # at most one row per A id
        same[r["a"]] = r["n"]
    asked = cut(asked_pairs(held), "token-pairs")
    counted = asked.groupBy("pair").agg(F.sum("n").alias("n"))
    counted = cut(counted, "pair-counts")
    best = same.copy()
    tops = counted.groupBy(F.shiftright("pair", 20).cast("int").alias("a")).agg(F.max("n").alias("n"))
    for r in tops.collect():  # at most one row per A id
        best[r["a"]] = max(best[r["a"]], r["n"])
    # a shard gets one row per pair that it holds
    answers = asked.select("shard", "pair").join(counted, "pair").groupBy("shard", "pair").agg(F.first("n").alias("n"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def score(key, rows: pa.Table, known: pa.Table) -> pa.Table:
        pair, n = known.column("pair").to_numpy(), known.column("n").to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        n_best, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        at = 0
        for b in rows.to_batches():
            doc = np.arange(b.num_rows)

            def add(owner, times, count, top):
                # exact sums of whole numbers, by document
                t = np.zeros(b.num_rows + 1, np.int64)
                np.add.at(t, owner, times * count)
                total[at:at + b.num_rows] += t[:-1]
                t[:] = 0
                np.add.at(t, owner, np.where(count == top, times, 0))
                n_best[at:at + b.num_rows] += t[:-1]

            a, times = _flat(b, "same"), _flat(b, "same_n").astype(np.int64)
            add(np.repeat(doc, np.diff(np.asarray(b.column("same").offsets))), times, same[a], best[a])
            p, times = _flat(b, "pair"), _flat(b, "pair_n").astype(np.int64)
            if len(p):
                add(np.repeat(doc, np.diff(np.asarray(b.column("pair").offsets))), times, n[np.searchsorted(pair, p)], best[p >> 20])
            at += b.num_rows
        out = {k: rows.column(k) for k in names if k not in ("n_best", "count_sum")}
        out["n_best"], out["count_sum"] = pa.array(n_best), pa.array(total)
        return pa.table([out[k] for k in names], names=names)

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return held.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(score, kinds)
