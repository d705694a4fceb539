"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A shard of documents (a partition, cut at ``shard_bytes``) is split into
matches of the pre-tokenising pattern; the shard's distinct matches form one
flat symbol array.  An inverted index from token pair (named by the rank its
concatenation has) to positions in that array lists where each merge
applies.  Ranks are replayed in order: one numpy step applies a merge at all
its positions, and only the two neighbours of each merged position are looked
up again and posted to the index.  Words never interact, so shards give the
ids that one replay over the whole corpus would.

Null and empty texts have no ids.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticklake.llm.common import bounded_batches, doc_chunks, process_cache, ranges, texts_of, word_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points that the pattern's white-space class holds (fixed by Unicode's White_Space property).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings of contractions after an apostrophe (fixed by the pattern), longest first per initial.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    import unicodedata

    def build():
        t = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                t[c] = LETTER
            elif k == "N":
                t[c] = NUMBER
        t[WHITE] = SPACE
        return t

    return process_cache("char-classes", build)


def split_points(codes: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in ``codes`` (code points of documents laid end to end).

    ``doc_start`` marks the first code point of each document; the matches
    cover the text without gaps, so starts say everything.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = _classes()[codes]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= doc_start
    run = np.flatnonzero(start)
    end = np.append(run[1:], n)
    kind = cls[run]
    # a white-space run gives its last character up when text follows: to the next match if it is
    # a plain space, else as a match of its own
    last = end - 1
    follows = np.zeros(len(run), bool)
    follows[:-1] = ~doc_start[run[1:]]
    gives = (kind == SPACE) & follows
    plain = gives & (codes[last] == 32)
    start[last[gives]] = True
    start[end[plain]] = False
    # contractions: a lone apostrophe that starts a match, followed by one of the endings
    lone = np.flatnonzero((kind == OTHER) & (end - run == 1) & (codes[run] == 39) & follows)
    if len(lone):
        lone = lone[start[run[lone]] & (kind[np.minimum(lone + 1, len(run) - 1)] == LETTER)]
        pad = np.concatenate([codes, np.zeros(2, codes.dtype)])
        p = run[lone]
        c1, c2, room = pad[p + 1], pad[p + 2], end[lone + 1] - end[lone] if len(lone) else np.zeros(0, int)
        size = np.zeros(len(p), np.int64)
        for ending in CONTRACTIONS:
            if len(ending) == 1:
                hit = c1 == ord(ending)
            else:
                hit = (c1 == ord(ending[0])) & (c2 == ord(ending[1])) & (room >= 2)
            size = np.where((size == 0) & hit, len(ending), size)
        for at, k, r in zip(p[size > 0], size[size > 0], room[size > 0]):
            start[at + 1] = False
            if k < r:
                start[at + 1 + k] = True
    return np.flatnonzero(start)


class Ranks:
    """A rank file prepared for replay."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        n = len(tokens)
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs, out = [], []
        late = np.zeros(n, bool)  # tokens inside an earlier-ranked token: a merge may then enable a lower rank
        for s, r in rank.items():
            for i in range(1, len(s)):
                a, b = rank.get(s[:i]), rank.get(s[i:])
                if a is not None and a > r:
                    late[a] = True
                if b is not None and b > r:
                    late[b] = True
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    out.append(r)
        pairs, out = np.array(pairs, np.int64), np.array(out, np.int64)
        order = np.argsort(pairs)
        self.pairs, self.out, self.late = pairs[order], out[order], late
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.offs = np.cumsum(self.lens) - self.lens

    @classmethod
    def load(cls, path: str) -> "Ranks":
        def build():
            held = {}
            with open(path, "rb") as f:
                for line in f:
                    if line.strip():
                        token, r = line.split()
                        held[int(r)] = base64.b64decode(token)
            return cls([held[i] for i in range(len(held))])

        return process_cache(("ranks", path), build)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the concatenation of each pair, -1 where it is no token."""
        key = a << 32 | b
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[i] == key, self.out[i], -1)

    def replay(self, data: np.ndarray, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words laid end to end, and the index where each word's ids start (n + 1)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(len(word_start) + 1, np.int64)
        sym = self.byte[data]
        word = np.zeros(n, np.int64)
        word[word_start[1:]] = 1
        np.cumsum(word, out=word)
        nxt = np.arange(1, n + 1)
        prv = np.arange(-1, n - 1)
        nxt[word_start[1:] - 1] = -1
        nxt[n - 1] = -1
        prv[word_start] = -1
        # the inverted index: rank of the pair -> positions of its left symbol
        post: dict[int, list[np.ndarray]] = {}
        left = np.flatnonzero(nxt >= 0)
        r = self.of(sym[left], sym[left + 1])
        heap: list[int] = []

        def add(rank, pos):
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, pos = rank[order], pos[order]
            edge = np.flatnonzero(np.diff(rank)) + 1
            lo = [0, *edge.tolist(), len(rank)]
            for i in range(len(lo) - 1):
                k = int(rank[lo[i]])
                if k in post:
                    post[k].append(pos[lo[i]:lo[i + 1]])
                else:
                    post[k] = [pos[lo[i]:lo[i + 1]]]
                    heapq.heappush(heap, k)

        keep = r >= 0
        add(r[keep], left[keep])
        alive = np.ones(n, bool)
        while heap:
            k = heapq.heappop(heap)
            held = post.pop(k)
            pos = np.sort(held[0]) if len(held) == 1 else np.unique(np.concatenate(held))
            pos = pos[alive[pos]]
            q = nxt[pos]
            ok = q >= 0
            pos, q = pos[ok], q[ok]
            ok = self.of(sym[pos], sym[q]) == k
            pos, q = pos[ok], q[ok]
            if not len(pos):
                continue
            if self.late[k]:  # leftmost of each word only; the rest wait for lower ranks that may appear
                first = np.ones(len(pos), bool)
                first[1:] = word[pos[1:]] != word[pos[:-1]]
                if not first.all():
                    post[k] = [pos[~first]]
                    heapq.heappush(heap, k)
                    pos, q = pos[first], q[first]
            elif len(pos) > 1:
                touch = pos[1:] == q[:-1]
                if touch.any():  # overlapping pairs: every other one of a chain, from the left
                    begin = np.ones(len(pos), bool)
                    begin[1:] = ~touch
                    at = np.flatnonzero(begin)
                    rank_in = np.arange(len(pos)) - np.repeat(at, np.diff(np.append(at, len(pos))))
                    even = rank_in % 2 == 0
                    pos, q = pos[even], q[even]
            sym[pos] = k
            alive[q] = False
            after = nxt[q]
            nxt[pos] = after
            has = after >= 0
            prv[after[has]] = pos[has]
            before = prv[pos]
            lhs = np.concatenate([before[before >= 0], pos[has]])
            if len(pos) > 1 and (after[:-1] == pos[1:]).any():  # neighbours that both merged share a pair
                lhs = np.unique(lhs)
            rr = self.of(sym[lhs], sym[nxt[lhs]])
            hit = rr >= 0
            add(rr[hit], lhs[hit])
        kept = np.flatnonzero(alive)
        first = np.searchsorted(kept, word_start)
        return sym[kept], np.append(first, len(kept))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids."""
        return self.flat[ranges(self.offs[ids], self.lens[ids])]


class Shard:
    """Distinct matches of a run of documents and the documents as rows of match numbers."""

    CHUNK = 1 << 19

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.number: dict[str, int] = {}
        self.docs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        for i, j in doc_chunks(offsets, self.CHUNK):
            lo, hi = int(offsets[i]), int(offsets[j])
            raw = data[lo:hi]
            text = raw.tobytes().decode("utf-8")
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            # byte offsets -> code-point offsets
            lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if len(raw) != len(codes) else None
            rel = offsets[i:j + 1] - lo
            doc_at = lead[rel] if lead is not None else rel
            mark = np.zeros(len(codes), bool)
            mark[doc_at[:-1][doc_at[:-1] < len(codes)]] = True
            start = split_points(codes, mark)
            end = np.append(start[1:], len(codes))
            _, first, inverse = np.unique(word_hashes(codes, start, end), return_index=True, return_inverse=True)
            number = self.number
            glob = np.fromiter(
                (number.setdefault(text[a:b], len(number)) for a, b in zip(start[first].tolist(), end[first].tolist())),
                np.int32, len(first))
            words = glob[inverse]
            # matches of one hash are compared letter by letter with their first
            size, like = end - start, first[inverse]
            other = codes != codes[np.minimum(ranges(start[like], size), len(codes) - 1)]
            for k in np.flatnonzero((size != size[like]) | np.logical_or.reduceat(other, start)).tolist() if len(start) else ():
                words[k] = number.setdefault(text[start[k]:end[k]], len(number))
            at = np.searchsorted(start, doc_at)
            self.docs += [words[at[k]:at[k + 1]] for k in range(j - i)]
            self.bytes += hi - lo

    def encode(self):
        """Yields each document's ids (int64 array), in order."""
        words = [w.encode("utf-8") for w in self.number]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(lens) - lens
        ids, at = self.ranks.replay(np.frombuffer(b"".join(words), np.uint8), start)
        size = np.diff(at)
        for d in self.docs:
            yield ids[ranges(at[d], size[d])]


def encode_batches(batches, path: str, shard_bytes: int, emit):
    """Drives shards over Arrow batches with a ``text`` column; ``emit(batch, ids list)`` makes the output batch."""
    ranks = Ranks.load(path)
    held, shard = [], Shard(ranks)

    def flush():
        gen = shard.encode()
        for b in held:
            yield emit(ranks, b, (next(gen) for _ in range(b.num_rows)))

    for b in batches:
        data, offsets = texts_of(b.column("text"))
        shard.add(data, offsets)
        held.append(b.drop_columns(["text"]))
        if shard.bytes >= shard_bytes:
            yield from flush()
            held, shard = [], Shard(ranks)
    yield from flush()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 48 << 20) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text.  Null or empty text: an empty array."""

    def run(batches):
        def emit(_, b, each):
            arrays = [a.astype(np.int32) for a in each]
            off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            return pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["doc_id", "ids"])

        yield from encode_batches(batches, path, shard_bytes, emit)

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return bounded_batches(src).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, data binary)``: the bytes that ``ids`` stand for.  Null ids: empty."""

    def run(batches):
        ranks = Ranks.load(path)
        for b in batches:
            out = [ranks.decode(np.array(x or [], np.int64)).tobytes() for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "data"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, shard_bytes: int = 48 << 20) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the bytes they decode to.

    Encoding and decoding run in one pass, so the ids themselves never leave
    the task.  Null or empty text: no ids, digests of nothing.  Repeated rows
    each give a row; extra columns are ignored; an empty table gives none.
    """

    def run(batches):
        def emit(ranks, b, each):
            n, a, d = [], [], []
            for ids in each:
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(ranks.decode(ids).tobytes()).hexdigest())
            return pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        yield from encode_batches(batches, path, shard_bytes, emit)

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bounded_batches(src).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
