"""Removal of repeated byte passages by depth-limited radix sort of suffixes.

Every window of ``width`` bytes is the head of a suffix; suffixes need be
ordered only through their first ``width`` bytes, and those left equal are
exactly the repeated windows.  The sort runs most significant digit first
and drops a suffix as soon as it stands alone:

* Digit 1 is the window's *anchor*: the 64-byte gram with the smallest hash
  inside the window.  Equal windows have equal anchors at equal offsets, so
  one row per anchor (about 1 in 70 bytes) stands for all windows that have
  it.  Anchors are dealt out by gram; those whose gram occurs once are
  dropped.
* Digit 2 is the whole surrounding of the anchor, all bytes its windows can
  reach.  A surrounding that occurs twice is finished: every window in it is
  repeated.
* Digit 3, for the rest (anchors at the edge of a repeated passage), is the
  window itself: for each offset the windows of one gram are ordered by
  content, one row per distinct surrounding.  Equal groups are the repeats.

Hot groups.  A task first settles what it can see alone: of equal texts it
sends one (the others lose everything), and of a gram with more than
``HEAVY`` surroundings in the task it sends a few as witnesses, the rest
skip digit 1, known to be repeated.  So one gram sends a bounded number of
rows per task to one place.  Grams that are heavy somewhere, or have more than
``LIMIT`` surroundings, have their windows dealt out one by one, by content,
with map-side combine and a join that adaptive execution splits.

Texts move once, and only those that a bitmap of fixed size does not rule
out (its false positives cost a move, never a result).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import Prefix, bounded_batches, cut, doc_chunks, mix64, ranges, texts_of

GRAM = 64
CHUNK = 1 << 19
HEAVY = 4096
LIMIT = 16384
SHARD = 64 << 20
BLOCK = 1 << 16
MAP_BITS = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: What became of an anchor.
WHOLE, FEW, MANY, COPY = 0, 1, 2, 3


def _sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over each run of ``w`` values (block prefixes and suffixes)."""
    n = len(a)
    if n < w:
        return a[:0]
    b = np.concatenate([a, np.full(-n % w, a[-1], a.dtype)]).reshape(-1, w)
    pre = op.accumulate(b, axis=1).ravel()
    suf = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(suf[:n - w + 1], pre[w - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int):
    """Anchors of documents laid end to end: positions, gram hashes, surrounding hashes, and each document's first (n + 1)."""
    n, w = len(data), width - GRAM + 1
    if n < width:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(len(offsets), np.int64)
    p = Prefix(data)
    gram = p.window(GRAM) | np.uint64(1)
    low = _sliding(gram, w, np.minimum)  # of each window start
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    low[np.arange(len(low)) + width > doc_end[:len(low)]] = 0
    # a gram is an anchor if it is the least of some window that holds it
    high = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    pos = np.flatnonzero(high == gram)
    at = np.searchsorted(pos, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    lo = np.maximum(pos - (w - 1), offsets[doc])
    hi = np.minimum(pos + width, offsets[doc + 1])
    around = mix64(p.hash(lo, hi) + (pos - lo).astype(np.uint64) * _STEP)
    return pos, gram[pos].view(np.int64), around.view(np.int64), at


def _new(*columns) -> np.ndarray:
    """True where a sorted row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _marks(src: DataFrame, width: int) -> DataFrame:
    """Digit 1's rows: ``deal, gram, around, key, n, kind``.

    ``n``: occurrences of the surrounding in this document (and its local
    copies).  ``kind``: FEW to be ordered by gram, MANY already known to
    belong to a heavy gram (witnesses are sent too), COPY a whole text.
    """

    def rows(deal, gram, around, key, n, kind):
        return pa.record_batch(
            [pa.array(deal), pa.array(gram), pa.array(around), pa.array(key), pa.array(n.astype(np.int32)), pa.array(kind.astype(np.int8))],
            names=["deal", "gram", "around", "key", "n", "kind"])

    def settle(held, copies, twice):
        keys = np.array([k for k, _ in held], np.int64)
        size = np.array([len(g) for _, (g, _) in held], np.int64)
        doc = np.repeat(np.arange(len(held)), size)
        gram = np.concatenate([g for _, (g, _) in held]) if held else np.zeros(0, np.int64)
        around = np.concatenate([a for _, (_, a) in held]) if held else np.zeros(0, np.int64)
        order = np.lexsort((doc, around, gram))
        gram, around, doc = gram[order], around[order], doc[order]
        first = np.flatnonzero(_new(gram, around, doc))
        n = np.diff(np.append(first, len(gram)))
        gram, around, doc = gram[first], around[first], doc[first]
        n = n + np.isin(doc, np.fromiter(twice, np.int64, len(twice)))
        # surroundings of each gram in this task
        other = _new(gram, around)
        group = np.cumsum(_new(gram)) - 1 if len(gram) else np.zeros(0, np.int64)
        kinds = np.bincount(group, weights=other).astype(np.int64) if len(gram) else np.zeros(0, np.int64)
        rank = np.cumsum(other) - 1
        rank -= rank[np.flatnonzero(_new(gram))][group] if len(gram) else 0
        heavy = kinds[group] > HEAVY if len(gram) else np.zeros(0, bool)
        skip = heavy & (rank >= 2)
        kind = np.where(heavy, MANY, FEW)
        deal = np.where(skip, mix64(gram.view(np.uint64) + around.view(np.uint64)).view(np.int64), gram)
        # heavy rows all go by surrounding; the first two surroundings also go by gram, as witnesses
        both = np.concatenate([np.arange(len(gram)), np.flatnonzero(heavy & ~skip)])
        deal = np.concatenate([deal, mix64(gram.view(np.uint64) + around.view(np.uint64)).view(np.int64)[heavy & ~skip]])
        witness = np.concatenate([heavy & ~skip, np.zeros((heavy & ~skip).sum(), bool)])
        kind = np.where(witness, COPY + 1, kind[both])
        copies = np.array(copies, np.int64)
        yield rows(np.concatenate([deal, mix64(copies.view(np.uint64)).view(np.int64)]), np.concatenate([gram[both], copies * 0]),
                   np.concatenate([around[both], copies * 0]), np.concatenate([keys[doc[both]] if len(keys) else doc[both], copies]),
                   np.concatenate([n[both], copies * 0]), np.concatenate([kind, np.full(len(copies), COPY)]))

    def run(batches):
        held, copies, twice, seen, total = [], [], set(), {}, 0
        for b in batches:
            data, offsets = texts_of(b.column("text"))
            key = b.column("key").to_pylist()
            for i, j in doc_chunks(offsets, CHUNK):
                base = offsets[i]
                part = data[base:offsets[j]]
                at = offsets[i:j + 1] - base
                fresh = []
                for k in range(j - i):
                    if at[k + 1] - at[k] < width:
                        continue
                    d = hashlib.blake2b(part[at[k]:at[k + 1]].data, digest_size=16).digest()
                    if d in seen:
                        twice.add(seen[d])
                        copies.append(key[i + k])
                    else:
                        seen[d] = len(held) + len(fresh)
                        fresh.append(k)
                if fresh:
                    _, gram, around, first = anchors(part, at, width)
                    held += [(key[i + k], (gram[first[k]:first[k + 1]], around[first[k]:first[k + 1]])) for k in fresh]
                total += len(part)
            if total >= SHARD:
                yield from settle(held, copies, twice)
                held, copies, twice, seen, total = [], [], set(), {}, 0
        if held or copies:
            yield from settle(held, copies, twice)

    return src.select("key", "text").mapInArrow(run, "deal long, gram long, around long, key long, n int, kind byte")


def _repeated(marks: DataFrame) -> DataFrame:
    """Anchors of grams that occur more than once: ``key, gram, around, kind, sends``.

    ``kind`` WHOLE: the surrounding is repeated, nothing is left to order.
    ``sends``: this document's bytes stand for the surrounding at digit 3.
    """

    def block(t):
        deal, gram, around, key, n, kind = (t.column(c).to_numpy() for c in ("deal", "gram", "around", "key", "n", "kind"))
        copy, witness = kind == COPY, kind == COPY + 1
        group = np.cumsum(_new(deal)) - 1
        one = _new(deal, gram, around)
        surrounding = np.cumsum(one) - 1
        # a surrounding's witness and its own rows never share a deal, except by chance; both count once
        times = np.bincount(surrounding, weights=n)[surrounding]
        total = np.bincount(group, weights=n)[group]
        distinct = np.bincount(group, weights=one)[group]
        heavy = np.bincount(group, weights=witness | (kind == MANY))[group] > 0
        kinds = np.where(heavy | (distinct > LIMIT), MANY, FEW)
        kinds = np.where(times > 1, WHOLE, kinds)
        kinds = np.where(copy, COPY, kinds)
        sends = one & ~copy & (heavy | (distinct > 1))
        way = np.where(heavy | (distinct > LIMIT), MANY, FEW)
        keep = ((total > 1) | heavy | copy) & ~witness
        # witnesses are sent again under their own surrounding, so their first row there sends the bytes
        out = np.flatnonzero(keep)
        return pa.record_batch(
            [pa.array(key[out]), pa.array(gram[out]), pa.array(around[out]), pa.array(kinds[out].astype(np.int8)), pa.array(way[out].astype(np.int8)),
             pa.array(sends[out])], names=["key", "gram", "around", "kind", "way", "sends"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            deal = t.column("deal").to_numpy()
            last = int(np.searchsorted(deal, deal[-1])) if len(deal) else 0
            if last >= BLOCK:
                yield block(t.slice(0, last))
                rest = t.slice(last)
            else:
                rest = t
        if rest is not None and rest.num_rows:
            yield block(rest)

    return marks.repartition("deal").sortWithinPartitions("deal", "gram", "around").mapInArrow(
        run, "key long, gram long, around long, kind byte, way byte, sends boolean")


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << MAP_BITS))


def _key_map(keys: DataFrame) -> np.ndarray:
    """Bitmap of hashed keys: 2**MAP_BITS bits, whatever the number of keys."""
    b = keys.select((_bit(F.col("key")) + 1).alias("b"))
    rows = b.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint8)
        at = (r["k"] - 1) * len(bits)
        out[at:at + len(bits)] = bits[:len(out) - at]
    return out


def _listed(src: DataFrame, bits: np.ndarray, inside: bool) -> DataFrame:
    """Rows whose key is (not) in the bitmap."""
    held = bits.tobytes()

    def run(batches):
        own = np.frombuffer(held, np.uint8)
        for b in batches:
            at = b.column("bit").to_numpy()
            hit = (own[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            out = b.drop_columns(["bit"]).filter(pa.array(hit == inside))
            if out.num_rows:
                yield out

    return src.withColumn("bit", _bit(F.col("key"))).mapInArrow(run, src.schema)


def _contexts(asked: DataFrame, width: int, then=None, schema: str = "key long, gram long, around long, whole boolean, left short, bytes binary") -> DataFrame:
    """Bytes left and right of the anchors that ``want`` lists: ``key, gram, around, whole, left, bytes``.

    ``then`` goes on with these batches in the same process and gives rows of ``schema``.
    """
    w = width - GRAM + 1

    def run(batches):
        for b in batches:
            data, offsets = texts_of(b.column("text"))
            want = b.column("want").combine_chunks() if isinstance(b.column("want"), pa.ChunkedArray) else b.column("want")
            lists = want.flatten()
            size = np.diff(want.offsets.to_numpy()) if len(want) else np.zeros(0, np.int64)
            begin = np.cumsum(size) - size
            asked_gram, asked_around, asked_whole = (lists.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            key = b.column("key").to_numpy()
            for i, j in doc_chunks(offsets, CHUNK):
                base = offsets[i]
                part = data[base:offsets[j]]
                pos, _, around, at = anchors(part, offsets[i:j + 1] - base, width)
                out = []
                for k in range(j - i):
                    s = begin[i + k]
                    mine, here = asked_around[s:s + size[i + k]], around[at[k]:at[k + 1]]
                    order = np.argsort(here, kind="stable")
                    place = np.searchsorted(here, mine, sorter=order)
                    place = np.minimum(place, len(here) - 1)
                    if not len(here):
                        continue
                    q = order[place]
                    ok = here[q] == mine
                    out.append((np.full(ok.sum(), i + k), s + np.flatnonzero(ok), pos[at[k] + q[ok]]))
                if not out:
                    continue
                doc, item, p = (np.concatenate(x) for x in zip(*out))
                lo = np.maximum(offsets[doc] - base, p - (w - 1))
                hi = np.minimum(offsets[doc + 1] - base, p + width)
                left, right = p - lo, hi - (p + GRAM)
                # left bytes, then right bytes; the gram itself is equal in the whole group
                starts = np.stack([lo, p + GRAM], axis=1).ravel()
                lens = np.stack([left, right], axis=1).ravel()
                flat = part[ranges(starts, lens)]
                off = np.concatenate([[0], np.cumsum(left + right)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.record_batch(
                    [pa.array(key[doc]), pa.array(asked_gram[item]), pa.array(asked_around[item]), pa.array(asked_whole[item]),
                     pa.array(left.astype(np.int16)), raw], names=["key", "gram", "around", "whole", "left", "bytes"])

    # the other columns are not used: with them, this and the final pass read the same shuffle of the texts
    return asked.mapInArrow(run if then is None else lambda batches: then(run(batches)), schema)


def _window_hashes(left: np.ndarray, raw: pa.Array, w: int):
    """For each row and offset: hash of the window that starts ``offset`` bytes before the anchor, and if it lies in the text.

    A row's bytes are laid so that the anchor is at column ``w - 1``; the
    window of offset ``o`` is then columns ``w - 1 - o`` to ``2 (w - 1) - o``.
    """
    data, off = texts_of_binary(raw)
    size = np.diff(off)
    span = 2 * (w - 1)
    m = np.zeros((len(size), span), np.uint8)
    shift = (w - 1) - left.astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    m[row, np.arange(len(data)) - np.repeat(off[:-1] - shift, size)] = data
    p = Prefix(m.ravel())
    start = (np.arange(len(size)) * span)[:, None] + (w - 1 - np.arange(w))[None, :]
    h = p.hash(start.ravel(), start.ravel() + (w - 1)).reshape(len(size), w)
    o = np.arange(w)[None, :]
    ok = (o <= left[:, None]) & (w - 1 - o <= (size - left)[:, None])
    return h, ok


def texts_of_binary(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    _, off, data = raw.buffers()
    off = np.frombuffer(off, np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def _covers(key, around, cover: np.ndarray) -> pa.RecordBatch:
    hit = cover.any(axis=1)
    packed = np.packbits(cover[hit], axis=1)
    return pa.record_batch(
        [pa.array(key[hit]), pa.array(around[hit]), pa.array([r.tobytes() for r in packed], pa.binary())], names=["key", "around", "cover"])


def _last_digit(ctx: DataFrame, width: int) -> DataFrame:
    """``key, around, cover``: for each offset a bit, set where the window is repeated."""
    w = width - GRAM + 1

    def block(t):
        gram, around, key = (t.column(c).to_numpy() for c in ("gram", "around", "key"))
        once = np.flatnonzero(_new(gram, around))  # rows of one doc_id may have sent the same bytes twice
        t, gram, around, key = t.take(pa.array(once)), gram[once], around[once], key[once]
        left, raw = t.column("left").to_numpy(), t.column("bytes")
        hashes, ok = np.empty((w, len(gram)), np.uint64), np.empty((w, len(gram)), bool)
        for i in range(0, len(gram), 512):  # hashed a few rows at a time: the prefix sums are the largest arrays
            h, inside = _window_hashes(left[i:i + 512], raw.slice(i, 512), w)
            h += gram[i:i + 512].view(np.uint64)[:, None] + np.arange(w, dtype=np.uint64)[None, :] * _STEP
            hashes[:, i:i + 512], ok[:, i:i + 512] = mix64(h).T, inside.T
        cover = np.zeros((len(gram), w), bool)
        for o in range(w):  # ordered one offset at a time: only windows of one offset can be equal
            at = np.flatnonzero(ok[o])
            s = hashes[o, at]
            order = np.argsort(s)
            s = s[order]
            same = np.zeros(len(s), bool)
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= same[1:].copy()
            cover[at[order[same]], o] = True
        cover[t.column("whole").to_numpy(zero_copy_only=False)] = False  # settled by digit 2
        return _covers(key, around, cover)

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            while t.num_rows > 1024:  # blocks of whole groups
                gram = t.column("gram").to_numpy()
                end = int(np.searchsorted(gram, gram[1024], side="right"))
                if end == t.num_rows:
                    break
                yield block(t.slice(0, end))
                t = t.slice(end)
            rest = t
        if rest is not None and rest.num_rows:
            yield block(rest)

    return ctx.repartition("gram").sortWithinPartitions("gram", "around").mapInArrow(run, "key long, around long, cover binary")


def _dealt_out(asked: DataFrame, width: int) -> DataFrame:
    """The same for heavy grams: every window is dealt out by its content."""
    w = width - GRAM + 1

    def spread(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                t = b.slice(i, 512)
                gram, around, key = (t.column(c).to_numpy() for c in ("gram", "around", "key"))
                h, ok = _window_hashes(t.column("left").to_numpy(), t.column("bytes"), w)
                h += gram.view(np.uint64)[:, None] + np.arange(w, dtype=np.uint64)[None, :] * _STEP
                h = mix64(h).view(np.int64)
                r, o = np.nonzero(ok)
                yield pa.record_batch(
                    [pa.array(h[r, o]), pa.array(key[r]), pa.array(around[r]), pa.array(o.astype(np.int16)),
                     t.column("whole").take(pa.array(r))], names=["content", "key", "around", "o", "whole"])

    def gather(t):
        cover = np.zeros((1, w), bool)
        cover[0, t.column("o").to_numpy()] = True
        return pa.Table.from_batches([_covers(t.column("key")[:1].to_numpy(), t.column("around")[:1].to_numpy(), cover)])

    # (bytes found and dealt out by one Python process: two in a row would each hold its own memory)
    each = _contexts(asked, width, spread, "content long, key long, around long, o short, whole boolean")
    # one surrounding may come from two documents here: a heavy gram's rows and other tasks' rows do not meet before
    twice = each.groupBy("content").agg(
        F.min("around").alias("a"), F.max("around").alias("b"), F.min("key").alias("c"), F.max("key").alias("d")).where(
        "a <> b OR c <> d").select("content")
    return each.where("NOT whole").join(twice, "content").select("key", "around", "o").groupBy("key", "around").applyInArrow(
        gather, "key long, around long, cover binary")


def _removed(joined: DataFrame, width: int, with_text: bool, keep: list[str]) -> DataFrame:
    """The results of documents whose ``want`` lists settled anchors (null: none)."""
    w = width - GRAM + 1

    def one(part, around, whole, cover):
        if (whole == COPY).any():
            return np.ones(len(part), bool)
        covered = np.zeros(len(part) + 1, np.int32)
        pos, _, here, _ = anchors(part, np.array([0, len(part)]), width)
        full = pos[np.isin(here, around[whole == WHOLE])]
        np.add.at(covered, np.maximum(full - (w - 1), 0), 1)
        np.add.at(covered, np.minimum(full + width, len(part)), -1)
        some = np.flatnonzero(whole != WHOLE)
        if len(some):
            some = some[np.argsort(around[some], kind="stable")]
            at = np.searchsorted(around[some], here)
            at = np.minimum(at, len(some) - 1)
            hit = np.flatnonzero(around[some][at] == here)
            bits = np.unpackbits(np.frombuffer(b"".join(cover[k].as_py() for k in some[at[hit]].tolist()), np.uint8).reshape(len(hit), -1), axis=1, count=w)
            r, o = np.nonzero(bits)
            begin = pos[hit][r] - o
            begin = begin[(begin >= 0) & (begin + width <= len(part))]
            np.add.at(covered, begin, 1)
            np.add.at(covered, begin + width, -1)
        return np.cumsum(covered[:-1]) > 0

    def run(batches):
        for b in batches:
            data, offsets = texts_of(b.column("text"))
            want = b.column("want") if "want" in b.schema.names else None
            size, gone, spans, sha, text = [], [], [], [], []
            for i in range(b.num_rows):
                part = data[offsets[i]:offsets[i + 1]]
                out = None
                if want is not None and want[i].is_valid and len(want[i].values):
                    x = want[i].values
                    out = one(part, x.field(0).to_numpy(), x.field(1).to_numpy(), x.field(2))
                    kept = part[~out].tobytes()
                else:
                    kept = part.tobytes()
                spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if out is not None else 0)
                size.append(len(part))
                gone.append(len(part) - len(kept))
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    text.append(kept.decode("utf-8", "ignore"))
            cols = [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(text, pa.string()))
                names.append("kept_text")
            yield pa.record_batch([*cols, *(b.column(f"keep_{c}") for c in keep)], names=[*names, *keep])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    kinds = dict(joined.dtypes)
    return joined.drop("key").mapInArrow(run, schema + "".join(f", `{c}` {kinds[f'keep_{c}']}" for c in keep))


def remove_repeats(docs: DataFrame, width: int = 200, with_text: bool = True, keep: list[str] | None = None,
                   by_content: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``) of every row.

    Removes each byte covered by a window of ``width`` bytes that also starts
    anywhere else, in this document or another.  Windows are judged on the
    input and never cross documents.  Null text: empty.  A text shorter than
    ``width`` has no windows.  Equal texts of at least ``width`` bytes lose
    everything.  Bytes of a character cut in two are left out of
    ``kept_text``.  Rows with a null or repeated doc_id each give a row.
    ``keep`` names columns to carry along.  With ``by_content`` a row is known
    by a 64-bit hash of its id and text, so that unlike texts of one id share
    nothing; else by its id.
    """
    if width < GRAM + 8:
        raise ValueError(f"width must be at least {GRAM + 8}")
    keep = keep or []
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
                      *[docs[c].alias(f"keep_{c}") for c in keep])
    name = F.xxhash64("doc_id", "text") if by_content else F.coalesce("doc_id", F.xxhash64("text"))
    src = src.select(name.alias("key"), "doc_id", "text", *[f"keep_{c}" for c in keep])
    hit = cut(_repeated(_marks(bounded_batches(src), width)), "repeated-anchors")
    bits = _key_map(hit.select("key"))
    moved = _listed(src, bits, True)
    # (both digit-3 ways and the final pass read one shuffle of the texts)
    asks = lambda way: hit.where((F.col("way") == way) & F.col("sends")).groupBy("key").agg(
        F.collect_list(F.struct("gram", "around", (F.col("kind") == WHOLE).alias("whole"))).alias("want"))
    asked = lambda way: moved.join(asks(way), "key")
    covers = _last_digit(_contexts(asked(FEW), width), width).union(_dealt_out(asked(MANY), width))
    settled = hit.where(F.col("kind").isin(WHOLE, COPY)).select("key", "around", "kind", F.lit(None).cast("binary").alias("cover")).union(
        covers.select("key", "around", F.lit(FEW).cast("byte").alias("kind"), "cover"))
    want = settled.groupBy("key").agg(F.collect_list(F.struct("around", "kind", "cover")).alias("want"))
    return _removed(_listed(src, bits, False), width, with_text, keep).union(
        _removed(moved.join(want, "key", "left"), width, with_text, keep))
