"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bulk-synchronous best-fit decreasing:

1. Documents are tokenised and cut; pieces (one small row each) are written
   to the checkpoint folder.
2. Pieces are range-sorted by (length, id) over the cluster.  Lengths are
   whole numbers up to the capacity, so the sorted order is a list of *runs*
   - all pieces of one length - and the gaps, sorted the same way, are runs
   of sequences with the same room left.
3. One round per run of pieces, longest first: a successor sweep over the
   gap runs finds the smallest gap that holds the length.  All pieces of the
   run compete for it at once; conflicts are resolved by rank (the k-th piece
   of the run takes the k-th sequence of the gap run, the rest sweep on to
   the next larger gap, and what finds none opens new sequences).  The gaps
   used shrink and join the run of their new size; the next round follows.
4. A round is recorded as intervals (length, ranks, first sequence, offset).
   Every task matches its own sorted pieces against the intervals by rank.

The sweeps see runs, not rows: at most ``capacity`` lengths and a number of
gap runs bounded by the capacity, however many documents there are.  What
reaches the driver is one count per (sorted partition, length), at most
partitions + capacity rows, since a length spans neighbouring partitions.
A third of all documents with one length is simply a long run, spread over
many sorted partitions.
"""

from __future__ import annotations

import bisect
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm.bpe import Shard
from ticklake.llm.common import bounded_batches, cut, process_cache, ranges, release, texts_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes take code points from 256 up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(path: str):
    """Encoder of single pre-tokens with the vocabulary of a byte-level tokenizers file."""
    import public_tokenizers
    import tiktoken

    def build():
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        special = {t["content"] for t in held.get("added_tokens", [])}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return process_cache(("tokenizer", path), build)


def _added(path: str) -> list[str]:
    """Texts of the file's added tokens: in a document they are tokens, whatever surrounds them."""

    def build():
        with open(path, encoding="utf-8") as f:
            return [t["content"] for t in json.load(f).get("added_tokens", [])]

    return process_cache(("added", path), build)


def _library(path: str):
    from tokenizers import Tokenizer
    return process_cache(("library", path), lambda: Tokenizer.from_file(path))


class _WordIds(Shard):
    """A shard whose distinct matches are encoded by the tokenizer library."""

    def __init__(self, path: str):
        super().__init__(None)
        self.path = path

    def encode(self):
        encode = _encoder(self.path).encode_ordinary
        each = [encode(w) for w in self.number]
        size = np.fromiter(map(len, each), np.int64, len(each))
        at = np.cumsum(size) - size
        ids = np.fromiter((i for e in each for i in e), np.uint32, int(size.sum()))
        for d in self.docs:
            yield ids[ranges(at[d], size[d])]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False,
           shard_bytes: int = 32 << 20) -> DataFrame:
    """Token pieces of every whole text: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    A document is its ids followed by ``end_id``; longer ones are cut into
    pieces of ``capacity``, the remainder first.  Null or empty text: the
    end id alone.
    """

    def cut_points(n):
        r = n % capacity or min(n, capacity)
        return [0, *range(r, n + 1, capacity)]

    def run(batches):
        held, shard = [], _WordIds(path)

        def flush():
            gen = shard.encode()
            for ids_col, own in held:
                cols = [[], [], [], [], []]
                kept = []
                for row, doc in enumerate(ids_col.to_pylist()):
                    ids = next(gen)
                    ids = np.append(own.get(row, ids), np.uint32(end_id)).astype("<u4")
                    at = cut_points(len(ids))
                    for k in range(len(at) - 1):
                        part = ids[at[k]:at[k + 1]]
                        for c, v in zip(cols, (doc, k, at[k], len(part), zlib.crc32(part.tobytes()))):
                            c.append(v)
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    off = np.concatenate([[0], np.cumsum([len(a) for a in kept])]).astype(np.int32)
                    flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(off), pa.array(flat)))
                    names.append("ids")
                yield pa.record_batch(out, names=names)

        for b in batches:
            text, own = b.column("text"), {}
            for token in _added(path):
                text_has = pc.fill_null(pc.match_substring(b.column("text"), token), False)
                for row in np.flatnonzero(text_has.to_numpy(zero_copy_only=False)).tolist():
                    # texts that name an added token go through the library whole
                    own[row] = np.array(_library(path).encode(b.column("text")[row].as_py(), add_special_tokens=False).ids, np.uint32)
                text = pc.if_else(text_has, "", text)
            shard.add(*texts_of(text))
            held.append((b.column("doc_id"), own))
            if shard.bytes >= shard_bytes:
                yield from flush()
                held, shard = [], _WordIds(path)
        yield from flush()

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bounded_batches(src).mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit over runs: intervals (length, first rank, count, first sequence, offset).

    ``counts``: pieces by length.  ``gaps``: room left -> runs (first
    sequence, count); ``sizes`` holds the rooms present, ascending.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    plan: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def give(room, first, count):
        if room == 0:
            return
        if room not in gaps:
            gaps[room] = []
            bisect.insort(sizes, room)
        runs = gaps[room]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + count)
        else:
            runs.append((first, count))

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            i = bisect.bisect_left(sizes, length)  # the successor: smallest gap that holds the length
            if i == len(sizes):
                # none left: open as many sequences as the rest fills with this length
                opened = -(-todo // (capacity // length))
                give(capacity, fresh, opened)
                fresh += opened
                continue
            room = sizes[i]
            first, count = gaps[room].pop()
            take = min(count, todo)
            if take < count:
                gaps[room].append((first + take, count - take))
            elif not gaps[room]:
                del gaps[room]
                sizes.pop(i)
            plan.append((length, rank, take, first, capacity - room))
            give(room - length, first, take)
            rank += take
            todo -= take
    return plan


def pack(cut_pieces: DataFrame, capacity: int = 1024, partitions: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``length`` between 1 and ``capacity``).

    Other columns pass through.  Ties in length are broken by (doc_id,
    piece); repeated rows are separate pieces; an empty table stays empty.
    Pieces of null or non-positive length take no room: they are left out.
    """
    spark = cut_pieces.sparkSession
    held = cut(cut_pieces.where("length > 0"), "pieces")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(
        held.repartitionByRange(n, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
        .withColumn("_at", F.monotonically_increasing_id()), "sorted-pieces")
    release(held)
    runs = (
        rows.groupBy(F.shiftright("_at", 33).alias("part"), F.col("length"))
        .agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("part", "length").collect())
    totals: dict[int, int] = {}
    base = []
    for r in runs:
        base.append((r["part"] * (capacity + 1) + r["length"], r["first"], totals.get(r["length"], 0)))
        totals[r["length"]] = totals.get(r["length"], 0) + r["n"]
    if any(length > capacity for length in totals):
        raise ValueError(f"a piece is longer than the capacity {capacity}")
    base = np.array(sorted(base), np.int64).reshape(-1, 3)
    plan = np.array(sorted(sweep(totals, capacity)), np.int64).reshape(-1, 5)
    span = np.int64(1) << np.int64(40)

    def place(batches):
        key = plan[:, 0] * span + plan[:, 1]
        for b in batches:
            at = b.column("_at").to_numpy(zero_copy_only=False)
            length = b.column("length").to_numpy(zero_copy_only=False)
            i = np.searchsorted(base[:, 0], (at >> 33) * (capacity + 1) + length)
            rank = at - base[i, 1] + base[i, 2]
            k = np.searchsorted(key, length * span + rank, side="right") - 1
            seq = plan[k, 3] + rank - plan[k, 1]
            out = b.drop_columns(["_at"])
            yield pa.record_batch([*out.columns, pa.array(seq), pa.array(plan[k, 4])], names=[*out.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in held.dtypes) + ", sequence_id long, offset long"
    return rows.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents (see ``pieces`` and ``pack``)."""
    return pack(pieces(docs, path, capacity, end_id, keep_ids), capacity)
