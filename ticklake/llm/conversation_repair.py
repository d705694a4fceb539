"""Repair of damaged conversations by cheapest edits, with Four-Russians block tables.

A conversation is repaired by keeping, re-roling, deleting and inserting rows
until its role initials read ``(s?(ua)+)?``.  The automaton of that pattern
has four states, so what a suffix of a conversation costs is a vector of
four numbers; less its minimum it is one of a small set of vectors, because
two inserts lead from any state to any that follows.

* ``Blocks`` enumerates those vectors and tabulates, for every block of
  ``length`` row symbols and every vector behind the block, the vector before
  it and the cost added (nine symbols: four initials, truncated or not, and
  rows that must go).
* Conversations are read in *chunks*, bounded runs of rows.  A chunk maps the
  vector behind it to the vector before it, block by block through the table;
  these maps (one number per vector) are composed from the last chunk to the
  first.  Then a chunk knows the vector behind it, and maps the state it is
  entered in to the state it is left in; those are composed forwards.
* With state and vector known, each block is expanded backward into the
  costs of its rows, and the edits are read off forwards, in each place the
  ASCII-least letter among the cheapest.

Rows are numbered over a range sort, so a conversation of any size spreads
over many tasks; only its chunk maps are read in one stream.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm.common import bounded_batches, cut, process_cache

#: Prices of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: 0 nothing read, 1 after the system row, 2 after a user row, 3 after an assistant row.
STATES, ACCEPTING = 4, (0, 3)
#: State that a row of the wanted role leads to, and that role.
WANTED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
INITIALS = "sua?"
#: Faults of a row, the first that holds.
NONE, BLANK, DUPLICATE, TRUNC = range(4)
MUST_GO = 8
LEGAL = ("su", "ua", "au")
ROWS_TO_A_CHUNK_BITS = 13


def _follow(state: int, initial: int) -> int | None:
    """State after a kept row, None where the pattern has no such row."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    if initial == 2:
        return 3 if state == 2 else None
    return None


def symbol(initial: int, fault: int) -> int:
    """What the edits see of a row."""
    return MUST_GO if fault in (BLANK, DUPLICATE) else initial * 2 + (fault == TRUNC)


def _with_inserts(cost: list[int]) -> list[int]:
    """Costs-to-go when rows may also be inserted here."""
    cost = list(cost)
    for _ in range(STATES):
        for q in range(STATES):
            cost[q] = min(cost[q], INSERT + cost[WANTED[q]])
    return cost


def before(sym: int, after: list[int]) -> list[int]:
    """Costs-to-go of a row and what follows it, per state."""
    cost = []
    for q in range(STATES):
        ways = [DELETE + after[q]]
        if sym != MUST_GO:
            extra = TRUNCATED * (sym & 1)
            ways.append(REROLE + extra + after[WANTED[q]])
            kept = _follow(q, sym >> 1)
            if kept is not None:
                ways.append(extra + after[kept])
        cost.append(min(ways))
    return _with_inserts(cost)


AT_END = _with_inserts([0 if q in ACCEPTING else 10**6 for q in range(STATES)])


class Blocks:
    """The tables of blocks up to ``length`` symbols, and the traces of blocks met so far."""

    def __init__(self, length: int = 4):
        self.length = length
        self.vectors: list[tuple[int, ...]] = []
        number: dict[tuple[int, ...], int] = {}

        def named(v):
            low = min(v)
            v = tuple(x - low for x in v)
            if v not in number:
                number[v] = len(number)
                self.vectors.append(v)
            return number[v], low

        self.end, _ = named(AT_END)
        step, i = [], 0
        while i < len(self.vectors):
            step.append([named(before(s, list(self.vectors[i]))) for s in range(MUST_GO + 1)])
            i += 1
        one = np.array(step, np.int64)  # vector, symbol -> (vector before, cost added)
        n = len(self.vectors)
        #: tables[k][symbols as a number of k digits, the first the highest][vector behind]
        self.into = [np.arange(n)[None, :]]
        self.cost = [np.zeros((1, n), np.int64)]
        for _ in range(length):
            last, paid = self.into[-1], self.cost[-1]
            self.into.append(np.stack([one[last, s, 0] for s in range(MUST_GO + 1)]).reshape(-1, n))
            self.cost.append(np.stack([paid + one[last, s, 1] for s in range(MUST_GO + 1)]).reshape(-1, n))
        self.traces: dict[tuple[bytes, int, int], tuple[list[str], int]] = {}

    @classmethod
    def load(cls, length: int = 4) -> "Blocks":
        return process_cache(("blocks", length), lambda: cls(length))

    def cuts(self, symbols: bytes):
        """Whole blocks from the right; what is left over stands first."""
        r = len(symbols) % self.length
        return [symbols[:r]] * bool(r) + [symbols[i:i + self.length] for i in range(r, len(symbols), self.length)]

    def code(self, block: bytes) -> int:
        c = 0
        for s in block:
            c = c * (MUST_GO + 1) + s
        return c

    def map(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols: the vector before them and the cost added."""
        at = np.arange(len(self.vectors))
        paid = np.zeros(len(self.vectors), np.int64)
        for block in reversed(self.cuts(symbols)):
            c, k = self.code(block), len(block)
            paid += self.cost[k][c][at]
            at = self.into[k][c][at]
        return at, paid

    def behind(self, symbols: bytes, vector: int) -> tuple[list[bytes], list[int], int]:
        """Blocks, the vector behind each, and the vector before the first."""
        blocks, out = self.cuts(symbols), []
        for block in reversed(blocks):
            out.append(vector)
            vector = int(self.into[len(block)][self.code(block)][vector])
        return blocks, out[::-1], vector

    def expand(self, block: bytes, vector: int, state: int) -> tuple[list[str], int]:
        """Edits of each row of a block (inserts before it included) and the state behind it."""
        key = (block, vector, state)
        if key not in self.traces:
            costs = [list(self.vectors[vector])]
            for s in reversed(block):
                costs.append(before(s, costs[-1]))
            costs.reverse()
            edits, q = [], state
            for i, s in enumerate(block):
                now, after, letters = costs[i], costs[i + 1], ""
                while True:
                    extra = 0 if s == MUST_GO else TRUNCATED * (s & 1)
                    kept = None if s == MUST_GO else _follow(q, s >> 1)
                    if now[q] == DELETE + after[q]:
                        letters += "D"
                        break
                    if now[q] == INSERT + now[WANTED[q]]:
                        letters, q = letters + "I", WANTED[q]
                        continue
                    if kept is not None and now[q] == extra + after[kept]:
                        letters, q = letters + "K", kept
                        break
                    letters, q = letters + "R", WANTED[q]
                    break
                edits.append(letters)
            self.traces[key] = edits, q
        return self.traces[key]

    def trace(self, symbols: bytes, vector: int, state: int) -> tuple[list[str], int]:
        """Edits of every row and the state left in, given the vector behind the symbols."""
        blocks, behind, _ = self.behind(symbols, vector)
        edits: list[str] = []
        for block, v in zip(blocks, behind):
            some, state = self.expand(block, v, state)
            edits += some
        return edits, state


def closing(state: int) -> str:
    """Inserts after the last row."""
    letters = ""
    while state not in ACCEPTING:
        letters, state = letters + "I", WANTED[state]
    return letters


# ------------------------------------------------------------------ damage and faults
BLANK_SPACE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the fixed damage by ``crc32('conv_id:turn') % 20``.

    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of
    it, 3 repeats the row, 4 makes its role ``user``.  Null
    columns count as one space (``conv_id`` and ``turn`` in the checksum only).
    """
    space, src = F.lit(" "), _plain(rows)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    harm = F.crc32(name.cast("binary")) % 20
    src = src.withColumn("harm", harm).where("harm <> 0")
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return src.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def ordered(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with ``at``, their place in the order of all rows, written.

    A conversation's rows go by turn (nulls first), then role, the first 32
    characters of the text and its checksum: equal turns have a fixed order.
    The sort is by range over all of that and a random last digit, so neither
    a large conversation nor a crowd of equal rows gathers in one task.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32), F.xxhash64("text")]
    spread = rows.withColumn("digit", F.rand(7))
    out = spread.repartitionByRange(n, *keys, "digit").sortWithinPartitions(*keys)
    out = out.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))
    seen = F.struct("role", F.sha2("text", 256).alias("text"))
    return cut(out.withColumns({
        "blank": ~F.col("text").rlike(f"[^{BLANK_SPACE}]"),
        "cut_off": ~F.col("text").rlike(rf"[.!?][{BLANK_SPACE}]*\z"),
        "said": F.sha2(F.to_json(seen), 256)}), "conversation-rows")


def _fault(held: DataFrame) -> DataFrame:
    """Rows with ``fault``: the first of blank, duplicate, truncated."""
    first = (held.where("NOT blank").groupBy("conv_id", "said").agg(F.min("at").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first"))
    again = held.select("conv_id", "turn", "role", "at", "blank", "cut_off", "said").join(
        first, held["conv_id"].eqNullSafe(F.col("c")) & (held["said"] == F.col("s")), "left")
    fault = (F.when(F.col("blank"), BLANK).when(F.col("first") < F.col("at"), DUPLICATE)
             .when(F.col("cut_off"), TRUNC).otherwise(NONE))
    return again.select("conv_id", "turn", "role", "at", fault.alias("fault"))


def chunks(held: DataFrame, bits: int = ROWS_TO_A_CHUNK_BITS) -> DataFrame:
    """One row per chunk: its rows' symbols (a digit each: initial * 4 + fault, in hex) in order, and its counts."""
    initial = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial)
    each = _fault(held).select(
        "conv_id", F.shiftright("at", bits).alias("chunk"), "at", F.lower(F.hex((initial * 4 + F.col("fault")).cast("long"))).alias("x"), "fault")
    count = lambda k: F.count_if(F.col("fault") == k)
    return each.groupBy("conv_id", "chunk").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda r: r["x"])).alias("rows"),
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNC).alias("truncated"))


def _symbols(rows: str) -> bytes:
    return bytes(symbol(c >> 2, c & 3) for c in (int(x, 16) for x in rows))


def _in_order(df: DataFrame, backward: bool) -> DataFrame:
    """Clustered by conversation, its chunks in order (a requirement of the plan)."""
    by = F.col("chunk").desc() if backward else F.col("chunk").asc()
    out = df.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(by)))
    return out.sortWithinPartitions("conv_id", by)


def edits(held: DataFrame, bits: int = ROWS_TO_A_CHUNK_BITS, block: int = 4) -> DataFrame:
    """One row per chunk: ``conv_id, chunk, edits`` (one entry per row), ``enter`` (state it is entered in), ``tail`` (inserts after the last row), ``cost``
    (of the whole conversation, on its first chunk), ``illegal`` and the counts of faults."""

    def maps(batches):
        tables = Blocks.load(block)
        for b in batches:
            got = [tables.map(_symbols(r)) for r in b.column("rows").to_pylist()]
            yield pa.record_batch(
                [*b.columns, pa.array([x[0].tolist() for x in got], pa.list_(pa.int32())), pa.array([x[1].tolist() for x in got], pa.list_(pa.int64()))],
                names=[*b.schema.names, "into", "paid"])

    def backward(batches):
        tables = Blocks.load(block)
        conv, vector, cost = object(), tables.end, 0
        for b in batches:
            out = [[], [], []]
            for c, into, paid in zip(b.column("conv_id").to_pylist(), b.column("into").to_pylist(), b.column("paid").to_pylist()):
                if c != conv:
                    conv, vector, cost = c, tables.end, 0
                out[0].append(vector)
                cost += paid[vector]
                vector = into[vector]
                out[1].append(cost + tables.vectors[vector][0])
            yield pa.record_batch([b.column("conv_id"), b.column("chunk"), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64())],
                                  names=["conv_id", "chunk", "vector", "cost"])

    def leaves(batches):
        tables = Blocks.load(block)
        for b in batches:
            got = [[tables.trace(_symbols(r), v, q)[1] for q in range(STATES)] for r, v in zip(b.column("rows").to_pylist(), b.column("vector").to_pylist())]
            yield pa.record_batch([*b.columns, pa.array(got, pa.list_(pa.int32()))], names=[*b.schema.names, "leaves"])

    def forward(batches):
        conv, state, last = object(), 0, ""
        for b in batches:
            enter, seam = [], []
            for c, to, ends in zip(b.column("conv_id").to_pylist(), b.column("leaves").to_pylist(), b.column("ends").to_pylist()):
                if c != conv:
                    conv, state, last = c, 0, ""
                enter.append(state)
                state = to[state]
                seam.append(int(last != "" and last + ends[0] not in LEGAL))
                last = ends[1]
            yield pa.record_batch([b.column("conv_id"), b.column("chunk"), pa.array(enter, pa.int32()), pa.array(seam, pa.int64())],
                                  names=["conv_id", "chunk", "enter", "seam"])

    def walk(batches):
        tables = Blocks.load(block)
        for b in batches:
            done, tails, wrong = [], [], []
            for r, v, q, seam, final in zip(*(b.column(k).to_pylist() for k in ("rows", "vector", "enter", "seam", "final"))):
                some, q = tables.trace(_symbols(r), v, q)
                initials = "".join(INITIALS[int(x, 16) >> 2] for x in r)
                done.append(some)
                tails.append(closing(q) if final else "")
                wrong.append(seam + sum(x + y not in LEGAL for x, y in itertools.pairwise(initials)))
            yield pa.record_batch(
                [*(b.column(k) for k in ("conv_id", "chunk", "enter")), pa.array(done, pa.list_(pa.string())), pa.array(tails, pa.string()),
                 *(b.column(k) for k in ("cost", "blank", "duplicate", "truncated")), pa.array(wrong, pa.int64())],
                names=["conv_id", "chunk", "enter", "edits", "tail", "cost", "blank", "duplicate", "truncated", "illegal"])

    def on_chunk(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"conv_id": "same_conv", "chunk": "same_chunk"})
        on = left["conv_id"].eqNullSafe(right["same_conv"]) & (left["chunk"] == right["same_chunk"])
        return left.join(right, on).drop("same_conv", "same_chunk")

    table = bounded_batches(chunks(held, bits)).mapInArrow(
        maps, "conv_id long, chunk long, rows string, blank long, duplicate long, truncated long, into array<int>, paid array<long>")
    table = cut(table, "conversation-chunks")
    behind = _in_order(table.select("conv_id", "chunk", "into", "paid"), True).mapInArrow(
        backward, "conv_id long, chunk long, vector int, cost long")
    known = on_chunk(table.drop("into", "paid"), behind)
    known = bounded_batches(known.select("conv_id", "chunk", "rows", "blank", "duplicate", "truncated", "vector", "cost")).mapInArrow(
        leaves, "conv_id long, chunk long, rows string, blank long, duplicate long, truncated long, vector int, cost long, leaves array<int>")
    known = cut(known, "conversation-vectors")
    ends = F.transform(F.array(F.substring("rows", 1, 1), F.substring("rows", -1, 1)),
                       lambda x: F.substring(F.lit(INITIALS), F.shiftright(F.conv(x, 16, 10).cast("int"), 2) + 1, F.lit(1)))
    entered = _in_order(known.select("conv_id", "chunk", "leaves", ends.alias("ends")), False).mapInArrow(
        forward, "conv_id long, chunk long, enter int, seam long")
    last = known.groupBy("conv_id").agg(F.max("chunk").alias("last"))
    joined = _beside(on_chunk(known.drop("leaves"), entered), last).withColumn("final", F.col("chunk") == F.col("last"))
    return bounded_batches(joined).mapInArrow(
        walk, "conv_id long, chunk long, enter int, edits array<string>, tail string, cost long, blank long, duplicate long, truncated long, illegal long")


# ------------------------------------------------------------------ results
def _lines(letters: str, role: str, text: str, state: int) -> tuple[list[tuple[str, str, str]], int]:
    """Repaired rows (edit, role, text) of one row's letters, and the state behind them."""
    out = []
    for x in letters:
        if x == "K":
            state = _follow(state, INITIALS.index(role[0]))
            out.append((x, role, text))
        elif x != "D":
            state = WANTED[state]
            out.append((x, ROLE[state], "" if x == "I" else text))
    return out, state


def _stream(held: DataFrame, plan: DataFrame, bits: int, by: list[str]) -> DataFrame:
    """Each chunk's plan followed by its rows in order, chunks in order, clustered by ``by``."""
    none = lambda kind: F.lit(None).cast(kind)
    head = plan.select("conv_id", "chunk", F.lit(-1).cast("long").alias("at"), none("string").alias("role"), none("string").alias("text"),
                       "edits", "tail", "enter")
    rows = held.select("conv_id", F.shiftright("at", bits).alias("chunk"), "at", "role", "text",
                       none("array<string>").alias("edits"), none("string").alias("tail"), none("int").alias("enter"))
    order = ["at"] if "chunk" in by else ["chunk", "at"]
    both = head.unionByName(rows).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return bounded_batches(both.sortWithinPartitions(*by, *order))  # with "place": dropped, the plan would lose the clustering


def _walked(batches):
    """``(conv, at, letters, lines)`` for each plan (no letters), row and closing insert of a stream, ``None`` after each batch."""
    plan, at, state, tail = [], 0, 0, ""
    for b in batches:
        cols = [b.column(k).to_pylist() for k in ("conv_id", "at", "role", "text", "edits", "tail", "enter")]
        for conv, place, role, text, edits_, tail_, enter in zip(*cols):
            if place < 0:
                plan, at, state, tail = edits_, 0, enter, tail_
                yield conv, place, "", []
                continue
            lines, state = _lines(plan[at], role, text, state)
            yield conv, place, plan[at], lines
            at += 1
            if at == len(plan) and tail:
                lines, state = _lines(tail, "", "", state)
                yield conv, place, tail, lines
        yield None


def repair(rows: DataFrame, bits: int = ROWS_TO_A_CHUNK_BITS, block: int = 4) -> DataFrame:
    """The repaired rows ``conv_id, at, place, edit, role, text`` of conversations (``conv_id, turn, role, text``).

    ``at`` orders the rows they come from, ``place`` the rows of one ``at``;
    ``edit`` is ``K``, ``R`` or ``I`` (deleted rows are gone).  Rows of a
    conversation are taken in the order of ``ordered``; null roles and texts
    count as one space, an empty role has no initial and is never kept, null
    ids are one conversation.  A large conversation stays spread over tasks.
    """
    held = ordered(_plain(rows))
    plan = cut(edits(held, bits, block), "conversation-edits")

    def run(batches):
        out = [[] for _ in range(6)]
        for x in _walked(batches):
            if x is None:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))],
                                      names=["conv_id", "at", "place", "edit", "role", "text"])
                out = [[] for _ in range(6)]
                continue
            conv, at, letters, lines = x
            for line in lines:
                again = out[1] and out[1][-1] == at and out[0][-1] == conv
                for c, v in zip(out, (conv, at, out[2][-1] + 1 if again else 0, *line)):
                    c.append(v)

    return _stream(held, plan, bits, ["conv_id", "chunk"]).mapInArrow(
        run, "conv_id long, at long, place int, edit string, role string, text string")


def _plain(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return rows.select(
        rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"),
        F.coalesce(rows["role"].cast("string"), space).alias("role"), F.coalesce(rows["text"].cast("string"), space).alias("text"))


def audit(rows: DataFrame, bits: int = ROWS_TO_A_CHUNK_BITS, block: int = 4) -> DataFrame:
    """Per conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``audit`` spells the edits, ``repaired_sha256`` is the digest of the
    repaired ``role:text`` lines.  A digest is one serial stream: the rows of
    a conversation pass through it in order, a batch at a time.  See
    ``repair`` for nulls, ties and repeated rows; an empty table gives no rows.
    """
    held = ordered(_plain(rows))
    plan = cut(edits(held, bits, block), "conversation-edits")

    def run(batches):
        conv, letters, digest, lines_so_far = None, None, None, 0
        for x in _walked(batches):
            if x is None:
                continue
            if letters is None or x[0] != conv:
                if letters is not None:
                    yield row(conv, letters, digest)
                conv, letters, digest, lines_so_far = x[0], [], hashlib.sha256(), 0
            letters.append(x[2])
            for _, role, text in x[3]:
                digest.update((("\n" if lines_so_far else "") + role + ":" + text).encode())
                lines_so_far += 1
        if letters is not None:
            yield row(conv, letters, digest)

    def row(conv, letters, digest):
        return conv, "".join(letters), digest.hexdigest()

    def batched(batches):
        out, held_bytes = [], 0
        for r in run(batches):
            out.append(r)
            held_bytes += 100 + len(r[1])
            if held_bytes > 1 << 22:
                yield made(out)
                out, held_bytes = [], 0
        yield made(out)

    def made(out):
        return pa.record_batch([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.string()) for k in (1, 2))],
                               names=["conv_id", "audit", "repaired_sha256"])

    spelled = _stream(held, plan, bits, ["conv_id"]).mapInArrow(batched, "conv_id long, audit string, repaired_sha256 string")
    span = (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long")
    gaps = held.groupBy("conv_id").agg(F.coalesce(span, F.lit(0).cast("long")).alias("gaps"))
    counts = plan.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), F.min_by("cost", "chunk").alias("cost"))
    return _beside(_beside(gaps, counts), spelled)


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``conv_id``, null ids included."""
    right = right.withColumnRenamed("conv_id", "same_conv")
    return left.join(right, left["conv_id"].eqNullSafe(right["same_conv"]), how).drop("same_conv")


def damage_and_repair(rows: DataFrame, bits: int = ROWS_TO_A_CHUNK_BITS, block: int = 4) -> DataFrame:
    """``audit`` of the rows after the fixed damage, for every ``conv_id`` of ``rows``.

    A conversation that the damage leaves without rows has zeros, an empty
    audit and the digest of nothing.
    """
    told = audit(damaged(rows), bits, block)
    every = rows.select(rows["conv_id"].cast("long").alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return _beside(every, told, "left").select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
