import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from ticklake.llm.conversation_repair import Blocks, damage_and_repair, repair, symbol

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(name.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def solve(rows):
    """Cheapest edits by a plain search over (row, roles so far): (cost, audit, repaired lines)."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))

    def step(state, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role[:1]))

    @lru_cache(None)
    def best(i, state, inserted=0):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state)
            ways.append((3 + cost, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    nxt = step(state, new)
                    if nxt:
                        cost, audit, lines = best(i + 1, nxt)
                        ways.append((price + extra + cost, letter + audit, (f"{new}:{text}", *lines)))
        if inserted < 4:
            for new in ("user", "assistant"):
                nxt = step(state, new)
                if nxt:
                    cost, audit, lines = best(i, nxt, inserted + 1)
                    ways.append((2 + cost, "I" + audit, (f"{new}:", *lines)))
        return min(ways) if ways else (10**9, "", ())

    for i in range(len(rows), -1, -50):  # keeps the recursion shallow
        for s in ("", "s", "u", "a"):
            best(i, s)
    cost, audit, lines = best(0, "")
    return faults, cost, audit, lines


def expected(rows):
    convs = {r[0] for r in rows}
    groups = defaultdict(list)
    for r in damage(rows):
        groups[r[0]].append(r)
    out = {}
    for conv in convs:
        g = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, cost, audit, lines = solve(tuple(g))
        turns = [r[1] for r in g if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[2][:1] for r in g]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, n, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "s"])
            text = rng.choice(["Hello there.", "no end", " \t\n", "", None, "What? ", "x" * 50 + "!", "é 🙂.", "a\nb.", "Yes!"])
            if rng.random() < 0.6:
                text = f"{text}{rng.randrange(100)}."
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
    return rows


def check(spark, rows, **options):
    got = {r["conv_id"]: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in damage_and_repair(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_every_conversation_equals_a_plain_search(spark):
    check(spark, made(1, 300))


def test_chunks_and_blocks_of_any_size_give_the_same(spark):
    rows = made(2, 40) + [(1000, t, random.Random(t).choice(["user", "assistant", "system"]), f"t {t % 37}." if t % 5 else "cut") for t in range(400)]
    for bits, block in ((1, 1), (2, 3), (5, 4)):
        check(spark, rows, bits=bits, block=block)


def test_null_ids_and_turns_repeated_rows_and_long_texts(spark):
    rows = [(None, None, "user", "a."), (None, 1, None, None), (7, None, None, None), (8, 0, "user", "long " * 100_000 + "."), (8, 1, "assistant", "ok."),
            (9, 0, "system", "Same."), (9, 0, "system", "Same."), (9, 1, "user", "Same.")]
    check(spark, rows)


def test_an_empty_table_gives_no_rows(spark):
    assert damage_and_repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_extra_columns_with_clashing_names_are_ignored(spark):
    rows = made(3, 5)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA + ", at long, chunk long, edits long, said long")
    got = {r["conv_id"]: r["audit"] for r in damage_and_repair(df).collect()}
    assert got == {k: v[6] for k, v in expected(rows).items()}


def test_repaired_rows_are_the_audit_s(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Bye."), (2, 0, "system", "Be good."), (2, 1, "user", "x.")]
    got = sorted((r["conv_id"], r["at"], r["place"], r["edit"], r["role"], r["text"]) for r in repair(spark.createDataFrame(rows, SCHEMA), bits=1).collect())
    for conv in (1, 2):
        _, _, audit, lines = solve(tuple(r for r in rows if r[0] == conv))
        assert [f"{r[4]}:{r[5]}" for r in got if r[0] == conv] == list(lines)
        assert "".join(r[3] for r in got if r[0] == conv) == audit.replace("D", "")


@pytest.mark.parametrize("block", [1, 2, 4])
def test_tables_hold_every_block(block):
    tables = Blocks(block)
    assert len(tables.vectors) < 60
    for k in range(1, block + 1):
        assert tables.into[k].shape == (9**k, len(tables.vectors))
    assert symbol(3, 1) == symbol(0, 2) == 8
