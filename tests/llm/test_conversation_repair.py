"""Repairs against a search over all edit sequences, in pieces of any size; the query against a plain version."""
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from ostinato.llm import conversation_repair as cr
from ostinato.llm import queries

STATES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def best(rows):
    """rows: (role, text, fault). Least (cost, audit) with the repaired lines, by search over all sequences of edits."""
    @lru_cache(None)
    def rest(t, last, put):
        found = []
        if t == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[t]
            cost, audit, lines = rest(t + 1, last, 0)
            found.append((cost + 4, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for letter, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    to = STATES.get((last, new[:1]))
                    if to:
                        cost, audit, lines = rest(t + 1, to, 0)
                        found.append((cost + price + extra, letter + audit, (f"{new}:{text}", *lines)))
        if put < 3:
            for new in ("user", "assistant"):
                to = STATES.get((last, new[:1]))
                if to:
                    cost, audit, lines = rest(t, to, put + 1)
                    found.append((cost + 3, "I" + audit, (f"{new}:", *lines)))
        return min(found, default=(10 ** 9, "", ()))
    import sys
    sys.setrecursionlimit(20_000)
    return rest(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def plain(table):
    """table: (conv_id, turn, role, text) -> the rows of the query."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            rows += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in rows if r[0] is not None]
        marked = faults([r[1:] for r in rows])
        cost, audit, lines = best(tuple(marked))
        pairs = [(a[0][:1], b[0][:1]) for a, b in zip(marked, marked[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")),
                    sum("".join(p) not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answered(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_vectors_converge_and_are_few():
    own = cr.Machine()
    assert len(own.vectors) < 200
    for code in range(cr.CODES):
        for shape, vector in enumerate(own.vectors):
            made = cr.before(vector, code)
            assert own.vectors[own.step[shape][code]] == tuple(x - min(made) for x in made)
    lefts, _ = own.speculate([cr.code_of(1, 0), cr.code_of(2, 0)] * 6)
    assert len(set(lefts)) == 1                                             # well-formed rows: one vector, whatever follows
    assert len(set(own.speculate([0] * 50)[0])) == len(own.vectors)         # deletions alone: none has converged


@pytest.mark.parametrize("seed", range(4))
def test_pieces_agree_with_the_whole(seed):
    own, draw = cr.machine(), random.Random(seed)
    for _ in range(200):
        codes = [draw.choice(range(cr.CODES) if seed else [0, 3]) for _ in range(draw.randint(1, 12))]
        lefts, exits = own.speculate(codes)
        for right in range(len(own.vectors)):
            after, left = own.vectors_after(codes, right)
            assert left == lefts[right]
            for entry in range(4):
                state = entry
                for t, code in enumerate(codes):
                    state = own.edits[after[t]][code][state].state
                assert exits[4 * right + entry] == state


def made(seed, conversations=60):
    draw = random.Random(seed)
    table = []
    for conv in range(conversations):
        n = draw.choice([1, 2, 3, 5, 8, 40])
        for turn in range(n):
            role = draw.choice(["user", "assistant"]) if draw.random() < .4 else ["user", "assistant"][turn % 2]
            role = draw.choice(["system", "tool", None, "", "User", "ultra"]) if draw.random() < .15 else role
            text = draw.choice(["Hello.", "No", "What?  ", " \t", None, "Fine!\n", f"word {turn}.", "é. ü"])
            table.append((conv if conv else None, None if draw.random() < .05 else turn + draw.choice([0, 0, 0, 1]), role, text, 1, "x"))
    return table


SCHEMA = "conv_id long, turn long, role string, text string, block long, pos string"


@pytest.mark.parametrize("block_rows, range_rows", [(cr.BLOCK_ROWS, cr.RANGE_ROWS), (3, 50), (1, 1000)])
def test_against_search(spark, block_rows, range_rows):
    table = made(block_rows)
    got = answered(cr.repair_damaged(spark.createDataFrame(table, SCHEMA).repartition(3), block_rows, range_rows))
    assert got == plain([r[:4] for r in table])


def test_one_long_conversation_in_many_pieces(spark):
    """Rows of one role alternate between two best edits, and deletions keep every vector: nothing converges by itself."""
    table = [(1, t, "user" if t < 150 else "assistant", "Same." if 60 <= t < 120 else f"Text {t}.", 0, "") for t in range(300)]
    got = answered(cr.repair_damaged(spark.createDataFrame(table, SCHEMA), 4, 100))
    assert got == plain([r[:4] for r in table])


def test_empty_and_wholly_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert answered(cr.repair_damaged(empty)) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = answered(cr.repair_damaged(spark.createDataFrame([(5, gone, "user", "x" * 100_000, 1, "")], SCHEMA)))
    assert got == [(5, 0, 0, 0, 0, 0, 0, "", cr.EMPTY_HASH)]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answered(queries.QUERIES["op11_conversation_repair"](spark, sf)) == plain(table)
