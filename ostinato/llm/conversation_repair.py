"""Repair of the role structure of conversations at least cost, by a Viterbi search that runs in pieces of a conversation.

A conversation is right if the initials of its roles read `(s?(ua)+)?`. Rows are kept (0), given the role user or assistant
(3), or deleted (4, and always where blank or repeated); a truncated row that is not deleted costs 3 more; an empty row of
user or assistant may be inserted anywhere (3). The cost of the rest, for each state of the pattern, is a vector, found
from the end of a conversation to its front.

The rows lie in one order, cut into blocks of fixed size. A conversation within a block is solved there. A piece of a
longer one does not know the vector at its right end, so it starts from speculative ones: all vectors that can occur there
(up to a constant there are a few). The first gives a cost vector after every row, each other one is rerun from the right
only until it differs from the first by a constant (rank convergence). Pieces whose vectors have not converged at their left end are
fixed up in passes, in which each takes over what its right neighbours have found, over twice the distance each time, until
the vectors differ only by constants or the conversation ends. The stitched vectors give, from the front, the edits that
are least in ASCII order among the cheapest; the state in which a piece is entered is carried over in passes of the same kind.

Defined cases: a null role or text is one space (such a role has no legal place), a null id or turn counts as one space in
the drawn damage, null ids are one conversation, null turns come first; rows of one turn stand in order of role and of the
text's SHA-256; a conversation without rows after damage has zeros, an empty audit and the hash of the empty string; an
empty table gives no rows; texts and conversations may be of any length; other columns are not read. Equal rows follow each other, so
every repetition of a row is a duplicate. The text of one conversation is hashed as a stream by one task, as SHA-256 cannot be split.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.storage import dropped, written

BLOCK_ROWS = 4096
RANGE_ROWS = 1 << 18
SEPARATORS = " \t\n\x0b\x0c\r"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

INITIALS = "sua"
BEGIN, SYSTEM, USER, ASSISTANT = range(4)                   # what the last role was
NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = ["u", "u", "a", "u"]                               # by state: the one initial that may be put there
ROLE = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
AT_END = (0, 2 * INSERT, INSERT, 0)                         # cost of closing the pattern, by state
FINE, BLANK, DUPLICATE, CUT = range(4)                      # faults of a row
LEGAL = {(0, 1), (1, 2), (2, 1)}                            # neighbours by place in INITIALS; 3 is any other initial


def code_of(initial: int, fault: int) -> int:
    """What matters of a row: 0 for one that has to go, else its initial and whether it is truncated."""
    return 0 if fault in (BLANK, DUPLICATE) else 1 + 2 * initial + (fault == CUT)


CODES = 1 + 2 * (len(INITIALS) + 1)


def consuming(state: int, code: int) -> Iterator[tuple[str, int, int, str | None]]:
    """Ways to go past a row: letter, cost, next state, new initial (None where the row keeps its role or goes)."""
    yield "D", DELETE, state, None
    if code:
        initial, cut = divmod(code - 1, 2)
        kept = NEXT.get((state, INITIALS[initial])) if initial < len(INITIALS) else None
        if kept is not None:
            yield "K", TRUNCATED * cut, kept, None
        yield "R", REROLE + TRUNCATED * cut, NEXT[state, WANTED[state]], WANTED[state]


def before(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Cost vector before a row from the one after it."""
    out = [min(cost + after[to] for _, cost, to, _ in consuming(state, code)) for state in range(4)]
    for _ in range(4):
        out = [min(out[s], INSERT + out[NEXT[s, WANTED[s]]]) for s in range(4)]
    return tuple(out)


@dataclass
class Edit:
    """What is done at a row, from the state in which it is met."""
    letters: str
    inserted: tuple[str, ...]       # roles put in front of the row
    role: str | None                # new role; None where the row keeps its own or goes
    gone: bool
    state: int
    cost: int


class Machine:
    """All cost vectors up to a constant that can occur, as numbers, and tables over them."""

    def __init__(self):
        self.vectors, number = [AT_END], {AT_END: 0}
        self.step: list[list[int]] = []            # by vector: the vector before a row of each code
        self.edits: list[list[list[Edit]]] = []    # by vector after the row, code and state
        for after in self.vectors:                 # grows while it is read
            row = []
            for code in range(CODES):
                vector = before(after, code)
                shape = tuple(x - min(vector) for x in vector)
                if shape not in number:
                    number[shape] = len(self.vectors)
                    self.vectors.append(shape)
                row.append(number[shape])
            self.step.append(row)
            self.edits.append([[self._edit(after, code, s) for s in range(4)] for code in range(CODES)])

    @staticmethod
    def _edit(after, code, state) -> Edit:
        here, letters, inserted, cost = before(after, code), "", [], 0
        while True:
            ways = [(letter, c, to, role, False) for letter, c, to, role in consuming(state, code) if c + after[to] == here[state]]
            put = NEXT[state, WANTED[state]]
            if INSERT + here[put] == here[state]:
                ways.append(("I", INSERT, put, WANTED[state], True))
            letter, c, to, role, stays = min(ways)
            letters, cost = letters + letter, cost + c
            if not stays:
                return Edit(letters, tuple(inserted), ROLE.get(role), letter == "D", to, cost)
            inserted.append(ROLE[role])
            state = to

    def closing(self, state: int) -> tuple[str, ...]:
        """Roles inserted after the last row."""
        roles = []
        while AT_END[state]:
            roles.append(ROLE[WANTED[state]])
            state = NEXT[state, WANTED[state]]
        return tuple(roles)

    def vectors_after(self, codes: list[int], right: int) -> tuple[list[int], int]:
        """The vector after each row, and the one before the first, from the one at the right end."""
        after = [0] * len(codes)
        for t in range(len(codes) - 1, -1, -1):
            after[t] = right
            right = self.step[right][codes[t]]
        return after, right

    def speculate(self, codes: list[int]) -> tuple[list[int], list[int]]:
        """For every vector at the right end: the vector at the left end, and the state at the right end for each state at the left."""
        base, left = self.vectors_after(codes, 0)
        states = []                                  # before each row, by state of entry
        for entry in range(4):
            own = [entry]
            for t, code in enumerate(codes):
                own.append(self.edits[base[t]][code][own[-1]].state)
            states.append(own)
        lefts, exits = [], []
        for right in range(len(self.vectors)):
            t, rerun, here = len(codes) - 1, [], right
            while t >= 0 and here != base[t]:        # up to here the vectors differ by more than a constant
                rerun.append(here)
                here = self.step[here][codes[t]]
                t -= 1
            lefts.append(left if t >= 0 else here)
            for own in states:
                state = own[t + 1]
                for at, vector in zip(range(t + 1, len(codes)), reversed(rerun)):
                    state = self.edits[vector][codes[at]][state].state
                exits.append(state)
        return lefts, exits


@functools.cache
def machine() -> Machine:
    return Machine()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the drawn damage: conv, turn, role, text without nulls (but for turn); `conv` is "" for a null id."""
    blank = F.lit(" ")
    conv_id, turn = F.col("conv_id"), F.col("turn")
    drawn = F.crc32(F.concat_ws(":", F.coalesce(conv_id.cast("string"), blank), F.coalesce(turn.cast("string"), blank))) % 20
    rows = conversations.select(conv_of(conv_id).alias("conv"), turn.cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
                                F.coalesce("text", blank).alias("text"), drawn.alias("h")).filter("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def conv_of(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def in_order(rows: DataFrame, block_rows: int, ranges: int) -> DataFrame:
    """(block, pos, conv, turn, role, digest, initial, fault), written: all rows in one order, in blocks numbered without gaps.

    `rows` has conv, turn, role and text. Texts stay behind. Only one row per range comes to the driver.
    """
    said = F.rtrim(F.col("text"), F.lit(SEPARATORS))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.char_length("role") > 0) & (initial >= 0), initial).otherwise(len(INITIALS))
    own = F.when(said == "", BLANK).when(F.right(said, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    keyed = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), initial.cast("int").alias("initial"),
                        own.cast("int").alias("own"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "role", "digest", "row"]       # equal rows differ in the last, so that many of them can be parted
    spine = written(keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("row").withColumn("pos", F.monotonically_increasing_id()))
    part, place = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    sizes = spine.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("n")).orderBy("part").collect()
    blocks = np.cumsum([0, *(-(-r["n"] // block_rows) for r in sizes)]).tolist()
    base = spine.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, blocks)], "part long, base long")
    first = spine.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("own"))
    out = spine.join(written(first), "pos", "left").withColumn("part", part).join(F.broadcast(base), "part")
    out = out.select((F.col("base") + F.floor(place / block_rows)).alias("block"), "pos", "conv", "turn", "role", "digest", "initial", fault.alias("fault"))
    return written(out)


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block as one batch; the input is sorted by block."""
    held = []
    for batch in batches:
        number = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(number)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
            if b == a:
                continue
            if held and held[0].column("block")[0].as_py() != int(number[a]):
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def pieces(block: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Bounds of the conversations in a block."""
    codes = block.column("conv").dictionary_encode().indices.to_numpy()
    cuts = (np.flatnonzero(np.diff(codes)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(codes)])


def codes_of(block: pa.RecordBatch) -> list[int]:
    initial, fault = block.column("initial").to_numpy(), block.column("fault").to_numpy()
    return np.where((fault == BLANK) | (fault == DUPLICATE), 0, 1 + 2 * initial + (fault == CUT)).tolist()


def edge_pieces(ordered: DataFrame) -> DataFrame:
    """The first and the last conversation of each block: conv, block, lefts and exits (`Machine.speculate`), last_initial."""
    def run(batches):
        own = machine()
        for block in block_batches(batches):
            bounds, codes = list(pieces(block)), codes_of(block)
            rows = []
            for a, b in dict.fromkeys((bounds[0], bounds[-1])):
                lefts, exits = own.speculate(codes[a:b])
                rows.append((block.column("conv")[a].as_py(), block.column("block")[a].as_py(), lefts, exits, block.column("initial")[b - 1].as_py()))
            conv, number, lefts, exits, last = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(number, pa.int64()), pa.array(lefts, pa.list_(pa.int32())),
                                              pa.array(exits, pa.list_(pa.int32())), pa.array(last, pa.int32())],
                                             names=["conv", "block", "lefts", "exits", "last_initial"])
    slim = ordered.select("block", "pos", "conv", "initial", "fault").repartition("block").sortWithinPartitions("block", "pos")
    return written(slim.mapInArrow(run, "conv string, block long, lefts array<int>, exits array<int>, last_initial int"))


def settled_maps(maps: DataFrame, towards: int, start: int) -> DataFrame:
    """(conv, block, value) for maps(conv, block, map): each piece's map after those of all its neighbours on one side (1: later ones).

    In each pass a piece takes over the map at twice the distance, until its own gives one value for everything. Where no
    neighbour is left the conversation ends, with `start`.
    """
    here, reach = maps, 1
    constant = F.size(F.array_distinct("map")) == 1
    while here.filter(~constant).limit(1).count():
        there = here.select("conv", (F.col("block") - towards * reach).alias("block"), F.col("map").alias("ahead"))
        through = F.transform("ahead", lambda x: F.get("map", x))
        alone = F.array_repeat(F.get("map", F.lit(start)), F.size("map"))
        joined = here.join(there, ["conv", "block"], "left").select(
            "conv", "block", F.when(constant, F.col("map")).when(F.col("ahead").isNull(), alone).otherwise(through).alias("map"))
        here, reach = written(joined), 2 * reach
    return here.select("conv", "block", F.get("map", F.lit(0)).alias("value"))


def stitched(edges: DataFrame) -> DataFrame:
    """(block, conv, right, entry, before_initial, ends): what each edge piece has to know of its neighbours."""
    lefts = settled_maps(edges.select("conv", "block", F.col("lefts").alias("map")), 1, 0)
    follow = lefts.select("conv", (F.col("block") - 1).alias("block"), F.col("value").alias("right"))
    known = written(edges.join(follow, ["conv", "block"], "left").select(
        "conv", "block", "last_initial", F.coalesce("right", F.lit(0)).alias("right"), F.col("right").isNull().alias("ends"), "exits"))
    states = settled_maps(known.select("conv", "block", F.slice("exits", F.col("right") * 4 + 1, F.lit(4)).alias("map")), -1, BEGIN)
    came = states.join(known.select("conv", "block", "last_initial"), ["conv", "block"]).select(
        "conv", (F.col("block") + 1).alias("block"), F.col("value").alias("entry"), F.col("last_initial").alias("before_initial"))
    return written(known.join(came, ["conv", "block"], "left").select("block", "conv", "right", F.coalesce("entry", F.lit(BEGIN)).alias("entry"), "before_initial", "ends"))


EDITS = ("block long, pos long, conv string, role string, digest binary, fault int, illegal long, cost long, letters string, in_front string, "
         "new_role string, gone boolean, behind string")


def edit_rows(ordered: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row with what is done to it, written: EDITS. `in_front` and `behind` are the lines inserted there."""
    def run(batches):
        own = machine()
        lines = lambda roles: "\n".join(f"{r}:" for r in roles) if roles else None
        for block in block_batches(batches):
            codes, initial = codes_of(block), block.column("initial").to_pylist()
            right, entry, came, ends = (block.column(c) for c in ("right", "entry", "before_initial", "ends"))
            letters, front, roles, gone, behind, cost, illegal = [], [], [], [], [], [], []
            for a, b in pieces(block):
                after, _ = own.vectors_after(codes[a:b], right[a].as_py() or 0)
                state, last = entry[a].as_py() or BEGIN, came[a].as_py()
                for t in range(a, b):
                    edit = own.edits[after[t - a]][codes[t]][state]
                    state = edit.state
                    letters.append(edit.letters)
                    front.append(lines(edit.inserted))
                    roles.append(edit.role)
                    gone.append(edit.gone)
                    behind.append(None)
                    cost.append(edit.cost)
                    illegal.append(int(last is not None and (last, initial[t]) not in LEGAL))
                    last = initial[t]
                if ends[a].as_py() is not False:
                    close = own.closing(state)
                    letters[-1] += "I" * len(close)
                    cost[-1] += INSERT * len(close)
                    behind[-1] = lines(close)
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in ("block", "pos", "conv", "role", "digest", "fault")), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()),
                 pa.array(letters, pa.string()), pa.array(front, pa.string()), pa.array(roles, pa.string()), pa.array(gone, pa.bool_()), pa.array(behind, pa.string())],
                names=[f.split()[0] for f in EDITS.split(", ")])
    rows = ordered.select("block", "pos", "conv", "role", "digest", "initial", "fault").join(known, ["block", "conv"], "left")
    return written(rows.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(run, EDITS))


def repaired_rows(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, pos, lines): the lines `role:text` of the repaired conversations, those inserted around a row in one string with its own.

    At most one row of equal conversation, role and text stays, so texts are met by these three.
    """
    texts = rows.select("conv", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("conv", "role", "digest").agg(F.any_value("text").alias("text"))
    stays = edits.filter("not gone or in_front is not null or behind is not null")
    whole = stays.join(texts, ["conv", "role", "digest"], "left")
    line = F.when(~F.col("gone"), F.concat(F.coalesce("new_role", "role"), F.lit(":"), F.col("text")))
    return whole.select("conv", "pos", F.concat_ws("\n", "in_front", line, "behind").alias("lines"))


def text_hashes(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the newline-joined lines of each conversation, as a stream."""
    def run(batches):
        conv, digest = None, None
        for batch in batches:
            done = []
            for name, text in zip(batch.column("conv").to_pylist(), batch.column("lines")):
                data = text.as_buffer()
                if name != conv:
                    if conv is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = name, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(data)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["conv", "repaired_sha256"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])
    return lines.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(run, "conv string, repaired_sha256 string")


def summary(edits: DataFrame) -> DataFrame:
    """Faults, cost and audit of each conversation; a block's part of an audit is put together before the shuffle by conversation."""
    faults = [F.sum((F.col("fault") == k).cast("long")).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))]
    def joined(order, text):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("audit")
    per_block = edits.groupBy("conv", "block").agg(*faults, F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), joined("pos", "letters"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return per_block.groupBy("conv").agg(*sums, joined("block", "audit"))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, ranges: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edits, ordered rows) of rows(conv, turn, role, text), both written; `edits` is one row per row (EDITS)."""
    ordered = in_order(rows, block_rows, ranges)
    edges = edge_pieces(ordered)
    known = stitched(edges)
    edits = edit_rows(ordered, known)
    dropped(edges, known)
    return edits, ordered


def repair_damaged(conversations: DataFrame, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per conv_id of the table: damage, faults, cost, audit and the hash of the repaired text."""
    rows = damaged(conversations)
    edits, ordered = repair(rows, block_rows, max(1, -(-conversations.count() // range_rows)))
    turns = ordered.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    hashes = text_hashes(repaired_rows(edits, rows))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    names = conversations.select("conv_id").distinct().withColumn("conv", conv_of(F.col("conv_id")))
    return names.join(turns, "conv", "left").join(summary(edits), "conv", "left").join(hashes, "conv", "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
