"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record is framed as the public record format of that kind does it: length (8 bytes), masked CRC-32C of the length,
payload, masked CRC-32C of the payload. The payload is the document id, whether there is one, the bytes of an id (2 for
vocabularies of at most 65,536, else 4), the number of ids and the ids, all little-endian. Documents are dealt out by ranges of their id; a task writes its range in order into
files of bounded size, each with an index file of its own that holds offset and length of every frame. A file counts
only once it is closed and renamed and stands in the written list, so files of lost or repeated tasks are never read.
Sequential reads go through a file in pieces, shuffled reads seek by the index; both verify both checksums.

Defined cases: a null text is empty, its record holds the end id alone; null ids come first and stay null; rows that
repeat an id follow each other in order of the text's hash; an empty table gives no file and no rows; a text of any
length is one record; other columns are not read; a damaged or cut file fails the read.
"""

from __future__ import annotations

import functools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.batches import slices
from ostinato.llm.bpe import BATCH_BYTES, encoder
from ostinato.llm.storage import step_path, written
from ostinato.llm.warc import open_folder
from ostinato.operators.ordering import running_sums

FILE_BYTES = 64 << 20         # after which the next file is begun
RANGE_BYTES = 32 << 20        # of text in one range of ids, on average
READ_BYTES = 8 << 20
FILES = "file string, records long, tokens long, bytes long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
# The reflected polynomial of CRC-32C, and the constant of its masked form.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 64                    # bytes that one step of the checksum takes
HEAD, TAIL, FIXED = 12, 4, 16  # bytes before the payload, after it, and of it before the ids


@functools.cache
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _zero_byte(state: np.ndarray) -> np.ndarray:
    return _byte_table()[state & 255] ^ (state >> 8)


@functools.cache
def _place_tables() -> np.ndarray:
    """What a byte at each place of a block adds to the state after the block."""
    rows = [_byte_table()]
    for _ in range(BLOCK - 1):
        rows.append(_zero_byte(rows[-1]))
    return np.stack(rows[::-1])


@functools.cache
def _shift_table(power: int) -> np.ndarray:
    """What 2**power zero bytes make of each byte of a state."""
    if power == 0:
        return _zero_byte(np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None])
    half = _shift_table(power - 1)
    return _apply(half, half)


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers at[i], at[i] + 1, ... of `size[i]` each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


def crc32c(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32C of the spans [at, at + size) of a byte array, all at once.

    A state of zero is left as it is by zero bytes, so spans are filled up in front to whole blocks. Blocks are taken
    on their own and joined in pairs, level by level.
    """
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    filled = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    filled[_ranges((first + blocks) * BLOCK - size, size)] = data[_ranges(at, size)]
    filled = filled.reshape(-1, BLOCK)
    state = np.zeros(len(filled), np.uint32)
    for place, table in enumerate(_place_tables()):
        state ^= table[filled[:, place]]
    power = BLOCK.bit_length() - 1
    while len(blocks) and blocks.max() > 1:
        pairs = (blocks + 1) // 2
        even = np.zeros(2 * int(pairs.sum()), np.uint32)
        even[_ranges(2 * np.cumsum(pairs) - blocks, blocks)] = state
        state = _apply(_shift_table(power), even[0::2]) ^ even[1::2]
        blocks, power = pairs, power + 1
    out = np.zeros(len(size), np.uint32)
    out[blocks > 0] = state
    begin, left, power = np.full(len(size), 0xFFFFFFFF, np.uint32), size.astype(np.int64), 0
    while left.any():
        begin = np.where(left & 1, _apply(_shift_table(power), begin), begin)
        left, power = left >> 1, power + 1
    return out ^ begin ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def frames(doc_ids: pa.Array, ids: np.ndarray, rows: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Framed records of `ids` between the row bounds as bytes, and the bounds of the frames; an id takes `width` bytes, 2 or 4."""
    count = np.diff(rows)
    halves = (HEAD + FIXED + TAIL) // 2 + count * (width // 2)        # everything is laid out in units of two bytes
    ends = np.cumsum(halves)
    first = ends - halves
    out = np.zeros(int(ends[-1]) if len(ends) else 0, "<u2")

    def put(at, values, units):
        for k in range(units):
            out[at + k] = values >> (16 * k) & 0xFFFF

    payload = FIXED + width * count
    known = np.array(doc_ids.is_valid())
    named = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    put(first, payload, 4)
    put(first + HEAD // 2, named, 4)
    put(first + HEAD // 2 + 4, known, 1)
    put(first + HEAD // 2 + 5, width, 1)
    put(first + HEAD // 2 + 6, count, 2)
    body = np.ascontiguousarray(ids.astype(f"<u{width}")).view("<u2")
    out[_ranges(first + (HEAD + FIXED) // 2, count * (width // 2))] = body
    data = out.view(np.uint8)
    put(first + 4, masked(crc32c(data, 2 * first, np.full(len(first), 8))), 2)
    put(ends - 2, masked(crc32c(data, 2 * first + HEAD, payload)), 2)
    return data, 2 * np.concatenate(([0], ends))


def checked(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """Fail unless both checksums of the frames at `at` with payloads of `size` bytes hold."""
    def stored(place):
        return data[place[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    if (stored(at + 8) != masked(crc32c(data, at, np.full(len(at), 8)))).any():
        raise ValueError("damaged length of a record")
    if (stored(at + HEAD + size) != masked(crc32c(data, at + HEAD, size))).any():
        raise ValueError("damaged record")


def with_end(ids: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """`end` after each row."""
    bounds = rows + np.arange(len(rows))
    out = np.full(int(bounds[-1]), end, np.uint32)
    out[_ranges(bounds[:-1], np.diff(rows))] = ids
    return out, bounds


def write_records(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all texts in ascending order of their id; returns the list of files (file, records, tokens, bytes).

    The ids are those of the tokenizers library, made by `bpe`, which takes half the time over words that occur once.
    File names rise in the order of the records. Texts are shuffled once, by ranges; the number of ranges follows the bytes of text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns(
        {"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = ["doc_id", "h", "row"]       # the place in the table parts equal rows only, which may follow each other in any order
    ranged = rows.repartitionByRange(max(1, -(-total // RANGE_BYTES)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        task, done, handle = TaskContext.get().partitionId(), [], None

        def close():
            name = f"part-{task:08d}-{len(done):06d}-{uuid.uuid4().hex}"
            handle.close()
            with system.open_output_stream(f"{root}/{name}.index") as index:
                index.write(np.concatenate(places).astype("<i8").tobytes())
            system.move(temporary, f"{root}/{name}.records")
            done.append((name, records, tokens, size))

        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                ids, bounds = with_end(*encoder(tokenizer).encode(part.column("text")), end)
                data, cuts = frames(part.column("doc_id"), ids, bounds, 2 if len(encoder(tokenizer).table.tokens) <= 1 << 16 else 4)
                k = 0
                while k < part.num_rows:
                    if handle is None:
                        temporary = f"{root}/.{uuid.uuid4().hex}"
                        handle, records, tokens, size, places = system.open_output_stream(temporary), 0, 0, 0, []
                    to = max(k + 1, int(np.searchsorted(cuts, cuts[k] + file_bytes - size, "right")) - 1)
                    handle.write(memoryview(data[cuts[k]:cuts[to]]))
                    places.append(np.stack([cuts[k:to] - cuts[k] + size, np.diff(cuts[k:to + 1])], axis=1))
                    records, tokens, size, k = records + to - k, tokens + int(bounds[to] - bounds[k]), size + int(cuts[to] - cuts[k]), to
                    if size >= file_bytes or k < part.num_rows:
                        close()
                        handle = None
        if handle is not None:
            close()
        names, *numbers = zip(*done) if done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)], names=["file", "records", "tokens", "bytes"])

    return written(ranged.mapInArrow(run, FILES))


def _columns(data: np.ndarray, at: np.ndarray, size: np.ndarray, starts, with_ids: bool) -> pa.RecordBatch:
    """Rows of checked frames; `starts` are the ids before each, or None."""
    checked(data, at, size)
    doc, known, count, crc, raw = [], [], [], [], []
    for a, n in zip(at.tolist(), size.tolist()):
        head = data[a + HEAD:a + HEAD + FIXED]
        doc.append(int(head[:8].copy().view("<i8")[0]))
        known.append(bool(head[8]))
        width = int(head[10])
        count.append(int(head[12:].copy().view("<u4")[0]))
        if width not in (2, 4) or n != FIXED + width * count[-1]:
            raise ValueError("a record holds another number of ids than it says")
        body = data[a + HEAD + FIXED:a + HEAD + n].copy().view(f"<u{width}").astype("<u4", copy=False).tobytes()
        crc.append(zlib.crc32(body))
        raw.append(body if with_ids else None)
    count = np.array(count, np.int64)
    before = pa.nulls(len(at), pa.int64()) if starts is None else pa.array(starts + np.cumsum(count) - count, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=~np.array(known, bool)), before, pa.array(count), pa.array(crc, pa.int64()),
                                       pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def _whole_frames(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and payload sizes of the frames that lie wholly in `data`, and the bytes they and the next one need."""
    at, size, here = [], [], 0
    while here + HEAD <= len(data):
        n = int(data[here:here + 8].copy().view("<u8")[0])
        if here + HEAD + n + TAIL > len(data):
            return np.array(at, np.int64), np.array(size, np.int64), HEAD + n + TAIL
        at.append(here)
        size.append(n)
        here += HEAD + n + TAIL
    return np.array(at, np.int64), np.array(size, np.int64), HEAD


def read_records(spark: SparkSession, files: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """All records of the listed files in their order: doc_id, start (ids of all records before), n_tokens, ids_crc32, ids.

    Files are read in pieces; a task holds one piece, or one record that is longer.
    """
    placed = written(running_sums(files.select("file", "tokens", "bytes"), [], ["file"], {"before": "tokens"}))

    def run(batches):
        system, root = open_folder(folder)
        for batch in batches:
            for name, before, left in zip(*(batch.column(c).to_pylist() for c in ("file", "before", "bytes"))):
                with system.open_input_stream(f"{root}/{name}.records") as stream:
                    held, need = b"", HEAD
                    while left or held:
                        more = stream.read(min(left, max(READ_BYTES, need - len(held))))
                        left -= len(more)
                        held += more
                        data = np.frombuffer(held, np.uint8)
                        at, size, need = _whole_frames(data)
                        if not len(at):
                            if not more or need > len(held) + left:
                                raise ValueError(f"{name} ends within a record")
                            continue
                        rows = _columns(data, at, size, before, with_ids)
                        yield rows
                        before += int(np.sum(rows.column("n_tokens").to_numpy()))
                        held = held[int(at[-1] + HEAD + size[-1] + TAIL):]
    return placed.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, RECORDS)


def read_index(files: DataFrame, folder: str) -> DataFrame:
    """(file, number, offset, bytes) of every record, from the index files alone."""
    def run(batches):
        system, root = open_folder(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_stream(f"{root}/{name}.index") as stream:
                    number = 0
                    while piece := stream.read(READ_BYTES):
                        places = np.frombuffer(piece, "<i8").reshape(-1, 2)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(np.arange(len(places)) + number),
                                                          pa.array(places[:, 0]), pa.array(places[:, 1])], names=["file", "number", "offset", "bytes"])
                        number += len(places)
    return files.select("file").mapInArrow(run, "file string, number long, offset long, bytes long")


def read_shuffled(spark: SparkSession, files: DataFrame, folder: str, seed: int, with_ids: bool = True) -> DataFrame:
    """All records in an order that depends on `seed`: position long beside the columns of `read_records` (start is null).

    Only index entries are shuffled. Each task seeks the records of its stretch of the order and reads them one by one.
    """
    entries = read_index(files, folder).withColumn("draw", F.xxhash64(F.lit(seed), "file", "number"))
    dealt = entries.repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "draw", "file", "number").sortWithinPartitions("draw", "file", "number")
    dealt = written(dealt.select("file", "offset", "bytes", F.monotonically_increasing_id().alias("position")))

    def run(batches):
        system, root = open_folder(folder)
        name = stream = None
        for batch in batches:
            for file, offset, size, position in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "bytes", "position"))):
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, system.open_input_file(f"{root}/{file}.records")
                data = np.frombuffer(stream.read_at(size, offset), np.uint8)
                if len(data) != size:
                    raise ValueError(f"{file} ends within a record")
                rows = _columns(data, np.zeros(1, np.int64), np.array([size - HEAD - TAIL]), None, with_ids)
                yield pa.RecordBatch.from_arrays([pa.array([position], pa.int64()), *rows.columns], names=["position", *rows.schema.names])
        if stream is not None:
            stream.close()
    return dealt.mapInArrow(run, "position long, " + RECORDS)


def token_round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or step_path(spark)
    return read_records(spark, write_records(docs, folder, tokenizer), folder, with_ids=False).drop("ids")
