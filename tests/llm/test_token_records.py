"""Framed token ids against the library's own encoding, checksums against published values, damage and shuffled reads."""
import itertools
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ostinato.llm import queries, token_records

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, file string, start long"
ROWS = [(7, "Hello world, it's 12 o'clock", "a", 1), (3, None, "a", 1), (3, "", None, 1), (None, "no id", "b", 2), (7, "Hello world, it's 12 o'clock", "a", 1),
        (-5, "é ß 漢字 <|endoftext|> x\n\n  y", "c", None), (11, "word " * 30_000, "d", 4), (12, "z" * 5_000, "d", 4)]


def long_way(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (token_records.POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    rng = np.random.default_rng(1)
    parts = [b"", b"123456789", bytes(32), b"a", *(rng.bytes(n) for n in (63, 64, 65, 128, 129, 777, 4096))]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    got = token_records.crc32c(data, np.cumsum(size) - size, size).tolist()
    assert got[1] == 0xE3069283 and got[2] == 0x8A9136AA          # published values
    assert got == [long_way(p) for p in parts]
    assert len(token_records.crc32c(data, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def library_rows(rows):
    library = Tokenizer.from_file(PATH)
    out = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    return [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in out]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("file_bytes", [token_records.FILE_BYTES, 200])
def test_round_trip(spark, docs, tmp_path, file_bytes):
    files = token_records.write_records(docs, str(tmp_path), PATH, file_bytes=file_bytes)
    got = token_records.read_records(spark, files, str(tmp_path)).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (d is not None, d or 0, n, c) for d, n, c in library_rows([r[:2] for r in ROWS]))
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    index = token_records.read_index(files, str(tmp_path)).collect()
    assert len(index) == len(ROWS) and sum(r.bytes for r in index) == sum(r.bytes for r in files.collect())
    one = token_records.read_shuffled(spark, files, str(tmp_path), 1).orderBy("position").collect()
    two = token_records.read_shuffled(spark, files, str(tmp_path), 2).orderBy("position").collect()
    key = lambda r: (r.doc_id or 0, r.n_tokens, r.ids_crc32, r.ids)
    assert sorted(map(key, one)) == sorted(map(key, got)) == sorted(map(key, two)) and list(map(key, one)) != list(map(key, two))


def test_damage_is_found(spark, docs, tmp_path):
    files = token_records.write_records(docs, str(tmp_path), PATH)
    for name in [f for f in os.listdir(tmp_path) if f.endswith(".records")]:
        whole = (tmp_path / name).read_bytes()
        for spoiled in (whole[:30] + bytes([whole[30] ^ 1]) + whole[31:], bytes([whole[0] ^ 4]) + whole[1:], whole[:-3]):
            (tmp_path / name).write_bytes(spoiled)
            with pytest.raises(Exception, match="damaged|ends within"):
                token_records.read_records(spark, files, str(tmp_path)).collect()
        (tmp_path / name).write_bytes(whole)


def test_empty(spark, docs, tmp_path):
    files = token_records.write_records(docs.filter("false"), str(tmp_path), PATH)
    assert files.count() == 0 and token_records.read_records(spark, files, str(tmp_path)).count() == 0
    assert token_records.read_shuffled(spark, files, str(tmp_path), 1).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = library_rows([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()])
    got = queries.QUERIES["op12_token_records"](spark, sf).orderBy("doc_id").collect()
    starts = [0, *itertools.accumulate(n for _, n, _ in want)][:-1]
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(d, s, n, c) for (d, n, c), s in zip(want, starts)]
