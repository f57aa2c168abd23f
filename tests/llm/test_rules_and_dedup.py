"""Counts, host rules, exact groups and WARC archives against plain versions."""
import gzip
import hashlib
import io

import numpy as np
import pyarrow as pa
import pytest
from plain import base_counts, lower

from ostinato.llm import exact_dedup, quality_rules, text_stats, warc
from ostinato.llm.storage import written

TEXTS = [None, "", " \n\t", "one", "a b c a b c", "x\nx\n\n \nx y\nx y\n", "é é é é", "# | a < b\n# | a < b", "l1\r\nl1\r\nl2", "a b c d " * 50, "\n\n", "A\x85b 　c",
         " ".join(f"w{k % 7}" for k in range(400)), "word " * 30000]


def test_counts():
    rng = np.random.default_rng(2)
    texts = TEXTS + ["".join(rng.choice(list("ab \n#é"), 60)) for _ in range(300)]
    got = text_stats.base_counts(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert {n: int(v[k]) for n, v in got.items()} == base_counts(text), repr(text)[:80]
    assert all(len(v) == 0 for v in text_stats.base_counts(pa.array([], pa.string())).values())


def test_host_rules(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good, "good", "x") for k in range(30)] + [(100 + k, "bad", "bad", "x") for k in range(30)] + [(200, good, "bad", "x"), (300, good, None, "x")]
    rows += [(400, None, "good", "x"), (None, "# # #", "good", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    got = {r.id: r for r in quality_rules.host_rules(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[k].kept for k in range(30)) and not any(got[100 + k].kept for k in range(30))
    assert got[200].host_failed and not got[200].kept          # a clean text of a host that fails
    assert got[300].kept and 0 < got[300].host_rate < 0.5      # one document: close to the mean
    assert not got[400].kept and not got[None].kept
    assert quality_rules.host_rules(docs.filter("false")).count() == 0
    same = quality_rules.host_rules(docs.filter("source = 'good'"))
    assert same.select("host_rate").distinct().count() == 1


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(spark, keep):
    rows = [(1, "Text"), (2, "tEXT"), (3, "text "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "A" * 100_000), (9, "a" * 100_000), (None, "text"), (None, "null"), (None, "null"),
            (5, ""), (1, "solo"), (1, "other")] + [(1000 + k, "many copies é") for k in range(500)]
    docs = written(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(7))
    got = exact_dedup.exact_groups(docs, keep=keep).collect()
    groups = {}
    for doc, text in rows:
        groups.setdefault(lower(text), []).append(doc)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        ids = by_digest[r.text_sha256]
        # a null id is smaller than any
        want = max([i for i in ids if i is not None], default=None) if keep == "max" else (None if None in ids else min(ids))
        assert r.group_size == len(ids) and r.keep_id == want and (not r.kept or r.id == r.keep_id)
    kept = exact_dedup.exact_dedup(docs, keep=keep)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(docs.filter("false")).count() == 0


PAGES = [(1, "http://a/ b\r\nX: y", "p" * 99), (2, None, "p" * 99), (3, "u", "q" * 100), (4, "u", "q" * 100), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 300_000),
         (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 300_000), (None, "u", "q" * 100), (9, "u", "r" * 500), (9, "u", "r" * 500), (10, "u", "r" * 500)]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    folder = str(tmp_path / "warc")
    archives = warc.write_archives(pages, folder, archive_bytes=2000)
    chunks = warc.read_chunks(spark, archives, folder, chunk_bytes=1 << 16).collect()
    records = {}
    for c in sorted(chunks, key=lambda c: (c.archive, c.record_no, c.chunk_no)):
        records.setdefault((c.archive, c.record_no), []).append(c)
    assert len(records) == len(PAGES)
    seen = []
    for parts in records.values():
        body = b"".join(p.chunk or b"" for p in parts)
        digest, end = hashlib.sha256(), 0
        for k, p in enumerate(parts):
            digest.update(p.chunk)
            end += len(p.chunk)
            assert (p.chunk_no, p.end_offset, p.digest_so_far, p.is_last) == (k, end, digest.hexdigest(), k == len(parts) - 1) and p.chunk_bytes <= 1 << 16
        page = None if parts[0].record_id == "none" else int(parts[0].record_id)
        html = next((h or "") for i, _, h in PAGES if i == page).encode()
        last = parts[-1]
        assert (last.payload_bytes, last.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert body == (html if last.record_type == "response" else b"")
        seen.append((page, last.record_type, last.refers_to))
    assert sorted(seen, key=str) == sorted([(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", "3"), (5, "response", None), (6, "response", None),
                                           (7, "response", None), (8, "revisit", "7"), (None, "revisit", "3"), (9, "response", None), (9, "response", None), (10, "revisit", "9")], key=str)
    assert warc.archive_round_trip(pages.filter("false")).count() == 0
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()}
    assert (8, "revisit", 7) in got and len(got) == len(PAGES) - 1


def test_damaged_archives():
    parts = warc.record_parts(1, "u", hashlib.sha256(b"body").hexdigest(), None, False, memoryview(b"body"))
    data = gzip.compress(b"".join(bytes(p) for p in parts))
    assert [b"".join(c) for _, c in warc.RecordReader(io.BytesIO(data + data))] == [b"body", b"body"]
    with pytest.raises(ValueError):
        for _, c in warc.RecordReader(io.BytesIO(data[:-20])):
            list(c)
    with pytest.raises(ValueError):
        for _, c in warc.RecordReader(io.BytesIO(gzip.compress(b"".join(bytes(p) for p in parts)[:-6]))):
            list(c)
