"""BPE by merge rounds against the tokenizers library."""
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ostinato.llm import bpe

ODD = ["", None, "It's  they'll 'S don''t  \n\n x\n's '  's a  'll", "　　x 　y", "ΑΣ ΟΔΟΣ.", "İstanbul ﬁ Å é ½²③ 12345",
       "<|endoftext|> a <|startoftext|>b<|endoftext|><|endoftext|>", "a   ", "   a", "a" * 301 + " " + "b" * 7, "日本語テキスト 한국어 😀👩‍👩‍👧 x",
       "\t\t\r\n x  \x1c y\x85z", "'re 've'm 'd'dd", "x <|endoftext|>  y's", "ab" * 20000]
# Unicode 15 blocks that both sides know
BLOCKS = [(0x20, 0x7E), (0xA1, 0x17F), (0x391, 0x3A1), (0x410, 0x44F), (0x5D0, 0x5EA), (0x905, 0x939), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0x1F600, 0x1F64F),
          (0x300, 0x36F), (0x2000, 0x200A), (0x660, 0x669)]


def random_texts(seed, n=1500):
    rng = random.Random(seed)
    near = "ab 's\n\tré½٣漢😀.!-_re ll'0  "
    yield from ("".join(rng.choice(near) for _ in range(rng.randint(0, 40))) for _ in range(n))
    yield from ("".join(chr(rng.randint(*rng.choice(BLOCKS))) for _ in range(rng.randint(1, 30))) for _ in range(n))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_text(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    texts = ODD + list(random_texts(5))
    ids, at = own.encode(pa.array(texts, pa.string()))
    ids = ids.tolist()
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[at[k]:at[k + 1]] == want, text
        assert bpe.detokenize(own.table, want) == library.decode(want, skip_special_tokens=False)


def test_operator(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(k, t, "clash") for k, t in enumerate(ODD)] + [(None, "null id", "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    got = bpe.encode_decode(docs, path, outputs=outputs).collect()
    assert len(got) == len(rows)
    for r, (doc, text, _) in zip(got, rows):
        want = library.encode(text or "", add_special_tokens=False).ids
        plain = library.decode(want, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (doc, len(want), want, plain)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert bpe.encode_decode(docs.filter("false"), path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_decode(docs, path, outputs=("tokens",))


def test_merge_order_is_checked(tmp_path):
    file = tmp_path / "bad.json"
    letters = bpe.byte_letters()
    vocab = {c: k for k, c in enumerate([*letters, "ab", "abc"])}
    file.write_text(__import__("json").dumps({"model": {"vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}, "added_tokens": []}))
    with pytest.raises(ValueError):
        bpe.MergeTable(str(file))
