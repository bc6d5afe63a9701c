import hashlib
import random
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import bpe, queries, token_files

from .test_kernels import thue_morse

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "  a  b", " a\n\n b \n", "it's they're I'll we've 's 't''s '' 'd'm a 'tis 'Re'sx", "x\t y\r\n z", "日本語 123 ½ ²", "<|endoftext|>a <|endoftext|> b<|startoftext|>", "a  x", "é'sé ’s é İ Σ ΑΣ ǅ ß ſ", "z" * 5000, " " * 3000, "🎉🎉 x🎉", "..'s 12's <| <|end", "가 ͸ \x00\x1c\x85"]


def texts():
    rng = random.Random(5)
    letters = list(" \n\t'sretvlmdaZ1.é日🎉 -<|́")
    return ODD + [*thue_morse(), " ".join(thue_morse())] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(BYTE)


def test_byte_bpe_equals_the_library(vocabulary):
    e, t = bpe.Encoder(vocabulary), Tokenizer.from_file(BYTE)
    own = texts()
    ids, size = e.encode(pa.array(own, pa.large_string()))
    at = 0
    for x, n in zip(own, size.tolist(), strict=True):
        got = ids[at : at + n]
        at += n
        assert got.tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)
        assert e.decode(got).decode("utf-8", "replace") == t.decode(got.tolist(), skip_special_tokens=False)


def test_failing_pieces_are_merged_and_others_are_not(vocabulary):
    e = bpe.Encoder(vocabulary)
    e.encode(pa.array([" ".join("the quick thntquellion reedorly xqzjk".split() * 3)]))
    assert 0 < e.stats["merged"] < e.stats["pieces"]


def test_long_pieces_equal_short_rule(vocabulary):
    word = "abcdefgh" * 8
    a = vocabulary._merge_long(word.encode())
    b, _ = vocabulary.merge([word.encode()])
    assert a.tolist() == b.tolist()


def test_bpe_digests_and_decoded_text(spark, sf_dir):
    t = Tokenizer.from_file(BYTE)
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_bpe(spark, sf_dir).collect()} == want
    d = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, ids string")
    assert [(r.doc_id, r.back) for r in bpe.encode(d, BYTE, decoded="back").orderBy("doc_id").collect()] == [(1, "a b"), (2, "")]


def test_word_bpe_equals_the_library():
    e = token_files.PieceEncoder(WORD)
    t = Tokenizer.from_file(WORD)
    own = texts()
    ids, size = e.encode(pa.array(own, pa.large_string()))
    at = 0
    for x, n in zip(own, size.tolist(), strict=True):
        assert ids[at : at + n].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)
        at += n


@pytest.mark.parametrize("made", [lambda v: bpe.Encoder(v), lambda v: token_files.PieceEncoder(WORD)])
def test_pieces_of_one_hash_are_told_apart(vocabulary, made):
    import numpy as np

    e, t = made(vocabulary), Tokenizer.from_file(BYTE if made(vocabulary).__class__ is bpe.Encoder else WORD)
    e.cache.hashes = lambda data, starts, ends: np.full(len(starts), 7, dtype=np.uint64)
    for _ in range(3):
        own = ["one two three one", "four two é five six one", "日本語 two three one four"]
        ids, size = e.encode(pa.array(own, pa.large_string()))
        assert ids.tolist() == [i for x in own for i in t.encode(x, add_special_tokens=False).ids] and size.sum() == len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    t = Tokenizer.from_file(WORD)
    rows = [(i * 7 % 101, x) for i, x in enumerate(texts()[:101])]
    d = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, block string").repartition(3)
    token_files.write_tokens(d, WORD, path := str(tmp_path / "t"), encoding=encoding)
    start, want = 0, []
    for i, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = token_files.with_crc(token_files.read_tokens(spark, path)).orderBy("key").collect()
    assert [tuple(r) for r in got] == want
    part = token_files.read_tokens(spark, path).where("key between 5 and 6").select("key", "n_tokens")
    assert [r.key for r in part.orderBy("key").collect()] == [5, 6]
    token_files.write_tokens(d.limit(0), WORD, path := str(tmp_path / "e"))
    assert token_files.read_tokens(spark, path).count() == 0
