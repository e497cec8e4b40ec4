import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm.bpe import PerfectHash, codec, encode_decode, load_ranks
from tidemark.llm.token_file import token_file

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  ", "a", "a  b", "a   b c", " a\n b", "a\n\n  b", "x\t\t y ", "don't we'll", "été 12 345", "日本語 text", "  a  b", "<|endoftext|> a <|endoftext|>",
       "z" * 5000, "1" * 999 + " " * 50 + "q", "é\r\n é\r\n", "a\x1cb \x1d c d 　 e", "🙂🙂 🙂a", "\x00 \x00"]


def _texts(n=300):
    r = random.Random(5)
    pool = ["the", "ing", " ", " ", "  ", "\n", ".", ",", "!!", "é", "ß", "12", "'s", "\t", "ño", "中文", "🙂", "_", "x" * 30, " "]
    return ["".join(r.choice(pool) for _ in range(r.randrange(0, 60))) for _ in range(n)] + ODD


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [str(i).encode() for i in range(3000)]
    h = PerfectHash(keys)
    assert sorted(h.get(k) for k in keys) == list(range(3000))
    assert h.get(b"stranger") == -1 and PerfectHash([]).get(b"a") == -1


def test_codec_equals_tiktoken():
    own = codec(RANKS, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
    for t in _texts():
        packed = own.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(t or ""), repr(t)
        assert own.decode(packed) == (t or "").encode()


def test_bpe_query_rows(spark):
    texts = _texts(40) * 2
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in encode_decode(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = theirs.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_file_equals_library(spark):
    texts = _texts(200)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(5)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(token_file(df).collect())
    start = 0
    assert len(got) == len(texts)
    for i, (doc, at, n, crc) in enumerate(got):
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        assert (doc, at, n, crc) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(texts[i])
        start += n


@pytest.mark.parametrize("rows", [[], [(None, "a"), (None, None), (3, ""), (3, "b")]])
def test_token_file_nulls_ties_and_empty(spark, rows):
    got = token_file(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert sum(r.n_tokens for r in got) == sum(1 if not t else 2 for _, t in rows)
