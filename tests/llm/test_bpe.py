"""Ids against tiktoken, exact decoding, and boundaries of pre-tokens at every code point."""

import hashlib
import random

import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from lumenark.llm.bpe import Encoder, decode, encode, encode_batch, load_ranks, pre_tokens, round_trip, scan  # noqa: E402

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(ranks, reference):
    rng = random.Random(3)
    alphabet = "a b'sstmdrevl'l  \n\t  1²½٣éßñ%%!…中文😀‍́_-'''"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", "'", "''", "a'", " '", "'s", "I've'd've 's' s ' \n x", "  ", " \n ", "don'tx", "'ll'll", "x'\n's", "a" * 3000, "　x", "%" * 2000 + "'s", "abcd'" * 500 + "é" * 1000, "'re" * 300]
    small = Encoder(ranks, entries=50)  # the cache turns over
    for encoder in (Encoder(ranks), small):
        got = list(encode_batch(pa.array(texts), encoder))
        assert got == [reference.encode_ordinary(t) for t in texts]
        assert all(encoder.decode(x) == t.encode() for x, t in zip(got, texts, strict=True))


def test_every_code_point(ranks, reference):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][::3]
    texts = ["".join("a" + c + "1" + c + " " + c + "b" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert list(encode_batch(pa.array(texts), Encoder(ranks))) == [reference.encode_ordinary(t) for t in texts]


def test_scan_is_the_same_in_blocks_of_any_size():
    import numpy as np

    symbols = np.random.default_rng(1).integers(0, 9, 1000).astype(np.uint8)
    want = scan(symbols, 1000)
    assert all((scan(symbols, b) == want).all() for b in (1, 7, 128))


def test_pre_tokens_cover_the_text():
    texts = ["a b", None, "", "x\n\ny 'll", "é"]
    rows = [r for _, rr in pre_tokens(pa.array(texts)) for r in rr]
    assert [b"".join(r).decode() for r in rows] == [t or "" for t in texts]


def test_queries(docs, corpus, reference):
    rows = [(1, None), (2, ""), (3, "hello world"), (None, "x"), (3, "hello world")] + [(100 + r.doc_id, r.text) for r in corpus.where("doc_id < 100").collect()]
    text = dict(rows)
    df = docs(rows, extra=True)
    for r in round_trip(df, PATH, with_ids=True).collect():
        ids = reference.encode_ordinary(text[r.doc_id] or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
    encoded = encode(df, PATH)
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in decode(encoded, PATH).collect()) == sorted((d or 0, t or "") for d, t in rows)
    assert all(len(r.ids) == len(r.offsets) for r in encoded.collect()) and round_trip(docs([]), PATH).count() == 0
