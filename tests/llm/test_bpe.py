import hashlib
import random

import numpy as np
import pytest

from cartulary.llm import bpe
from cartulary.llm.queries import BYTE_BPE
from tests.llm.cases import LONG, ODD_TEXTS, documents, empty_documents, given_texts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE_BPE)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pieces_of_any_characters(library):
    r = random.Random(5)
    ranges = [(0, 0x250), (0x370, 0x600), (0x900, 0xA00), (0x2000, 0x2100), (0x3000, 0x3100), (0x4E00, 0x4F00), (0x1F600, 0x1F640), (9, 14), (32, 33), (0x1C, 0x20)]
    texts = ["".join(chr(r.randint(a, b - 1)) for a, b in r.choices(ranges, k=r.randint(1, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaaa", "ab" * 500, "  \n\n  x \t"]
    vocab = bpe.vocabulary(BYTE_BPE)
    found = [ids(x) for x in bpe.encode_texts(vocab, texts)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, found, expected, strict=True) if a != b] == []


def test_given_documents_and_round_trip(spark, library):
    rows = [*given_texts(spark), *((10_000 + i, t) for i, t in enumerate([*ODD_TEXTS, LONG]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coded = bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE)
    found = {r.doc_id: r for r in coded.select("*", *bpe.digests(coded)).collect()}
    for i, text in rows:
        expected = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(expected, skip_special_tokens=False)
        row = found[i]
        assert ids(row.ids) == expected and row.decoded == back and row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_broken_bytes_decode_with_replacement(spark, library):
    some = [np.array(x, "<u4").tobytes() for x in ([128, 129, 130], [447], [], [50256])]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(some)] + [(9, None)], "k int, ids binary")
    found = {r.k: r.decoded for r in bpe.decode(df, BYTE_BPE).collect()}
    assert found == {**{i: library.decode(ids(x), skip_special_tokens=False) for i, x in enumerate(some)}, 9: ""}


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "old", 2.0)], "doc_id long, text string, ids string, decoded double")
    row = bpe.encode(docs, BYTE_BPE).first()
    assert row.asDict().keys() == {"doc_id", "text", "decoded", "ids"} and ids(row.ids) == [64]
    assert bpe.encode(empty_documents(spark), BYTE_BPE).collect() == []
    assert bpe.encode(documents(spark, ["b", "b"]), BYTE_BPE).count() == 2
