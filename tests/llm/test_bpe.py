"""Chunked encodings against the tokenizers library, text by text."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import blocks as bl, bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, encoding="utf-8").read())


def test_documents(codec, library):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks()
    want = [x.ids for x in library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode_column(codec, texts)] == want
    assert [codec.decode(x) for x in map(np.array, want)] == [library.decode(x, skip_special_tokens=False) for x in want]


@pytest.mark.parametrize("chunk", [2, 4, 16, 64])
def test_small_chunks_of_strange_text(codec, library, monkeypatch, chunk):
    """Cuts every few bytes, in texts of blanks, marks, numerals and many scripts."""
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    rng = random.Random(chunk)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "B", "the", "'s", "'re", "'LL", "don't", "é", "ß", "ñ", "١", "²", "½", "中", "ї", "😀", "́", "​", "ǆ", "9", "123", ".", "--", "###", "<|endoftext|>", "<|end", "\x00", "\x7f"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 80))) for _ in range(1500)]
    texts += ["".join(chr(c) for c in range(1, 0x250)), " ".join(chr(c) for c in range(1, 0x250)), "a".join(chr(c) for c in range(1, 0x250))]
    got = bpe.encode_column(codec, pa.array(texts))
    for t, g in zip(texts, got, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert g.tolist() == want, t
        assert codec.decode(g) == library.decode(want, skip_special_tokens=False)


def test_query_columns_and_edge_cases(spark, library):
    texts = [None, "", " ", "x" * 100_000, "word " * 30_000, "<|endoftext|>", "same same", "same same"]
    docs = spark.createDataFrame([(i if i else None, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH).collect()}
    for i, t in enumerate(texts):
        r = got[i if i else None]
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["text"] == t
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert bpe.encode(docs.limit(0), PATH).collect() == []


def test_every_distinct_chunk_is_encoded_once(spark, codec, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(6)
    made = spark.sparkContext.accumulator(0)
    got = bpe.encode(docs, PATH, sizes=bl.Sizes(100_000, 500, 4, 2000), made=made).collect()
    texts = [r["text"] or "" for r in got]
    assert [r["ids"] for r in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    names = [n for names in bpe.Chunked(codec, pa.array(texts)).names for n in names]
    assert made.value == len(set(names)) < len(names)


def test_joins_widen_until_edges_agree(codec):
    """Chunks without a token edge at some boundaries: the join goes on to one where they have it."""
    raw = b"one two three four five six seven eight nine ten"
    sure, whole = bpe._sure(np.frombuffer(raw, np.uint8)).tolist(), codec.plain(raw).tolist()

    def chunk(hidden):
        def made(a, b):
            ids, ends = codec.coded(codec.plain(raw[a:b]))
            return ids, [e - (a + e in hidden) * 0.5 for e in ends]

        return made

    for cuts in ([sure[3] + 2], [sure[3]], [sure[1] + 1, sure[4] + 2, sure[6] + 1]):
        for hidden in ([], [sure[2]], [sure[3]], sure[2:5], sure):
            assert codec.join(raw, cuts, sure, chunk(hidden), codec.plain).tolist() == whole, (cuts, hidden)


def test_ids_outside_the_vocabulary_raise(spark, codec):
    for bad in (-1, len(codec.bytes)):
        with pytest.raises(Exception, match="token ids must be"):
            bpe.decode(spark.createDataFrame([([1, bad],)], "ids array<int>"), PATH).collect()
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).collect()[0]["decoded"] is None
