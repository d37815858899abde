"""Token counts, codec and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from utterscope.llm import bpe_codec, packing, queries, token_counts
from utterscope.llm.pretokens import vocabulary

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORDS)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def random_docs(spark):
    rng = random.Random(1)
    parts = ["a", "aa", "'s", "'RE", " ", "  ", "\n", "ß", "É", "1", "²", "ª", "½", "the", " and", "_", "-", "!!", "日本",
             "<|endoftext|>", "<|startoftext|>", "🙂", "́", "Σ", "İ", "x" * 25, "ab" * 20, "\x1c", "Ᲊ"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_counts_equal_the_library(random_docs, odd_docs, no_docs, byte_tokenizer):
    for docs in (random_docs, odd_docs):
        got = sorted(map(tuple, token_counts.count_tokens(docs, BYTES).collect()), key=str)
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(byte_tokenizer, r.text))) for r in docs.collect()), key=str)
        assert got == want
    assert token_counts.count_tokens(no_docs, BYTES).count() == 0


def test_codec_round_trip(random_docs, odd_docs, no_docs, byte_tokenizer):
    for docs in (random_docs, odd_docs):
        encoded = bpe_codec.encode_texts(docs, BYTES)
        assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str) == \
            sorted(((r.doc_id, ids_of(byte_tokenizer, r.text)) for r in docs.collect()), key=str)
        assert sorted(((r.doc_id, r.text) for r in bpe_codec.decode_ids(encoded, BYTES).collect()), key=str) == \
            sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert bpe_codec.decode_ids(bpe_codec.encode_texts(no_docs, BYTES), BYTES).count() == 0


def test_ids_outside_the_vocabulary_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, [60000, -1, 65]), (2, None), (3, []), (4, [None, 65])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe_codec.decode_ids(rows, BYTES).collect()} == {1: "b", 2: "", 3: "", 4: "b"}


def test_every_prefix_has_one_last_token(byte_tokenizer):
    encoder = bpe_codec.PrefixEncoder(vocabulary(BYTES))
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abeinorstth ") for _ in range(rng.randint(1, 30))).replace(" ", "")
        for n in range(1, len(text) + 1):
            assert encoder.encode([text[:n].encode()])[0] == ids_of(byte_tokenizer, text[:n])


def test_chunks_are_learnt_again_after_the_limit(byte_tokenizer):
    _, chunks = token_counts._counter(BYTES)
    before = chunks.limit
    chunks.limit = 3
    words = [[f" word{i}" for i in range(10)], [" word1", " word1"]]
    assert chunks.values(words) == [[len(ids_of(byte_tokenizer, w)) for w in ws] for ws in words]
    chunks.limit = before


def check_pieces(rows, docs, tokenizer):
    want = {}
    for d in docs:
        want.setdefault(d.doc_id, []).append(ids_of(tokenizer, d.text) + [1])
    by_doc = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.bucket == r.length.bit_length() - 1
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert by_doc.keys() == want.keys()
    for doc, lists in want.items():
        pieces = by_doc[doc]
        for ids in lists:
            assert sum(p.length for p in pieces if p.doc_tokens == len(ids)) % len(ids) == 0
            for p in pieces:
                if p.doc_tokens == len(ids) and len(lists) == 1:
                    assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start:p.start + p.length]


def test_pieces_hold_each_id_once(random_docs, odd_docs, no_docs, word_tokenizer):
    for docs in (random_docs, odd_docs):
        check_pieces(packing.pack(docs, WORDS).collect(), docs.collect(), word_tokenizer)
    assert packing.pack(no_docs, WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, WORDS, longest=100)


def test_binary_pieces():
    assert packing.binary_pieces(0, 8) == []
    assert packing.binary_pieces(29, 8) == [8, 8, 8, 4, 1]
    assert all(sum(packing.binary_pieces(n, 16)) == n for n in range(200))


def test_buckets_on_disk(spark, odd_docs, tmp_path):
    pieces = packing.pack(odd_docs, WORDS)
    packing.write_buckets(pieces, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.count() == pieces.count() and back.where("length != pow(2, bucket)").count() == 0


def test_queries_equal_the_library(spark, byte_tokenizer, word_tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = {d: ids_of(byte_tokenizer, t) for d, t in docs.items()}
    counts = {r.doc_id: r for r in queries.op2(spark, SF).collect()}
    assert all(counts[d].n_tokens == len(x) and counts[d].over_limit == (len(x) > 1024) for d, x in ids.items())
    coded = {r.doc_id: r for r in queries.op3(spark, SF).collect()}
    for d, x in ids.items():
        assert coded[d].ids_sha256 == hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
        assert coded[d].decoded_sha256 == hashlib.sha256(byte_tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()
    for r in queries.op4(spark, SF).collect():
        x = ids_of(word_tokenizer, docs[r.doc_id]) + [1]
        assert r.doc_tokens == len(x)
        assert r.ids_crc32 == zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes())
