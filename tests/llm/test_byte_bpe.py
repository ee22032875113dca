"""Tree concatenation against the library's encoding of whole texts."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paylake.llm import byte_bpe as B


@pytest.fixture(scope="module")
def coder():
    return B.Coder(B.default_tokenizer())


def plain(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def by_leaves(coder, text, leaf):
    kinds, contents = zip(*coder.leaves(text, leaf))
    assert all(len(c) <= 2 * leaf + 1 for c in contents)
    return B.whole_ids(coder, kinds, coder.leaf_ids(kinds, contents))


ODD = ["a" * 999, "ab" * 500, " " * 700, "\n\n \t" * 150, "abc" * 333 + "'ll" * 90, "日本語テキスト" * 100, "0123456789" * 90,
       "héé" * 200 + "<|endoftext|>" + "zz" * 300, "<|endoftext|>" * 40, " x " * 200, "👩‍👩‍👧" * 120, "'s't're" * 150,
       "word " * 300, "x" * 130 + " " + "y" * 130 + "\x1c" * 200, "=" * 2048, "-=" * 700]


@pytest.mark.parametrize("text", ODD)
@pytest.mark.parametrize("leaf", [3, 16, 77])
def test_leaves_join_exactly(coder, text, leaf):
    assert by_leaves(coder, text, leaf) == coder.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\t\r\x0b\xa0\u3000\x85\x1c!é日👩<|endoftext|>0", max_size=60), max_size=5))
def test_remembered_stretches(texts):
    coder = B._coder(B.default_tokenizer())
    assert coder.digests(texts) == [plain(coder.tok, t) for t in texts]


def test_memory_starts_anew(coder, monkeypatch):
    monkeypatch.setattr(B, "MEMORY", 5)
    texts = ["one two three four five six seven eight", " nine ten", *ODD]
    assert coder.digests(texts) == [plain(coder.tok, t) for t in texts]
    monkeypatch.setattr(B, "CALL_CHARS", 10)
    assert coder.digests(texts) == [plain(coder.tok, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ceinrst'\nAé日0 ", min_size=1, max_size=200), st.integers(2, 20))
def test_random_texts(text, leaf):
    coder = B._coder(B.default_tokenizer())
    assert by_leaves(coder, text, leaf) == coder.tok.encode(text, add_special_tokens=False).ids


def test_random_words_and_windows(coder):
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("aeinrstthingedoure") for _ in range(rng.randint(2, 300)))
        for window in (1, 4):
            cut = rng.randint(1, len(word) - 1)
            assert coder.join(coder.word(word[:cut]), coder.word(word[cut:]), window) == coder.word(word)


def test_documents(spark, coder):
    texts = ["", None, "Hello world", *ODD, "long words " + "q" * 5000 + " end", "Hello world"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (2, "again", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").withColumn("row", F.lit("clash"))
    got = sorted(tuple(r) for r in B.encode(df.repartition(3), leaf=100).na.fill(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if i is None else i, *plain(coder.tok, t)) for i, t, _, _ in rows)
    assert B.encode(df.filter("false"), leaf=100).collect() == []


def test_text_of_megabytes(spark, coder):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(1_500_000)) + " tail " + "word " * 200_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in B.encode(df).collect()] == [(1, *plain(coder.tok, text))]


def test_registered_query(spark, coder):
    sf_dir = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in B.op12_byte_bpe(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == sorted((r["doc_id"], *plain(coder.tok, r["text"])) for r in docs)


def test_other_tokenizers_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        B.Coder(public_tokenizers.path("word_bpe_49k.json"))
