"""BPE against the tokenizers library: ids and decoded texts, odd texts included."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenlog.llm import bpe, queries

SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "I'm it's O'RE  <|endoftext|>x<|STARTOFTEXT|><|startoftext|>", "İΣΑΣ ς 12 3½ é \x1ca\x1f b\x85c  d​ ﻿", "a" * 5000, "ab" * 300 + "</w>", "!!!" * 100, "日本語👩‍👩‍👧", "q</w>x'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def same(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = bpe.load().encode(text)
    assert got.tolist() == want
    assert bpe.load().decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    same(library, text)


def test_random_texts(library):
    r = random.Random(7)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0x1F600, 0x1100, 0x1161]] + ["'s", " ", "the", "ing"] * 60
    for _ in range(1500):
        same(library, "".join(r.choices(pool, k=r.randrange(1, 60))))


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib

    got = queries.op1_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "ab cd", "y"), (None, "", None)], "doc_id long, text string, ids string")
    rows = bpe.transcode(df).collect()
    assert [len(r.ids) for r in rows] == [0, len(bpe.load().encode("ab cd")), 0]
    assert bpe.decode(bpe.transcode(df, decoded=False)).select("decoded").collect()[1][0] == rows[1].decoded
    assert bpe.transcode(df.filter(F.lit(False))).collect() == []


def test_small_caches_change_nothing():
    small = bpe.Bpe(public_tokenizers.path(bpe.TOKENIZER), 3, 2)
    text = "the cat, the dog's and the cat again; the end " * 5
    assert small.encode(text).tolist() == bpe.load().encode(text).tolist()
