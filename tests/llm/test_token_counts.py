"""Token counts against the tokenizers library."""

import public_tokenizers
from tokenizers import Tokenizer

from lumenlog.llm import bpe, blocks, queries, token_counts

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def plain(rows):
    out = []
    for i, t in rows:
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        out.append((str(i), len((t or "").encode()), n, n > 2048))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op7_token_counts(spark, SF)) == plain(rows)


def test_odd_rows_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks.build, "__defaults__", (None, 3, 200, False))
    rows = [(1, None), (1, "the cat's hat"), (1, "the cat's hat"), (None, "a<|endoftext|>b 12"), (4, " \t"), (5, "É́x " * 900), (6, "the " * 2048), (7, "the " * 2049)]
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, block int").repartition(2)
    assert got(token_counts.token_counts(df)) == plain(rows)
    assert token_counts.token_counts(df.filter("false")).collect() == []
