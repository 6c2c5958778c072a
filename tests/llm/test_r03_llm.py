"""Cases of the third round's findings on the operators for training data."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from lumenlog.llm import bpe, lm, passages
from lumenlog.llm.arrow import slices


def test_the_pipeline_decodes_what_it_encodes(spark):
    """The last stage is the whole operator: ids, and the text that they stand for."""
    texts = {1: "It's the Dog's bone <|endoftext|> again", 2: "", 3: None, 4: "İΣΑΣ 12 3½ é"}
    docs = spark.createDataFrame([(i, "web", t) for i, t in texts.items()], "doc_id long, source string, text string")
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    rows = C.encode(spark, docs, "").collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4]
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_workers_keep_no_caches_beyond_a_task():
    """A Python worker serves all stages: words of one must not stand in memory beside the next."""
    tokenizer = bpe.load()
    for part in slices(iter([pa.RecordBatch.from_pydict({"text": ["one two three", "four five"]})]), "text", 1):
        for text in part.column("text").to_pylist():
            tokenizer.encode(text)
            passages._WORDS[text]
            assert tokenizer.chunks and tokenizer.pieces and passages._WORDS
    assert not tokenizer.chunks and not tokenizer.pieces and not passages._WORDS


@pytest.mark.parametrize("high", [5, 1 << 62])
def test_standing_counts_places_as_a_plain_count_does(high):
    """op6_lm: packed keys and keys too large to be packed; what stands before, in all, and equal numbers for equal keys."""
    key = np.random.default_rng(3).integers(0, 40, 700) * (high // 40 + 1)
    before, total, number = lm.standing(key)
    assert before.tolist() == [int((key[:i] == k).sum()) for i, k in enumerate(key)]
    assert total.tolist() == [int((key == k).sum()) for k in key]
    assert len(set(zip(key.tolist(), number.tolist()))) == len(set(key.tolist())) == len(set(number.tolist()))
    assert [len(x) for x in lm.standing(key[:0])] == [0, 0, 0]


def test_words_are_sorted_once(spark, monkeypatch):
    """op6_lm: the sum and the number over the same words share one sort."""
    plans = []
    keep = lm.blocks.stored
    monkeypatch.setattr(lm.blocks, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    lm.score(spark.createDataFrame([(i, "a b a c") for i in range(12)], "doc_id long, text string")).count()
    assert [plan.count("Sort [") for name, _, plan in plans if name == "words"] == [1]
