"""Stages one by one against plain versions of what they decide, on whole small tables."""

import re
from collections import Counter

import public_tokenizers
from test_mixture import plain_targets
from test_simhash import brute, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline as C
from lumenlog.functions.storage import materialise
from lumenlog.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = materialise(stage(spark, docs, SF), name)
        after = docs.collect()
        assert after
        if name != "encode":
            assert docs.columns == columns
        seen[name] = before, after
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    right = [(r.doc_id in kept) == bool(labels[r.doc_id]) for r in before if r.doc_id in labels]
    assert sum(right) >= 0.97 * len(right)

    before, after = seen["near_duplicates"]
    before = sorted(before, key=lambda r: r.doc_id)
    roots = brute([plain_fingerprint(r.text) for r in before])
    assert sorted(r.doc_id for r in after) == [r.doc_id for i, r in enumerate(before) if roots[i] == i]

    before, after = seen["passages"]
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        words = iter(texts[r.doc_id].split())
        assert all(w in words for w in r.text.split()), "a subsequence of the text is left"
    runs = Counter()
    for r in after:
        words = r.text.lower().split()
        runs.update({tuple(words[i : i + 80]) for i in range(len(words) - 79)})
    assert not [x for x, n in runs.items() if n > 1]

    before, after = seen["mix"]
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += len(words.findall(r.text))
    for r in after:
        taken[r.source] += len(words.findall(r.text))
    for s, t in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 16

    before, after = seen["encode"]
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in before)
    assert sorted((r.doc_id, list(r.ids)) for r in after) == want


def test_run(spark):
    assert C.run(spark, SF).count() > 0
