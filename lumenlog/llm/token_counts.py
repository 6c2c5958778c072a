"""Token counts without token ids: pieces are counted once per distinct pre-token.

Documents become blocks of pre-token frequencies (``blocks``). Rows of pre-tokens are brought together by pre-token
and sorted, each run's pieces are counted once, and the counts return to the blocks, where they are multiplied with the
documents' frequencies and summed.

Defined cases: a null text has 0 bytes and 0 tokens; special tokens inside a text count one each; repeated rows are
rows of the result; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import blocks
from lumenlog.llm.bpe import TOKENIZER, Kept, load


class PreTokens:
    """Pre-tokens of texts as numbers; special tokens are terms of their own."""

    def __init__(self, tokenizer: str):
        self.bpe, self.vocabulary = load(tokenizer), {}
        self.chunks = Kept(self.chunk, 1 << 20)

    def number(self, term: str) -> int:
        return self.vocabulary.setdefault(term, len(self.vocabulary))

    def chunk(self, text: str) -> bytes:
        return np.array([self.number(p) for p in self.bpe.split.findall(text)], np.int32).tobytes()

    def terms(self, text: str) -> np.ndarray:
        bpe, out = self.bpe, []
        for plain, special in bpe.segments(text):
            out.extend(map(self.chunks.__getitem__, bpe.chunked(bpe.normalized(plain))))
            if special:
                # No pre-token holds a space, so these names are free.
                out.append(np.array([self.number(" " + special)], np.int32).tobytes())
        return np.frombuffer(b"".join(out), np.int32)


def count_pieces(terms: DataFrame, tokenizer: str) -> DataFrame:
    """(block, place, pieces) of (word, block, place): one count for each run of a word in the sorted partition."""

    def run(batches):
        bpe, last, n = load(tokenizer), None, 0
        for batch in batches:
            words = batch.column("word").dictionary_encode()
            counts = []
            for w in words.dictionary.to_pylist():
                if w != last:
                    last, n = w, 1 if w.startswith(" ") else len(bpe.piece(w)) // 4
                counts.append(n)
            pieces = np.array(counts, np.int64)[words.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("place"), pa.array(pieces)], ["block", "place", "pieces"])

    rows = terms.select("word", "block", "place").repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(run, "block long, place int, pieces long")


def token_counts(docs: DataFrame, limit: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    table = blocks.build(sized, lambda: PreTokens(tokenizer), ["doc_id", "n_bytes"])
    values = count_pieces(blocks.terms(table), tokenizer)
    found = blocks.sums(table, values.withColumnRenamed("pieces", "n_tokens"), ["n_tokens"], ["doc_id", "n_bytes"])
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
