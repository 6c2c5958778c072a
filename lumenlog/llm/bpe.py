"""BPE encoding and decoding by contiguous rank arrays, for tokenizer files of the word-end kind.

A short word is held as an array of part boundaries and an array of the ranks of neighbouring parts. The lowest rank
is found by a scan, its boundary is deleted and the two ranks beside it are refreshed. A scan of a few dozen entries
beats any queue; words beyond ``SHORT`` symbols take a heap, so a text without spaces is no quadratic trap.

Words repeat, so a task keeps the ids of the pieces and of the space-free chunks it met, up to a fixed number of each. Tasks are independent and stateless: nothing is shuffled, and a lost one is run again.

Defined cases: a null text is an empty one and has no ids; special tokens inside a text are single ids; the columns
``ids`` and ``decoded`` replace columns of those names, all others pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenlog.llm.arrow import Kept, mapped, with_columns

TOKENIZER = "word_bpe_49k.json"
SHORT = 64
NONE = sys.maxsize
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next unused from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, pieces_kept: int = 400_000, chunks_kept: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.joined = [self.vocab[a + b] for a, b in merges]  # id by rank
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.specials.values()]))
        for token, i in [*self.vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("|".join(sorted(map(re.escape, self.specials), key=len, reverse=True)) or "(?!)")
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.pieces = Kept(self.piece, pieces_kept)
        self.chunks = Kept(self.chunk, chunks_kept)

    def normalized(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # Python lower-cases a final sigma by its place in the word; the tokenizer does it letter by letter.
        return text.replace("Σ", "σ").lower()

    def chunked(self, text: str) -> list[str]:
        """Space-free runs of a text: pieces never reach over a space."""
        # str.split also cuts at the four information separators, which are no spaces for the tokenizer.
        return regex.split(r"\s+", text) if SEPARATORS.search(text) else text.split()

    def piece(self, text: str) -> bytes:
        """Ids of one piece (a match of the splitting pattern), as bytes."""
        return array("i", self.merged(text.encode().decode("latin-1").translate(self.alphabet))).tobytes()

    def chunk(self, text: str) -> bytes:
        """Ids of a space-free run, as bytes."""
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def symbols(self, word: str) -> list[int]:
        """Ids of the single characters; the last one carries the word end."""
        return [*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + self.end]]

    def merged(self, word: str) -> list[int]:
        parts = self.symbols(word)
        if len(parts) > SHORT:
            return self.merged_long(parts)
        rank, joined = self.ranks.get, self.joined
        near = [rank(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while near and (low := min(near)) != NONE:
            k = near.index(low)  # the boundary between parts k and k + 1 goes
            parts[k] = one = joined[low]
            del parts[k + 1], near[k]
            if k:
                near[k - 1] = rank(parts[k - 1] << 20 | one, NONE)
            if k < len(near):
                near[k] = rank(one << 20 | parts[k + 1], NONE)
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        rank, n = self.ranks.get, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], right[i], right[j] = self.joined[low], -1, right[j], -1
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def segments(self, text: str):
        """(plain text, special token or None) in the order of the text."""
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], m[0]
            at = m.end()
        yield text[at:], None

    def encode(self, text: str | None) -> np.ndarray:
        out = []
        text = text or ""
        if not self.special.search(text):
            return np.frombuffer(b"".join(map(self.chunks.__getitem__, self.chunked(self.normalized(text)))), np.int32)
        for plain, special in self.segments(text):
            out.extend(map(self.chunks.__getitem__, self.chunked(self.normalized(plain))))
            if special:
                out.append(array("i", [self.specials[special]]).tobytes())
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


_LOADED: dict[str, Bpe] = {}


def load(name: str = TOKENIZER) -> Bpe:
    """The tokenizer of a file, once per Python process: a name of the public files, or a path."""
    if name not in _LOADED:
        import public_tokenizers

        _LOADED[name] = Bpe(name if "/" in name else public_tokenizers.path(name))
    return _LOADED[name]


def ids_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def transcode(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, decoded: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if asked for, ``decoded``: the text that those ids stand for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(tokenizer)
        ids = [bpe.encode(x) for x in batch.column(text).to_pylist()]
        new = {"ids": ids_array(ids)}
        if decoded:
            new["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.string())
        return with_columns(batch, new)

    return mapped(docs, run, text, ids="array<int>", **({"decoded": "string"} if decoded else {}))


def decode(df: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with ``decoded``, the text that the ids stand for; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(tokenizer)
        return with_columns(batch, {"decoded": pa.array([bpe.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()], pa.string())})

    return mapped(df, run, decoded="string")
