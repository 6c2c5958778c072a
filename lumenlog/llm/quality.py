"""Document quality by a linear-chain conditional random field over the lines.

Every line is good or bad. A line's evidence is its own features and those of the lines before and behind it; the
chain adds how well neighbouring labels go together. Forward-backward gives each line's probability of being good, and
a document's quality is their mean, weighted by line length.

The field is fitted on the driver, on the lines of at most ``max_docs`` labelled documents (a parameter; those of the
lowest hash); only their features travel. Labels of lines are those of their document. Scoring is one pass of
independent tasks.

Defined cases: a null or empty text is one empty line; documents without a label, labels without a document and null
labels teach nothing; of contradictory labels the lowest counts; without any label every score is one half; the columns
``score`` and ``predicted`` replace columns of those names. Only the text is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.arrow import mapped, slices, with_columns

#: Bound of the labelled sample the field is fitted on.
MAX_DOCS = 4000
FEATURES = "log_bytes log_words word_length upper capitals digits bytes_beyond_ascii commas stops marks odd_marks distinct stutter repeated short_words blank".split()


def _classes() -> np.ndarray:
    """Bit masks of the character classes of a byte."""
    kind = np.zeros(256, np.uint8)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", bytes(range(128, 256)), b",;", b".?:", b"!\"'()-", b"#$%&*+/<=>@[\\]^_`{|}~")):
        kind[list(chars)] = 1 << i
    return kind


CLASSES = _classes()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, line lengths in bytes, lines per text)."""
    lines, per, repeated = [], [], []
    for text in texts:
        own = (text or "").encode().split(b"\n")
        per.append(len(own))
        seen: dict[bytes, int] = {}
        for x in own:
            seen[x] = seen.get(x, 0) + 1
        repeated += [seen[x] > 1 and bool(x) for x in own]
        lines += own
    size = np.array([len(x) for x in lines], np.int64)
    words = np.empty((len(lines), 4))
    for i, x in enumerate(lines):
        w = x.split()
        words[i] = len(w), len(set(w)), sum(map(bytes.__eq__, w, w[1:])), sum(map((4).__gt__, map(len, w)))
    n, distinct, stutter, short = np.maximum(words, [[1, 1, 0, 0]]).T
    kinds = CLASSES[np.frombuffer(b"\n".join([*lines, b""]), np.uint8)]
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])

    def count(i: int, of: np.ndarray = kinds) -> np.ndarray:
        return np.add.reduceat((of >> i & 1).astype(np.int32), starts).astype(float)

    upper, lower, digits, beyond, commas, stops, marks, odd = map(count, range(8))
    full = np.maximum(size, 1)
    letters = np.maximum(upper + lower, 1)
    capitals = upper / n
    columns = [np.log1p(size), np.log1p(words[:, 0]), full / n, upper / letters, capitals, digits / full, beyond / full, commas / n, stops / n, marks / n, odd / n, distinct / n, stutter / n, np.array(repeated, float), short / n, size == 0]
    return np.column_stack(columns).astype(np.float32), size, np.array(per, np.int64)


def neighbours(x: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Each line's features with those of the line before and the line behind (zeros at the ends)."""
    ends = np.cumsum(per)
    before, behind = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[ends - per] = 0
    behind[ends - 1] = 0
    return np.hstack([x, before, behind, np.ones((len(x), 1), x.dtype)])


def chain_order(per: np.ndarray):
    """For each step t, the lines at place t of all texts with that many lines, longest texts first."""
    order = np.argsort(-per, kind="stable")
    starts = (np.cumsum(per) - per)[order]
    falling = -per[order]
    for t in range(int(per.max(initial=0))):
        yield starts[: np.searchsorted(falling, -t, "left")] + t


def step(m: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log odds of the next state from the log odds of this one; a[i, j] is the log weight of j after i."""
    return np.logaddexp(a[0, 1], a[1, 1] + m) - np.logaddexp(a[0, 0], a[1, 0] + m)


def messages(s: np.ndarray, at: list[np.ndarray], a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (evidence of the line included) and backward log odds (excluded) of every line."""
    fore, back = s.copy(), np.zeros_like(s)
    for rows in at[1:]:
        fore[rows] += step(fore[rows - 1], a)
    for rows in reversed(at[1:]):
        back[rows - 1] = step(s[rows] + back[rows], a.T)
    return fore, back


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Field:
    """A fitted field: feature means and scales, line weights and the weights of label pairs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray

    def inputs(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return neighbours(np.hstack([z, z * z]), per)

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of good for every line, line lengths, lines per text)."""
        x, size, per = line_features(texts)
        fore, back = messages(self.inputs(x, per) @ self.weights, list(chain_order(per)), self.pairs)
        return sigmoid(fore + back), size, per

    def scores(self, texts: list[str | None]) -> np.ndarray:
        good, size, per = self.marginals(texts)
        weight = size + 1e-6  # a text of empty lines only: their plain mean
        starts = np.cumsum(per) - per
        return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0.0, 1.0)


def fit_field(x: np.ndarray, per: np.ndarray, labels: np.ndarray, rounds: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by full gradient steps (Adam), every document counting as its mean line."""
    width = 6 * len(FEATURES) + 1
    field = Field(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(width), np.zeros((2, 2)))
    if not len(per):
        return field
    field.mean, field.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = field.inputs(x, per)
    y = np.repeat(labels.astype(float), per)
    share = np.repeat(1 / per, per)
    starts = np.cumsum(per) - per
    later = np.setdiff1d(np.arange(len(x)), starts)
    at = list(chain_order(per))
    both = np.array([[np.sum(share[later] * ((y[later - 1] == i) & (y[later] == j))) for j in (0, 1)] for i in (0, 1)])
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        w, a = theta[:width], theta[width:].reshape(2, 2)
        s = z @ w
        fore, back = messages(s, at, a)
        grad = z.T @ (share * (sigmoid(fore + back) - y))
        odds = {0: 0.0, 1: 1.0}
        logs = np.stack([odds[i] * fore[later - 1] + a[i, j] + odds[j] * (s[later] + back[later]) for i in (0, 1) for j in (0, 1)])
        joint = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
        pair = (joint * share[later]).sum(axis=1) - both.ravel()
        g = np.concatenate([grad, pair]) / len(per) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    field.weights, field.pairs = theta[:width], theta[width:].reshape(2, 2)
    return field


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS) -> Field:
    """The field fitted on at most ``max_docs`` labelled documents outside fold 0."""
    taught = labels.filter(F.col(label).isNotNull() & (fold("doc_id") != 0)).groupBy("doc_id").agg(F.min(label).cast("double").alias("_label"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def run(batches):
        for batch in slices(batches, "text"):
            x, _, per = line_features(batch.column("text").to_pylist())
            ends = np.cumsum(per)
            data = [x[b - n : b].tobytes() for b, n in zip(ends, per)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array(data, pa.binary())], ["doc_id", "_label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").select("doc_id", "text", "_label").mapInArrow(run, f"doc_id {kind}, _label double, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    parts = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, len(FEATURES)) for r in rows]
    per = np.array([len(p) for p in parts], np.int64)
    x = np.concatenate(parts).astype(float) if parts else np.zeros((0, len(FEATURES)))
    return fit_field(x, per, np.array([r._label for r in rows]))


def classify(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (probability of being good, 0 to 1) and ``predicted`` (1 from ``threshold`` on)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = field.scores(batch.column("text").to_pylist())
        return with_columns(batch, {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return mapped(docs, run, "text", score="double", predicted="int")
