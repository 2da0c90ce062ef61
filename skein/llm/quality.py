"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts.  Trees are grown level by level from histograms of
binned features and flattened into arrays, which are traversed for all documents at once.

The classifier is fitted on at most ``max_labelled`` labelled rows (a documented bound; those
with the smallest hashes of their ids), everything else covers all rows.

Defined results: a null text counts as empty; empty texts get the score of their (zero)
statistics; a document with several labels is fitted once with each of them; of rows that share
an id the one with the smallest text is fitted; null labels are ignored; without any label every
score is 0.5; a null id is never held out nor learned from; repeated rows are scored one by one;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, map_batches, tidied

MAX_LABELLED = 20_000

FEATURES = (
    "chars", "words", "mean_word", "sd_word", "unique_words", "top_word", "short_words", "repeated_pairs", "upper", "digit",
    "space", "newline", "bang", "pipe", "marks", "stops", "symbols", "beyond_ascii", "caps_words", "mean_line", "repeated_lines", "zipped",
    "vowels", "entropy", "markup",
)

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_CLASSES = np.stack(
    [_UPPER, _DIGIT, *(np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (b" \t", b"\n", b"!", b"|", b"*#$%&@^~+=_", b".?", b"(){}[]<>/\\:;\"'`", b"aeiouAEIOU", b"<>")), np.arange(256) >= 128]
).astype(np.float64)


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, space, newline, bang, pipe, marks, stops, symbols, vowels, markup, beyond = (_CLASSES @ counts / n).tolist()
    shares = counts[counts > 0] / n
    words = raw.split()
    k = len(words) or 1
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()), len(seen) / k, max(seen.values(), default=0) / k,
        float((sizes <= 3).mean()), 1 - pairs / max(1, k - 1), upper, digit, space, newline, bang, pipe, marks, stops, symbols, beyond,
        sum(map(bytes.isupper, words)) / k, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(zlib.compress(raw, 1)) / n,
        vowels, float(-(shares * np.log2(shares)).sum()), markup,
    ]


class Trees:
    """Complete trees of one depth as arrays: a feature and a threshold per node, a value per leaf."""

    def __init__(self, depth: int, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> None:
        self.depth, self.base, self.feature, self.threshold, self.leaf = depth, base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.leaf[t, node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, penalty: float = 1.0, least: float = 5.0) -> Trees:
    """Boost ``trees`` trees on the logistic loss."""
    n, width = x.shape
    if not n:
        return Trees(1, 0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)  # above cut b: bin > b
    mean = min(1 - 1e-3, max(1e-3, float(y.mean())))
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    total = np.full(n, base)
    offset = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * bins) + offset + binned).ravel()
            size = count * width * bins
            g = np.bincount(slot, np.repeat(gradient, width), size).reshape(count, width, bins).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(weight, width), size).reshape(count, width, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
            gain[(h < least / 4) | (ht - h < least / 4)] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-9 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        g = np.bincount(node - inner, gradient, leaves)
        h = np.bincount(node - inner, weight, leaves)
        value[t] = -rate * g / (h + penalty)
        total += value[t, node - inner]
    return Trees(depth, base, feature, threshold, value)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, features array) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "x": [statistics(t) for t in batch["text"]]})

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(tidied(run), f"id {id_type}, x array<double>")


def held_out(id_column):
    """Whether a row is never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Trees:
    """Fit on labelled rows that are not held out, ``max_labelled`` at most."""
    bounded_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id", "y")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(chosen.distinct()), F.col(id_col) == F.col("__id"))  # at most max_labelled rows
    texts = texts.groupBy("__id", "y").agg(F.min("__text").alias("__text"))
    rows = _measured(texts.select(F.struct("__id", "y").alias("k"), "__text"), "k", "__text").collect()  # as many
    rows.sort(key=lambda r: (str(r["id"]), r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["id"]["y"] for r in rows]))


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]]).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"id": batch["id"], "score": model.score(x)})

    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(tidied(run), "id string, score double")
    return found.select(F.col("id").cast(id_type).alias(id_col), "score")


def filter_quality(docs: DataFrame, model: Trees, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()]).reshape(len(batch), len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= least))

    return map_batches(docs, run)
