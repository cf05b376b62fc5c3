"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import SLICE_BYTES, WHITESPACE, slices, stretches, word_hashes

_U32 = np.uint32
_MIX = _U32(0x9E3779B1)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets by document); bytes that are no UTF-8 count as replacement characters."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), _U32)
        return points, np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), _U32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate([np.zeros(0, _U32), *parts]), np.cumsum([0, *map(len, parts)])


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, bytes behind them that n-grams reach into) of a slice; a very long text gives several."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield data, offsets, data[:0]
        return
    for lo, hi in stretches(data, WHITESPACE):
        stop = min(hi + 12, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[lo:hi], np.array([0, hi - lo]), data[hi:stop]


def _features(data: np.ndarray, offsets: np.ndarray, behind: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets by document) of whole words, and of 3-grams and 4-grams of characters."""
    shift = _U32(32 - bits)
    hashed, _, _, by_doc = word_hashes(data, offsets, WHITESPACE)
    found = [((hashed >> np.uint64(64 - bits)).astype(np.int64), by_doc)]
    points, at = _code_points(data, offsets)
    more, _ = _code_points(behind, np.array([0, len(behind)]))
    points = np.concatenate((points, more))
    gram = points[:-1] * _MIX + points[1:]
    for n, factor in ((3, 2654435761), (4, 2246822519)):
        gram = gram[: max(0, len(points) - n + 1)] * _MIX + points[n - 1 :]
        sizes = np.clip(np.diff(at) + len(more) - n + 1, 0, np.diff(at))
        starts = np.arange(sizes.sum()) + np.repeat(at[:-1] - (np.cumsum(sizes) - sizes), sizes)  # none reaches into another document
        buckets = (gram[starts] * _U32(factor)) >> shift
        found.append((buckets.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))))
    return found


@dataclass
class SubwordModel:
    vectors: np.ndarray  # buckets x dimensions
    output: np.ndarray  # dimensions x classes
    bias: np.ndarray

    def margin_table(self) -> np.ndarray:
        """What each bucket adds to the difference of the two classes' logits, for a mean over buckets."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = 16, dim: int = 16, epochs: int = 12, rate: float = 0.4, seed: int = 7) -> SubwordModel:
    """Stochastic gradient descent, one document at a time, on (buckets, counts) examples.

    A document's vector is the mean over its features; a step is scaled so that it moves that vector
    by ``rate`` times the gradient whatever the document's length.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    output = np.zeros((dim, 2), np.float32)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    bias = np.log(np.array([1 - share, share], np.float32)).astype(np.float32)
    total, step = epochs * len(examples), 0
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            buckets, counts = examples[i]
            now = rate * (1 - step / total)
            step += 1
            if not len(buckets):
                continue
            weight = counts / counts.sum()
            mean = weight @ vectors[buckets]
            logits = mean @ output + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[i]] -= 1
            back = output @ error
            output -= now * np.outer(mean, error) / max(1e-3, float(mean @ mean))
            bias -= 0.1 * now * error
            vectors[buckets] -= (now / float(weight @ weight)) * weight[:, None] * back[None, :]
    return SubwordModel(vectors, output, bias)


def _counter(bits: int, most: int):
    def count(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                held = [[] for _ in range(hi - lo)]
                for block in _blocks(data, offsets):
                    for buckets, at in _features(*block, bits):
                        for i in range(hi - lo):
                            held[i].append(np.unique(buckets[at[i] : at[i + 1]], return_counts=True))
                rows = []
                for parts in held:
                    total = np.bincount(np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts]), 1).astype(np.int64)
                    found = np.flatnonzero(total)
                    found = np.sort(found[np.argsort(-total[found], kind="stable")[:most]])
                    rows.append((found.astype("<u4").tobytes(), total[found].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["label", "buckets", "counts"])

    return count


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 3000, sample_features: int = 8192, bits: int = 16, **training: float) -> SubwordModel:
    """Trains on at most ``sample_rows`` labelled documents, whole texts, taken by hash of their id.

    The documents are read once, and joined with the sample's ids by broadcast (its size is that
    bound). Executors count features; of each text at most the ``sample_features`` most frequent are
    sent, so the driver gets 200 MB at most by these defaults. Of rows repeated under one id the
    smallest text is used. Null ids and labels other than 0 and 1 are not used.
    """
    label = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("label")).where("_id is not null and label in (0, 1)")
    taken = label.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(taken), "_id").groupBy("_id", "label").agg(F.min("text").alias("text"))
    rows = found.select("label", "text").mapInArrow(_counter(bits, sample_features), "label long, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.buckets), bytes(r.counts)))  # in an order that doesn't depend on scheduling
    examples = [(np.frombuffer(r.buckets, "<u4").astype(np.int32), np.frombuffer(r.counts, "<u4").astype(np.float32)) for r in rows]
    return train(examples, np.array([r.label for r in rows], np.int64), bits, **training)


def _scorer(table, offset: float, bits: int):
    def score(batches):
        margin = table.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                total, n = np.zeros(hi - lo), np.zeros(hi - lo)
                for block in _blocks(data, offsets):
                    for buckets, at in _features(*block, bits):
                        sums = np.concatenate(([0.0], np.cumsum(margin[buckets], dtype=np.float64)))
                        total += sums[at[1:]] - sums[at[:-1]]
                        n += np.diff(at)
                value = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + offset)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.round(value, 9))], ["doc_id", "score"])

    return score


def score(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of label 1 for every whole text.

    Defined cases: null and empty texts have no features and get the score of the bias; repeated rows
    are scored each; null ids stay null. Only the text enters a score.
    """
    bits = int(len(model.vectors)).bit_length() - 1
    table = docs.sparkSession.sparkContext.broadcast(model.margin_table())
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(_scorer(table, float(model.bias[1] - model.bias[0]), bits), "doc_id long, score double")
