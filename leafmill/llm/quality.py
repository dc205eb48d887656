"""Quality: a linear-chain conditional random field over a document's lines, weighted by their lengths."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, texts
from .crf import Chain, fit, logistic, sigmoid
from .labelled import held_out, sample

TRAIN_ROWS = 5000
TRAIN_CHARS = 20_000
#: Bins of each line feature, cut at quantiles of the sample.
BINS = 12

#: Byte classes: 0 other, 1 lower-case or non-ASCII letter, 2 upper case, 3 digit, 4 white space, 5 sentence mark, 6 other mark.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6

FEATURES = ("log_bytes", "words", "upper", "digits", "sentence_marks", "other_marks", "spaces", "word_length", "distinct", "repeats", "copies", "mean_run")


def line_features(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some texts, the number of lines of each text, and the lines' bytes."""
    per_doc, rows, raw = [], [], []
    for text in batch:
        lines = text.split("\n")
        per_doc.append(len(lines))
        seen = Counter(lines) if len(lines) > 1 else None
        for line in lines:
            w = line.split()
            n = len(w)
            rows.append((n, len(set(w)) / n if n else 1.0, sum(map(str.__eq__, w, w[1:])) / n if n else 0.0, min(seen[line], 9) if seen and line else 1))
            raw.append(line)
    data = "\n".join(raw).encode("utf-8", "replace") + b"\n"
    code = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(code == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    cls = _CLASS[code]
    count = [np.add.reduceat((cls == k).astype(np.int32), starts) for k in range(1, 7)]
    count[3] = count[3] - 1  # the line's own end
    n, distinct, repeats, copies = np.array(rows, float).T
    full, letters = np.maximum(size, 1), np.maximum(count[0] + count[1], 1)
    marks = np.append((cls[1:] == 6) & (cls[:-1] == 6), False)
    runs = np.add.reduceat(marks.astype(np.int32), starts)
    out = np.stack([np.log1p(size), np.log1p(n), count[1] / letters, count[2] / full, count[4] / full, count[5] / full, count[3] / full, size / np.maximum(n, 1), distinct, repeats, copies, runs / full], 1)
    return out, np.array(per_doc, np.int64), size


@dataclass
class LineTagger:
    """Weights of each feature's bin, for a line itself, the line before and the line after it."""

    edges: list[np.ndarray]
    weights: np.ndarray
    chain: Chain
    scale: np.ndarray

    def cells(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Indices of the weights of each line: one a feature and neighbour; a missing neighbour has a bin of its own."""
        own = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)
        missing = BINS
        before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
        before[starts], after[starts + lengths - 1] = missing, missing
        width = BINS + 1
        base = np.arange(own.shape[1]) * width
        return np.concatenate([own + base, before + base + own.shape[1] * width, after + base + 2 * own.shape[1] * width], 1)

    def evidence(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(1) + self.weights[-1]

    def score(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of some texts, the probability that each of their lines is bad, and their numbers of lines."""
        x, lengths, size = line_features(batch)
        starts = np.cumsum(lengths) - lengths
        p = self.chain.marginals(self.evidence(self.cells(x, starts, lengths)), starts, lengths)
        return sigmoid(self.summary(p, starts, size) @ self.scale), p, lengths

    @staticmethod
    def summary(p: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A constant and the log-odds of the share of bytes in good lines."""
        weight = size + 1.0
        good = np.add.reduceat((1 - p) * weight, starts) / np.add.reduceat(weight, starts)
        good = np.clip(good, 1e-3, 1 - 1e-3)
        return np.stack([np.ones(len(starts)), np.log(good / (1 - good))], 1)


def train(rows: list[tuple[str, int]]) -> LineTagger:
    """Lines of bad documents start as bad; those that the first fit finds good are good in the second."""
    rows = rows or [("", 1)]
    x, lengths, size = line_features([t for t, _ in rows])
    starts = np.cumsum(lengths) - lengths
    doc_bad = np.array([1 - y for _, y in rows], float)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    # Rare values stand at the far end of a feature, so bad lines' quantiles cut it too.
    bad_line = np.repeat(doc_bad, lengths) > 0
    if bad_line.any():
        edges = [np.sort(np.unique(np.concatenate([e[::2], np.quantile(x[bad_line, k], [0.1, 0.3, 0.5, 0.7, 0.9])])))[: BINS - 1] for k, e in enumerate(edges)]
    model = LineTagger(edges, np.zeros(3 * x.shape[1] * (BINS + 1) + 1), Chain(), np.array([0.0, 1.0]))
    cells = model.cells(x, starts, lengths)
    y = np.repeat(doc_bad, lengths)
    if y.min() == y.max():
        model.weights[-1] = 6.0 if y.max() else -6.0
        return model
    weight = np.minimum(size, 400) / 100 + 0.2
    n = len(model.weights) - 1

    def evidence(w):
        return w[cells].sum(1) + w[-1]

    def back(g):
        return np.append(np.bincount(cells.ravel(), np.repeat(g, cells.shape[1]), minlength=n), g.sum())

    for _ in range(2):
        model.weights = fit(model.chain, model.weights, evidence, back, starts, lengths, y, weight, steps=60, rate=0.1, ridge=1e-3)
        own = Chain().marginals(evidence(model.weights), starts, lengths)
        y = np.where((own < 0.2) & (lengths.repeat(lengths) > 1), 0.0, np.repeat(doc_bad, lengths))
    p = model.chain.marginals(evidence(model.weights), starts, lengths)
    model.scale = logistic(model.summary(p, starts, size), 1 - doc_bad)
    return model


def score_documents(docs: DataFrame, model: LineTagger, id_col: str = "doc_id", text_col: str = "text", lines: bool = True) -> DataFrame:
    """``doc_id, score`` of every row, and ``line_good array<double>``: the probability that each line is good.

    Lines end at line feeds. A null text is empty and, like every text, has one line at least. Row by row: repeated
    rows and null ids go through, an empty table gives an empty result. Only text is looked at.
    """
    small_batches(docs.sparkSession, 1024)

    def run(batches):
        for b in batches:
            score, p, lengths = model.score(b.column("text").to_pylist()) if b.num_rows else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
            cols = [b.column("doc_id"), pa.array(score)]
            if lines:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(1 - p)))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "line_good"][: len(cols)])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double" + ", line_good array<double>" * lines)


def filter_documents(docs: DataFrame, model: LineTagger, least: float, text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, without the rows whose score is below ``least``."""
    small_batches(docs.sparkSession, 1024)

    def run(batches):
        for b in batches:
            if b.num_rows:
                score, _, _ = model.score([t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])
                yield b.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)


def learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> LineTagger:
    return train(sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, TRAIN_ROWS, TRAIN_CHARS))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score_documents(docs, learn(spark, docs, sf_dir), lines=False)
    return got.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
