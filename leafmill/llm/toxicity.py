"""Toxicity: a linear-chain conditional random field tags toxic spans, its marginals give a document's score."""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crf import Chain, fit, logistic, sigmoid
from .labelled import held_out, sample
from .common import small_batches, table, texts

#: Labelled rows that are looked at, at most, and the characters of the longest.
TRAIN_ROWS = 6000
TRAIN_CHARS = 20_000
#: Weights of hashed word features.
BUCKETS = 1 << 18
#: Words whose evidence a worker remembers.
REMEMBERED = 500_000

#: How much more often toxic texts use a type that tells them.
LIFT = 8.0

_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…“”„’"


def word_features(token: str) -> list[int]:
    """Hashed features of a token: the word, its beginnings and its end; a token without letters has none."""
    w = token.strip(_EDGES)
    if not w:
        return []
    names = ["w" + w, "4" + w[:4], "5" + w[:5], "7" + w[:7], "s" + w[-3:]]
    return [zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


def chains(lines: list) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains of consecutive token lists: a chain is a whole line, however long."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    lengths = lengths[lengths > 0]
    return np.cumsum(lengths) - lengths, lengths


def tokens(text: str) -> list[list[str]]:
    return [line.split() for line in text.lower().split("\n")]


@dataclass
class Tagger:
    weights: np.ndarray
    chain: Chain
    scale: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def evidence(self, words: list[str]) -> np.ndarray:
        known, w = self.known, self.weights
        out = list(map(known.get, words))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for i, u in enumerate(out):
                if u is None:
                    token = words[i]
                    if token not in known:
                        known[token] = float(w[word_features(token)].sum()) + float(w[-1])
                    out[i] = known[token]
        return np.array(out)

    def document_features(self, p: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """Of each document: one, its highest marginal's log-odds, its expected toxic tokens and their share, as logs."""
        most = np.zeros(n)
        np.maximum.at(most, docs, p)
        total = np.bincount(docs, np.where(p > 0.05, p, 0.0), minlength=n)
        size = np.bincount(docs, minlength=n)
        most = np.clip(most, 1e-6, 1 - 1e-6)
        return np.stack([np.ones(n), np.log(most / (1 - most)), np.log1p(total), np.log((total + 0.05) / (size + 20))], 1)

    def tag(self, batch: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens of a batch of tokenised documents, and the document of each."""
        lines = [line for doc in batch for line in doc if line]
        words = [w for line in lines for w in line]
        docs = np.repeat(np.arange(len(batch)), [sum(map(len, d)) for d in batch])
        starts, lengths = chains(lines)
        return self.chain.marginals(self.evidence(words), starts, lengths), docs

    def score(self, batch: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, docs = self.tag(batch)
        return sigmoid(self.document_features(p, docs, len(batch)) @ self.scale), p, docs


def token_types(token: str) -> tuple[str, ...]:
    """A token's word and three beginnings of it; a short word stands for its beginnings too."""
    w = token.strip(_EDGES)
    return ("w" + w, *(str(k) + w[:k] if len(w) > k else "w" + w for k in (4, 5, 7)))


def toxic_types(types_of: np.ndarray, docs: list[np.ndarray], labels: list[int], n_types: int) -> np.ndarray:
    """Flags of types that toxic texts hold far more often than others: tokens of them are labelled toxic.

    A text's uses of a type count up to four. A type has to be in four toxic texts, to be used ``LIFT`` times as often
    by toxic texts as by others, and so often that, among all types, chance would hardly bring one about.
    """
    counts, held = np.zeros((2, n_types), np.int64), np.zeros(n_types, np.int64)
    for ids, y in zip(docs, labels, strict=True):
        words, uses = np.unique(ids, return_counts=True)
        own = types_of[words]
        repeat = own[:, 1:] == own[:, :1]  # a word that stands for its beginnings counts once
        flat = np.concatenate([own[:, 0], own[:, 1:][~repeat]])
        n = np.concatenate([uses, np.broadcast_to(uses[:, None], repeat.shape)[~repeat]])
        found, at = np.unique(flat, return_inverse=True)
        counts[y, found] += np.minimum(np.bincount(at, n, minlength=len(found)).astype(np.int64), 4)
        if y:
            held[found] += 1
    clean, toxic = counts
    share = min(max(sum(labels), 1) / max(len(labels), 1), 0.5)
    rate = toxic / share >= LIFT * np.maximum(clean, 0.5) / (1 - share)
    least = np.log(max(int((held > 0).sum()), 1)) + 2
    expected = (toxic + clean) * share
    evidence = toxic * np.log(np.maximum(toxic, 1) / np.maximum(expected, 1e-9)) - toxic + expected  # Chernoff's bound
    return (held >= 4) & rate & (evidence >= least)


def train(rows: list[tuple[str, int]]) -> Tagger:
    """Labels tokens of labelled texts, fits the chain on them and the document's score on its marginals.

    The chain is fitted on the toxic texts of ``rows`` and twice as many others, the score on all.
    """
    vocabulary: dict[str, int] = {}
    ids, sizes, labels = [], [], [y for _, y in rows]
    for text, _ in rows:
        lines = [line for line in tokens(text) if line]
        ids.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for line in lines for w in line], np.int32))
        sizes.append([len(line) for line in lines])
    types: dict[str, int] = {}
    types_of = np.array([[types.setdefault(t, len(types)) for t in token_types(w)] for w in vocabulary], np.int32).reshape(len(vocabulary), 4)
    toxic_type = toxic_types(types_of, ids, labels, len(types))
    del types
    bad = toxic_type[types_of].any(1) if len(types_of) else np.zeros(0, bool)
    at, owned = array("i"), array("i")
    for i, w in enumerate(vocabulary):
        found = word_features(w)
        at.extend(found)
        owned.extend([i] * len(found))
    flat, owner, n_words = np.array(at, np.int32), np.array(owned, np.int32), len(vocabulary)
    del vocabulary, at, owned
    model = Tagger(np.zeros(BUCKETS + 1), Chain(), np.array([-4.0, 1.0, 0.0, 0.0]))
    model.weights[-1] = -4.0

    def lay(chosen):
        of = np.concatenate([ids[i] for i in chosen] or [np.zeros(0, np.int32)])
        starts, lengths = chains([range(n) for i in chosen for n in sizes[i]])
        return of, starts, lengths, np.repeat(np.arange(len(chosen)), [len(ids[i]) for i in chosen])

    toxic = [i for i, y in enumerate(labels) if y]
    clean = [i for i, y in enumerate(labels) if not y][: 2 * len(toxic)]
    of, starts, lengths, doc = lay(toxic + clean)
    y = (bad[of] & (doc < len(toxic))).astype(float)
    if y.sum() == 0:  # nothing to learn from: nothing is toxic
        model.weights[-1] = -12.0
        return model

    def by_word(w):
        return np.bincount(owner, w[flat], minlength=n_words) + w[-1]

    def back(g):
        grad = np.bincount(of, g, minlength=n_words)
        return np.append(np.bincount(flat, grad[owner], minlength=BUCKETS), g.sum())

    weight = np.where(y > 0, min(20.0, 0.1 * len(y) / y.sum()), 1.0)
    model.weights = fit(model.chain, model.weights, lambda w: by_word(w)[of], back, starts, lengths, y, weight, steps=40, rate=0.3, ridge=1e-4)
    evidence, summaries = by_word(model.weights), []
    for at in range(0, len(rows), 1000):
        chosen = list(range(at, min(len(rows), at + 1000)))
        of_, starts_, lengths_, doc_ = lay(chosen)
        summaries.append(model.document_features(model.chain.marginals(evidence[of_], starts_, lengths_), doc_, len(chosen)))
    model.scale = logistic(np.concatenate(summaries), np.array(labels, float))
    return model


def spans(text: str, p: np.ndarray, at_least: float) -> list[tuple[int, int, float]]:
    """Character ranges of consecutive tokens whose marginal is ``at_least`` so high, with the highest of each."""
    out, k, end = [], 0, -1
    for m in re.finditer(r"\S+", text):
        if k < len(p) and p[k] >= at_least:
            if out and end == k - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[k])))
            else:
                out.append((m.start(), m.end(), float(p[k])))
            end = k
        k += 1
    return out


def tag_documents(docs: DataFrame, model: Tagger, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """``doc_id, score`` of every row, and ``spans array<struct<start, end, p>>`` of its offending characters.

    A document's score rises with its highest marginal and with the expected number of its toxic tokens. A null or
    empty text has no tokens and the score that goes with none. Row by row: repeated rows and null ids go through;
    an empty table gives an empty result. Only text is looked at.
    """
    small_batches(docs.sparkSession, 1024)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        for b in batches:
            raw = b.column("text").to_pylist()
            parts = [tokens(t) for t in raw]
            score, p, owner = model.score(parts)
            cols = [b.column("doc_id"), pa.array(score)]
            if offsets:
                first = np.searchsorted(owner, np.arange(len(raw) + 1))
                hits = [[] for _ in raw]
                for i in np.unique(owner[p >= at_least]).tolist():
                    hits[i] = [{"start": s, "end": e, "p": q} for s, e, q in spans(raw[i], p[first[i] : first[i + 1]], at_least)]
                cols.append(pa.array(hits, kind))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "spans"][: len(cols)])

    schema = "doc_id long, score double" + ", spans array<struct<start:int,end:int,p:double>>" * offsets
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(sample(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, TRAIN_ROWS, TRAIN_CHARS))
    got = tag_documents(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
