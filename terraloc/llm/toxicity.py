"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is a logistic function of the weights of its words and word beginnings; a document's score is the
noisy-or of its sentences' scores, 1 - prod(1 - p), taken over each STRETCH sentences in turn, of which the worst
stretch counts: the small scores of plain sentences don't add up with a document's length. The weights are fitted to
document labels alone through that noisy-or, after which the sentences that carry a document's score can be pointed out.

The model is fitted on the driver on at most TRAIN_DOCS labelled documents (chosen by a hash of doc_id, so a sample of
the same size at any scale), whole texts of TRAIN_BYTES together; one that no longer fits makes room for the next.
Every document is scored whole.

Defined cases: null and empty texts, and texts without words, score 0; equal texts score the same; labels that are
null are ignored; of several labels of a document the highest counts, and of several texts the smallest; without usable
labels all scores are 0.
Columns other than doc_id and text are never inputs of a score, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.llm.common import give_back, table

TRAIN_DOCS = 6000
TRAIN_BYTES = 64 << 20
STRETCH = 32
FEATURES = 3000
LEAST_DF = 6
LEAST_Z = 4.0
THRESHOLD = 0.7
PREFIXES = range(3, 8)
CACHED_WORDS = 50_000
BUCKETS = 1 << 22
SENTENCE = re.compile(r"[^.!?\n]+")
NOT_LETTER = re.compile(r"[\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word's letters in lower case, and its beginnings of 3 to 7 letters."""
    core = NOT_LETTER.sub("", word.lower())
    return [core, *(core[:k] + "*" for k in PREFIXES if k < len(core))] if core else []


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)


class _Hits(dict):
    """Word to the weighted features that it has."""

    def __init__(self, weights):
        self.weights = weights

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = tuple(f for f in word_features(word) if f in self.weights)
        self[word] = out
        return out


def sentences(text: str):
    """Start, end and words of each stretch between sentence ends that has words."""
    for m in SENTENCE.finditer(text):
        words = m[0].split()
        if words:
            yield m.start(), m.end(), words


class _Codes(dict):
    """Word to the hashes of its features."""

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = out = np.array([zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in word_features(word)], np.int64)
        return out


def _names(rows, cache: _Codes, top: set[int]) -> set[str]:
    """The features whose hashes are in top."""
    out, seen = set(), set()
    for text, _ in rows:
        for w in set(text.split()).difference(seen):
            if not top.isdisjoint(cache[w].tolist()):
                out.update(f for f, k in zip(word_features(w), cache[w].tolist(), strict=True) if k in top)
                if len(seen) < CACHED_WORDS:
                    seen.add(w)
    return out


def fit(rows: list[tuple[str, int]], rounds: int = 300, rate: float = 0.1, l2: float = 3e-5) -> Model:
    """rows: text and label. Adam on the noisy-or's log loss, over the features that labels speak for or against most."""
    labels = np.array([y for _, y in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return Model()
    # Counts by hash, whose memory doesn't depend on the texts; the names come from a second pass.
    cache = _Codes()
    df, pos = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for text, y in rows:
        found = np.unique(np.concatenate([*(cache[w] for w in set(text.split())), np.zeros(0, np.int64)]).astype(np.int64))
        df[found] += 1
        pos[found] += y
    base = labels.mean()
    z = np.where(df >= LEAST_DF, (pos - df * base) / np.sqrt(np.maximum(df, 1) * base * (1 - base)), 0)
    top = set(sorted(np.nonzero(np.abs(z) >= LEAST_Z)[0].tolist(), key=lambda k: (-abs(z[k]), k))[:FEATURES])
    names = sorted(_names(rows, cache, top))
    if not names:
        return Model()
    index = {f: i for i, f in enumerate(names)}
    hits = _Hits(index)
    in_of, row_of, col_of, plain, heads, doc_of = (array("q") for _ in range(6))  # a sentence is in a stretch, a stretch of a document
    for d, (text, _) in enumerate(rows):
        heads.append(len(doc_of))
        doc_of.append(d)
        plain.append(0)
        for k, (_, _, words) in enumerate(sentences(text)):
            if k and k % STRETCH == 0:
                doc_of.append(d)
                plain.append(0)
            got = {f for w in words for f in hits[w]}
            if got:
                row_of.extend(repeat(len(in_of), len(got)))
                col_of.extend(index[f] for f in got)
                in_of.append(len(doc_of) - 1)
            else:
                plain[-1] += 1
    in_of, row_of, col_of, plain, heads, doc_of = (np.array(x, np.int64) for x in (in_of, row_of, col_of, plain, heads, doc_of))
    w, b = np.zeros(len(names)), -4.0
    state = np.zeros((2, len(names) + 1))
    for t in range(1, rounds + 1):
        s = b + np.bincount(row_of, w[col_of], len(in_of))
        none = -(np.bincount(in_of, np.logaddexp(0, s), len(doc_of)) + plain * np.logaddexp(0, b))  # log of no toxic sentence
        if t <= rounds // 3:  # over whole documents, until the weights tell which stretch is the worst
            p = np.clip(-np.expm1(np.bincount(doc_of, none, len(rows))), 1e-9, 1)[doc_of]
            slope = np.where(labels[doc_of] > 0, -(1 - p) / p, 1.0) / len(rows)  # of the loss, by -none
        else:
            worst = np.lexsort((none, doc_of))[heads]  # each document's stretch
            p = np.clip(-np.expm1(none[worst]), 1e-9, 1)
            slope = np.zeros(len(doc_of))
            slope[worst] = np.where(labels > 0, -(1 - p) / p, 1.0) / len(rows)
        gs = slope[in_of] / (1 + np.exp(-s))
        g = np.append(np.bincount(col_of, gs[row_of], len(names)) + l2 * w, gs.sum() + (slope * plain).sum() / (1 + np.exp(-b)))
        state[0] += 0.1 * (g - state[0])
        state[1] += 0.001 * (g * g - state[1])
        step = rate * state[0] / (1 - 0.9**t) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), {f: float(x) for f, x in zip(names, w, strict=True)})


def score_text(text: str, model: Model, hits: _Hits) -> tuple[float, int, int, float]:
    """Score, and start, end and score of the sentence that weighs most (-1, -1 and 0 without sentences)."""
    none, most, best = 0.0, 0.0, (-1, -1, -1e300)
    bias, weights, get = model.bias, model.weights, hits.__getitem__
    plain = float(np.logaddexp(0, bias))
    for k, (start, end, words) in enumerate(sentences(text)):
        if k % STRETCH == 0:
            none = 0.0
        got = [f for f in map(get, words) if f]
        s = bias + sum(weights[f] for f in set().union(*got)) if got else bias
        none += float(np.logaddexp(0, s)) if got else plain
        most = max(most, none)
        if s > best[2]:
            best = (start, end, s)
    return float(-np.expm1(-most)), best[0], best[1], float(1 / (1 + np.exp(-best[2]))) if best[0] >= 0 else 0.0


SCORED = "doc_id long, score double, worst_start long, worst_end long, worst_score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCORED for each row of docs."""
    if not model.weights:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(-1).cast("long").alias("worst_start"), F.lit(-1).cast("long").alias("worst_end"), F.lit(0.0).alias("worst_score"))

    def run(batches):
        hits = _Hits(model.weights)
        for b in batches:
            rows = [score_text(x or "", model, hits) for x in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCORED)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, end (characters), score, sentence: each sentence that scores at least `least`."""

    def run(batches):
        hits = _Hits(model.weights)
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for start, end, words in sentences(text or ""):
                    s = model.bias + sum(model.weights[f] for f in {f for w in words for f in hits[w]})
                    p = float(1 / (1 + np.exp(-s)))
                    if p >= least:
                        out.append((i, start, end, p, text[start:end]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], names=["doc_id", "start", "end", "score", "sentence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt. A row without a doc_id has no label to learn, and isn't one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fits on at most train_docs labelled documents of TRAIN_BYTES that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    # Both sides are bounded by train_docs from here on.
    picked = {r.doc_id: r.toxic for r in chosen.collect()}
    ids = lambda some: F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in some], "doc_id long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    sizes = {r.doc_id: r.size for r in texts.select("doc_id", F.octet_length("text").alias("size")).join(ids(picked), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("size").alias("size")).collect()}
    left, fitting = TRAIN_BYTES, []
    for k in picked:  # in the order of their hashes
        if sizes.get(k, left + 1) <= left:
            left -= sizes[k]
            fitting.append(k)
    sample = texts.join(ids(fitting), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    model = fit([(r.text, picked[r.doc_id]) for r in sample.sort("doc_id").toLocalIterator()])
    give_back()  # the texts and their features, which the driver would hold through all later steps
    return model


def filter_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least threshold; all columns stay."""
    if not model.weights:
        return docs

    def run(batches):
        hits = _Hits(model.weights)
        for b in batches:
            keep = [score_text(x or "", model, hits)[0] < threshold for x in b.column(b.schema.names.index("text")).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))
        hits.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")
