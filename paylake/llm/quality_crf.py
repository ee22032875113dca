"""Quality classifier: a linear-chain conditional random field over lines.

A document is the chain of its lines.  Each line has features of its own bytes
(shares of character classes, word lengths, repetition) and of its neighbour
lines; a two-label CRF (bad 0, good 1) gives each line's marginal by the
forward-backward algorithm, and the document's score is the mean marginal of
"good", weighted by line length.

Training: the document's label stands for each of its lines.  The model is
fitted on a bounded sample of labelled documents (``SAMPLE_DOCS``), the first
by a hash of the id among the rows whose ``crc32(doc_id)`` mod 5 is not 0;
only features of those documents come to the driver (whole documents, of any
length, up to ``SAMPLE_LINES`` lines in all; one that no longer fits is passed over).  Scores use the text alone.

Nulls and empty texts are one empty line.  Texts of any length are scored
whole; a line of any length is one row of features.  Repeated rows get equal
scores; an id with several labels has the smallest, and an id on several texts
labels each of them.  Ties in the sample's order go by id, lines and hash of the
text.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample.
SAMPLE_DOCS = 6000
SAMPLE_LINES = 150_000
EPOCHS = 150
L2 = 1e-4
TRANSITION_L2 = 0.02
LEARNING_RATE = 0.08
#: Fixed values of the task.
FOLDS, THRESHOLD = 5, 0.3

# Byte classes: 0 other control, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence
# punctuation, 6 quotes and brackets, 7 other ASCII marks, 8 exclamation and
# question marks, 9 bar, 10 byte of a non-ASCII character.
_CLASSES = 11
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[0x20, 0x09, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,;:"]] = 5
_CLASS[[ord(c) for c in "'\"()[]{}"]] = 6
_CLASS[[ord(c) for c in "#$%&*+-/<=>@\\^_`~"]] = 7
_CLASS[[ord(c) for c in "!?"]] = 8
_CLASS[ord("|")] = 9
_CLASS[128:] = 10
_ROLL = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)
OWN = _CLASSES + 8
FEATURES = 3 * OWN + 1


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of each line, lengths in bytes, lines per document) of texts
    given as UTF-8 bytes and offsets.  Lines end at line feeds."""
    n_docs = len(off) - 1
    # one closing line feed per text, so that every text has its lines and an empty text one
    size = len(data) + n_docs
    text = np.empty(size, np.uint8)
    ends = off[1:] + np.arange(1, n_docs + 1) - 1
    keep = np.ones(size, bool)
    keep[ends] = False
    text[keep] = data
    text[ends] = 10
    stops = np.flatnonzero(text == 10)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)
    lengths = stops - starts
    lines = np.searchsorted(stops, ends, side="right")
    per_doc = np.diff(np.concatenate([[0], lines]))
    n = len(stops)
    out = np.zeros((n, OWN), np.float32)
    if not n:
        return out, lengths, per_doc
    cls = _CLASS[text]
    total = np.maximum(lengths, 1).astype(np.float32)
    for c in range(_CLASSES):
        hit = (cls == c).view(np.uint8)
        if c == 0:
            hit = hit & (text != 10)
        out[:, c] = np.add.reduceat(hit, starts, dtype=np.int32) / total
    blank = (cls == 4) | (text == 10)
    first = ~blank
    first[1:] &= blank[:-1]
    words = np.add.reduceat(first.view(np.uint8), starts, dtype=np.int32).astype(np.float32)
    # words that start in upper case, words whose last byte is a mark, all-upper words
    last = ~blank
    last[:-1] &= blank[1:]
    w = np.maximum(words, 1)
    out[:, 11] = np.add.reduceat((first & (cls == 2)).view(np.uint8), starts, dtype=np.int32) / w
    out[:, 12] = np.add.reduceat((last & ((cls == 7) | (cls == 8) | (cls == 9))).view(np.uint8), starts, dtype=np.int32) / w
    out[:, 13] = np.minimum(lengths / (w * 12.0), 2)
    out[:, 14] = np.minimum(np.log1p(words) / 6, 1.5)
    # repetition: words equal to the one before; lines equal to an earlier line of the text
    head, tail = np.flatnonzero(first), np.flatnonzero(last)
    if len(head):
        power = np.multiply.accumulate(np.full(size, 0x9E3779B97F4A7C15 | 1, np.uint64))
        total_hash = np.concatenate([[np.uint64(0)], np.cumsum(_ROLL[text] * power)])
        inverse = np.multiply.accumulate(np.full(size, pow(0x9E3779B97F4A7C15 | 1, -1, 2**64), np.uint64))
        word = (total_hash[tail + 1] - total_hash[head]) * inverse[head]
        line_of = np.searchsorted(stops, head)
        same = np.zeros(len(head), bool)
        same[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
        out[:, 15] = np.bincount(line_of, weights=same, minlength=n) / w
        line = (total_hash[stops] - total_hash[starts]) * inverse[starts]
        doc = np.repeat(np.arange(n_docs), per_doc)
        order = np.lexsort((np.arange(n), line, doc))
        again = np.zeros(n, bool)
        again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        out[:, 16] = again & (lengths > 0)
    end = np.maximum(stops - 1, 0)
    out[:, 17] = (lengths > 0) & np.isin(text[end], [ord("."), ord("!"), ord("?")])
    out[:, 18] = lengths == 0
    np.sqrt(out[:, :13], out=out[:, :13])           # small shares matter most
    return out, lengths, per_doc


def with_neighbours(own: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Features of a line: its own, those of the line before and after (zeros at
    the ends of a document), and a constant."""
    n = len(own)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :OWN], out[:, -1] = own, 1
    ends = np.cumsum(per_doc)
    if n > 1:
        out[1:, OWN:2 * OWN] = own[:-1]
        out[:-1, 2 * OWN:3 * OWN] = own[1:]
    out[(ends - per_doc)[per_doc > 0], OWN:2 * OWN] = 0
    out[(ends - 1)[per_doc > 0], 2 * OWN:3 * OWN] = 0
    return out


def forward_backward(score: np.ndarray, trans: np.ndarray, per_doc: np.ndarray,
                     weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the two-label chains.

    ``score``: log-potential of "good" over "bad" of each line; ``trans``: 2 x 2
    log-potentials of neighbouring labels.  Returns P(good) of each line, the
    expected number of each transition (chains counted by ``weight``, 1 if not
    given), and the sum of log partition functions.
    All chains advance together, longest first.
    """
    n = len(score)
    order = np.argsort(-per_doc, kind="stable")
    starts = (np.cumsum(per_doc) - per_doc)[order]
    lens = per_doc[order]
    each = np.ones(len(lens)) if weight is None else weight[order]
    pot = np.exp(np.stack([-score / 2, score / 2], 1).clip(-300, 300))
    t = np.exp(trans)
    alpha, scale = np.zeros((n, 2)), np.ones(n)
    active = int((lens > 0).sum())
    for k in range(int(lens[0]) if len(lens) else 0):
        active = int(np.searchsorted(-lens, -k, side="left"))       # chains longer than k
        at = starts[:active] + k
        a = pot[at] if k == 0 else (alpha[at - 1] @ t) * pot[at]
        s = a.sum(1)
        alpha[at], scale[at] = a / s[:, None], s
    beta = np.ones((n, 2))
    pairs = np.zeros((2, 2))
    for k in range((int(lens[0]) if len(lens) else 0) - 2, -1, -1):
        active = int(np.searchsorted(-lens, -(k + 1), side="left"))
        at = starts[:active] + k
        nxt = pot[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = nxt @ t.T
        pairs += (alpha[at].T @ (nxt * each[:active, None])) * t
    post = alpha * beta
    return post[:, 1] / post.sum(1), pairs, float(np.log(scale).sum())


class Model:
    """Weights of the chain; plain numbers, so it travels with a task."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        own, lengths, per_doc = line_features(data, off)
        x = with_neighbours(own, per_doc)
        p, _, _ = forward_backward(x.astype(float) @ self.weights, self.trans, per_doc)
        weight = lengths + 1.0
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        return np.clip(np.bincount(doc, weight * p, len(per_doc)) / np.bincount(doc, weight, len(per_doc)), 0, 1)


def fit(own: np.ndarray, per_doc: np.ndarray, label: np.ndarray) -> Model:
    """The chain of document labels repeated on every line; see :func:`fit_lines`."""
    return fit_lines(own, per_doc, np.repeat(label, per_doc))


def fit_lines(own: np.ndarray, per_doc: np.ndarray, y: np.ndarray) -> Model:
    """Weighted maximum likelihood by Adam on the whole sample, from a label of each
    line.  A document weighs as much for its pairs of neighbouring lines as for its
    lines: one over its number of lines, times a share by which lines of both labels
    count alike.  All weights are regularised; the transitions, which documents of
    one label alone would make as strong as they are let, by ``TRANSITION_L2``."""
    x = with_neighbours(own, per_doc).astype(float)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    y = y.astype(float)
    of_doc = np.bincount(doc, y, len(per_doc)) / np.maximum(per_doc, 1)          # share of good lines
    good = min(max(float(of_doc.mean()), 1e-3), 1 - 1e-3) if len(per_doc) else 0.5
    share = of_doc * 0.5 / good + (1 - of_doc) * 0.5 / (1 - good)
    chain = share / np.maximum(per_doc, 1) / max(len(per_doc), 1)
    weight = chain[doc]
    w, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    l2 = np.concatenate([np.full(FEATURES, L2), np.full(4, TRANSITION_L2)])
    same = doc[1:] == doc[:-1]
    seen = np.bincount((2 * y[:-1] + y[1:]).astype(int)[same], weight[1:][same], 4)
    for step in range(1, EPOCHS + 1):
        trans = w[FEATURES:].reshape(2, 2)
        p, pairs, _ = forward_backward(x @ w[:FEATURES], trans, per_doc, chain)
        grad = np.concatenate([x.T @ (weight * (p - y)), pairs.ravel() - seen]) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - LEARNING_RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(w[:FEATURES], w[FEATURES:].reshape(2, 2))


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, mod 5; a null id counts as fold 1 (never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(1))


def fitting(sizes: list[tuple[int, int, int]], most: int) -> list[tuple[int, int]]:
    """(id, hash) of the texts, in their order, that together have ``most`` lines at most."""
    out, total = [], 0
    for doc_id, th, lines in sizes:
        if total + lines <= most:
            out.append((doc_id, th))
            total += lines
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; without any label the model scores 0.5."""
    common.prepare(docs.sparkSession)
    ids = (labels.filter("quality is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 0)
           .groupBy(F.col("doc_id").cast("long").alias("k_id")).agg(F.min("quality").cast("int").alias("label"))
           .orderBy(F.xxhash64("k_id"), "k_id").limit(SAMPLE_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.buffers(batch.column("text"))
            own, _, per_doc = line_features(data, off)
            ends = np.cumsum(per_doc)
            raw = [own[a:b].tobytes() for a, b in zip(ends - per_doc, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k_id"), batch.column("label"), pa.array(per_doc.astype(np.int64)), pa.array(raw, pa.binary())],
                names=["k_id", "label", "lines", "own"])

    text = F.coalesce(F.col("text"), F.lit(""))
    labelled = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                .join(F.broadcast(ids), F.col("doc_id") == F.col("k_id"))        # at most SAMPLE_DOCS rows
                .withColumn("th", F.xxhash64("text")))
    # numbers of lines first: only the documents that fit send features
    sizes = (labelled.select("k_id", "th", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("lines"))
             .groupBy("k_id", "th", "lines").count()
             .orderBy(F.xxhash64("k_id"), "k_id", "lines", "th").limit(SAMPLE_DOCS).collect())
    fit_in = fitting([(r.k_id, r.th, r.lines * r["count"]) for r in sizes], SAMPLE_LINES)
    if not fit_in:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)))
    taken = common.small_table(docs.sparkSession, fit_in, "t_id long, t_th long")
    rows = (labelled.join(F.broadcast(taken), (F.col("k_id") == F.col("t_id")) & (F.col("th") == F.col("t_th")))
            .select("k_id", "label", "text").mapInArrow(common.released(run), "k_id long, label int, lines long, own binary")
            .orderBy(F.xxhash64("k_id"), "k_id", "lines", "own").limit(SAMPLE_DOCS).collect())
    own, per_doc, label, total = [], [], [], 0
    for r in rows:
        own.append(np.frombuffer(r.own, np.float32).reshape(-1, OWN))
        per_doc.append(r.lines)
        label.append(r.label)
        total += r.lines
    if not own:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)))
    return fit(np.concatenate(own), np.array(per_doc, np.int64), np.array(label))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, and its ``score``."""
    common.prepare(docs.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    names = [*keep, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.buffers(batch.column("__text"))
            for a, b in common.slices(np.diff(off)):
                score = model.scores(data[off[a]:off[b]], off[a:b + 1] - off[a])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in keep), pa.array(score)], names=names)

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(common.released(run), f"{schema}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = scored(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
