"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features, those of the lines before and
after it, and the label of its neighbour.  Forward-backward gives each line's probability
of being good; weighted by length they make up the document's, which a two-parameter
logistic fit turns into a calibrated score.

Training never brings a text or a line to the driver: the features of the sample are
written once, and every evaluation of the likelihood sums values and gradients in the
executors; the driver holds one vector of parameters and two numbers per sampled document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import documents, stash
from quire.llm.passage_dedup import word_hashes

ACCEPT = 0.7
#: Bound of the training sample: labelled documents, each with its whole text.
TRAIN_DOCS = 4000
#: Evaluations of the likelihood, each one pass of the executors over the sample's features.
ROUNDS = 25
_SAMPLE_PARTS, _LINES = 8, 30_000
_PART = 2 << 20

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_STOP = np.isin(_BYTE, list(b".,;:?'\"()-"))
_BANG = _BYTE == 33
_BAR = _BYTE == 124
_SYMBOL = ~(_SPACE | _DIGIT | _LETTER | _STOP | _BANG | _BAR)
_CLASSES = (_UPPER, _DIGIT, _STOP, _BANG, _BAR, _SYMBOL, _BYTE >= 128, _SPACE)
FEATURES = len(_CLASSES) + 8


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lines per document, length of every line plus one)."""
    if not texts:
        return np.empty((0, FEATURES)), np.empty(0, np.int64), np.empty(0)
    data = b"\n".join(texts)
    buf = np.frombuffer(data, np.uint8)
    per_doc = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    end = np.append(np.flatnonzero(buf == 10), len(buf))
    start = np.append(0, end[:-1] + 1)
    size = end - start
    n, columns = len(end), []
    some = np.maximum(size, 1)
    for cls in _CLASSES:
        total = np.append(0, np.cumsum(cls[buf], dtype=np.int64))
        columns.append((total[end] - total[start]) / some)
    space = _SPACE[buf]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    w_start, w_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line = np.searchsorted(end, w_start, side="right")
    words = np.bincount(line, minlength=n)
    many = np.maximum(words, 1)
    hashes = word_hashes(data, w_start, w_end)
    length = w_end - w_start
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))
    keyed = np.unique(hashes ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    last = buf[w_end - 1] if len(w_end) else np.empty(0, np.uint8)
    doc = np.repeat(np.arange(len(texts)), per_doc)
    whole = word_hashes(data, start, end) ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, same, times = np.unique(whole, return_inverse=True, return_counts=True)
    columns += [
        np.bincount(line[again], minlength=n) / many,
        np.bincount(line[keyed], minlength=n) / many,
        np.bincount(line[(_SYMBOL | _BANG)[last]], minlength=n) / many,
        np.bincount(line, length, minlength=n) / many / 10,
        np.bincount(line[length <= 3], minlength=n) / many,
        np.log1p(size) / 10,
        (times[same] > 1).astype(float),
        (words == 0).astype(float),
    ]
    return np.stack(columns, 1), per_doc, size + 1.0


def with_neighbours(x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after in its document (zeros at the ends)."""
    first = np.cumsum(per_doc) - per_doc
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[first + per_doc - 1] = 0
    return np.concatenate([x, before, after], 1)


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of "good" against "bad"
    bias: float
    step: np.ndarray  # [from, to] label weights
    slope: float = 1.0
    shift: float = 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias

    def document_scores(self, texts: list[bytes]) -> np.ndarray:
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= _PART):
                held += len(texts[stop])
                stop += 1
            x, per_doc, size = line_features(texts[at:stop])
            out[at:stop] = self.calibrated(self.good_shares(x, per_doc, size))
            at = stop
        return out

    def good_shares(self, x: np.ndarray, per_doc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Per document: the length-weighted mean of its lines' probability of being good."""
        good, _ = marginals(self.emissions(with_neighbours(x, per_doc)), per_doc, self.step)
        first = np.cumsum(per_doc) - per_doc
        return np.add.reduceat(good * size, first) / np.add.reduceat(size, first)

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _chains(emission: np.ndarray, per_doc: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once, normalised at each line.

    Returns P(good) per line, P(label before, label here) per line (zeros for first lines), and
    per line its share of the logarithm of its chain's normaliser.
    """
    n, first = len(emission), np.cumsum(per_doc) - per_doc
    order = np.argsort(-per_doc, kind="stable")
    first, count = first[order], per_doc[order]
    top = np.maximum(emission, 0)
    e = np.stack([np.exp(-top), np.exp(emission - top)], 1)
    t = np.exp(step)
    forward, backward, pair, scale = np.empty((n, 2)), np.ones((n, 2)), np.zeros((n, 2, 2)), np.empty(n)
    active = [np.searchsorted(-count, -k, side="left") for k in range(int(count.max()) if n else 0)]
    for k, m in enumerate(active):
        at = first[:m] + k
        f = e[at] if not k else (forward[at - 1] @ t) * e[at]
        scale[at] = f.sum(1)
        forward[at] = f / scale[at][:, None]
    for k in range(len(active) - 1, 0, -1):
        at = first[: active[k]] + k
        b = (backward[at] * e[at]) @ t.T
        backward[at - 1] = b / b.sum(1, keepdims=True)
        p = forward[at - 1][:, :, None] * t * (backward[at] * e[at])[:, None, :]
        pair[at] = p / p.sum((1, 2), keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(1), pair, np.log(scale) + top


def marginals(emission: np.ndarray, per_doc: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) per line, and P(label before, label here) per line (zeros for first lines)."""
    return _chains(emission, per_doc, step)[:2]


def likelihood(crf: Crf, x: np.ndarray, per_doc: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The documents' log-likelihood when all lines of one have its label, each document's times its
    weight and divided by its lines, and the gradient by (weights, bias, steps).  x: features of the
    lines without neighbours; label and weight: one per document."""
    z = np.clip((with_neighbours(x, per_doc) - crf.mean) / crf.scale, -6, 6)
    emission = z @ crf.weight + crf.bias
    good, pair, share = _chains(emission, per_doc, crf.step)
    each, y = np.repeat(weight / per_doc, per_doc), np.repeat(label, per_doc)
    stay = weight / per_doc * (per_doc - 1)
    seen = np.diag([stay[label == 0].sum(), stay[label == 1].sum()])
    value = each @ (y * emission - share) + (seen * crf.step).sum()
    miss = (y - good) * each
    return value, np.concatenate([miss @ z, [miss.sum()], (seen - np.einsum("n,nij->ij", each, pair)).ravel()])


def climb(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Quasi-Newton ascent with limited memory and a step that is halved until the value rises."""
    value, grad = evaluate(theta)
    used, moves, best = 1, [], theta
    while used < rounds and np.abs(grad).max() > 1e-5:
        way, taken = grad.copy(), []
        for s, y, r in reversed(moves):
            taken.append(r * (s @ way))
            way -= taken[-1] * y
        if moves:
            s, y, r = moves[-1]
            way *= 1 / (r * (y @ y))
        else:
            way /= max(1.0, np.linalg.norm(way))
        for (s, y, r), a in zip(moves, reversed(taken), strict=True):
            way += s * (a - r * (y @ way))
        size = 1.0
        while used < rounds:
            found, slope = evaluate(best + size * way)
            used += 1
            if found > value + 1e-4 * size * (grad @ way):
                break
            size /= 4
        else:
            break
        s, y = size * way, grad - slope
        if s @ y > 1e-12:
            moves = [*moves[1 - memory :], (s, y, 1 / (s @ y))]
        best, value, grad = best + s, found, slope
    return best


def calibrate(crf: Crf, share: np.ndarray, label: np.ndarray) -> None:
    """Two parameters from the documents' shares of good lines to their labels: Newton steps, damped
    by a weak pull towards the identity."""
    for _ in range(50):
        p = 1 / (1 + np.exp(-(crf.slope * share + crf.shift)))
        miss, w = label - p, p * (1 - p)
        g = np.array([(miss * share).sum() - 0.1 * (crf.slope - 1), miss.sum() - 0.1 * crf.shift])
        h = np.array([[(w * share * share).sum() + 0.1, (w * share).sum()], [(w * share).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(h, g)
        crf.slope, crf.shift = crf.slope + float(np.clip(move[0], -1, 1)), crf.shift + float(np.clip(move[1], -1, 1))


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


SAMPLE = "doc_id long, quality int, x binary, size binary"
MOMENTS = "n long, bad long, good long, total binary, squares binary"


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, quality, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, _, size = line_features([text.encode()])
            row = [doc_id, quality, x.astype("<f4").tobytes(), size.astype("<f4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "quality", "x", "size"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, labels, features, lines per document, line lengths) of some documents at a time."""
    held: list[tuple] = []
    lines = 0

    def flush():
        ids, quality, x, size = zip(*held, strict=True)
        return np.array(ids), np.array(quality), np.concatenate(x).astype(float), np.array([len(i) for i in x]), np.concatenate(size).astype(float)

    for batch in batches:
        for doc_id, quality, x, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append((doc_id, quality, np.frombuffer(x, "<f4").reshape(-1, FEATURES), np.frombuffer(size, "<f4")))
            lines += len(held[-1][2])
            if lines > _LINES:
                yield flush()
                held, lines = [], 0
    if held:
        yield flush()


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some documents: lines, documents by label, sums and squares of features with neighbours."""
    for _, quality, x, per_doc, _ in _groups(batches):
        wide = with_neighbours(x, per_doc)
        row = [len(x), int((quality == 0).sum()), int((quality == 1).sum()), wide.sum(0).tobytes(), (wide**2).sum(0).tobytes()]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["n", "bad", "good", "total", "squares"])


def _gradient(crf: Crf, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, grad = 0.0, np.zeros(3 * FEATURES + 5)
        for _, quality, x, per_doc, _ in _groups(batches):
            v, g = likelihood(crf, x, per_doc, quality, weight[quality])
            value, grad = value + v, grad + g
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([grad.tobytes()], pa.binary())], ["value", "grad"])

    return run


def _shares(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, quality, x, per_doc, size in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(quality, pa.int32()), pa.array(crf.good_shares(x, per_doc, size))], ["doc_id", "quality", "share"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, quality, text): the first train_docs labelled, not held-out documents in hash order.

    A doc_id whose labels differ is left out, as are labels without a document; where documents
    repeat a doc_id, the text of the smallest digest counts.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    rows = documents(docs)
    chosen = known.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.sha2("text", 256)).alias("text"))
    return found.select("doc_id", "quality", "text")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, ridge: float = 1e-3) -> Crf:
    """Fits to the training sample: every line of a document takes its label, and classes and
    documents are weighted alike.  Without documents the score is one half throughout."""
    wide = 3 * FEATURES
    crf = Crf(np.zeros(wide), np.ones(wide), np.zeros(wide), 0.0, np.zeros((2, 2)))
    sample = stash(training_sample(docs, labels, train_docs).repartition(_SAMPLE_PARTS).mapInArrow(_sample_features, SAMPLE))
    got = sample.mapInArrow(_moments, MOMENTS).collect()
    if not got:
        return crf
    lines = sum(r.n for r in got)
    crf.mean = sum(np.frombuffer(r.total) for r in got) / lines
    crf.scale = np.sqrt(np.maximum(sum(np.frombuffer(r.squares) for r in got) / lines - crf.mean**2, 0)) + 1e-3
    weight = 0.5 / np.maximum(1, [sum(r.bad for r in got), sum(r.good for r in got)])

    def put(theta: np.ndarray) -> None:
        crf.weight, crf.bias, crf.step = theta[:wide], float(theta[wide]), theta[wide + 1 :].reshape(2, 2)

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        put(theta)
        sums = sample.mapInArrow(_gradient(crf, weight), "value double, grad binary").collect()
        return sum(r.value for r in sums) - ridge / 2 * theta @ theta, sum(np.frombuffer(r.grad) for r in sums) - ridge * theta

    put(climb(evaluate, np.zeros(wide + 5), rounds))
    # two numbers a document: bounded by train_docs, whatever the length of the texts
    shares = sorted(sample.mapInArrow(_shares(crf), "doc_id long, quality int, share double").collect())
    calibrate(crf, _logit(np.array([r.share for r in shares])), np.array([r.quality for r in shares]))
    return crf


def _score(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.document_scores([t.encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def score_column(text: Column, model: Crf) -> Column:
    """The score of each text, in place: rows keep their other columns and need not meet again."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.document_scores([t.encode() for t in batch]))

    return F.pandas_udf(run, "double")(text)


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **bounds: int) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= accept, else 0).

    Only the text enters a score.  Null and empty texts are one empty line.  Without usable
    labels every score is one half.
    """
    model = train(docs, labels, **bounds)
    scored = documents(docs).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **bounds: int) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts, each judged by its own text.

    Rows without doc_id are left out; of rows that repeat a doc_id each stays or goes by itself.
    """
    score = score_column(F.coalesce(docs["text"].cast("string"), F.lit("")), train(docs, labels, **bounds))
    return docs.where(docs["doc_id"].cast("long").isNotNull() & (score >= accept))
