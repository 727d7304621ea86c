"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features are indicators, hashed into 2**18 buckets: words and pairs of words;
shapes of words (case, digits, marks at the end) and pairs of shapes, each with
the share of the text that they make up, in steps; and how much of the text
repeats its own word or 6-word sequences, in steps. Labels, language, source
and id are no inputs.

Fitting: the log of the ratio of a feature's smoothed class counts scales its
indicator, and a linear hinge-loss model is fitted to the scaled indicators by
dual coordinate descent. A fifth of the sample, kept out of that, gives the
logistic map from margins to scores. The fit is on a bounded sample: the
``sample`` training rows that come first by hash of doc_id. Scoring reads every
text once and shuffles nothing.

Defined results: null text counts as empty and is scored like any text. Labels
that are null, or of documents that are not there, are unused; where a doc_id
has several labels the lowest counts. Without labels of both classes every
score is the share of label 1 (0.5 without labels). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.llm import textnp as tn
from cladewise.session import bounded_batches

BUCKETS = 1 << 18
#: Labelled rows that are fitted on, at most.
SAMPLE = 16_000
HELD_OUT_FOLD, FOLDS = 0, 5
THRESHOLD = 0.3
_U = np.uint64
_STEPS = np.array([0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.75])

# Kinds of bytes: 0 white, 1 lower or non-ASCII, 2 upper, 3 digit, 4 other marks.
_KIND = np.full(256, 4, np.uint8)
_KIND[tn.SPACE] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3


def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    s = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=s[1:])
    return s[ends] - s[starts]


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word's shape."""
    kind = _KIND[buf]
    n = ends - starts
    upper, digit, mark = (_count(kind == k, starts, ends) for k in (2, 3, 4))
    last, first = buf[ends - 1], kind[starts]
    end = np.where(kind[ends - 1] == 4, last, kind[ends - 1]).astype(np.uint64)
    case = np.where(upper == 0, 0, np.where(upper + mark + digit == n, 3, np.where((upper == 1) & (first == 2), 1, 2)))
    return (end | case.astype(np.uint64) << _U(8) | np.minimum(mark, 4).astype(np.uint64) << _U(11) | np.minimum(digit, 4).astype(np.uint64) << _U(14) | np.minimum(n // 8, 3).astype(np.uint64) << _U(17) | first.astype(np.uint64) << _U(19))


def _bucket(kind: int, x: np.ndarray) -> np.ndarray:
    return (tn.mix64(x ^ _U(kind * 0x1000193B1)) & _U(BUCKETS - 1)).astype(np.int64)


def _shared(doc: np.ndarray, x: np.ndarray, total: np.ndarray):
    """Different values of each text, and in which step of share they stand."""
    order = np.lexsort((x, doc))
    d, v = doc[order], x[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])]) if len(d) else np.zeros(0, np.int64)
    n = np.diff(np.r_[new, len(d)])
    d, v = d[new], v[new]
    return d, v, np.searchsorted(_STEPS, n / total[d], "right").astype(np.uint64)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets of each text, and where each text's begin."""
    starts, ends, firsts = tn.words(buf, offs)
    n = np.diff(firsts)
    docs = len(n)
    doc = np.repeat(np.arange(docs), n)
    word = tn.word_hashes(tn.LOWER[buf], starts, ends)
    shape = shapes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    keys = [(np.arange(docs), _bucket(9, np.searchsorted([1, 5, 20, 100], n, "right").astype(np.uint64)))]
    keys.append((doc, _bucket(1, word)))
    total = np.maximum(n, 1)
    d, v, step = _shared(doc, shape, total)
    keys.append((d, _bucket(2, v << _U(4) | step)))
    if len(word) > 1:
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        keys.append((doc[pair], _bucket(3, word[pair] * _U(31) + word[pair + 1])))
        d, v, step = _shared(doc[pair], tn.mix64(shape[pair]) * _U(31) + shape[pair + 1], total)
        keys.append((d, _bucket(4, v ^ step)))
        same = np.bincount(doc[pair], weights=word[pair] == word[pair + 1], minlength=docs) / total
        at, wins, heads = tn.windows(word, firsts, 6)
        wd = np.repeat(np.arange(docs), np.diff(heads))
        order = np.lexsort((wins, wd))
        again = np.zeros(len(order), bool)
        again[1:] = (wins[order][1:] == wins[order][:-1]) & (wd[order][1:] == wd[order][:-1])
        repeats = np.bincount(wd[order], weights=again, minlength=docs) / total
        for k, share in ((5, same), (6, repeats)):
            step = np.searchsorted(_STEPS, share, "right").astype(np.uint64)
            keys.append((np.arange(docs), _bucket(k, step)))
    key = np.unique(np.concatenate([d * BUCKETS + b for d, b in keys]))
    return key % BUCKETS, np.searchsorted(key, np.arange(docs + 1) * BUCKETS)


class Model:
    """Weights of the buckets (log-count ratio times hinge weight), offset, and the logistic map."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float, constant: float | None = None):
        self.weights, self.offset, self.slope, self.shift, self.constant = weights, offset, slope, shift, constant

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offs) - 1, self.constant)
        found, heads = features(buf, offs)
        sums = np.add.reduceat(self.weights[found], heads[:-1])
        return 1 / (1 + np.exp(-np.clip(self.slope * (sums + self.offset) + self.shift, -30, 30)))


class Sample(Sequence):
    """Bucket lists of many rows in one array; an item is a view of its part."""

    def __init__(self, flat: np.ndarray, heads: np.ndarray):
        self.flat, self.heads = flat, heads

    def __len__(self) -> int:
        return len(self.heads) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self.flat[self.heads[i] : self.heads[i + 1]]


class InOrder(Sequence):
    """The rows of ``rows`` with the numbers ``order``, without a copy."""

    def __init__(self, rows: Sequence[np.ndarray], order: Sequence[int]):
        self.rows, self.order = rows, order

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.rows[self.order[i]]


def hinge_by_dual_descent(rows: Sequence[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model (y is -1 or 1), one dual variable at a time."""
    w, b = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([(v := scale[r]) @ v + 1.0 for r in rows])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = scale[r]
            g = y[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost.max():
            break
    return w, b


def logistic_map(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into the probability of label 1, by Newton steps."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gc = d @ margin + 1e-3 * (a - 1), d.sum()
        haa, hac, hcc = h @ (margin * margin) + 1e-3, h @ margin, h.sum() + 1e-6
        det = haa * hcc - hac * hac
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        a, c = a - da, c - dc
        if abs(da) + abs(dc) < 1e-9:
            break
    return float(max(a, 1e-3)), float(c)


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, cost: float = 0.05, smooth: float = 1.0, keep: float = 0.9) -> Model:
    """Fit on a bounded list of bucket lists with labels 0 and 1."""
    n = len(rows)
    if not n or labels.min() == labels.max():
        return Model(np.zeros(1), 0, 1, 0, float(labels.mean()) if n else 0.5)
    part = np.arange(n) % 5 == 0
    if len(set(labels[part])) < 2 or len(set(labels[~part])) < 2:
        part[:] = False
    own = np.flatnonzero(~part)
    counts = np.full((2, BUCKETS), smooth)
    for i in own:
        counts[labels[i]][rows[i]] += 1
    ratio = np.log(counts[1] / (np.sum(labels[own] == 1) + 2 * smooth)) - np.log(counts[0] / (np.sum(labels[own] == 0) + 2 * smooth))
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([np.mean(y[own] < 0), np.mean(y[own] > 0)])
    cost_of = cost * 0.5 / share[(y[own] > 0).astype(int)]
    w, b = hinge_by_dual_descent(InOrder(rows, own), ratio, y[own], cost_of)
    w = (1 - keep) * np.abs(w[w != 0]).mean() * (counts.sum(0) > 2 * smooth) + keep * w if (w != 0).any() else w
    weights = ratio * w
    held = np.flatnonzero(part) if part.any() else own
    margin = np.array([weights[rows[i]].sum() for i in held]) + b
    return Model(weights.astype(np.float64), b, *logistic_map(margin, y[held]))


def fold(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the training folds' labelled rows, at most ``sample`` of them."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD)).groupBy("doc_id").agg(F.min(label).alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in tn.slices(batch):
                found, heads = features(buf, offs)
                raw = found.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("label"), pa.array([raw[4 * a : 4 * b] for a, b in zip(heads[:-1].tolist(), heads[1:].tolist())], pa.binary())], names=["doc_id", "label", "found"]
                )

    # The sample's ids are bounded by its size: a few hundred KB to broadcast.
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", F.col("label").cast("int"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, found binary"
    # Straight into one array, which is doubled when it is full.
    flat, end, ends, keys = np.empty(1 << 20, np.int32), 0, [0], []
    for r in picked.mapInArrow(run, schema).toLocalIterator():
        found = np.frombuffer(r.found, "<i4")
        if end + len(found) > len(flat):
            flat = np.concatenate([flat[:end], np.empty(max(len(flat), len(found)), np.int32)])
        flat[end : end + len(found)] = found
        end += len(found)
        ends.append(end)
        keys.append((r.doc_id, r.label))
    rows = Sample(flat[:end], np.array(ends, np.int64))
    order = sorted(range(len(keys)), key=lambda i: (*keys[i], rows[i].tobytes()))
    made = fit(InOrder(rows, order), np.array([min(max(keys[i][1], 0), 1) for i in order], np.int64))
    del rows, flat, keys, order
    tn.tidy()
    return made


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each document and its score."""
    bounded_batches(docs.sparkSession)
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in tn.slices(batch):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(model_b.value.scores(buf, offs), pa.float64())], names=[*keep, "score"])

    cols = list(dict.fromkeys([*keep, "text"]))
    types = {c: docs.schema[c].dataType.simpleString() for c in keep}
    return docs.select(*cols).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()) + ", score double")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold. One scan, no shuffle."""
    bounded_batches(docs.sparkSession)
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in tn.slices(batch):
                yield rows.filter(pa.array(model_b.value.scores(buf, offs) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return scored(docs, fitted(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
