"""Toxicity by a chain of linear classifiers.

Features are how often a text has a word, or words with a beginning of 4 or 5 letters (inflected and compounded forms
share it), as log(1 + count): some beginnings are telling only where they abound. Features are told by a hash into 2^BITS
columns, so there is no vocabulary to choose or to cut. A model weighs every feature that its category's texts have more often
than the others; what speaks for clean texts alone is left to the intercept.

The labels have one flag, so the categories come from the toxic texts themselves: KINDS clusters of them by their
telling features (spherical k-means). The chain predicts one kind after another, and `toxic`, the label itself, last. Each
model is a logistic regression on the features and the probabilities of the categories before. For that, each model is
trained once for each fold without its rows, and it is these out-of-fold probabilities that later models are
trained with; what a fold's models take from the data (clusters, how telling a feature is, weights) comes from the other
folds alone, and equal texts are in one fold. Columns are scaled by how telling they are (the z-score of their texts
among the category's), so that the ridge holds back what few texts have.

Texts are rejected from the probability on that parts toxic from clean texts best, by the out-of-fold probabilities.

Only training is bounded: SAMPLE labelled documents, those with the smallest hash of their identifier, come to the driver
as column numbers and counts. Scoring reads every whole text in tasks, without a shuffle.

Defined results: null counts as empty; where no toxic text has a letter, every text has the probability of the intercepts; without both a toxic and a clean text in the sample every probability is 0; labels of
unknown documents and null labels are ignored; of several labels of a document the toxic one holds, of several texts with one
identifier the one with the smallest digest is learned from; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from convoweave.llm.rows import slices
from convoweave.session import cut, table

SAMPLE = 4_000
BITS = 20
FOLDS = 3
KINDS = 4
BEGINNINGS = (4, 5)
RIDGE = 0.3
KEEN = 10.0  # a z-score that leaves a column as it is
CACHED_WORDS = 50_000  # of a task; its cache is emptied when it is full
CATEGORIES = (*(f"kind_{k}" for k in range(KINDS)), "toxic")
FALSE_ALARM = 20.0  # what rejecting a share of the clean texts costs against missing that share of the toxic ones
LETTERS = re.compile(r"[^\W\d_]+")


def columns_of(word: str) -> list[int]:
    """The columns of a word and of its beginnings (marked with *)."""
    names = (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k))
    return [crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in names]


def counted(texts: Iterable[str | None], known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and count of every feature of some texts, by row and column. known: columns of the words that a task has met."""
    rows, columns, counts = [], [], []
    for k, text in enumerate(texts):
        words = Counter(LETTERS.findall((text or "").lower()))
        if len(known) > CACHED_WORDS:
            known.clear()
        for w, n in words.items():
            at = known.get(w)
            if at is None:
                at = known[w] = columns_of(w)
            columns += at
            counts += [n] * len(at)
        rows += [len(columns)]
    sizes = np.diff(np.array([0, *rows]))
    key = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << BITS | np.array(columns, np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], np.array(counts, np.int64)[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[starts] >> BITS, key[starts] & ((1 << BITS) - 1), np.add.reduceat(count, starts) if len(starts) else count


@dataclass
class Sparse:
    """A matrix by its entries: row, column and value of each; small types, since all of the sample is held at once."""

    row: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    height: int
    width: int

    def take(self, rows: np.ndarray) -> Sparse:
        """The marked rows."""
        here = rows[self.row]
        place = (np.cumsum(rows) - 1).astype(np.int32)
        return Sparse(place[self.row[here]], self.columns[here], self.values[here], int(rows.sum()), self.width)

    def scaled(self, scale: np.ndarray) -> Sparse:
        """The matrix with scaled columns; columns of scale 0 are left out."""
        here = scale[self.columns] > 0
        columns = self.columns[here]
        return Sparse(self.row[here], columns, self.values[here] * scale[columns].astype(np.float32), self.height, self.width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.columns], minlength=self.height)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * r[self.row], minlength=self.width)


def telling(x: Sparse, y: np.ndarray) -> np.ndarray:
    """By column: how telling it is of the rows with y, as its scale; 0 for columns that tell nothing or of the others."""
    texts = np.bincount(x.columns, minlength=x.width)
    hits = np.bincount(x.columns, y[x.row], minlength=x.width)
    share = y.mean() if len(y) else 0.0
    z = (hits - texts * share) / np.sqrt(texts * share * (1 - share) + 0.25)
    return np.maximum(z, 0) / KEEN


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def dot(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.einsum("i,i", a, b))  # in this thread, unlike a BLAS call


def logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, rounds: int = 12, inner: int = 25) -> np.ndarray:
    """Weights over the columns of x, those of extra, and one (hardly shrunk), of a ridge logistic regression, by Newton steps
    that conjugate gradients solve."""
    used = np.flatnonzero(np.bincount(x.columns, minlength=x.width))
    place = np.zeros(x.width, np.int32)
    place[used] = np.arange(len(used))
    small = Sparse(x.row, place[x.columns], x.values, x.height, len(used))
    dense = [*extra.T, np.ones(len(y))]
    shrink = np.r_[np.full(len(used) + extra.shape[1], RIDGE), 1e-4]

    def times(w: np.ndarray) -> np.ndarray:
        return small.times(w) + sum(c * v for c, v in zip(dense, w[len(used) :], strict=True))

    def back(r: np.ndarray) -> np.ndarray:
        return np.r_[small.back(r), [dot(r, c) for c in dense]]

    w = np.zeros(len(shrink))
    for _ in range(rounds):
        p = sigmoid(times(w))
        slope, bend = back(y - p) - shrink * w, p * (1 - p) + 1e-9
        step, rest = np.zeros(len(w)), slope.copy()
        way, size = rest.copy(), dot(rest, rest)
        least = size * 1e-3
        for _ in range(inner):
            if size <= least:
                break
            bent = back(bend * times(way)) + shrink * way
            far = size / dot(way, bent)
            step += far * way
            rest -= far * bent
            size, before = dot(rest, rest), size
            way = rest + size / before * way
        w += step
        if np.abs(step).max(initial=0) < 5e-3:
            break
    full = np.zeros(x.width)
    full[used] = w[: len(used)]
    return np.r_[full, w[len(used) :]]


def kinds(x: Sparse, y: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The cluster of every row with y (-1 for the others): spherical k-means over the telling columns, from rows far apart."""
    hit = y > 0
    rows = x.take(hit).scaled(telling(x, y))
    length = np.sqrt(np.bincount(rows.row, rows.values**2, minlength=rows.height))
    rows.values = rows.values / np.maximum(length, 1e-12)[rows.row]
    middle = rows.back(np.ones(len(length)))
    near = rows.times(middle)
    centres: list[np.ndarray] = []
    for _ in range(KINDS):  # the row most like all, then always the one that is least like the centres
        first = int(near.argmax()) if not centres else int(np.where(length > 0, near, np.inf).argmin())
        mark = np.zeros(len(length))
        mark[first] = 1
        centres.append(rows.back(mark))
        near = np.max([rows.times(c) for c in centres], axis=0)
    label = None
    for _ in range(rounds):
        new = np.argmax([rows.times(c) for c in centres], axis=0)
        if label is not None and (new == label).all():
            break
        label = new
        for k in range(KINDS):
            if (label == k).any():
                c = rows.back((label == k).astype(float))
                centres[k] = c / max(np.sqrt(dot(c, c)), 1e-12)
    found = np.full(len(y), -1)
    found[hit] = label
    return found


def named_like(label: np.ndarray, other: np.ndarray) -> np.ndarray:
    """`label` with its kinds named so that they agree with `other` on as many rows as they can."""
    agree = np.array([[((label == k) & (other == m)).sum() for m in range(KINDS)] for k in range(KINDS)])
    best = max(permutations(range(KINDS)), key=lambda p: sum(agree[k, m] for k, m in enumerate(p)))
    return np.where(label < 0, -1, np.array(best)[label])


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability in the middle of the gap that parts toxic from clean texts best, by out-of-fold probabilities."""
    order = np.argsort(-p, kind="stable")
    hits, alarms = np.cumsum(y[order]) / y.sum(), np.cumsum(1 - y[order]) / (1 - y).sum()
    gain = np.where(np.r_[np.diff(p[order]) < 0, True], hits - FALSE_ALARM * alarms, -np.inf)
    best = int(gain.argmax())
    return float(p[order][best] + (p[order][best + 1] if best + 1 < len(p) else 0)) / 2


@dataclass
class Chain:
    """The trained models: weights[k] is over `columns`, the k earlier probabilities and one."""

    columns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: list[np.ndarray] = field(default_factory=list)
    reject: float = 1.0  # from this probability of the last category on, a text is rejected

    def scores(self, texts: list[str | None], known: dict[str, list[int]] | None = None) -> np.ndarray:
        """The probability of each category for each text."""
        out = np.zeros((len(texts), 0))
        if not self.weights:
            return np.zeros((len(texts), len(CATEGORIES)))
        if not len(self.columns):  # no toxic text has a feature, so the intercepts are all that is known
            row, at, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            row, at, value = self.features(texts, {} if known is None else known)
        for w in self.weights:
            z = np.bincount(row, value * w[at], minlength=len(texts)) + out @ w[len(self.columns) : -1] + w[-1]
            out = np.hstack([out, sigmoid(z)[:, None]])
        return out

    def features(self, texts: list[str | None], known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in `columns` and value of the features of some texts that the models know."""
        row, column, count = counted(texts, known)
        at = np.minimum(np.searchsorted(self.columns, column), len(self.columns) - 1)
        here = self.columns[at] == column
        return row[here], at[here], np.log1p(count[here])


def fit(x: Sparse, y: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of each model over the columns of x, earlier probabilities and one, and the out-of-fold probabilities."""
    folds = [f for f in range(FOLDS) if (fold == f).any() and 0 < y[fold != f].sum() < (fold != f).sum()]
    label = kinds(x, y)
    labels = {f: named_like(kinds(x.take(fold != f), y[fold != f]), label[fold != f]) for f in folds}
    weights, out = [], np.zeros((len(y), 0))
    for c in range(len(CATEGORIES)):
        wanted = lambda kind, toxic, c=c: (kind == c).astype(float) if c < KINDS else toxic
        scale = telling(x, wanted(label, y))
        w = logistic(x.scaled(scale), out, wanted(label, y))
        weights.append(np.r_[w[: x.width] * scale, w[x.width :]])
        found = np.zeros(len(y))
        for f in folds:
            seen, unseen = x.take(fold != f), x.take(fold == f)
            hit = wanted(labels[f], y[fold != f])
            scale = telling(seen, hit)
            w = logistic(seen.scaled(scale), out[fold != f], hit)
            found[fold == f] = sigmoid(unseen.times(w[: x.width] * scale) + out[fold == f] @ w[x.width : -1] + w[-1])
        out = np.hstack([out, found[:, None]])
    return weights, out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain for `labels` (doc_id, toxic) of `docs` (doc_id, text)."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "toxic", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in slices(batches):
            row, column, count = counted(b.column("text").to_pylist(), known)
            at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            lists = (pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (column, count))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "digest")), *lists], ["doc_id", "toxic", "digest", "columns", "counts"])

    schema = rows.select("doc_id", "toxic", "digest").schema.add("columns", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType()))
    one = cut(rows.mapInArrow(listed, schema)).groupBy("doc_id").agg(F.min(F.struct("digest", "toxic", "columns", "counts")).alias("x"))
    found = one.select("doc_id", "x.*").orderBy("digest", "doc_id").drop("doc_id").toArrow().combine_chunks()
    if not found.num_rows:
        return Chain()
    y = found["toxic"].to_numpy().astype(float)
    if y.min() == y.max():
        return Chain()
    fold = np.array([int(d[:8], 16) % FOLDS for d in found["digest"].to_pylist()])
    lists = [found[c].combine_chunks() for c in ("columns", "counts")]
    row = np.repeat(np.arange(len(y), dtype=np.int32), lists[0].value_lengths().to_numpy())
    columns, values = lists[0].flatten().to_numpy(), np.log1p(lists[1].flatten().to_numpy(), dtype=np.float32)
    del found, lists
    # Columns of no toxic text have no part in any model, since their scale is 0 in all.
    names = np.flatnonzero(np.bincount(columns[y[row] > 0], minlength=1 << BITS))
    place = np.full(1 << BITS, -1, np.int32)
    place[names] = np.arange(len(names))
    here = place[columns] >= 0
    x = Sparse(row[here], place[columns[here]], values[here], len(y), len(names))
    weights, out = fit(x, y, fold)
    used = np.flatnonzero(np.any([w[: len(names)] != 0 for w in weights], axis=0))
    return Chain(names[used].astype(np.int64), [np.r_[w[: len(names)][used], w[len(names) :]] for w in weights], threshold(out[:, -1], y))


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the probability of each category, and rejected, for every whole text."""
    names = [f"p_{c}" for c in CATEGORIES]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in slices(batches):
            p = shared.value.scores(b.column("t").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in np.round(p, 6).T), pa.array(p[:, -1] >= shared.value.reject)], ["doc_id", *names, "rejected"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    schema = rows.select("doc_id").schema
    for name in names:
        schema = schema.add(name, "double")
    return rows.mapInArrow(run, schema.add("rejected", "boolean"))


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of `docs`, with all their columns, that the chain does not reject; in one pass without a shuffle."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in slices(batches):
            yield b.filter(pa.array(shared.value.scores(b.column(at).to_pylist(), known)[:, -1] < shared.value.reject, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` scored by a chain trained on a bounded sample of `labels`."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
