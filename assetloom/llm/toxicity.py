"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other document, labelled or not,
is unlabelled. With the class prior p and a loss l, the risk of a classifier g is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

where the second part estimates the risk on clean text from unlabelled text. Where
it falls below zero the positives among the unlabelled are being fitted, and the
step goes the other way. Several linear classifiers are trained in numpy on bounded
random samples and their scores averaged. Only this fit is sampled.

A document is the set of hashed features of its words: the word and its beginnings,
so that forms never seen share features with known ones. Features are kept that are
significantly more frequent among the positives than among the unlabelled; they are
weighted by rarity and a document's vector has length one. Frequencies are counted
over all documents that are not held out. A feature kept that no sampled positive
holds gets the weight that the fitted ones have on average for its frequencies. As
unlabelled positives pull scores down, the border is laid where the share of
unlabelled documents above it is the class prior, again over all of them. Counts and
margins are added up per task in arrays of fixed size, so neither the driver nor a
task holds more as documents are added.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import broadcast_if_small, narrow_batches, text_of
from assetloom.llm.numtext import text_slices, tidy

WORD = re.compile(r"[^\W_]+")
SLICE_BYTES = 4 << 20
CACHED_WORDS = 200_000
BEGINNINGS = (4, 5, 6)
MARGIN_BITS = 20  # the border is exact to this many bits of the range of margins
OUTPUTS = ("score", "predicted")


@dataclass(frozen=True)
class Settings:
    """Parameters of the training. The first three bound the sample, and so what reaches the driver."""

    positives: int = 4_000
    unlabelled: int = 12_000
    sample_bytes: int = 96 << 20
    bits: int = 18
    significance: float = 5.0  # standard deviations above the unlabelled frequency
    documents: int = 5  # documents that must hold a feature
    models: int = 3
    epochs: int = 12
    batch: int = 256
    rate: float = 0.5
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """A linear classifier: score = logistic(weights . vector - border)."""

    features: np.ndarray  # sorted ids of the features kept
    rarity: np.ndarray
    weights: np.ndarray
    border: float
    bits: int
    prior: float


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether labels of a row must not be learnt: crc32 of its id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_features(word: str, bits: int) -> list[int]:
    """Hashed features of a word: the whole word and its beginnings."""
    mask, found, done = (1 << bits) - 1, [], 0
    value = zlib.crc32(b"<")
    for n in BEGINNINGS:
        if len(word) < n:
            break
        value = zlib.crc32(word[done:n].encode(), value)
        found.append(value & mask)
        done = n
    return [*found, zlib.crc32(f"{word[done:64]}>".encode(), value) & mask]


class _Words(dict):
    """Features of words, kept ones alone where they are given; words seen lately are remembered."""

    def __init__(self, bits: int, kept: np.ndarray | None = None):
        self.bits = bits
        self.place = None if kept is None else {int(f): i for i, f in enumerate(kept)}

    def __missing__(self, word: str) -> list[int]:
        found = word_features(word, self.bits)
        if self.place is not None:
            found = [self.place[f] for f in found if f in self.place]
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


class _Featurizer:
    """Features of texts."""

    def __init__(self, bits: int, kept: np.ndarray | None = None):
        self.of_word = _Words(bits, kept)

    def each(self, text: str | None) -> Iterator[int]:
        """Features of the different words; words that begin alike repeat theirs."""
        words = set(WORD.findall((text or "").lower()))
        return chain.from_iterable(map(self.of_word.__getitem__, words))

    def __call__(self, text: str | None) -> list[int]:
        return sorted(set(self.each(text)))


def _features(docs: DataFrame, bits: int) -> list[np.ndarray]:
    """Features of the few documents of a sample (a column text), on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        featurize = _Featurizer(bits)
        for part in text_slices(batches, "text", SLICE_BYTES):
            found = [featurize(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["features"])

    schema = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType()))])
    table = narrow_batches(docs).mapInArrow(run, schema).toArrow()
    return [np.asarray(x.values.to_numpy(), dtype=np.int64) for x in table.column("features")]


def _frequencies(docs: DataFrame, bits: int) -> np.ndarray:
    """Number of documents (a column text) that hold each feature; the last entry is that of all documents."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        featurize = _Featurizer(bits)
        total = np.zeros(size + 1, np.int64)
        for part in text_slices(batches, "text", SLICE_BYTES):
            found, ends = [], [0]
            for text in part.column("text").to_pylist():
                found.extend(featurize.each(text))
                ends.append(len(found))
            rows = np.repeat(np.arange(part.num_rows) << bits, np.diff(ends))
            pairs = np.sort(rows + np.array(found, np.int64))
            first = np.diff(pairs, prepend=-1) != 0
            total[:size] += np.bincount(pairs[first] & (size - 1), minlength=size)
            total[size] += part.num_rows
        yield _counted(np.flatnonzero(total), total[total > 0])

    return _total(docs, run, size + 1)


def _counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])


def _total(docs: DataFrame, run, size: int) -> np.ndarray:
    """Sum over all tasks of what ``run`` counts, for keys below ``size``."""
    parts = narrow_batches(docs).mapInArrow(run, "key bigint, n bigint")
    table = parts.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[table.column("key").to_numpy()] = table.column("n").to_numpy()
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Sample:
    """Vectors of documents over the kept features, as one flat array."""

    def __init__(self, docs: list[np.ndarray], kept: np.ndarray, rarity: np.ndarray):
        rows, places, values = [], [], []
        for d in docs:
            at = np.searchsorted(kept, d)
            at = at[(at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == d)] if len(kept) else at[:0]
            v = rarity[at]
            values.append(v / np.sqrt((v * v).sum()) if len(v) else v)
            places.append(at)
        self.ends = np.cumsum([0, *(len(x) for x in places)])
        self.place = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.value = np.concatenate(values) if values else np.zeros(0)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row in the batch, place and value of all entries of some documents."""
        sizes = (self.ends[1:] - self.ends[:-1])[rows]
        row = np.repeat(np.arange(len(rows)), sizes)
        flat = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.ends[rows], sizes)
        return row, self.place[flat], self.value[flat]


def train_nnpu(
    positive: _Sample, unlabelled: _Sample, n_pos: int, n_unl: int, n_features: int, prior: float, s: Settings, seed: int
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk under the logistic loss, by AdaGrad."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n_features), -1.0
    grown, grown_b = np.full(n_features, 1e-4), 1e-4
    size_u = min(s.batch, n_unl)
    size_p = max(1, min(n_pos, s.batch // 4))
    for _ in range(s.epochs):
        order_p, order_u = rng.permutation(n_pos), rng.permutation(n_unl)
        for k in range(n_unl // size_u):
            rows_p = order_p[np.arange(k * size_p, (k + 1) * size_p) % n_pos]
            rows_u = order_u[k * size_u : (k + 1) * size_u]
            row_p, at_p, v_p = positive.take(rows_p)
            row_u, at_u, v_u = unlabelled.take(rows_u)
            g_p = np.bincount(row_p, w[at_p] * v_p, size_p) + b
            g_u = np.bincount(row_u, w[at_u] * v_u, size_u) + b
            clean = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
            if clean >= 0:
                # d/dg of p * l(g) - p * l(-g) is -p for the logistic loss
                slope_p, slope_u = np.full(size_p, -prior / size_p), _logistic(g_u) / size_u
            else:
                slope_p, slope_u = prior * _logistic(g_p) / size_p, -_logistic(g_u) / size_u
            step = np.bincount(at_p, slope_p[row_p] * v_p, n_features)
            step += np.bincount(at_u, slope_u[row_u] * v_u, n_features)
            grown += step * step
            w -= s.rate * step / np.sqrt(grown)
            step_b = slope_p.sum() + slope_u.sum()
            grown_b += step_b * step_b
            b -= s.rate * step_b / np.sqrt(grown_b)
    return w, b


def _margins(texts: list[str | None], featurize: _Featurizer, weights: list[float], squares: list[float]) -> np.ndarray:
    """Weights times vector, for each text."""
    margins = []
    for text in texts:
        found = featurize(text)
        length = sum(squares[f] for f in found) ** 0.5
        margins.append(sum(weights[f] for f in found) / length if length else 0.0)
    return np.array(margins)


def _border(docs: DataFrame, model: Model) -> float:
    """The margin that the share ``prior`` of all documents (a column text) reaches.

    Margins are counted in steps of a power of two, at most 2^21 of them, so the counts
    do not depend on how documents are dealt, and equal margins stay on one side.
    """
    # a vector has length one, so no margin is larger than the weights' length
    reach = max(float(np.sqrt((model.weights**2).sum())), 1e-9)
    step, half = 2.0 ** (np.ceil(np.log2(reach)) - MARGIN_BITS + 1), 1 << MARGIN_BITS
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        m = Model(**shared.value)
        featurize = _Featurizer(m.bits, m.features)
        weights, squares = (m.rarity * m.weights).tolist(), (m.rarity**2).tolist()
        total = np.zeros(2 * half, np.int64)
        for part in text_slices(batches, "text", SLICE_BYTES):
            margins = _margins(part.column("text").to_pylist(), featurize, weights, squares)
            np.add.at(total, np.floor(margins / step).astype(np.int64) + half, 1)
        yield _counted(np.flatnonzero(total), total[total > 0])

    counts = _total(docs, run, 2 * half)
    shared.unpersist()
    upto = np.cumsum(counts)
    at = int(np.searchsorted(upto, np.floor((1 - model.prior) * (upto[-1] - 1)), side="right"))
    return (at - half) * step


def _weights_by_frequency(weights: np.ndarray, fitted: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Weights with those not ``fitted`` laid on the line through zero that fits the others over the log ``ratio``."""
    r = ratio[fitted]
    slope = float((weights[fitted] * r).sum() / (r * r).sum()) if len(r) else 1.0
    return np.where(fitted, weights, max(slope, 0.0) * ratio)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
    settings: Settings = Settings(),
    prior: float | None = None,
) -> Model:
    """Train on rows that are not held out (see ``held_out``).

    ``labels`` gives ids with a label of 1; labels of 0 only enter the class prior,
    the share of 1 among all labels, unless ``prior`` is given. Frequencies and the
    border cover all rows; the sample of the fit is drawn by a hash of the row, so it
    is the same at every run. Without a confirmed
    document the model scores the prior, which is then 0.
    """
    s = settings
    known = labels.where(~held_out(id_col) & F.col(f"`{label_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")
    )
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    share, n_pos = known.agg(F.avg("label"), F.sum("label")).first()
    prior = (share or 0.0) if prior is None else prior
    empty = np.zeros(0, np.int64)
    if not n_pos:
        border = -float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 40.0
        return Model(empty, np.zeros(0), np.zeros(0), border, s.bits, prior)
    open_docs = docs.where(~held_out(id_col)).select(
        F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")
    )
    n_docs, n_bytes = open_docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    mean = max((n_bytes or 0) / max(n_docs, 1), 1.0)

    def drawn(wanted: int, bound: int, of: float, salt: int) -> Column:
        wanted = min(wanted, bound / mean)
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 40)) < int(min(1.0, wanted / max(of, 1)) * (1 << 40))

    confirmed = known.where(F.col("label") > 0).select("id")
    wide = F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)) + 16
    confirmed_docs = open_docs.join(broadcast_if_small(confirmed, wide), "id", "left_semi").select("text")
    in_unl, in_pos = _frequencies(open_docs.select("text"), s.bits), _frequencies(confirmed_docs, s.bits)
    all_unl, all_pos = int(in_unl[-1]), int(in_pos[-1])
    in_unl, in_pos = in_unl[:-1], in_pos[:-1]

    chosen = confirmed.where(drawn(s.positives, s.sample_bytes // 4, n_pos, s.seed))
    positive = _features(open_docs.join(F.broadcast(chosen), "id").select("text"), s.bits)
    unlabelled = _features(
        open_docs.where(drawn(s.unlabelled, 3 * (s.sample_bytes // 4), n_docs, s.seed + 1)).select("text"), s.bits
    )
    if not positive or not unlabelled:
        return Model(empty, np.zeros(0), np.zeros(0), 40.0, s.bits, prior)

    rate = in_unl / all_unl
    expected = all_pos * rate
    above = (in_pos - expected) / np.sqrt(np.maximum(expected * (1 - rate), 1.0))
    kept = np.flatnonzero((above > s.significance) & (in_pos + in_unl >= s.documents))
    rarity = np.log((all_unl + 1) / (in_unl[kept] + 1)) + 0.1
    p, u = _Sample(positive, kept, rarity), _Sample(unlabelled, kept, rarity)
    fits = [
        train_nnpu(p, u, len(positive), len(unlabelled), len(kept), prior, s, s.seed + k) for k in range(s.models)
    ]
    fitted = np.bincount(p.place, minlength=len(kept)) > 0
    ratio = np.log((in_pos[kept] + 1) / (all_pos + 1)) - np.log((in_unl[kept] + 1) / (all_unl + 1))
    weights = _weights_by_frequency(np.mean([w for w, _ in fits], axis=0), fitted, ratio)
    # a document without any feature has the margin 0 and is never above the border
    model = Model(kept, rarity, weights, 0.1, s.bits, prior)
    return replace(model, border=max(_border(open_docs.select("text"), model), 0.1)) if len(kept) else model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``at_least`` on) added.

    Whole texts are scored. NULL and empty texts and texts without known features get
    the score of no evidence, below one half. Rows are independent, so repeated rows
    are scored alike; an empty table stays empty. Columns that bear an output's name
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    base = docs.drop(*[c for c in OUTPUTS if c != text_col])
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        m = Model(**shared.value)
        featurize = _Featurizer(m.bits, m.features)
        weights, squares = (m.rarity * m.weights).tolist(), (m.rarity**2).tolist()
        for part in text_slices(batches, text_col, SLICE_BYTES):
            texts = part.column(part.schema.names.index(text_col)).to_pylist()
            margins = _margins(texts, featurize, weights, squares)
            score = _logistic(margins - m.border)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])

    scored = narrow_batches(base).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= at_least).cast("int"))
