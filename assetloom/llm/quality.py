"""Quality scores from weak labels.

Heuristic labellers look at a whole text and vote good, bad or nothing. Spark counts
the patterns of votes over all documents; expectation-maximisation on these counts
estimates how each labeller votes on good and on bad documents, and so the posterior
of every pattern. The posteriors are the labels on which a linear scorer over hashed
features is trained (logistic loss, on a bounded sample drawn by hash). The scorer
then judges every whole document; it generalises beyond the heuristics' thresholds.

No true label is used. What reaches the driver is bounded by the number of patterns
(3 to the number of labellers) and by the sample.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import narrow_batches, text_of
from assetloom.llm.numtext import text_slices, tidy

SLICE_BYTES = 2 << 20
CACHED_TOKENS = 200_000
OUTPUTS = ("weak_label", "score", "predicted")
GOOD, BAD, NONE = "1", "0", "-"
LABELLERS = (
    "length", "symbols", "capitals", "digits", "word_length", "variety", "echo", "sentences", "bare_marks", "lines",
    "tails", "runs",
)


@dataclass(frozen=True)
class Settings:
    """Parameters; the first two bound the sample that reaches the driver."""

    sample: int = 12_000
    sample_bytes: int = 64 << 20
    bits: int = 18
    em_rounds: int = 100
    epochs: int = 15
    batch: int = 256
    rate: float = 0.3
    seed: int = 23


@dataclass(frozen=True)
class Model:
    posterior: dict[str, float]  # of every pattern of votes that was seen
    weights: np.ndarray
    bias: float
    bits: int


_PUNCTUATION = ".,;:!?\"'()"
_KINDS = 3  # features of a token: its shape, its word, its length


def _shape(token: str) -> str:
    """Runs of capitals, letters, digits and equal marks: 'A', 'a', '9' or the mark."""
    if token.isalpha():
        if token.islower():
            return "a"
        if token.isupper():
            return "A"
        if token[0].isupper() and token[1:].islower():
            return "Aa"
    out: list[str] = []
    for c in token[:40]:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class _Reader:
    """Votes and token counts of texts; what is known of tokens seen lately is kept in tables."""

    def __init__(self, bits: int | None = None, weights: np.ndarray | None = None):
        self.mask, self.weights = bits and (1 << bits) - 1, weights  # without bits: votes alone
        self.ids: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self._room(CACHED_TOKENS)

    def _room(self, size: int) -> None:
        self.ids.clear()
        self.fresh: list[tuple] = []  # of tokens that are not in the tables yet
        self.named: list[tuple] = []
        self.stats = np.zeros((size, 7))
        self.features = np.zeros((size, _KINDS), np.int32)
        self.weight = np.zeros(size)

    def _add(self, token: str) -> int:
        core = token.strip(_PUNCTUATION)
        n = len(token)
        if core.isalpha():
            letters, digits = len(core), 0
            upper = 0 if core.islower() else sum(map(str.isupper, core))
        else:
            letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
            upper = sum(map(str.isupper, token))
        row = self.ids[token] = len(self.ids)
        last = token[-1]
        self.fresh.append((
            n, letters, upper, digits, not letters and not digits, len(core) < n and last in ".!?",
            n > 2 and not last.isalnum() and not token[-2].isalnum(),
        ))
        if not self.mask:
            return row
        shape = _shape(token)
        place = self.shapes.get(shape)
        if place is None:
            if len(self.shapes) >= CACHED_TOKENS:
                self.shapes.clear()
            place = self.shapes[shape] = zlib.crc32(b"s" + shape.encode()) & self.mask
        self.named.append((place, zlib.crc32(core[:40].lower().encode()) & self.mask, min(n, 20)))
        return row

    def _flush(self) -> None:
        """Enter the new tokens into the tables."""
        stop = len(self.ids)
        if self.fresh:
            self.stats[stop - len(self.fresh) : stop] = self.fresh
            self.fresh = []
        if self.named:
            new = slice(stop - len(self.named), stop)
            self.features[new] = self.named
            if self.weights is not None:
                self.weight[new] = self.weights[self.features[new]].sum(axis=1)
            self.named = []

    def __call__(self, text: str | None) -> tuple[str, np.ndarray, np.ndarray]:
        """The pattern of votes; the rows of the distinct tokens and how often each occurs."""
        text = text or ""
        tokens = text.split()
        counts = Counter(tokens)
        n = len(tokens)
        if len(self.ids) + len(counts) > len(self.weight):
            self._room(max(CACHED_TOKENS, len(counts)))
        get, add = self.ids.get, self._add
        rows = np.array([r if (r := get(t)) is not None else add(t) for t in counts], dtype=np.int64)
        self._flush()
        count = np.fromiter(counts.values(), float, len(counts))
        if not n:
            return BAD + NONE * (len(LABELLERS) - 1), rows, count
        chars, letters, upper, digits, marks, ends, tails = (count @ self.stats[rows]).tolist()
        repeats = bytes(map(eq, tokens, tokens[1:]))
        echo = repeats.count(1)
        run = 5 if b"\1" * 4 in repeats else 3 if b"\1\1" in repeats else 2  # at most, or from 5 on
        lines = [x for x in text.split("\n") if x.strip()]
        short = sum(len(x) < 20 for x in lines)

        def vote(value: float, good: float, bad: float) -> str:
            """Small values are good."""
            return GOOD if value <= good else BAD if value >= bad else NONE

        mean = chars / n
        votes = (
            GOOD if n >= 40 else NONE,
            vote((chars - letters - digits) / chars, 0.08, 0.2),
            vote(upper / max(letters, 1), 0.12, 0.4),
            vote(digits / chars, 0.05, 0.25),
            GOOD if 3 <= mean <= 9 else BAD if mean > 14 or mean < 2 else NONE,
            NONE if n < 20 else vote(count.max() / n, 0.12, 0.25),
            NONE if n < 5 else vote(echo / n, 0.03, 0.2),
            NONE if n < 20 else vote(abs(ends / n - 0.08), 0.07, 0.25),
            vote(marks / n, 0.02, 0.15),
            NONE if len(lines) < 4 else vote(short / len(lines), 0.3, 0.7),
            vote(tails / n, 0.02, 0.2),
            NONE if n < 5 else vote(run, 2, 5),
        )
        return "".join(votes), rows, count

    def vector(self, rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of a text and their values: square roots of token counts, summed, over that of the length."""
        at, inverse = np.unique(self.features[rows].ravel(), return_inverse=True)
        value = np.bincount(inverse, np.repeat(np.sqrt(count), _KINDS), len(at))
        return at, value / np.sqrt(max(count.sum(), 1.0))

    def margin(self, rows: np.ndarray, count: np.ndarray) -> float:
        """Weights times the vector, without making it."""
        return float(self.weight[rows] @ np.sqrt(count) / np.sqrt(max(count.sum(), 1.0)))


def fit_votes(patterns: dict[str, int], rounds: int) -> tuple[dict[str, float], np.ndarray, float]:
    """EM over counted vote patterns: posteriors of good, P(good or bad vote | class) per labeller, share of good.

    Starts from the majority of the votes; each labeller has its own rates of good and
    bad votes on either class, smoothed by one document each. No vote says nothing.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((0, 2, 2)), 0.5
    votes = np.array([["10-".index(v) for v in p] for p in names])
    weight = np.array([patterns[p] for p in names], float)
    one_hot = np.eye(3)[votes][:, :, :2]  # pattern, labeller, vote
    good, bad = one_hot[:, :, 0].sum(1), one_hot[:, :, 1].sum(1)
    # one bad vote of a heuristic says more than one good vote
    post = (good + 1) / (good + 4 * bad + 2)
    rates, share = np.zeros((votes.shape[1], 2, 2)), 0.5
    for _ in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            mass = np.einsum("p,plv->lv", weight * p, one_hot) + 1.0
            rates[:, c] = mass / mass.sum(axis=1, keepdims=True)
        share = float((weight * post).sum() + 1) / (weight.sum() + 2)
        logs = np.einsum("plv,lcv->pc", one_hot, np.log(rates)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return dict(zip(names, post.tolist(), strict=True)), rates, share


def vote_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How many documents have each pattern of votes (pattern, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        read = _Reader()
        for part in text_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [pa.array([read(x)[0] for x in part.column("text").to_pylist()], pa.string())], ["pattern"]
            )

    texts = narrow_batches(docs.select(text_of(text_col).alias("text")))
    return texts.mapInArrow(run, "pattern string").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def train_quality(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings()
) -> Model:
    """Fit the label model on all documents and the scorer on a sample drawn by a hash of the text."""
    s = settings
    posterior, _, share = fit_votes(
        {r["pattern"]: r["n"] for r in vote_patterns(docs, text_col).collect()}, s.em_rounds
    )
    text = text_of(text_col)
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    wanted = min(s.sample, s.sample_bytes / max((size or 0) / max(n, 1), 1.0))
    draw = F.pmod(F.xxhash64(F.lit(s.seed), F.col(f"`{id_col}`"), text), F.lit(1 << 40))
    sample = docs.where(draw < int(min(1.0, wanted / max(n, 1)) * (1 << 40))).select(text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        read = _Reader(s.bits)
        for part in text_slices(batches, "text", SLICE_BYTES):
            patterns, vectors = [], []
            for text_ in part.column("text").to_pylist():
                pattern, rows, count = read(text_)
                patterns.append(pattern)
                vectors.append(read.vector(rows, count))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(patterns, pa.string()),
                    pa.array([at.astype(np.int32) for at, _ in vectors], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in vectors], pa.list_(pa.float32())),
                ],
                ["pattern", "at", "value"],
            )

    drawn = narrow_batches(sample).mapInArrow(run, "pattern string, at array<int>, value array<float>").toArrow()
    target = np.array([posterior.get(p, share) for p in drawn.column("pattern").to_pylist()])
    at = [np.asarray(x.values, dtype=np.int64) for x in drawn.column("at")]
    value = [np.asarray(x.values, dtype=float) for x in drawn.column("value")]
    weights, bias = np.zeros(1 << s.bits), 0.0
    grown, grown_b = np.full(1 << s.bits, 1e-4), 1e-4
    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs if len(target) else 0):
        order = rng.permutation(len(target))
        for k in range(0, len(order), s.batch):
            rows = order[k : k + s.batch]
            row = np.repeat(np.arange(len(rows)), [len(at[r]) for r in rows])
            f, v = np.concatenate([at[r] for r in rows]), np.concatenate([value[r] for r in rows])
            z = np.bincount(row, weights[f] * v, len(rows)) + bias
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[rows]) / len(rows)
            touched, inverse = np.unique(f, return_inverse=True)
            step = np.bincount(inverse, slope[row] * v)
            grown[touched] += step * step
            weights[touched] -= s.rate * step / np.sqrt(grown[touched])
            grown_b += slope.sum() ** 2
            bias -= s.rate * slope.sum() / np.sqrt(grown_b)
    return Model(posterior, weights.astype(np.float32), float(bias), s.bits)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """All rows of ``docs`` with ``weak_label``, ``score`` and ``predicted`` added.

    ``weak_label`` is the posterior of the votes (NULL for a pattern that training did
    not see), ``score`` the scorer's probability of good, ``predicted`` 1 from
    ``at_least`` on. NULL and empty texts get the vote of an empty text and the
    scorer's bias. Rows are independent: repeated rows are scored alike and an empty
    table stays empty. Columns that bear an output's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    base = docs.drop(*[c for c in OUTPUTS if c != text_col])
    more = [T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        m = Model(**shared.value)
        read = _Reader(m.bits, m.weights)
        for part in text_slices(batches, text_col, SLICE_BYTES):
            weak, z = [], []
            for text in part.column(part.schema.names.index(text_col)).to_pylist():
                pattern, rows, count = read(text)
                weak.append(m.posterior.get(pattern))
                z.append(read.margin(rows, count) + m.bias)
            score = 1 / (1 + np.exp(-np.clip(np.array(z), -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(weak, pa.float64()), pa.array(score)],
                [*part.schema.names, "weak_label", "score"],
            )

    scored = narrow_batches(base).mapInArrow(run, T.StructType([*base.schema.fields, *more]))
    return scored.withColumn("predicted", (F.col("score") >= at_least).cast("int"))
