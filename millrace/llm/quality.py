"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1), the unlabelled text of the corpus and an estimate of
the share of positives in it give the non-negative unbiased risk: the positives'
loss, plus the loss of unlabelled text as negative less the part that its
positives must have - never below zero.  A small network over text statistics
minimises it.  No label 0 is ever read.

The unlabelled side is all documents: their statistics are counted into at most
``CELLS`` cells (signs of random projections), and in the risk up to ``DRAWN`` rows
of each cell stand for all of its rows.  The prior is the smallest ratio, over the
scores' thresholds, of the unlabelled rows above to the positives above: where
only positives score high, the ratio is their share.  The network's output becomes
a probability by the slope and shift that minimise the unbiased logistic risk of
the positives and the unlabelled.  For both, the scores of all documents are
counted in bins.

``fit`` reads a sample bounded by ``bound`` labelled rows; everything else covers
every whole text.  Scoring is one pass without a shuffle.

Defined results for odd input: a null or empty text is scored from zero
statistics; rows with an equal doc_id are scored each for itself; a null doc_id
is not held out; without positive labels every score is 0.5; other columns are
ignored (and kept by ``keep_good``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import packed as P
from millrace.llm.components import cut_lineage
from millrace.llm.labelled import remainder, training_rows

#: Labelled rows that a fit reads at most (but for the spread of a hash).
BOUND = 12_000
#: Projections whose signs name a cell of unlabelled rows, and the cells.
PLANES = 11
CELLS = 1 << PLANES
#: Rows that stand for a cell, and bins of scores.
DRAWN, BINS = 4, 512
#: Chance that the prior's bound is too low, and the share of the positives that a threshold must keep to count.
DOUBT, LEAST_KEPT = 0.05, 0.02
THRESHOLD = 0.3
MODULUS, HELD = 5, 0
HIDDEN = 16
STEPS = 400


def byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, newline, sentence mark, other mark, bar, exclamation, non-ASCII."""
    out = np.full(256, 6, np.uint8)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[*P.SPACE.nonzero()[0]]] = 3
    out[10] = 4
    out[[ord(c) for c in ".,;:'\"-()?"]] = 5
    out[ord("|")], out[ord("!")] = 7, 8
    out[128:] = 9
    out[:32][out[:32] == 6] = 6
    return out


CLASSES = byte_classes()
N_CLASSES = 10


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each text (rows x features), each between 0 and some small number."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((rows, N_CLASSES + 9))
    full = size > 0
    at = offsets[:-1][full]
    if not len(at):
        return out
    kind = CLASSES[data]
    some = np.maximum(size, 1)
    for c in range(N_CLASSES):
        out[full, c] = np.add.reduceat(kind == c, at, dtype=np.int64) / some[full]
    starts, ends, doc = P.words_of(data, offsets)
    n = np.bincount(doc, minlength=rows).astype(float)
    words = np.maximum(n, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, rows) / words
    out[:, N_CLASSES] = np.log1p(n) / 10
    out[:, N_CLASSES + 1] = mean / 10
    out[:, N_CLASSES + 2] = np.sqrt(np.maximum(0, np.bincount(doc, length**2, rows) / words - mean**2)) / 10
    if len(starts):
        h = P.slice_hashes(data, starts, ends)
        beside = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
        out[:, N_CLASSES + 3] = np.bincount(doc, beside, rows) / words
        order = np.lexsort((h, doc))
        fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
        kinds = np.bincount(doc[order], fresh, rows)
        out[:, N_CLASSES + 4] = kinds / words
        out[:, N_CLASSES + 5] = np.log1p(kinds) / np.log1p(words)
        tail = kind[ends - 1]
        out[:, N_CLASSES + 6] = np.bincount(doc, (tail == 6) | (tail == 8), rows) / words
        out[:, N_CLASSES + 7] = np.bincount(doc, length <= 3, rows) / words
        head = kind[starts]
        out[:, N_CLASSES + 8] = np.bincount(doc, head == 1, rows) / words
    return out


def forward(x: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w["a"] + w["b"])
    return hidden, hidden @ w["c"] + x @ w["e"] + w["d"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_risk(positive: np.ndarray, plain: np.ndarray, prior: float, weight: np.ndarray | None = None, steps: int = STEPS, seed: int = 7) -> dict:
    """Weights that minimise the non-negative risk with the sigmoid loss, by Adam; ``weight`` counts the rows that each plain row stands for."""
    rng = np.random.default_rng(seed)
    k = positive.shape[1]
    w = {"a": rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "e": np.zeros(k), "d": np.zeros(())}
    first, second = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    x = np.r_[positive, plain]
    n = len(positive)
    share = np.full(len(plain), 1 / len(plain)) if weight is None else weight / weight.sum()
    for step in range(1, steps + 1):
        hidden, g = forward(x, w)
        s = sigmoid(g)
        slope = s * (1 - s)  # loss as positive: 1 - s; as negative: s
        rest = share @ s[n:] - prior * s[:n].mean()
        grad = np.zeros(len(x))
        if rest >= 0:
            grad[:n] = -prior * slope[:n] * 2 / n
            grad[n:] = slope[n:] * share
        else:  # the negative part fell below zero: step back on it
            grad[:n] = prior * slope[:n] / n
            grad[n:] = -slope[n:] * share
        back = np.outer(grad, w["c"]) * (1 - hidden**2)
        d = {"a": x.T @ back, "b": back.sum(0), "c": hidden.T @ grad, "e": x.T @ grad, "d": grad.sum()}
        for name in w:
            d[name] = d[name] + 1e-4 * w[name]
            first[name] = 0.9 * first[name] + 0.1 * d[name]
            second[name] = 0.999 * second[name] + 0.001 * d[name] ** 2
            w[name] = w[name] - 0.02 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return w


def prior_of(positive: np.ndarray, plain: np.ndarray, weight: np.ndarray) -> float:
    """Share of positives among the plain rows, from scores of both: the least ratio of rows above a threshold.

    A threshold's ratio counts with a margin for the chance in it, so that few rows don't decide.
    """
    at = np.unique(positive)
    kept = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    order = np.argsort(plain, kind="stable")
    tail = np.r_[np.cumsum(weight[order][::-1])[::-1], 0.0] / weight.sum()
    above = tail[np.searchsorted(plain[order], at)]
    margin = np.sqrt(np.log(2 / DOUBT) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(weight.sum()))
    sure = kept >= max(LEAST_KEPT, 1 / len(positive))
    best = int(np.argmin(np.where(sure, (above + margin) / np.maximum(kept, 1e-12), np.inf)))
    return float(np.clip(above[best] / kept[best], 0.01, 0.99))


def fit_posterior(positive: np.ndarray, plain: np.ndarray, weight: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that make raw scores log odds: they minimise the unbiased logistic risk, which is convex."""
    share = weight / weight.sum()
    middle, wide = float(share @ plain), float(np.sqrt(share @ (plain - share @ plain) ** 2)) + 1e-9
    z = np.stack([(plain - middle) / wide, np.ones(len(plain))], axis=1)
    pull = prior * np.array([((positive - middle) / wide).mean(), 1.0])
    ridge = np.diag([1e-3, 1e-6])
    loss = lambda t: float(share @ np.logaddexp(0, z @ t) - pull @ t + 0.5 * t @ ridge @ t)
    t, damp = np.zeros(2), 1e-3
    for _ in range(200):
        p = sigmoid(z @ t)
        curve = (z * (share * p * (1 - p))[:, None]).T @ z + ridge
        move = np.linalg.solve(curve + damp * np.eye(2), z.T @ (share * p) - pull + ridge @ t)
        if loss(t - move) <= loss(t):
            t, damp = t - move, damp / 3
            if np.abs(move).max() < 1e-8:
                break
        else:
            damp *= 10
    return float(t[0] / wide), float(t[1] - t[0] * middle / wide)


def fit_scale(g: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift of g for labels y: smoothed targets, damped Newton steps on a standard scale."""
    middle, wide = float(g.mean()), float(g.std()) + 1e-9
    x = np.stack([(g - middle) / wide, np.ones(len(g))], axis=1)
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    loss = lambda t: float(np.logaddexp(0, x @ t).sum() - target @ (x @ t))
    t, damp = np.zeros(2), 1e-3
    for _ in range(200):
        p = sigmoid(x @ t)
        curve = (x * (p * (1 - p))[:, None]).T @ x
        move = np.linalg.solve(curve + damp * (1 + np.diag(np.diag(curve))) + 1e-9 * np.eye(2), x.T @ (p - target))
        if loss(t - move) <= loss(t):
            t, damp = t - move, damp / 3
            if np.abs(move).max() < 1e-7:
                break
        else:
            damp *= 10
    return float(t[0] / wide), float(t[1] - t[0] * middle / wide)


class Model:
    """A fitted classifier: scores texts given as bytes and offsets."""

    def __init__(self, mean=None, spread=None, weights=None, scale=(1.0, 0.0)):
        self.mean, self.spread, self.weights, self.scale, self.prior = mean, spread, weights, scale, None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return forward(np.clip((x - self.mean) / self.spread, -6, 6), self.weights)[1]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.score_statistics(features(data, offsets).astype(np.float32).astype(float))

    def score_statistics(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return sigmoid(self.scale[0] * self.raw(x) + self.scale[1])


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch in runs of at most some ``most`` bytes of text: from, to, bytes, offsets."""
    data, offsets = P.text_buffer(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most)) - 1)
        b = min(b, batch.num_rows)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


WIDTH = N_CLASSES + 9
COUNTED = "key long, x array<float>"


def statistics(docs: DataFrame) -> DataFrame:
    """(key, x) of every document: its statistics, written to the checkpoint folder; one pass over the texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), as_lists(features(data, offsets).astype(np.float32))], ["key", "x"])

    return cut_lineage(docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(each, COUNTED))


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def as_rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(float)


def sums_of(counted: DataFrame, name: Callable[[np.ndarray], np.ndarray], seen: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of ``seen`` of all rows by their ``name``, a small number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = as_rows(batch.column(0))
            cell, values = name(x), np.c_[np.ones(len(x)), seen(x)]
            for c in np.unique(cell).tolist():
                total[c] = total.get(c, 0.0) + values[cell == c].sum(0)
        if total:
            values = np.stack([*total.values()])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), flat], ["cell", "v"])

    parts = counted.select("x").mapInArrow(each, "cell long, v array<double>").select("cell", F.posexplode("v").alias("at", "v"))
    rows = parts.groupBy("cell", "at").agg(F.sum("v").alias("v")).toPandas().sort_values(["cell", "at"], kind="stable")
    if rows.empty:
        return np.zeros(0), np.zeros((0, WIDTH))
    values = rows["v"].to_numpy().reshape(rows["cell"].nunique(), -1)
    return values[:, 0], values[:, 1:]


def drawn(counted: DataFrame, name: Callable[[np.ndarray], np.ndarray], most: int = DRAWN) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` rows of each cell, by a hash, and how many rows of it each of them stands for."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.zeros((0, WIDTH)), np.zeros(CELLS, np.int64)
        cells, marks = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            x = as_rows(batch.column(0))
            c = name(x)
            np.add.at(count, c, 1)
            key = P.mix(np.ascontiguousarray(x.astype(np.float32)).view(np.uint32).astype(np.uint64) @ (np.arange(1, WIDTH + 1, dtype=np.uint64) * P.U64(P.BASE)), 9)
            held, cells, marks = np.r_[held, x], np.r_[cells, c], np.r_[marks, key]
            order = np.lexsort((marks, cells))
            nth = np.arange(len(order)) - np.searchsorted(cells[order], cells[order])
            keep = order[nth < most]
            held, cells, marks = held[keep], cells[keep], marks[keep]
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(marks.view(np.int64)), as_lists(held.astype(np.float32)), pa.array(np.where(np.r_[True, cells[1:] != cells[:-1]], count[cells], 0))], ["cell", "mark", "x", "n"])

    parts = cut_lineage(counted.select("x").mapInArrow(each, "cell long, mark long, x array<float>, n long"))
    sizes = parts.groupBy("cell").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("mark"))
    rows = parts.select("cell", "mark", "x", nth.alias("nth")).where(F.col("nth") <= most).join(sizes, "cell").toPandas().sort_values(["cell", "nth"], kind="stable")
    share = rows["n"] / rows.groupby("cell")["nth"].transform("max")
    return np.stack(rows["x"].to_list()).astype(float), share.to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, modulus: int = MODULUS, held: int = HELD, counted: DataFrame | None = None) -> Model:
    """A model from at most some ``bound`` labelled rows, none held out, and all documents as unlabelled ones."""
    counted = statistics(docs) if counted is None else counted
    rows = training_rows(counted, labels.where("quality = 1"), "quality", modulus, held, bound, text="x")
    positive = rows.select("key", "x").toPandas().sort_values("key", kind="stable")
    n, sums = sums_of(counted, lambda x: np.zeros(len(x), np.int64), lambda x: np.c_[x, x * x])
    if not len(positive) or not n.sum():
        return Model()
    mean, square = np.split(sums[0] / n[0], 2)
    model = Model(mean, np.sqrt(np.maximum(0, square - mean**2)) + 1e-3)
    norm = lambda v: np.clip((v - model.mean) / model.spread, -6, 6)
    planes = np.random.default_rng(11).normal(size=(WIDTH + 1, PLANES))
    cell = lambda x: (np.c_[norm(x), np.ones(len(x))] @ planes >= 0) @ (1 << np.arange(PLANES))
    plain, weight = drawn(counted, cell)
    plain, good = norm(plain), norm(np.stack(positive["x"].to_list()).astype(float))

    def scores(weights: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores of the positives; and those of all documents, as the means and sizes of bins."""
        raw = lambda x: forward(norm(x), weights)[1]
        own = forward(good, weights)[1]
        cuts = np.unique(np.quantile(np.r_[own, forward(plain, weights)[1]], np.linspace(0, 1, BINS)))
        size, total = sums_of(counted, lambda x: np.searchsorted(cuts, raw(x)), lambda x: raw(x)[:, None])
        return own, total[:, 0] / size, size

    # a first network, at even odds, ranks the rows for the prior; the second is fitted with it
    prior = prior_of(*scores(fit_risk(good, plain, 0.5, weight)))
    model.prior, model.weights = prior, fit_risk(good, plain, prior, weight)
    model.scale = fit_posterior(*scores(model.weights), prior)
    return model


def scored(keys: DataFrame, threshold: float, modulus: int, held: int) -> DataFrame:
    return keys.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([model.score(data, offsets) for _, _, data, offsets in pieces(batch, 1)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, score double"), threshold, modulus, held)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    """``score_documents`` by a model fitted on the same documents, whose statistics are counted once."""
    counted = statistics(docs)
    model = fit(docs, labels, modulus=modulus, held=held, counted=counted)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score_statistics(as_rows(batch.column(1))))], ["doc_id", "score"])

    return scored(counted.mapInArrow(each, "doc_id long, score double"), threshold, modulus, held)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([model.score(data, offsets) for _, _, data, offsets in pieces(batch, at)] or [np.empty(0)])
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(each, docs.schema)
