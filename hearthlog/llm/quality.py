"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is web text whatever its labels.
A linear scorer over binned text statistics is trained to minimise the non-negative risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the sigmoid loss: where the second part of
a mini-batch falls below zero its gradient is ascended instead. The class prior is estimated from the
unlabelled set itself: a first scorer (positives against unlabelled) ranks held-back rows, and the
least ratio of upper-tail shares, unlabelled over positive, bounds the share of positives from above.

Fitting uses samples of at most ``max_positives`` and ``max_unlabelled`` rows, taken by a hash of the
id from all rows; scoring covers every text whole. No id, label, language or source goes into a score.

Defined cases: null and empty texts are scored like texts without words; documents with a null doc_id
are scored and never trained on; labels that are null, or of ids without documents, are ignored; several labels of an
id count as its least; with under ``least_rows`` positives or unlabelled documents in the training fold (so with empty
tables) nothing is learned, a warning is given and every score is 0.5.
Only the id and text columns of documents are read, so extra columns cannot clash.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

_SYMBOLS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{|}~/", np.uint8)
FEATURES = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "symbol", "pipe", "punctuation", "non_ascii", "control", "space",
    "entropy", "word_length", "unique_words", "repeated_neighbours", "unique_lines", "line_words", "capital_words", "symbol_words", "compression",
)


def statistics(text: bytes) -> tuple[float, ...]:
    """The FEATURES of one UTF-8 text."""
    n = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    w, many = max(len(words), 1), max(len(lines), 1)
    share = counts[counts > 0] / n
    upper, symbols = counts[65:91].sum(), counts[_SYMBOLS].sum()
    return (
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), upper / n, counts[48:58].sum() / n, symbols / n, counts[124] / n,
        counts[[33, 34, 39, 40, 41, 44, 46, 58, 59, 63]].sum() / n, counts[128:].sum() / n, (counts[:32].sum() - counts[9] - counts[10] - counts[13]) / n, counts[32] / n,
        -float((share * np.log2(share)).sum()) if len(share) else 0.0, len(text) / w, len(set(words)) / w ** 0.8, sum(map(bytes.__eq__, words, words[1:])) / w, len(set(lines)) / many, len(words) / many,
        sum(map(bytes.istitle, words)) / w, sum(not x[-1:].isalnum() and x[-1:] not in b".,;:!?" for x in words if x[-1] < 128) / w,
        len(zlib.compress(text, 1)) / n,
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        rows = np.array([statistics(t or b"") for t in texts], np.float64).reshape(-1, len(FEATURES))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.record_batch([batch.column(0), lists], names=["id", "x"])


@dataclass
class Scorer:
    """Bin edges of each feature, a weight for each bin, a bias and the estimated class prior."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        out, at = np.empty(x.shape, np.int64), 0
        for j, edges in enumerate(self.edges):
            out[:, j] = at + np.searchsorted(edges, x[:, j], side="right")
            at += len(edges) + 1
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[self.bins(x)].sum(axis=1) + self.bias, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    q = np.linspace(0, 1, bins + 1)[1:-1]
    tails = np.array([0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998])
    return [np.unique(np.quantile(c, np.concatenate([q, tails]))) for c in x.T]


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, edges: list[np.ndarray], steps: int = 600, batch: int = 1 << 17, rate: float = 0.05, decay: float = 1e-5, seed: int = 0) -> Scorer:
    """Minimise the non-negative PU risk by Adam over mini-batches."""
    size = sum(len(e) + 1 for e in edges)
    scorer = Scorer(edges, np.zeros(size), 0.0, prior)
    bp, bu = scorer.bins(positive), scorer.bins(unlabelled)
    theta, m, v, step = np.append(scorer.weights, scorer.bias), np.zeros(size + 1), np.zeros(size + 1), 0
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradient(bins: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        g = np.bincount(bins.ravel(), np.repeat(slopes, bins.shape[1]), size + 1)
        g[-1] = slopes.sum()
        return g / len(bins)

    while step < steps:
        order = rng.permutation(len(bu))
        for at in range(0, len(order), batch):
            u, p = bu[order[at : at + batch]], bp if len(bp) <= batch else bp[rng.integers(0, len(bp), batch)]
            zu, zp = theta[u].sum(axis=1) + theta[-1], theta[p].sum(axis=1) + theta[-1]
            su, sp = sigmoid(zu), sigmoid(zp)
            rest = su.mean() - prior * sp.mean()
            slope_p = gradient(p, sp * (1 - sp))
            g_rest = gradient(u, su * (1 - su)) - prior * slope_p
            g = g_rest - prior * slope_p if rest >= 0 else -g_rest
            g[:-1] += decay * theta[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * 0.5 ** (4 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Scorer(edges, theta[:-1], float(theta[-1]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray], least_share: float = 0.2) -> float:
    """Share of positives among the unlabelled: least ratio of upper tails of held-back scores, over tails
    that hold ``least_share`` of the positives or more, each lowered by one standard error: a prior that is
    too high makes the negative part of the risk collapse, one that is too low costs little."""
    half_p, half_u = np.arange(len(positive)) % 2 == 0, np.arange(len(unlabelled)) % 2 == 0
    first = fit_nnpu(positive[half_p], unlabelled[half_u], 0.5, edges, steps=100)
    sp, su = np.sort(first.scores(positive[~half_p])), np.sort(first.scores(unlabelled[~half_u]))
    cuts = np.unique(np.quantile(sp, np.linspace(0, 1 - least_share, 200)))
    tail_p = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
    tail_u = 1 - np.searchsorted(su, cuts, side="left") / len(su)
    noise = lambda q, n: np.sqrt(q * (1 - q) / n)
    low = (tail_u - noise(tail_u, len(su))) / np.minimum(1, tail_p + noise(tail_p, len(sp)))
    return float(np.clip(low.min(), 0.02, 0.98))


def held_out(id_: Column) -> Column:
    """Of the fold that no label is learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = 20_000, max_unlabelled: int = 40_000, bins: int = 16, least_rows: int = 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Scorer:
    """Fit on the training fold: labelled positives against unlabelled documents of that fold."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    sample = lambda df, n: df.distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    trusted = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("y").isNotNull()).groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id")
    chosen = sample(trusted, max_positives).withColumn("p", F.lit(1)).unionByName(sample(ids, max_unlabelled).withColumn("p", F.lit(0)))
    chosen = chosen.groupBy("id").agg(F.max("p").alias("p"), F.min("p").alias("u"))  # at most max_positives + max_unlabelled rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen.select("id")), "id", "left_semi")
    each = texts.mapInArrow(_features, "id long, x array<double>").groupBy("id").agg(F.min("x").alias("x"))  # rows of one id: one of them, whatever their order
    rows = each.join(F.broadcast(chosen), "id").orderBy("id").collect()
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES))
    p, u = np.array([r.p == 1 for r in rows], bool), np.array([r.u == 0 for r in rows], bool)
    if min(p.sum(), u.sum()) < least_rows:
        warnings.warn(f"{p.sum()} positives and {u.sum()} unlabelled documents in the training fold: nothing is learned", stacklevel=2)
        return Scorer([np.zeros(0)] * len(FEATURES), np.zeros(len(FEATURES)), 0.0, 0.5)
    edges = _edges(x[u], bins)
    return fit_nnpu(x[p], x[u], estimate_prior(x[p], x[u], edges), edges)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _features(batches):
            x = batch.column("x").values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("id"), pa.array(scorer.scores(x))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def score_of(text: Column, scorer: Scorer) -> Column:
    """The score of a text, on its own row."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = [statistics(t.encode() if t else b"") for t in batch]
            yield pd.Series(scorer.scores(np.array(rows, np.float64).reshape(-1, len(FEATURES))))

    return run(text.cast("string"))
