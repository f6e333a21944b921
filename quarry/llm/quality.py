"""Quality classifier by positive-unlabelled learning (operator 4).

A text gives some statistics of its characters, words and lines; each is cut into
bins, and a score adds a weight per bin. The weights minimise the non-negative
unbiased risk of positive-unlabelled learning: trusted positives are labelled rows of
quality 1, the unlabelled texts are the documents themselves, and rows labelled 0 are
never used. The bins' edges are quantiles over all documents. The class prior is the
least ratio, over thresholds of a first classifier that tells positives from unlabelled
texts, of the share of all documents above to the positives' share above; documents and
positives that the first classifier has learned from (half of them, by a hash of the id)
do not count.

Every document counts in the risk that is minimised. The many small gradient steps use a
bounded sample of unlabelled ids (max_unlabelled, the first by a hash; of an id's rows the
one of the least statistics) in place of all documents, and ROUNDS times a pass over all of
them gives the gradient and the mean there: their differences from the sample's are added to
each step that follows, so near there the steps are those that all documents would give.
(Jordan, Lee and Yang: communication-efficient surrogate likelihoods.) Labelled positives are
a bounded sample (max_positive ids).

Edge cases: null text counts as empty and is scored like any text. Without positives
or documents every score is 0.5. Repeated rows get equal scores; an id that is labelled
more than once counts as positive if any of its labels is. Null labels are no labels, and
rows of a null id are not learned from. Other columns are ignored or, by score(), kept;
one of the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

STATISTICS = 14
BINS = 12
_BYTES = np.arange(256)
_GROUPS = np.array(
    [
        (_BYTES >= 97) & (_BYTES <= 122),
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 48) & (_BYTES <= 57),
        np.isin(_BYTES, list(b".,;:?'\"()-")),
        np.isin(_BYTES, list(b"!")),
        np.isin(_BYTES, list(b"#$%&*@^~_=+`")),
        np.isin(_BYTES, list(b"|<>[]{}\\/")),
        _BYTES >= 128,
    ],
    np.float64,
)


def statistics(text: str | None) -> list[float]:
    """Shares of kinds of characters, repeats of words and lines, and lengths."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    return [
        *(_GROUPS @ raw / max(1, raw.sum())).tolist(),
        sum(map(eq, words, words[1:])) / (n + 20),  # in a short text words may repeat by chance
        len(set(words)) / n ** 0.9,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words)),
        len(text) / n,
        n / max(1, len(lines)) / 100,
    ]


class Model:
    """Bin edges and a weight per bin."""

    def __init__(self, edges: np.ndarray | None = None, weights: np.ndarray | None = None, bias: float = 0.0, prior: float = 0.5):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Columns of the bins that rows fall into (n x STATISTICS)."""
        at = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        return at + np.arange(STATISTICS) * BINS

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.weights[self.bins(x)].sum(1) + self.bias, -30, 30)))


class Unlabelled:
    """Bins of a sample of the unlabelled texts, and how far all of them are from it: the
    difference of the gradients by the weights and of the mean scores, at some weights."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.apart, self.drift = rows, np.zeros(STATISTICS * BINS + 1), 0.0

    def correct(self, w: np.ndarray, slope, everywhere) -> None:
        """everywhere(w): the sum of the slopes by weight, of the scores, and the number of texts."""
        f = _sigmoid(w[self.rows].sum(1) + w[-1])
        here = _by_weight(self.rows, slope(f) / len(f))
        total, score, n = everywhere(w)
        if n:
            # Sums over many tasks differ in their last digits by the tasks' order.
            self.apart, self.drift = np.round(total / n - here, 12), round(score / n - f.mean(), 12)


def _by_weight(rows: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sums of the rows' parts for each of their bins, and for the bias."""
    return np.append(np.bincount(rows.ravel(), np.repeat(part, rows.shape[1]), minlength=STATISTICS * BINS), part.sum())


def _minimise(p: np.ndarray, u: Unlabelled, gradient, start: np.ndarray | None = None, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> np.ndarray:
    """Adam on the weights, the last of which is the bias; gradient(f_p, f_u, drift) gives the
    derivatives by the sums, and the sign with which the unlabelled texts count."""
    w = np.zeros(STATISTICS * BINS + 1) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g_p, g_u, sign = gradient(w[p].sum(1) + w[-1], w[u.rows].sum(1) + w[-1], u.drift)
        g = decay * w + _by_weight(p, g_p) + _by_weight(u.rows, g_u) + sign * u.apart
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


#: How often all documents are gone through, and the steps after each.
ROUNDS, MORE_STEPS = 2, 150


def _solve(model: Model, positive: np.ndarray, unlabelled: np.ndarray, gradient, slope, everywhere=None) -> Model:
    """The weights that minimise a risk over positives and unlabelled texts (rows x STATISTICS)."""
    p, u = model.bins(positive), Unlabelled(model.bins(unlabelled))
    w = _minimise(p, u, gradient)
    for _ in range(ROUNDS if everywhere else 0):
        u.correct(w, slope, everywhere)
        w = _minimise(p, u, gradient, w, MORE_STEPS, 0.02)
    model.weights, model.bias = w[:-1], w[-1]
    return model


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


#: How a loss of the unlabelled texts changes with the score that a text's sum gives.
LOGISTIC, SIGMOID = (lambda score: score), (lambda score: score * (1 - score))


def tell_apart(edges: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, everywhere=None) -> Model:
    """The first classifier: positives against unlabelled texts (rows x STATISTICS)."""
    return _solve(Model(edges), positive, unlabelled, lambda fp, fu, _: ((_sigmoid(fp) - 1) / len(fp), LOGISTIC(_sigmoid(fu)) / len(fu), 1), LOGISTIC, everywhere)


def risk_gradient(fp: np.ndarray, fu: np.ndarray, prior: float, drift: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the non-negative risk with the sigmoid loss, by the sums of positive and of
    unlabelled rows. Where the unlabelled texts' part of the risk is negative, it is not to
    be lowered further: its gradient is turned round."""
    sp, su = _sigmoid(fp), _sigmoid(fu)
    dp, du = prior * SIGMOID(sp) / len(fp), SIGMOID(su) / len(fu)
    return (-2 * dp, du, 1) if su.mean() + drift >= prior * sp.mean() else (dp, -du, -1)


def learn(edges: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, everywhere=None) -> Model:
    """The classifier itself (rows x STATISTICS)."""
    return _solve(Model(edges, prior=prior), positive, unlabelled, lambda fp, fu, drift: risk_gradient(fp, fu, prior, drift), SIGMOID, everywhere)


def measure(text: Column) -> Column:
    """The statistics of each text, array<double>."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return run(text)


def _matrix(x: pa.Array) -> np.ndarray:
    return np.array(x.flatten(), float).reshape(-1, STATISTICS)


def score_of(x: Column, model: Model) -> Column:
    """The probability of good quality, by a text's statistics."""

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(rows)), pa.float64())

    return run(x)


def _above(x: Column, model: Model, thresholds: np.ndarray) -> Column:
    """How many of the (sorted) thresholds a text's score reaches."""

    @F.arrow_udf("int")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(thresholds, model.score(_matrix(rows)), side="right"), pa.int32())

    return run(x)


def over_all(measured: DataFrame, edges: np.ndarray, slope):
    """everywhere() for Unlabelled.correct: one pass over these documents, each task giving one
    sum for each weight."""

    def everywhere(w: np.ndarray) -> tuple[np.ndarray, float, int]:
        model = Model(edges, w[:-1], w[-1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(w) + 2)
            for batch in batches:
                if batch.num_rows:
                    rows = model.bins(_matrix(batch.column("x")))
                    f = _sigmoid(w[rows].sum(1) + w[-1])
                    sums += np.append(_by_weight(rows, slope(f)), [f.sum(), len(f)])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["i", "total"])

        sums = measured.select("x").mapInArrow(run, "i int, total double").groupBy("i").agg(F.sum("total").alias("total"))
        found = np.zeros(len(w) + 2)
        for r in sums.collect():
            found[r["i"]] = r["total"]
        return found[:-2], float(found[-2]), int(found[-1])

    return everywhere


#: Quantiles of the bins' edges, denser in the tails.
CUTS = [0.01, 0.03, 0.06, 0.1, 0.25, 0.5, 0.75, 0.9, 0.94, 0.97, 0.99]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every document, written to the shared folder."""
    return materialize(docs.select(F.col(id_col).alias("id"), measure(F.col(text_col)).alias("x")), "quality-statistics")


def fit(measured: DataFrame, positive_ids: DataFrame, max_positive: int = 10_000, max_unlabelled: int = 20_000) -> Model:
    """measured: what measured() gave of the documents. positive_ids: one column of the ids
    of trusted positives."""
    first = lambda ids, n: ids.orderBy(F.xxhash64("id"), "id").limit(n)
    known = lambda df: df.select(F.col(df.columns[0]).alias("id")).where("id is not null").distinct()
    ids = first(known(positive_ids), max_positive).withColumn("p", F.lit(True)).unionByName(first(known(measured), max_unlabelled).withColumn("p", F.lit(False)))
    seen = F.xxhash64("id", F.lit(1)) % 2 == 0  # what the first classifier learns from
    got = measured.join(F.broadcast(ids), "id").groupBy("id", "p").agg(F.min("x").alias("x")).select("p", seen.alias("seen"), "x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, STATISTICS)
    order = np.lexsort(x.T)  # one result whatever the order of rows
    x, p, seen_rows = x[order], got["p"].to_numpy(bool)[order], got["seen"].to_numpy(bool)[order]
    if not p.any() or p.all():
        return Model()
    edges = measured.agg(*[F.percentile_approx(F.get("x", F.lit(j)), CUTS, 10_000).alias(f"q{j}") for j in range(STATISTICS)]).first()
    edges = np.array([list(e) for e in edges], float)
    prior = 0.5
    if all((p == a)[seen_rows == b].any() for a in (True, False) for b in (True, False)):
        model = tell_apart(edges, x[p & seen_rows], x[~p & seen_rows], over_all(measured.where(F.col("id").isNotNull() & seen), edges, LOGISTIC))
        scores = np.sort(model.score(x[p & ~seen_rows]))
        at = scores[: max(1, len(scores) // 20)]  # thresholds that at most one positive in 20 is below
        above_p = 1 - np.searchsorted(scores, at) / len(scores)
        counts = measured.where(F.col("id").isNotNull() & ~seen).groupBy(_above(F.col("x"), model, at).alias("n")).count().collect()
        reached = np.zeros(len(at) + 1)
        for r in counts:
            reached[r["n"]] += r["count"]
        above_u = (reached.sum() - np.cumsum(reached)[:-1]) / reached.sum()
        prior = float(np.clip((above_u / above_p).min(), 0.05, 0.98))
    return learn(edges, x[p], x[~p], prior, over_all(measured.where("id is not null"), edges, SIGMOID))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """docs with the probability of good quality. A column of that name is replaced."""
    return docs.withColumn(out_col, score_of(measure(F.col(text_col)), model))


def positives(labels: DataFrame, train: Column) -> DataFrame:
    """Ids of rows labelled good, of those that may be learned from."""
    return labels.where((F.col("quality") == 1) & train).select("doc_id")
