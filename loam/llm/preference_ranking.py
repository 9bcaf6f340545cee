"""Quality scores by Bradley-Terry ranking of preference pairs.

Every text gets a few scale-free statistics. Each labelled document that is not held out stands in preference pairs
with all documents of the other label (label 1 over label 0); logistic loss on feature differences gives the
strengths, and a quantile of all training scores (at the share of label 0) becomes the threshold, at which the
reported score is 0.5. Nothing is sampled: no row, no pair.

The pairs are never listed. A pair's loss depends on the difference of two scores alone and is smooth, so it is
interpolated between nodes on the line of scores (cells of width CELL with DEGREE Chebyshev nodes; the error is below
1e-12 of a pair's loss). Sums over all pairs then follow from sums of the statistics at the nodes: each Newton step is
one pass over the training rows, and as many rows reach the driver as there are nodes, whatever the table. The
threshold is an exact order statistic, found by narrowing histograms. Weights are rounded to DIGITS decimals, so that
the order in which Spark adds doesn't show.

Defined results: a null or empty text has all statistics 0 and is scored like any other; labels that are null, or
that disagree for one id, are left out; without both labels every score is 0.5; repeated rows and ties get equal
scores; a null id is scored and counts as not held out; an empty table gives an empty table. Only the id and the
text are read from the documents, so that clashing extra columns don't matter. Whole texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import Column, DataFrame, functions as F

from loam.llm.common import bound_batches, drop_staged, lean, map_rows, stage
from loam.llm.quality_cascade import Features

#: Width of a cell of scores, Chebyshev nodes of a cell, decimals of a weight, bins of a histogram of scores.
CELL, DEGREE, DIGITS, BINS = 2.0, 16, 9, 4096

NAMES = ("symbols", "bangs", "upper", "repeats", "dup_lines", "word_length", "distinct", "log_words", "stops")


def statistics(text: str | None) -> list[float]:
    x = Features(text)
    n = max(x.n_words, 1)
    return [
        min(x.n_symbols / n, 3.0),
        min(x.text.count("!") / n, 3.0),
        x.n_upper / max(x.n_letters, 1),
        x.n_repeat_words / n,
        x.n_dup_lines / max(x.n_lines, 1),
        min(x.word_chars / n, 30.0) / 10,
        len(set(x.words)) / n,
        float(np.log1p(x.n_words)) / 5,
        min((x.text.count(".") + x.text.count("?")) / n, 1.0),
    ]


def moments(rows: DataFrame, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By label: places on the line of scores, and at each the sums of 1, x and the products x[i] * x[j], i <= j."""
    bound_batches(rows.sparkSession)
    i, j = np.triu_indices(len(weights))
    names = [f"m{k}" for k in range(1 + len(weights) + len(i))]

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            label = b.column(len(weights)).to_numpy().astype(np.int64)
            x = np.column_stack([b.column(k).to_numpy() for k in range(len(weights))])
            at = x @ weights / CELL
            cell = np.floor(at).astype(np.int64)
            basis = chebvander(2 * (at - cell) - 1, DEGREE - 1)
            values = np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]])
            key = 2 * cell + label
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(part):
                    k = label[part[0]], cell[part[0]]
                    sums[k] = sums.get(k, 0) + basis[part].T @ values[part]
        for (label, cell), found in sums.items():
            fixed = [pa.array(np.full(DEGREE, v)) for v in (label, cell)] + [pa.array(np.arange(DEGREE))]
            yield pa.RecordBatch.from_arrays(fixed + [pa.array(c) for c in np.ascontiguousarray(found.T)], names=["label", "cell", "k", *names])

    parts = rows.select(*NAMES, "label").mapInArrow(lean(run, __name__), "label long, cell long, k long, " + ", ".join(f"{n} double" for n in names))
    found = parts.groupBy("label", "cell", "k").agg(*(F.sum(n).alias(n) for n in names)).toPandas().sort_values(["label", "cell", "k"])
    # sums of Chebyshev polynomials become sums of the nodes' Lagrange polynomials
    nodes = np.cos((2 * np.arange(DEGREE) + 1) * np.pi / (2 * DEGREE))
    lagrange = chebvander(nodes, DEGREE - 1) * np.where(np.arange(DEGREE), 2, 1) / DEGREE
    out = {}
    for label in (0, 1):
        some = found[found.label == label]
        cells = some.cell.to_numpy()[::DEGREE]
        places = ((cells[:, None] + (nodes + 1) / 2) * CELL).ravel()
        out[label] = places, (lagrange @ some[names].to_numpy().reshape(len(cells), DEGREE, len(names))).reshape(len(places), len(names))
    return out


def pairwise(rows: DataFrame, weights: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, its descent, its curvature): mean logistic loss over all pairs of label 1 and label 0, and the ridge."""
    d = len(weights)
    found = moments(rows, weights)
    (bad, b), (good, g) = ((places, m / m[:, 0].sum()) for places, m in (found[0], found[1]))
    lead = bad[None, :] - good[:, None]
    p = np.exp(-np.logaddexp(0, -lead))  # chance that the pair is ordered wrongly
    q = p * (1 - p)
    loss = g[:, 0] @ np.logaddexp(0, lead) @ b[:, 0] + ridge / 2 * weights @ weights
    descent = p @ b[:, 0] @ g[:, 1 : d + 1] - g[:, 0] @ p @ b[:, 1 : d + 1] - ridge * weights
    square = np.zeros((d, d))
    square[np.triu_indices(d)] = q @ b[:, 0] @ g[:, d + 1 :] + g[:, 0] @ q @ b[:, d + 1 :]
    square += np.triu(square, 1).T
    across = g[:, 1 : d + 1].T @ q @ b[:, 1 : d + 1]
    return loss, descent, square - across - across.T + ridge * np.eye(d)


def fit(rows: DataFrame, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Weights by Newton steps on the logistic loss of all pairs; rows hold NAMES and label, both labels at least once."""
    w = np.zeros(len(NAMES))
    loss, descent, curve = pairwise(rows, w, ridge)
    for _ in range(steps):
        move = np.linalg.solve(curve, descent)
        move *= min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-7:  # the error left is about the square
            return np.round(w + move, DIGITS)
        after = pairwise(rows, w + move, ridge)
        while after[0] > loss + 1e-12:
            move /= 2
            after = pairwise(rows, w + move, ridge)
        w, (loss, descent, curve) = w + move, after
    raise RuntimeError(f"the strengths have not settled after {steps} steps")


def nth(values: DataFrame, column: str, rank: int, low: float, high: float) -> float:
    """The value of a rank (from 0) among all values, which lie from low to high; both occur."""
    while low < high:
        inside = values.where(F.col(column).between(low, high))
        at = F.least(F.floor((F.col(column) - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("bin").collect():
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def quantile(values: DataFrame, column: str, share: float, n: int, low: float, high: float) -> float:
    """The quantile of all n values, exact, between two of them by their distance as numpy's."""
    place = share * (n - 1)
    rank = int(place)
    value = nth(values, column, rank, low, high)
    if place == rank:
        return value
    most = F.col(column) <= value
    r = values.agg(F.count(F.when(most, 1)).alias("n"), F.min(F.when(~most, F.col(column))).alias("next")).first()
    after = value if r.n > rank + 1 else r.next
    return value + (after - value) * (place - rank)


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def each(rows):
        for k, t in rows:
            yield k, *statistics(t)

    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], each, f"doc_id {dict(docs.dtypes)[key]}, " + ", ".join(f"{n} double" for n in NAMES))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_rows(features: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Every labelled row that is not held out: NAMES and label."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where(F.col("label") == F.col("most")).where(~held_out(F.col("doc_id"))).drop("most")
    return features.join(known, "doc_id").select(*NAMES, "label")


def line(weights: np.ndarray) -> Column:
    return sum((F.col(n) * float(c) for n, c in zip(NAMES, weights)), F.lit(0.0))


def model(rows: DataFrame) -> tuple[np.ndarray, float, float]:
    """(weights, threshold, scale) from all training rows."""
    count = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return np.zeros(len(NAMES)), 0.0, 1.0
    w = fit(rows)
    n = sum(count.values())
    lines = rows.select(line(w).alias("line"))
    r = lines.agg(F.min("line").alias("low"), F.max("line").alias("high"), F.stddev_pop("line").alias("spread")).first()
    return w, quantile(lines, "line", count[0.0] / n, n, r.low, r.high), max(round(r.spread, DIGITS), 1e-9)


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    features = stage(featured(docs, key, text), "statistics")
    rows = stage(training_rows(features, labels, label), "training")
    w, threshold, scale = model(rows)
    drop_staged(rows)
    score = 1 / (1 + F.exp(-4 * (line(w) - F.lit(threshold)) / F.lit(scale)))
    return features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
