"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the logarithms of 1 + count and of 1 + count per DENSITY words, of the words and word beginnings most associated with the toxic label (a
vocabulary of at most VOCABULARY, chosen by the log-likelihood ratio of document frequencies). Severity
grades are 0 for documents labelled clean; toxic ones are graded 1 to GRADES by the quantiles of their
number of strongly associated features. One weight vector is shared by all ordered thresholds:
P(grade > k) = sigmoid(w.x - theta_k), theta_1 < theta_2 < ... The expected severity is the sum of
these over k, and a document is called toxic where P(grade > 0) is at least a half.

The model is fitted on a bounded sample: about TRAIN_ROWS labelled rows, drawn by a hash of doc_id.
Scoring covers the whole text of every row.

Defined results: null and empty texts have no features and the score of such; labels that are null or
without document are not used, several of one document count as the highest; without labels of both
kinds every severity is 0; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

TRAIN_ROWS = 12_000
VOCABULARY = 1024
LEAST_DOCUMENTS = 5
#: Signed root of the log-likelihood ratio from which a word is a feature, and from which it counts for grades.
LEAST_Z, STRONG_Z = 4.0, 8.0
#: Lengths of word beginnings, told from whole words by a leading mark.
PREFIXES = range(3, 8)
#: Words per which counts are taken as a density.
DENSITY = 100
#: Words whose features a task remembers.
REMEMBERED = 200_000
GRADES = 3
PENALTY = 1e-3
STEPS, RATE = 300, 0.1
WORD = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def word_counts(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def feature_counts(text: str | None, places: dict[str, int], known: dict[str, tuple[int, ...]]) -> tuple[Counter, int]:
    """Counts of the vocabulary's features in a text, and its number of words; known remembers the features of words."""
    found, total = Counter(), 0
    for word, n in word_counts(text).items():
        total += n
        own = known.get(word)
        if own is None:
            if len(known) >= REMEMBERED:
                known.clear()
            own = known[word] = tuple(places[p] for p in parts(word) if p in places)
        for p in own:
            found[p] += n
    return found, total


def values_of(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """Feature values of counts: of the counts themselves, and of their density."""
    return np.log1p(np.stack([counts, DENSITY * counts / np.maximum(1, total)]))


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter()
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            seen.update((p, toxic) for p in {p for w in word_counts(text.as_py()) for p in parts(w)})
        pairs = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "toxic", "n"])


def features(words: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places and counts of the vocabulary's words in each labelled text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [feature_counts(t.as_py(), words, known) for t in batch.column("text")]
            rows = [sorted(x.items()) for x, _ in found]
            lists = [pa.array([[pair[k] for pair in x] for x in rows], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists, pa.array([n for _, n in found], pa.int32())], names=["doc_id", "toxic", "places", "counts", "words"])

    return count


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def likelihood(p: np.ndarray, rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """(mean penalised log likelihood of the cumulative-link model, its gradient) at p: weights, first threshold, logarithms of the gaps between thresholds."""
    n, levels = len(grades), len(p) - width
    w, theta = p[:width], np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))
    score = np.bincount(rows, weights=values * w[places], minlength=n)
    cum = np.column_stack([np.ones(n), sigmoid(score[:, None] - theta), np.zeros(n)])  # P(grade >= k), k = 0 .. levels + 1
    at = np.arange(n)
    prob = np.maximum(cum[at, grades] - cum[at, grades + 1], 1e-9)
    slope = cum * (1 - cum)
    d_score = (slope[at, grades] - slope[at, grades + 1]) / prob
    d_theta = np.array([np.sum((grades == k) * slope[:, k + 1] / prob) - np.sum((grades == k + 1) * slope[:, k + 1] / prob) for k in range(levels)])
    tails = np.cumsum(d_theta[::-1])[::-1]
    gradient = np.concatenate([np.bincount(places, weights=values * d_score[rows], minlength=width) / n - PENALTY * w, tails[:1] / n, tails[1:] * np.exp(p[width + 1 :]) / n])
    return float(np.mean(np.log(prob)) - PENALTY * np.sum(w * w) / 2), gradient


def fit_ordinal(rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the penalised likelihood of the cumulative-link model; entries in coordinate form."""
    share = np.clip([np.mean(grades > k) for k in range(levels)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(levels) * 1e-3)
    p = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, STEPS + 1):
        g = likelihood(p, rows, places, values, grades, width)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:width], np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """words (word to place), weights and thresholds."""
    nothing = {"words": {}, "weights": np.zeros(0), "thresholds": np.zeros(0)}
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = known.count()
    if not total:
        return nothing
    drawn = materialize(known.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < min(1.0, TRAIN_ROWS / total) * (1 << 30)), "toxicity-labels")
    # Rows equal in id and text count once, so that no repeated row makes the sample grow.
    sample = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(small(drawn), "doc_id").filter("text IS NOT NULL")
    rows = materialize(sample.groupBy("doc_id", "toxic", F.xxhash64("text").alias("same")).agg(F.first("text").alias("text")).drop("same"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return nothing
    bad, good = sizes[1], sizes[0]
    seen = rows.select("text", "toxic").mapInArrow(document_frequencies, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    a, b, n = F.col("a"), F.col("b"), bad + good
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    ratio = part(a, (a + b) * bad / n) + part(b, (a + b) * good / n) + part(bad - a, (n - a - b) * bad / n) + part(good - b, (n - a - b) * good / n)
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * ratio)) * F.signum(a / bad - b / good)
    chosen = seen.filter(a + b >= LEAST_DOCUMENTS).withColumn("z", root).filter(F.abs("z") >= LEAST_Z)
    top = chosen.orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).collect()
    if not top:
        return nothing
    words = {r["word"]: i for i, r in enumerate(top)}
    strong = np.array([r["z"] >= STRONG_Z for r in top])
    table = rows.mapInArrow(features(words), "doc_id long, toxic int, places array<int>, counts array<int>, words int").toArrow().sort_by("doc_id")
    per_row = [len(x) for x in table["places"]]
    at = np.repeat(np.arange(len(per_row)), per_row)
    places = np.concatenate([np.zeros(0, int), *[np.asarray(x.values) for x in table["places"]]]).astype(int)
    counts = np.concatenate([np.zeros(0), *[np.asarray(x.values) for x in table["counts"]]]).astype(float)
    toxic = np.asarray(table["toxic"].to_pylist())
    strength = np.bincount(at, weights=counts * strong[places], minlength=len(toxic))
    edges = np.unique(np.quantile(strength[toxic == 1], np.arange(1, GRADES) / GRADES))
    grades = np.where(toxic == 1, 1 + np.searchsorted(edges, strength, side="left"), 0)
    grades = np.unique(grades, return_inverse=True)[1]
    values = values_of(counts, np.asarray(table["words"].to_pylist())[at])
    weights, thresholds = fit_ordinal(np.tile(at, 2), np.concatenate([places, places + len(words)]), values.ravel(), grades, 2 * len(words), int(grades.max()))
    return {"words": words, "weights": weights, "thresholds": thresholds}


def scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        weights, known = m["weights"], {}
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text")):
                found, total = feature_counts(text.as_py(), m["words"], known)
                if found:
                    places, counts = np.array(sorted(found.items())).T
                    sums[i] = np.sum(weights[[places, places + len(m["words"])]] * values_of(counts, total))
            over = sigmoid(sums[:, None] - m["thresholds"][None, :])
            first = over[:, 0] if over.shape[1] else np.zeros(batch.num_rows)
            columns = [batch.column("doc_id"), pa.array(over.sum(axis=1)), pa.array((over >= 0.5).sum(axis=1), pa.int32()), pa.array(first), pa.array(first >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return score


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade), grade, p_toxic and toxic of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(scorer(model), "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
