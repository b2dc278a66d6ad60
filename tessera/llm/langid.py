"""Language identification with a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge regression.

A text's features are the character n-grams of 1 to 3 characters that occur in it (lower-cased; every
run of other characters than letters is one blank). The kernel of two texts is the number of shared
n-grams over the geometric mean of their numbers. Landmarks are labelled texts; kernel values against
them span the Nystroem space in which one ridge regression a language (one versus the rest) is solved.
As the kernel is linear in presence, landmark matrix times dual weights is formed once, and a batch of
texts is scored by one product of its sparse presence matrix with it.

The model is fitted on a bounded sample: about TRAIN_PER_LANG texts of each language, drawn by a hash
of doc_id, of which LANDMARKS_PER_LANG are landmarks. Every language is learned; with more than
FULL_LANGS of them each has fewer texts and landmarks. Everything else covers whole texts of all rows.

Defined results: a null text, or one without a letter, is "und" with score 0, as all are where nothing
can be learned; a null doc_id is not held out; ties go to the first language in order; repeated rows
get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digests, in_arrow, small, without

TRAIN_PER_LANG = 500
LANDMARKS_PER_LANG = 64
#: With more languages than these, each has a smaller part, so that the sample stays bounded.
FULL_LANGS = 64
#: Expected texts of a language are never fewer, so that no language is missed by the draw.
LEAST_TRAIN = 50
RIDGE = 1e-4
#: Scores below this are no language that was learned, if the text is long enough to score higher.
REJECT = 0.2
#: Scores rise with the length of a text: the limit is at most this part of the least top score of pieces as long of training texts.
MARGIN = 0.5
#: Words of the pieces, from the beginning and the end of each training text.
PIECES = (1, 2, 4, 8, 16)

#: Weights (n-grams times languages) that are gathered at a time in scoring.
GATHERED = 1 << 21

#: Codes of letters: a-z have their own, all others share the rest by a hash, so an n-gram may stand for several.
LETTERS = 128
SPACE = LETTERS + LETTERS**2 + LETTERS**3


def letter_codes() -> np.ndarray:
    """Of every code point: 0 if no letter, 1-26 for a-z, else one of the other codes."""
    points = np.arange(0x110000)
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    codes = np.where(letters, 27 + points * 2654435761 % 2**32 % (LETTERS - 27), 0).astype(np.int32)
    codes[97:123] = np.arange(1, 27)
    return codes


def ngrams(text: str | None, codes: np.ndarray) -> np.ndarray:
    """Numbers of the distinct n-grams; empty if there is no letter."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    c = codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not c.any():
        return np.zeros(0, dtype=np.int32)
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    c = np.concatenate([[0], c[keep], [0]]).astype(np.int32)
    two = c[:-1] * LETTERS + c[1:]
    three = two[:-1] * LETTERS + c[2:]
    return np.concatenate([np.unique(c), np.unique(two) + LETTERS, np.unique(three) + (LETTERS + LETTERS**2)]).astype(np.int32)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = letter_codes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        grams = [ngrams(t, codes) for t in texts]
        pieces = [[g for p in short_pieces(t) if len(g := ngrams(p, codes))] for t in texts]
        columns = [batch.column("lang"), batch.column("at"), pa.array(grams, pa.list_(pa.int32())), pa.array(pieces, pa.list_(pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "at", "grams", "pieces"])


def short_pieces(text: str) -> list[str]:
    words = text.split()
    return [" ".join(w) for k in PIECES if k < len(words) for w in (words[:k], words[-k:])]


def limits(sizes: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The score below which a text is rejected, by the whole part of log2 of its number of n-grams."""
    least = np.full(SPACE.bit_length(), np.inf)
    np.minimum.at(least, np.frexp(sizes)[1] - 1, np.clip(scores, 0, 1))
    # Lengths that no piece has take the limit of the next shorter ones; what is shorter than all pieces is not rejected.
    # No limit is above those of longer texts, as few pieces may have a length.
    out, last = np.zeros(len(least)), 0.0
    for k in np.arange(len(least)):
        last = last if np.isinf(least[k]) else min(REJECT, MARGIN * least[k])
        out[k] = last
    return np.minimum.accumulate(out[::-1])[::-1]


def held_out(docs: DataFrame) -> Column:
    text = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def sample_sizes(languages: int) -> tuple[int, int]:
    """(texts, landmarks) of each language."""
    if languages <= FULL_LANGS:
        return TRAIN_PER_LANG, LANDMARKS_PER_LANG
    return max(LEAST_TRAIN, TRAIN_PER_LANG * FULL_LANGS // languages), max(1, LANDMARKS_PER_LANG * FULL_LANGS // languages)


def fit(docs: DataFrame) -> dict:
    """languages, vocabulary (n-gram numbers), weights (vocabulary x languages) and limits of scores."""
    rows = docs.select(docs["text"], docs["lang"], docs["doc_id"], held_out(docs).alias("out")).filter("NOT out AND lang IS NOT NULL AND text IS NOT NULL")
    counts = sorted(((r["count"], r["lang"]) for r in rows.groupBy("lang").count().collect()), key=lambda x: x[1])
    nothing = {"languages": [], "vocabulary": np.zeros(0, dtype=np.int32), "weights": np.zeros((0, 0), dtype=np.float32), "limits": limits(np.zeros(0), np.zeros(0))}
    if not counts:
        return nothing
    texts, most_landmarks = sample_sizes(len(counts))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, texts / n)) for n, lang in counts], "lang string, share double")
    at = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30))
    sample = rows.join(F.broadcast(share), "lang").withColumn("at", at).filter(F.col("at") < F.col("share") * (1 << 30))
    # Equal rows have equal draws: one of them is enough, and keeps the sample bounded.
    sample = sample.groupBy("lang", "at", F.xxhash64("text").alias("same")).agg(F.first("text").alias("text"))
    found = in_arrow(sample.select("text", "lang", "at"), gather, "lang string, at long, grams array<int>, pieces array<array<int>>").toArrow().sort_by([("at", "ascending"), ("lang", "ascending")])
    names = np.array(found["lang"].to_pylist(), dtype=object)
    grams = [np.asarray(x.values, dtype=np.int32) for x in found["grams"]]
    pieces = [np.asarray(g.values, dtype=np.int32) for x in found["pieces"] for g in x.values]
    keep = [i for i, g in enumerate(grams) if len(g)]
    names, grams = names[keep], [grams[i] for i in keep]
    languages = sorted(set(names.tolist()))
    if not languages:
        return nothing
    landmarks = np.concatenate([np.flatnonzero(names == x)[:most_landmarks] for x in languages])
    vocabulary = np.unique(np.concatenate([grams[i] for i in landmarks]))
    place = np.full(SPACE, -1, dtype=np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    matrix = np.zeros((len(vocabulary), len(landmarks)), dtype=np.float32)
    for j, i in enumerate(landmarks):
        matrix[place[grams[i]], j] = 1 / np.sqrt(len(grams[i]))
    kernel = np.zeros((len(grams), len(landmarks)))
    for i, g in enumerate(grams):
        at_ = place[g]
        kernel[i] = matrix[at_[at_ >= 0]].sum(axis=0) / np.sqrt(len(g))
    inner = kernel[landmarks]
    target = (names[:, None] == np.array(languages, dtype=object)[None, :]).astype(float)
    balance = (1 / np.maximum(1, target.sum(axis=0)))[np.argmax(target, axis=1)] * len(names) / len(languages)
    left = kernel.T @ (kernel * balance[:, None]) + RIDGE * len(names) * inner + 1e-8 * np.eye(len(landmarks))
    dual = np.linalg.solve(left, kernel.T @ (target * balance[:, None]))
    weights, pieces = (matrix @ dual).astype(np.float32), grams + pieces
    top = np.zeros(len(pieces))
    for i, g in enumerate(pieces):
        at_ = place[g]
        top[i] = weights[at_[at_ >= 0]].sum(axis=0).max() / np.sqrt(len(g))
    return {"languages": languages, "vocabulary": vocabulary, "weights": weights, "limits": limits(np.array([len(g) for g in pieces]), top)}


def bounded(texts: pa.Array, codes: np.ndarray, most: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, n-grams of the rows from there on), about most n-grams at a time."""
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        held.append(ngrams(text.as_py(), codes))
        n += len(held[-1])
        if n >= most:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, codes = model.value, letter_codes()
        languages = np.array([*m["languages"], "und"], dtype=object)
        weights = np.concatenate([m["weights"], np.zeros((1, m["weights"].shape[1]), dtype=np.float32)])
        place = np.full(SPACE, len(weights) - 1, dtype=np.int32)
        place[m["vocabulary"]] = np.arange(len(m["vocabulary"]))
        for batch in batches:
            best, top = np.full(batch.num_rows, len(languages) - 1), np.zeros(batch.num_rows)
            known = np.zeros(batch.num_rows, dtype=bool)
            for first, grams in bounded(batch.column("text"), codes, GATHERED // max(1, weights.shape[1])):
                sizes = np.array([len(g) for g in grams])
                some = np.flatnonzero(sizes)
                if not len(some) or len(languages) == 1:
                    continue
                heads = np.cumsum(sizes[some]) - sizes[some]
                values = np.add.reduceat(weights[place[np.concatenate([grams[i] for i in some])]], heads, axis=0) / np.sqrt(sizes[some])[:, None]
                best[first + some] = np.argmax(values, axis=1)
                top[first + some] = np.clip(values.max(axis=1), 0, 1)
                known[first + some] = top[first + some] >= m["limits"][np.frexp(sizes[some])[1] - 1]
            columns = [*(batch.column(c) for c in ("doc_id", "t1", "t2", "out")), pa.array(languages[best].tolist(), pa.string()), pa.array(top.astype(float), pa.float64()), pa.array(known)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t1", "t2", "held_out", "lang_pred", "score", "known"])

    return score


def scored(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, t1, t2 (digests of the text), held_out, lang_pred, score and known, whether the text is in a learned language, of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if learn_from is None else learn_from))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], held_out(docs).alias("out"), *[d.alias(k) for k, d in digests(docs).items()])
    return in_arrow(rows, scorer(model), "doc_id long, t1 long, t2 long, held_out boolean, lang_pred string, score double, known boolean")


def predict(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    return scored(docs, learn_from).drop("known", "t1", "t2")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language."""
    return without(docs, scored(docs).filter("NOT known").select("t1", "t2"))
