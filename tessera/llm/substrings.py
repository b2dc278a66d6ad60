"""Passages of LENGTH words or more that a document with a smaller id holds too, by seed and extend on winnowed anchors.

A window is LENGTH consecutive words; windows of equal words are equal.

1. Winnowing: of every window the SEED words with the smallest hash, the last ones of equals, are its anchor. So equal
   windows have equal anchors at equal places. An anchor's region is what the windows that chose it cover.
   One Arrow pass over the texts writes (anchor, region) hashes, some one for every 20 words.
2. Documents meet on their anchors: the smallest and the largest document of an anchor, and whether it has several
   regions, are aggregated map-side, and only anchors of several documents go on. Anchors with one region are done: what
   their smallest document has, all others repeat.
3. Anchors with several regions: one text of each region is fetched, once however many documents have it. The
   smallest document's region is the centre, and all others are extended against it word by word, to both
   sides. Windows within the extension are known by this; only those beyond go on, in halves by their place
   about the anchor, keyed by the words that all windows of a half have. A group is compared with its centre
   alone, never pairwise; after at most seven rounds a half is one window, equal in all of its group.
4. Windows known from a smaller document are united to spans, document by document, and their words removed.

Regions of a hot anchor are rows of a join by its hash, which adaptive execution splits; nothing is gathered by it.
Requests and spans meet the texts by shuffle at every size, so the texts are shuffled twice; nothing is broadcast here.

Defined results: a null text has no words; texts of fewer than LENGTH words lose nothing; a row without a
doc_id counts as of the largest long; rows that share a doc_id never lose words to each other, and rows of
equal id and text are alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digests, discard, materialize
from .textscan import BASE, NOT_SPACE, UNCHANGED, U, mixed, pieces, powers, word_array, words

LENGTH = 50
SEED = 12
#: The most words that a window has on one side of its anchor.
SPAN = LENGTH - SEED

ANCHORS = "doc long, t1 long, anchor long, region long, place int, first int, last int"
REGIONS = "anchor long, region long, low long, least int, most int, before string, after string"
EXTENDED = "anchor long, region long, low long, source long, one int, two int, halves array<struct<key:long,lo:int,hi:int>>"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>, kept string"
INVERSE = U(pow(int(BASE), -1, 2**64))


def anchors_of(hashes: np.ndarray, ranges: np.ndarray) -> dict[str, np.ndarray]:
    """Of the texts whose words' hashes are in ranges: row, place of the anchor, first and last window that chose it, and the hashes of anchor and region."""
    many = np.maximum(np.diff(ranges) - LENGTH + 1, 0)
    if not many.any():
        return {c: np.zeros(0, dtype=np.int64) for c in ("row", "place", "first", "last", "anchor", "region")}
    n = len(hashes)
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(hashes * powers(n), dtype=U)])
    back = powers(n, INVERSE)
    of = lambda i, j: mixed((sums[j] - sums[i]) * back[i])
    gram = of(np.arange(n - SEED + 1), np.arange(SEED, n + 1))
    best, wide = np.arange(len(gram)), 1
    while wide < SPAN + 1:
        step = min(wide, SPAN + 1 - wide)
        left, right = best[:-step], best[step:]
        best, wide = np.where(gram[right] <= gram[left], right, left), wide + step
    row = np.repeat(np.arange(len(many)), many)
    start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ranges[:-1], many)
    place = best[start]
    begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    end = np.append(begin[1:], len(row)) - 1
    row, place, first, last = row[begin], place[begin], start[begin], start[end]
    shape = (place - first).astype(U) * U(0xA0761D6478BD642F) + (last - first).astype(U) * U(0xE7037ED1A0B428DB)
    return {"row": row, "place": place, "first": first, "last": last, "anchor": gram[place].view(np.int64), "region": mixed(of(first, last + LENGTH) + shape).view(np.int64)}


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in pieces(batch.column("text")):
            hashes, _, ranges = words(data, offsets, NOT_SPACE, UNCHANGED)
            found = anchors_of(hashes, ranges)
            row, base = pa.array(found["row"]), ranges[found["row"]]
            carried = [batch.column(c).slice(first, end - first).take(row) for c in ("doc", "t1")]
            places = [pa.array(found[c] - base, pa.int32()) for c in ("place", "first", "last")]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(found["anchor"]), pa.array(found["region"]), *places], names=["doc", "t1", "anchor", "region", "place", "first", "last"])


def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted regions of every text, as the words before and after their anchors."""
    for batch in batches:
        docs, wanted = batch.column("doc").to_pylist(), batch.column("wanted")
        for first, end, data, offsets in pieces(batch.column("text")):
            hashes, begins, ranges = words(data, offsets, NOT_SPACE, UNCHANGED)
            found = anchors_of(hashes, ranges)
            heads = np.append(begins, len(data))
            cut = np.searchsorted(found["row"], np.arange(end - first + 1))
            rows = []
            for r in range(end - first):
                left = {(w["anchor"], w["region"]) for w in wanted[first + r].as_py()}
                for i in range(cut[r], cut[r + 1]):
                    key = int(found["anchor"][i]), int(found["region"][i])
                    if key in left:
                        left.remove(key)
                        place, one, two = (int(found[c][i]) for c in ("place", "first", "last"))
                        text = [data[heads[a] : min(heads[b], offsets[r + 1])].tobytes().decode("utf-8", "replace") for a, b in ((one, place), (place + SEED, two + LENGTH))]
                        rows.append((*key, docs[first + r], place - two, place - one, *text))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["anchor", "region", "low", "least", "most", "before", "after"])


def sides(column: pa.Array, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words on one side of an anchor, from it on, SPAN for each row, and how many there are."""
    out, sizes = np.zeros((len(column), SPAN), dtype=U), np.zeros(len(column), dtype=np.int64)
    for first, end, data, offsets in pieces(column):
        hashes, _, ranges = words(data, offsets, NOT_SPACE, UNCHANGED)
        sizes[first:end] = np.diff(ranges)
        k = np.arange(SPAN)
        at = ranges[1:, None] - 1 - k if backwards else ranges[:-1, None] + k
        inside = k < sizes[first:end, None]
        out[first:end][inside] = hashes[at[inside]]
    return out, sizes


def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extends every region against the centre of its group. Windows one to two (by their words before the anchor) are equal; halves hold the others."""
    turn = mixed(np.arange(501, 501 + 2 * SPAN, dtype=U)) | U(1)
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        number = {c: batch.column(c).to_numpy() for c in ("anchor", "lo", "hi", "least", "most", "c_least", "c_most")}
        lo, hi, own_lo, own_hi = number["lo"], number["hi"], np.maximum(number["least"], number["lo"]), np.minimum(number["most"], number["hi"])
        reach, hashes = [], []
        for c, backwards in (("before", True), ("after", False)):
            (x, n), (y, k) = sides(batch.column(c), backwards), sides(batch.column(f"c_{c}"), backwards)
            same = (x == y) & (np.arange(SPAN) < np.minimum(n, k)[:, None])
            reach.append(np.cumprod(same, axis=1).sum(axis=1))
            hashes.append(x)
        one = np.maximum(np.maximum(own_lo, number["c_least"]), SPAN - reach[1])
        two = np.minimum(np.minimum(own_hi, number["c_most"]), reach[0])
        none = one > two
        one, two = np.where(none, 1, one), np.where(none, 0, two)
        middle, k, halves = (lo + hi) // 2, np.arange(SPAN), [[] for _ in range(m)]
        for a, b in ((lo, middle), (middle + 1, hi)):
            low, high = np.maximum(own_lo, a), np.minimum(own_hi, b)
            go = np.flatnonzero((lo < hi) & (low <= high) & (none | (low < one) | (high > two)))
            part = np.where(k < a[go, None], hashes[0][go], 0) @ turn[:SPAN] + np.where(k < SPAN - b[go, None], hashes[1][go], 0) @ turn[SPAN:]
            key = mixed(part + number["anchor"][go].view(U) + a[go].astype(U) * U(0x9FB21C651E98DF25) + b[go].astype(U)).view(np.int64)
            for i, *half in zip(go.tolist(), key.tolist(), a[go].tolist(), b[go].tolist(), strict=True):
                halves[i].append(dict(zip(("key", "lo", "hi"), half, strict=True)))
        kind = pa.list_(pa.struct([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
        columns = [*(batch.column(c) for c in ("anchor", "region", "low", "c_low")), pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(halves, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "region", "low", "source", "one", "two", "halves"])


def extensions(known: DataFrame) -> list[DataFrame]:
    """Written tables of what the rounds find out of the regions of anchors that have several."""
    texts = ("least", "most", "before", "after")
    named = known.select("anchor", F.col("region").alias("c_region"), *[F.col(c).alias(f"c_{c}") for c in texts])
    group = known.select(F.col("anchor").alias("key"), "anchor", "region", "low", F.lit(0).alias("lo"), F.lit(SPAN).alias("hi"), *texts)
    rounds: list[DataFrame] = []
    while True:
        centres = group.groupBy("key").agg(F.min("anchor").alias("anchor"), F.min("low").alias("c_low"), F.max("low").alias("high"), F.min_by("region", "low").alias("c_region"))
        centres = centres.filter("c_low <> high").drop("high").join(named, ["anchor", "c_region"]).drop("anchor")
        pairs = group.join(centres, "key").filter("region <> c_region")
        pairs = pairs.select("anchor", "region", "low", "c_low", "lo", "hi", *texts, *[f"c_{c}" for c in texts])
        found = materialize(pairs.mapInArrow(extended, EXTENDED), "substrings-round")
        rounds.append(found)
        again = found.filter(F.size("halves") > 0)
        if not again.limit(1).count():
            return rounds
        again = again.select("anchor", "region", "low", F.explode("halves").alias("half"))
        group = again.select("half.key", "anchor", "region", "low", "half.lo", "half.hi").join(known.select("anchor", "region", *texts), ["anchor", "region"])


def named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and by what rows are told apart: doc, the largest long without a doc_id, and t1, the text's digest."""
    own = docs["doc_id"].cast("long")
    return docs.select(own.alias("doc_id"), docs["text"], F.coalesce(own, F.lit(2**63 - 1)).alias("doc"), digests(docs)["t1"].alias("t1"))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(doc, t1, first, end, source): words first to end of a text are windows that the document source, of a smaller id, holds too."""
    base = materialize(rows.select("doc", "t1", "text").mapInArrow(scan, ANCHORS), "substrings-anchors")
    shared = base.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("region").alias("r1"), F.max("region").alias("r2"))
    # Written first: so both sides of the join are shuffles as they stand, and the parts of a hot anchor can be split.
    shared = materialize(shared.filter("low <> high").select("anchor", "low", (F.col("r1") != F.col("r2")).alias("several")), "substrings-shared")
    hits = materialize(base.join(shared, "anchor"), "substrings-hits")
    discard(base, shared)
    alike = hits.filter("NOT several AND doc > low").select("doc", "t1", "first", (F.col("last") + LENGTH).alias("end"), F.col("low").alias("source"))
    several = hits.filter("several").drop("low", "several")
    kinds = materialize(several.groupBy("anchor", "region").agg(F.min("doc").alias("low"), F.min_by("t1", "doc").alias("t1")), "substrings-regions")
    asked = kinds.groupBy(F.col("low").alias("doc"), "t1").agg(F.collect_list(F.struct("anchor", "region")).alias("wanted"))
    asked = materialize(asked, "substrings-asked")
    told = rows.select("doc", "t1", "text").join(asked, ["doc", "t1"]).select("doc", "text", "wanted")
    known = materialize(told.mapInArrow(regions, REGIONS).dropDuplicates(["anchor", "region"]), "substrings-known")
    rounds = extensions(known)
    parts = [r.filter("one <= two").select("anchor", "region", "source", "one", "two") for r in rounds]
    own = kinds.select("anchor", "region", F.col("low").alias("source"), F.lit(0).alias("one"), F.lit(SPAN).alias("two"))
    found = several.join(reduce(DataFrame.union, parts, own), ["anchor", "region"]).filter("doc > source")
    low, high = F.greatest("first", F.col("place") - F.col("two")), F.least("last", F.col("place") - F.col("one"))
    found = found.select("doc", "t1", low.alias("first"), (high + LENGTH).alias("end"), "source").filter(F.col("end") - F.col("first") >= LENGTH)
    return alike.union(found)


def finisher(texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column("text")):
                own, ranges = word_array(data, offsets)
                found = batch.column("found").slice(first, end - first)
                sizes = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                base = np.repeat(ranges[:-1], sizes)
                edge = np.zeros(len(own) + 1, dtype=np.int64)
                flat = found.flatten()
                for k, c in ((1, "first"), (-1, "end")):
                    np.add.at(edge, base + flat.field(c).to_numpy(zero_copy_only=False), k)
                gone = np.cumsum(edge)[:-1] > 0
                count = np.concatenate([[0], np.cumsum(~gone)])[ranges]
                kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(count), own.filter(pa.array(~gone))), pa.scalar(b" ", pa.large_binary()))
                spans = [union(x) for x in found.to_pylist()]
                columns = [
                    batch.column("doc_id").slice(first, end - first), pa.array(np.diff(ranges), pa.int64()), pa.array(np.diff(ranges) - np.diff(count), pa.int64()), pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in kept], pa.string()),
                    pa.array(spans, pa.list_(pa.int64())), kept.cast(pa.large_string()).cast(pa.string()) if texts else pa.nulls(end - first, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return finish


def union(found: list[dict] | None) -> list[int]:
    """first, end, first, end, ... of the union of spans."""
    out: list[int] = []
    for first, end in sorted((x["first"], x["end"]) for x in found or ()):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """RESULT of every row of docs: what is removed, as first and end words of spans, and the kept text (null unless asked for)."""
    rows = named_rows(docs)
    spans = repeated_windows(rows).groupBy("doc", "t1").agg(F.collect_set(F.struct("first", "end")).alias("found"))
    spans = materialize(spans, "substrings-spans")
    return rows.join(spans, ["doc", "t1"], "left").select("doc_id", "text", "found").mapInArrow(finisher(texts), RESULT)
