"""Periodic runs of words: maximal stretches that repeat with a period, found by Main and Lorentz's divide and conquer.

Words become numbers, and every text is halved again and again. A run that crosses the middle of the
smallest block that holds it has one side of at least half its length, so from the middle on that side
repeats itself at the run's period: the Z-function of the side at the period says how far, and
the comparison across the middle how far the other side goes on. All blocks of a level, of all texts
of a piece, are tested together: four words are compared for every period first, three single places of
what is left next, and only what passes is followed to its ends. A block in which MANY periods pass (one word
repeated a thousand times) gets its whole Z-functions, in linear time, instead. Runs that go beyond
their block are found again in a larger one and dropped here; of equal stretches the smallest period stays.

Everything happens within one text, so there is no shuffle. A task holds pieces of a megabyte of text,
a longer text being a piece of its own, and at most CELLS candidates at a time.

Defined results: a null text has no words; texts of fewer than LEAST words have no runs; rows that share
a doc_id, or have none, are rows of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import pieces, word_array

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 24, 3
#: Candidates looked at in one go, and periods of a block from which its whole Z-functions are computed.
CELLS, MANY = 1 << 20, 64

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string, runs_sha256 string, collapsed_sha256 string"
DIGEST = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def agree(ids: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many of the numbers at i, i + step, ... in turn equal those at j, j + step, ...; at most limit."""
    size, go, width = np.zeros(len(i), dtype=np.int64), np.flatnonzero(limit > 0), 8
    while len(go):
        k = size[go, None] + np.arange(width)
        inside = k < limit[go, None]
        k = np.where(inside, k, 0) * step
        same = inside & (ids[i[go, None] + k] == ids[j[go, None] + k])
        n = np.where(same.all(axis=1), width, same.argmin(axis=1))
        size[go] += n
        go = go[n == width]
        width = max(8, min(2 * width, CELLS // max(1, len(go))))
    return size


def z_function(s: list[int]) -> np.ndarray:
    """Of every place the length of the longest common prefix of s and what begins there."""
    n = len(s)
    z, low, high = [0] * n, 0, 0
    z[0] = n
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return np.array(z, dtype=np.int64)


def periods(room: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, period) of the periods 1 to most of every block, CELLS at a time."""
    first = np.cumsum(most) - most
    total = int(most.sum())
    for begin in range(0, total, CELLS):
        at = np.arange(begin, min(begin + CELLS, total))
        block = np.searchsorted(first, at, side="right") - 1
        yield block, at - first[block] + 1


def side(ids: np.ndarray, left: np.ndarray, mid: np.ndarray, right: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, period, start, end) of repetitions that cross mid and have their longer side after it (step 1) or before it (-1)."""
    base, room, other = (mid, right - mid, mid - left) if step > 0 else (mid - 1, mid - left, right - mid)
    blocks, wide = [], []
    for block, p in periods(room, (right - left) // TIMES):
        need = np.maximum(LEAST // 2 - p, -(-p // 2))
        keep = p + need <= room[block]
        block, p, need = block[keep], p[keep], need[keep]
        for k in (0, 1, 2, 3, "last", "half", "quarter"):
            far = {"last": need - 1, "half": need // 2, "quarter": need // 4}.get(k, k) * step
            at = base[block] + far
            keep = ids[at] == ids[at + step * p]
            block, p, need = block[keep], p[keep], need[keep]
        blocks.append(block)
        wide.append(p)
    block, p = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (blocks, wide))
    near, beyond = np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=np.int64)
    dense = np.bincount(block, minlength=len(mid))[block] > MANY
    few = np.flatnonzero(~dense)
    b, q = block[few], p[few]
    near[few] = agree(ids, base[b], base[b] + step * q, room[b] - q, step)
    few = few[near[few] >= np.maximum(LEAST // 2 - q, -(-q // 2))]
    b, q = block[few], p[few]
    beyond[few] = agree(ids, base[b] - step, base[b] + step * (q - 1), other[b], -step)
    for b in np.unique(block[dense]).tolist():
        own = np.flatnonzero(block == b)
        inner = ids[left[b] : right[b]][::step].tolist()
        cut = int(other[b])
        near[own] = z_function(inner[cut:])[p[own]]
        before = inner[:cut][::-1]
        beyond[own] = z_function([*before, -1, *inner[::-1]])[cut + 1 + int(room[b]) - p[own]]
    start = np.where(step > 0, mid[block] - beyond, mid[block] - p - near)
    end = np.where(step > 0, mid[block] + p + near, mid[block] + beyond)
    long = end - start >= np.maximum(LEAST, TIMES * p)
    return block[long], p[long], start[long], end[long]


def runs_of(ids: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of the texts whose words are ids, in ranges, by start and period."""
    low, high = ranges[:-1], ranges[1:]
    left, right, found = low, high, []
    while True:
        long = right - left >= LEAST
        left, right, low, high = left[long], right[long], low[long], high[long]
        if not len(left):
            break
        mid = (left + right) // 2
        for step in (1, -1):
            b, p, start, end = side(ids, left, mid, right, step)
            more = (start == left[b]) & (start > low[b])
            more[more] = ids[start[more] - 1] == ids[start[more] - 1 + p[more]]
            after = (end == right[b]) & (end < high[b])
            after[after] = ids[end[after]] == ids[end[after] - p[after]]
            whole = ~more & ~after
            found.append(np.column_stack([start, end, p])[whole])
        left, right, low, high = np.concatenate([left, mid]), np.concatenate([mid, right]), np.tile(low, 2), np.tile(high, 2)
    rows = np.concatenate([np.zeros((0, 3), dtype=np.int64), *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in pieces(batch.column("text")):
            words, ranges = word_array(data, offsets)
            runs = runs_of(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), ranges)
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 1], -1)
            kept = np.cumsum(edge)[:-1] == 0
            count = np.concatenate([[0], np.cumsum(kept)])[ranges]
            lists = pa.LargeListArray.from_arrays(pa.array(count), words.filter(pa.array(kept)))
            collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
            own = np.searchsorted(runs[:, 0], ranges)
            n_runs, best, told, digests = np.diff(own), [], [], []
            for i in range(end - first):
                rows = [(s - int(ranges[i]), e - s, p) for s, e, p in runs[own[i] : own[i + 1]].tolist()]
                s, n, p = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rows else (None, None, None)
                best.append((s, n, p, 1000 * n // p if rows else None))
                told.append([{"start": s, "length": n, "period": p} for s, n, p in rows])
                digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode()).hexdigest())
            columns = [batch.column("doc_id").slice(first, end - first), pa.array(n_runs, pa.int64()), *(pa.array([b[k] for b in best], pa.int64()) for k in range(4))]
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            shown = [hashlib.sha256(x.as_buffer()).hexdigest() for x in collapsed]
            columns += [pa.array(told, kind), collapsed.cast(pa.large_string()).cast(pa.string()), pa.array(digests, pa.string()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed", "runs_sha256", "collapsed_sha256"])


def runs(docs: DataFrame) -> DataFrame:
    """Of every row of docs: its runs, the one of the greatest exponent, and the text without repeated periods."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(scan, RESULT)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in about a tenth of the rows, told by crc32 of doc_id, all words from one on repeat a period."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    words = F.filter(F.split(docs["text"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    again = "flatten(array_repeat(slice(w, int(a) + 1, int(p)), int(1 + (n - a) DIV p)))"
    return rows.selectExpr("doc_id", f"CASE WHEN n > 0 THEN array_join(slice(concat(slice(w, 1, int(a)), {again}), 1, int(n)), ' ') ELSE text END AS text")
