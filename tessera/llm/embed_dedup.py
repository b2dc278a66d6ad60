"""Near-duplicate embeddings by collision counting on sorted one-dimensional projections.

Vectors equal in all components form a class first and stand for each other. Of the classes, each is
projected on many random lines.

1. Candidates. Each of several groups has a line on which vectors are sorted, and a few more lines that
   are cut into cells: vectors in the same cells are sorted along the group's line, and each is a query whose window,
   centred on it, is scanned along that order. The cells are there because the window of a line alone
   holds about half of all vectors at a cosine of 0.9: they grow in number with the logarithm of the
   input, and the number of groups is set for RECALL at the threshold.
2. Counting. Of each such pair, the lines are counted, of LINES others, on which one lies in the window
   centred on the other. Pairs with at least the count that a pair at the threshold reaches with
   probability COUNT_RECALL are verified by their cosine in double precision.

A pair is counted in the first group that it shares only. Buckets are compared in blocks of bounded
size; what leaves a block is the number of links of each of its vectors and its members' connections,
never all pairs. Classes have numbers of their own; vec_ids serve for the output alone.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links
and are their own component; so do rows without a vec_id (whose component is null; they are kept);
vectors of different lengths do not link; rows that share a vec_id count as different vectors with one
id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, with_row
from .minhash import whole_blocks

COSINE = 0.9
RECALL, COUNT_RECALL = 0.97, 0.999
#: Lines on which collisions are counted, and the window's half width over the distance at the threshold.
LINES, WINDOW = 64, 1.0
#: Half width of the window along a group's sorted line, and width of cells on its others, over the same distance.
ALONG, CELL = 2.0, 5.0
#: Vectors that the window of a query should hold on average, if their directions were random: they cost a few dozen microseconds.
OCCUPANCY = 256
#: Members of a bucket that are compared in one block.
BLOCK = 2000
SEED = 71

DISTANCE = math.sqrt(2 - 2 * COSINE)


def same_cell(distance: float, width: float) -> float:
    """Probability that two points at this distance fall in one cell of a randomly placed grid, on a random line."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def in_window(distance: float, half: float) -> float:
    """Probability that two points at this distance are within half of each other on a random line."""
    return math.erf(half / distance / math.sqrt(2))


def groups_for(n: int) -> tuple[int, int]:
    """(lines with cells in a group, groups) for n vectors."""
    near, far = (same_cell(d, CELL * DISTANCE) for d in (DISTANCE, math.sqrt(2)))
    near_along, far_along = (in_window(d, ALONG * DISTANCE) for d in (DISTANCE, math.sqrt(2)))
    lines = max(0, round(math.log(max(1.0, n * far_along / OCCUPANCY)) / -math.log(far)))
    # Beside the group's own chance, the count's.
    missed = 1 - RECALL / COUNT_RECALL
    return lines, max(1, math.ceil(math.log(missed) / math.log(1 - near_along * near**lines)))


def least_count() -> int:
    """The most collisions that a pair at the threshold reaches with probability COUNT_RECALL."""
    p, below = math.erf(WINDOW / math.sqrt(2)), 0.0
    for k in range(LINES + 1):
        below += math.comb(LINES, k) * p**k * (1 - p) ** (LINES - k)
        if below > 1 - COUNT_RECALL:
            return k
    return LINES


def units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double) for each length of vector."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    begin = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        v = flat[begin[rows][:, None] + np.arange(size)]
        v = v / np.abs(v).max(axis=1, keepdims=True)
        out.append((rows, v / np.linalg.norm(v, axis=1, keepdims=True)))
    return out


def router(lines: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives each vector's key, of its cells, and place along the sorted line, in every group."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, along = np.zeros((batch.num_rows, groups), dtype=np.int16), np.zeros((batch.num_rows, groups), dtype=np.float32)
            buckets = np.zeros((batch.num_rows, groups), dtype=np.int64)
            for rows, v in units(batch.column("vec")):
                rng = np.random.default_rng([SEED, v.shape[1]])
                width = CELL * DISTANCE
                for g in range(groups):
                    along[rows, g] = v @ rng.standard_normal(v.shape[1])
                    cells = np.floor((v @ rng.standard_normal((v.shape[1], lines)) + rng.uniform(0, width, lines)) / width).astype(np.int64)
                    mix = (cells.astype(np.uint64) * rng.integers(1, 2**63, lines).astype(np.uint64)).sum(axis=1, dtype=np.uint64) + np.uint64(v.shape[1])
                    buckets[rows, g] = (mix * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    # Whether an earlier group is shared is told by 16 bits of its bucket, here and where they are compared.
                    keys[rows, g] = (buckets[rows, g].view(np.uint64) >> np.uint64(48)).astype(np.uint16).view(np.int16)
            columns = [batch.column(c) for c in ("rep", "n", "vec")]
            columns += [pa.array([x.tobytes() for x in part], pa.binary()) for part in (keys, along)]
            columns += [pa.array(list(buckets), pa.list_(pa.int64())), pa.array(list(along), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "vec", "keys", "lines", "buckets", "along"])

    return route


def collisions(onto: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On how many lines b lies in the window centred on a."""
    return (np.abs(onto[a] - onto[b]) <= WINDOW * DISTANCE).sum(axis=1)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks of buckets, sorted along their lines: (rep, links to others' vectors, a vector it is connected to or null)."""
    least, reach = least_count(), np.float32(ALONG * DISTANCE)
    for rows in whole_blocks(batches):
        n = rows.num_rows
        key = np.stack([rows[c].to_numpy() for c in ("band", "one", "two")])
        cut = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
        ends = np.repeat(np.append(cut, n), np.diff(np.concatenate([[0], cut, [n]])))
        rep, many, group, block, across = (rows[c].to_numpy() for c in ("rep", "n", "group", "block", "across"))
        keys, lines = (np.stack([np.frombuffer(x, dtype=kind) for x in rows[c].to_pylist()]) for c, kind in (("keys", np.int16), ("lines", np.float32)))
        along = lines[np.arange(n), group]
        ids, local = np.unique(rep, return_inverse=True)
        links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        vectors = units(rows["vec"])
        place, kind = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for k, (own, _) in enumerate(vectors):
            place[own], kind[own] = np.arange(len(own)), k
        onto = [(v @ np.random.default_rng([SEED, 1, v.shape[1]]).standard_normal((v.shape[1], LINES))).astype(np.float32) for _, v in vectors]
        at, d = np.arange(n), 1
        # Rows are in the order of their line: the windows of all queries are scanned together, a step further each time.
        while len(at := at[at + d < ends[at]]) and len(at := at[along[at + d] - along[at] <= reach]):
            for start in range(0, len(at), 20_000):
                i = at[start : start + 20_000]
                i = i[(~across[i] | (block[i] != block[i + d])) & (kind[i] == kind[i + d])]
                for k, (_, v) in enumerate(vectors):
                    x = i[kind[i] == k]
                    x = x[collisions(onto[k], place[x], place[x + d]) >= least]
                    x = x[np.einsum("ij,ij->i", v[place[x]], v[place[x + d]]) >= COSINE]
                    earlier = np.arange(keys.shape[1])[None, :] < group[x][:, None]
                    both = (keys[x] == keys[x + d]) & (np.abs(lines[x] - lines[x + d]) <= reach) & earlier
                    x = x[~both.any(axis=1)]
                    p, q = local[x], local[x + d]
                    np.add.at(links, p, many[x + d])
                    np.add.at(links, q, many[x])
                    while len(p):
                        low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
                        if not (apart := low < high).any():
                            break
                        np.minimum.at(label, high[apart], low[apart])
                        while (label[label] != label).any():
                            label = label[label]
            d += 1
        some = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        other = np.where(label[some] != some, ids[label[some]], -1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(other, mask=label[some] == some)], names=["rep", "links", "other"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    v = vectors["embedding"]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    valid = F.coalesce(finite & F.exists(v, lambda x: x != 0) & vectors["vec_id"].isNotNull(), F.lit(False))
    base = vectors.select(vectors["vec_id"], v.alias("vec"), valid.alias("valid"), F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2"))
    reps = base.filter("valid").groupBy("h1", "h2").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    reps = materialize(with_row(reps).withColumnRenamed("row", "rep"), "vectors")
    lines, groups = groups_for(reps.count())
    kind = dict(reps.dtypes)["vec"]
    routed = reps.select("rep", "n", "vec").mapInArrow(router(lines, groups), f"rep long, n long, vec {kind}, keys binary, lines binary, buckets array<long>, along array<float>")
    routed = materialize(routed, "vector-lines")
    members = routed.select("rep", F.posexplode(F.arrays_zip("buckets", "along")).alias("group", "in")).select("rep", "group", F.xxhash64("group", "in.buckets").alias("band"), F.col("in.along").alias("along"))
    sizes = materialize(members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    members = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") != F.col("other")).alias("across"), "block", "group", "rep", "along")
    # A pair of blocks (i, j) with i <> j gets the members of both; (i, i) those of one.
    dealt = members.join(routed.select("rep", "n", "vec", "keys", "lines"), "rep").repartition("band", "one", "two").sortWithinPartitions("band", "one", "two", "along")
    found = materialize(dealt.mapInArrow(counted, "rep long, links long, other long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    each = reps.select("h1", "h2", "rep", "n", "lowest").join(links, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    each = materialize(each.select("h1", "h2", "lowest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-components")
    discard(routed, sizes, found)
    each = each.join(each.groupBy("component").agg(F.min("lowest").alias("component_id")), "component")
    out = base.select("vec_id", "valid", "h1", "h2").join(each.select("h1", "h2", "n_links", "component_id"), ["h1", "h2"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("valid"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
