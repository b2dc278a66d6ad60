"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt over logical partitions by a hash of their content. The matrix M[partition, shard]
is drawn from the multivariate hypergeometric law whose margins are the partition sizes and the
shard sizes, which is the law of these counts under a uniform permutation. Each partition permutes
its rows and sends the first M[p, 0] to shard 0, the next M[p, 1] to shard 1, and so on; each shard
then permutes what it got. Only the partition sizes (at most MOST_PARTITIONS numbers) come to the
driver. All orders are of seeded hashes, so a retried task or a rerun gives the same result.

Equal rows are numbered where they meet, in the partition of their hash, and permuted by hash and number.
A content with more rows than two partitions have on average (there are fewer such contents than partitions)
is dealt as numbered copies of one of its rows, which are over all partitions. Rows count as equal if 128
bits of hash over all columns are.

Defined results: a null text has no bytes (size 1, crc 0); a null doc_id is a value like others;
empty input gives no rows; repeated rows each get a slot of their own, dealt independently; all columns
of docs move with their row, under docs_ and their name where that is one of DIGEST.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialize

MOST_PARTITIONS = 65_536
ROWS_A_PARTITION = 20_000
#: Numbers of the matrix, so that it is broadcast with at most 32 MB; many shards mean fewer partitions.
MOST_CELLS = 1 << 22
#: The columns of a row's place and the digest of its text.
DIGEST = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good items among draws without replacement from good + bad: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    logc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(logc(good, mode) + logc(bad, draws - mode) - logc(good + bad, draws))
    left = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix with these row and column sums, in the law of a uniform permutation."""
    rng, free, matrix = random.Random(seed), list(columns), []
    for n in rows:
        line, open_seats = [], sum(free)
        for s, seats in enumerate(free):
            open_seats -= seats
            line.append(hypergeometric(rng, seats, open_seats, n))
            n -= line[-1]
            free[s] -= line[-1]
        matrix.append(line)
    return matrix


def hot_contents(keys: DataFrame, parts: int, total: int) -> DataFrame | None:
    """(h1, h2, n) of the contents with more rows than two partitions have on average: fewer than parts / 2. None where there are none."""
    limit, at = 2 * total / parts, part_of("h1", parts)
    full = keys.groupBy(at.alias("part")).count().filter(F.col("count") > limit).select("part")
    full = [r["part"] for r in full.collect()]
    if not full:
        return None
    full = keys.sparkSession.createDataFrame([(p,) for p in full], "part int")
    counts = keys.withColumn("part", at).join(F.broadcast(full), "part", "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("n"))
    hot = materialize(counts.filter(F.col("n") > limit), "shard-hot")
    return hot if hot.limit(1).count() else None


def part_of(h: str | Column, parts: int) -> Column:
    return F.pmod(h, F.lit(parts)).cast("int")


def with_part(rows: DataFrame, hot: DataFrame | None, parts: int) -> DataFrame:
    """rows (h1, h2 and others) with the partition they are dealt to; hot contents as numbered copies, so that they are dealt one by one."""
    usual = rows.withColumns({"copy": F.lit(None).cast("long"), "part": part_of("h1", parts)})
    if hot is None:
        return usual
    usual = usual.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    others = [c for c in rows.columns if c not in ("h1", "h2")]
    one = rows.join(F.broadcast(hot), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in others])
    spans = one.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(ROWS_A_PARTITION)))).repartition("h1", "low")
    copies = spans.withColumn("copy", F.explode(F.sequence("low", F.least("n", F.col("low") + ROWS_A_PARTITION) - 1)))
    copies = copies.select("h1", "h2", *others, "copy").withColumn("part", part_of(F.xxhash64("h1", "copy"), parts))
    return usual.unionByName(copies)


def dealt(rows: DataFrame, matrix: DataFrame, parts: int) -> DataFrame:
    """rows of with_part() with the shard that their partition sends them to, and the part of the shard they arrive in.

    One exchange by part: equal rows are numbered and all rows of a partition permuted where they arrive.
    """
    again = F.row_number().over(Window.partitionBy("part", "h1", "h2").orderBy("h1")) - 1
    rows = rows.repartition("part").withColumn("copy", F.coalesce("copy", again))
    rows = rows.withColumns({f"g{k}": F.xxhash64(f"h{k}", "copy") for k in (1, 2)}).drop("h1", "h2", "copy")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("g1", "g2"))).join(F.broadcast(matrix), "part")
    shard_of = F.size(F.filter("ends", lambda e: e < F.col("place"))).cast("int")
    return rows.withColumns({"shard": shard_of, "sub": part_of("g2", parts)}).drop("part", "place", "ends")


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """Every row of docs, moved: doc_id, size, text_crc32, law, shard, slot, grown_shard and all other columns of docs with the text."""
    spark = docs.sparkSession
    held = {c: c if c in ("doc_id", "text") else f"row{i}" for i, c in enumerate(docs.columns)}
    base = docs.select(*[docs[c].alias(name) for c, name in held.items()])
    content = [x for name in held.values() for x in (F.col(name), F.col(name).isNull())]
    base = base.withColumns({f"h{k}": F.xxhash64(F.lit(seed + k), *content) for k in (1, 2)})
    keys = materialize(base.select("h1", "h2"), "shard-keys")
    total = keys.count()
    parts = min(MOST_PARTITIONS, max(1, MOST_CELLS // n_shards), max(64, math.ceil(total / ROWS_A_PARTITION)))
    hot = hot_contents(keys, parts, total)
    placed = with_part(keys, hot, parts)
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    seats = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = sorted(counts)
    ends = []
    for p, line in zip(used, communication_matrix([counts[p] for p in used], seats, seed), strict=True):
        ends.append((p, list(itertools.accumulate(line))))
    matrix = spark.createDataFrame(ends, "part int, ends array<bigint>")
    offsets = dealt(placed, matrix, parts).groupBy("shard", "sub").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("sub")) - F.col("count")
    offsets = materialize(offsets.select("shard", "sub", before.alias("before")), "shard-offsets")
    discard(keys)
    if parts * n_shards <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    # The keys alone have settled the offsets, so the texts are moved twice and written nowhere else.
    within = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("g2", "g1"))
    out = dealt(with_part(base, hot, parts), matrix, parts).withColumn("within", within).join(offsets, ["shard", "sub"])
    # The digests are taken from the rows where they arrived.
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(held[c]).alias(name) for c, name in free_names(docs.columns).items()],
    )


def free_names(columns: list[str]) -> dict[str, str]:
    """The name in the result of each column but doc_id: its own, after docs_ where DIGEST or another column has that."""
    taken, names = {*DIGEST, *(c.lower() for c in columns)}, {}
    for c in columns:
        if c == "doc_id":
            continue
        names[c] = c
        if c.lower() in DIGEST:
            while names[c].lower() in taken:
                names[c] = f"docs_{names[c]}"
            taken.add(names[c].lower())
    return names
