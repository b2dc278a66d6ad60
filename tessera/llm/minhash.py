"""Near-duplicates by b-bit MinHash: linked where 5-word shingle sets have a Jaccard similarity of 0.75 or more.

1. One Arrow pass gives each document the size of its shingle set, a 128-bit key of the set, hashes of
   bands of minima, and a signature of the low bits of all minima.
2. Documents of equal sets form a class; its smallest id stands for it from here on.
3. Classes that share a band hash are candidates. A bucket's members are paired with its smallest
   member, the collision-corrected similarity of the signatures is estimated by counting bits, and the
   most similar of these pairs of each member is confirmed on the full sets. So a group of near
   copies costs as many pairs as it has members.
4. In buckets that still hold several components, members of different components are compared by
   their signatures, in blocks of bounded rows and shingles. Members of pairs that may reach the threshold get their
   texts, and the pairs are confirmed within the block; only links that join components leave it.

Candidate loss: a pair of similarity 0.75 misses all 32 bands of 5 rows with probability 1.7e-4, and
the estimate prunes it (four standard deviations) with probability 3e-5; closer pairs far less.

Classes have numbers of their own; doc_ids serve for the output alone, so rows that share one but differ
in text stay apart. Hot buckets are spread: members of a bucket are never gathered by its key alone.

Defined results: null texts and texts without words have no shingles, link with nothing and are kept; a
row without a doc_id is compared like others, and component_id is null where no document reachable has
one; rows that share a doc_id are rows of their own, and a component that holds any of them goes by the
smallest doc_id in it; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, digests, discard, in_arrow, materialize, small, with_row, without
from .textscan import U, mixed, shingle_sets

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 5
BITS = 2
#: Standard deviations below the threshold at which an estimate still counts.
SLACK = 4.0
#: Members of a bucket that are compared in one block, and the shingles that they have together, but for a single longer one.
BLOCK, BLOCK_SHINGLES = 500, 1_000_000
#: Bytes of text whose sets are held at once, but for a single pair of blocks.
PORTION = 4 << 20

HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64
SLOT_MASK = int.from_bytes(b"\x55" * 8, "big")
FEATURES = "doc_id long, t1 long, t2 long, n_shingles long, key1 long, key2 long, bands array<long>, sig array<long>"


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = mixed(np.arange(1, HASHES + 1, dtype=U)) | U(1)
    shifts = mixed(np.arange(1001, 1001 + HASHES, dtype=U))
    turn = mixed(np.arange(2001, 2001 + ROWS, dtype=U)) | U(1)
    band_seeds = mixed(np.arange(3001, 3001 + BANDS, dtype=U))
    places = (np.arange(HASHES) % (64 // BITS) * BITS).astype(U)
    for batch in batches:
        sizes, keys, bands, sigs, filled = [], [], [], [], []
        for grams in shingle_sets(batch.column("text"), WORDS):
            sizes.append(len(grams))
            if not len(grams):
                keys.append((0, 0))
                continue
            filled.append(len(sizes) - 1)
            keys.append((int(np.sum(mixed(grams)).view(np.int64)), int(np.sum(mixed(grams ^ U(0x5851F42D4C957F2D))).view(np.int64))))
            low = np.full(HASHES, np.iinfo(U).max, dtype=U)
            for i in range(0, len(grams), 2048):
                np.minimum(low, (grams[None, i : i + 2048] * factors[:, None] + shifts[:, None]).min(axis=1), out=low)
            bands.append(mixed((low.reshape(BANDS, ROWS) * turn).sum(axis=1, dtype=U) ^ band_seeds))
            slots = (mixed(low) & U(2**BITS - 1)) << places
            sigs.append(np.bitwise_or.reduce(slots.reshape(LONGS, -1), axis=1))
        has = np.zeros(len(sizes), dtype=np.int64)
        has[filled] = 1
        lists = [
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * width)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, dtype=U), *rows]).view(np.int64)))
            for rows, width in ((bands, BANDS), (sigs, LONGS))
        ]
        key = np.array(keys, dtype=np.int64).reshape(-1, 2)
        carried = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(sizes, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), *lists], names=[*carried, "n_shingles", "key1", "key2", "bands", "sig"])


def least_matches() -> int:
    """Equal slots that a pair at the threshold has at least, but for SLACK standard deviations."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * PERCENT / 100
    return int(np.floor(HASHES * p - SLACK * np.sqrt(HASHES * p * (1 - p))))


def matches(a: str, b: str) -> Column:
    """Equal slots of two packed signatures of two bits a slot."""
    unlike = None
    for i in range(LONGS):
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        n = F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(SLOT_MASK)))
        unlike = n if unlike is None else unlike + n
    return F.lit(HASHES) - unlike


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets reach the threshold. Rows of one b follow each other, mostly."""
    for batch in batches:
        good, at, last = [], batch.column("b").to_pylist(), (None, None)
        texts = batch.column("text_b")
        for i, left in enumerate(shingle_sets(batch.column("text_a"), WORDS)):
            if last[0] != at[i]:
                last = at[i], next(shingle_sets(texts.slice(i, 1), WORDS))
            right = last[1]
            both = len(np.intersect1d(left, right, assume_unique=True))
            good.append(len(left) > 0 and 100 * both >= PERCENT * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def confirm(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes those whose full sets reach the threshold; texts: rep, text."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return materialize(in_arrow(both, confirmed, "a long, b long"), "minhash-links")


def texts_of(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of the classes of reps: the text of a row that is the class's first."""
    ids = materialize(classes.join(small(reps), "rep", "left_semi").select("rep", "first.*"), "minhash-ids")
    few, own = small(ids), digests(docs)
    same = [docs["doc_id"].cast("long").eqNullSafe(few["doc_id"]), own["t1"] == few["t1"], own["t2"] == few["t2"]]
    return docs.join(few, same).select(few["rep"], docs["text"]).groupBy("rep").agg(F.first("text").alias("text"))


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, of rows sorted by band and block pair."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([kept, rows]) if kept is not None else rows
        if not rows.num_rows:
            continue
        last = np.all([rows[c].to_numpy() == rows[c][-1].as_py() for c in ("band", "one", "two")], axis=0)
        begin = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if begin:
            yield rows.slice(0, begin)
        kept = rows.slice(begin)
    if kept is not None and kept.num_rows:
        yield kept


def likely(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within blocks, of different components, whose signatures may reach the threshold."""
    key = np.stack([rows[c].to_numpy() for c in ("band", "one", "two")])
    n = rows.num_rows
    cut = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
    ends = np.repeat(np.append(cut, n), np.diff(np.concatenate([[0], cut, [n]])))
    comp, block, across = (rows[c].to_numpy() for c in ("comp", "block", "across"))
    sig = np.asarray(rows["sig"].combine_chunks().flatten()).view(U).reshape(n, LONGS)
    at, d, least = np.arange(n), 1, least_matches()
    while len(at := at[at + d < ends[at]]):
        i = at[(comp[at] != comp[at + d]) & (~across[at] | (block[at] != block[at + d]))]
        x = sig[i] ^ sig[i + d]
        like = HASHES - np.bitwise_count((x | (x >> U(1))) & U(SLOT_MASK)).sum(axis=1, dtype=np.int64)
        i = i[like >= least]
        yield i, i + d
        d += 1


def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are in some likely pair of their block."""
    for rows in whole_blocks(batches):
        seen = np.zeros(rows.num_rows, dtype=bool)
        for i, j in likely(rows):
            seen[i] = seen[j] = True
        yield from rows.filter(pa.array(seen)).to_batches()


def portions(rows: pa.Table) -> Iterator[pa.Table]:
    """Slices of whole blocks with at most PORTION bytes of text, or one block."""
    key = np.stack([rows[c].to_numpy() for c in ("band", "one", "two")])
    ends = np.append(np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1, rows.num_rows)
    held = np.cumsum(pc.fill_null(pc.binary_length(rows["text"]), 0).to_numpy())[ends - 1]
    begin = before = 0
    while begin < rows.num_rows:
        first = int(np.searchsorted(ends, begin, "right"))
        last = max(first, int(np.searchsorted(held, before + PORTION, "right")) - 1)
        yield rows.slice(begin, int(ends[last]) - begin)
        begin, before = int(ends[last]), int(held[last])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) confirmed on full sets that span, block by block, what its members' links connect."""
    for rows in (part for table in whole_blocks(batches) for part in portions(table)):
        rep, comp = rows["rep"].to_pylist(), rows["comp"].to_pylist()
        sets = [set(g.tolist()) if len(g) <= 1000 else g for chunk in rows["text"].chunks for g in shingle_sets(chunk, WORDS)]
        band = np.stack([rows[c].to_numpy() for c in ("band", "one", "two")])
        first = np.concatenate([[0], np.cumsum(np.any(band[:, 1:] != band[:, :-1], axis=0))])
        up: dict[tuple[int, int], tuple[int, int]] = {}

        def root(x: tuple[int, int], up: dict = up) -> tuple[int, int]:
            while x in up:
                if up[x] in up:
                    up[x] = up[up[x]]
                x = up[x]
            return x

        found = []
        for left, right in likely(rows):
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                x, y = root((first[i], comp[i])), root((first[j], comp[j]))
                if x == y or not similar(sets[i], sets[j]):
                    continue
                up[x] = y
                found.append((rep[i], rep[j]))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def similar(x: set | np.ndarray, y: set | np.ndarray) -> bool:
    """Whether two sets of shingles, Python sets or sorted arrays, reach the threshold."""
    low, high = sorted((len(x), len(y)))
    if not low or 100 * low < PERCENT * high:
        return False
    if isinstance(x, set) and isinstance(y, set):
        both = len(x & y)
    else:
        x, y = (np.sort(np.fromiter(v, dtype=U, count=len(v))) if isinstance(v, set) else v for v in (x, y))
        both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (low + high - both)


def residual_links(docs: DataFrame, classes: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components that still share buckets. Only bucket members and spanning links are rows, never all pairs."""
    known = members.join(labels, "rep").select("band", "rep", "comp", "sig", "n_shingles")
    mixed_up = known.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("held")).filter("low <> high")
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES))).cast("int")
    known = known.join(mixed_up.select("band", blocks.alias("blocks")), "band")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    known = known.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = known.select("band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") != F.col("other")).alias("across"), "block", "rep", "comp", "sig")
    # A pair of blocks (i, j) with i <> j gets the rows of both; (i, i) those of one.
    dealt = known.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")
    found = materialize(in_arrow(dealt, suspects, known.schema), "minhash-suspects")
    full = found.join(texts_of(docs, classes, materialize(found.select("rep").distinct(), "minhash-reps")), "rep")
    full = full.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")
    links = materialize(in_arrow(full, linked, "a long, b long"), "minhash-residual")
    discard(found)
    return links


def link_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features of the rows; key1, key2, comp and component_id, the component and its smallest doc_id, of every shingle set)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], *[d.alias(k) for k, d in digests(docs).items()])
    features = materialize(in_arrow(rows, signatures, FEATURES), "minhash-features")
    classes = features.filter("n_shingles > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "t1", "t2")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialize(with_row(classes).withColumnRenamed("row", "rep"), "minhash-classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre <> last")
    members = materialize(banded.join(centres.select("band", "centre"), "band"), "minhash-members")
    sigs = classes.select("rep", "sig", "n_shingles")
    stars = members.filter("rep <> centre").select("rep", "centre").distinct()
    stars = stars.join(sigs.drop("n_shingles"), "rep").join(sigs.select(F.col("rep").alias("centre"), F.col("sig").alias("centre_sig")), "centre")
    stars = stars.select("rep", "centre", matches("sig", "centre_sig").alias("like")).filter(F.col("like") >= least_matches())
    best = stars.groupBy("rep").agg(F.max(F.struct("like", "centre")).alias("best"))
    tried = materialize(best.select(F.col("rep").alias("a"), F.col("best.centre").alias("b")), "minhash-stars")
    ends = materialize(tried.select(F.col("a").alias("rep")).union(tried.select("b")).distinct(), "minhash-reps")
    found = connected_components(confirm(texts_of(docs, classes, ends), tried))
    labels = materialize(sigs.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "sig", "n_shingles", F.coalesce("component", "rep").alias("comp")), "minhash-labels")
    more = residual_links(docs, classes, members, labels)
    discard(members, tried, ends)
    comps = labels.select("rep", "comp")
    if more.limit(1).count():
        links = more.join(comps.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(comps.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
        merged = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        comps = comps.join(merged.select(F.col("id").alias("comp"), F.col("component").alias("into")), "comp", "left").select("rep", F.coalesce("into", "comp").alias("comp"))
    known = materialize(classes.select("key1", "key2", "rep", "low").join(comps, "rep").select("key1", "key2", "low", "comp"), "minhash-components")
    lowest = known.groupBy("comp").agg(F.min("low").alias("component_id"))
    return features, known.join(lowest, "comp").select("key1", "key2", "comp", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (digests of the text), n_shingles, comp (null without words) and component_id of every row of docs."""
    features, comps = link_components(docs)
    out = features.select("doc_id", "t1", "t2", "n_shingles", "key1", "key2").join(comps, ["key1", "key2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "t1", "t2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("comp")).alias("comp"), component.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return components(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, less those of a component that are not its first by doc_id (rows without one come last)."""
    rows = materialize(components(docs).filter("comp IS NOT NULL").select("doc_id", "t1", "t2", "comp"), "minhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    firsts = materialize(rows.groupBy("comp").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("comp", "first"), "minhash-firsts")
    grouped = rows.join(small(firsts), "comp").select("doc_id", "t1", "t2", (order == F.col("first")).alias("is_first"))
    grouped = materialize(grouped.groupBy("doc_id", "t1", "t2", "is_first").agg(F.count("*").alias("n")), "minhash-grouped")
    left = without(docs, grouped.filter("NOT is_first"), by_id=True)
    again = grouped.filter("is_first AND n > 1")
    if not again.limit(1).count():
        return left
    # Rows that repeat the first one: one of them stays.
    one = without(left, again, by_id=True, how="left_semi").withColumns({f"minhash_{k}": d for k, d in digests(docs).items()})
    one = one.withColumn("minhash_id", docs["doc_id"]).dropDuplicates(["minhash_id", "minhash_t1", "minhash_t2"]).select(*docs.columns)
    return without(left, again, by_id=True).unionByName(one)
