"""Verbatim benchmark passages in training documents, found with suffix arrays of the training text.

1. One pass over the texts, whatever the benchmark's size: a document's runs of words in which every
   adjacent pair of words occurs in some item, and which are long enough for a window, are its passages.
   What is left out can match no window. The pairs are a bitmap of at most PAIR_BITS bits, in which
   hashes may clash: that lets more through, and loses nothing. Passages are a small table of their own.
2. Every Arrow batch of passages is a shard. Its words become numbers of the benchmark's vocabulary, by
   the words themselves, and all suffixes of its passages are sorted to full depth into a suffix array (prefix
   doubling). Every distinct benchmark suffix that begins with a pair of the shard is binary-searched, to the depth of its window;
   the interval between its bounds holds all its verbatim occurrences. For the longest matches the places that no
   earlier word continues are searched, to full depth, among the sorted suffixes of their window: the neighbours
   there have the most in common with the text. So items that share a passage cost no more than their number's logarithm.

The benchmark is a query set. It is broadcast in blocks of about BLOCK_BYTES of text (a longer item is a
block of its own); each block takes a pass over the passages, not over the documents.

Defined results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; a null
text has no words; an item without words or without an id has no windows; repeated items count once
each id; extra columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digests, in_arrow, materialize, small, with_row, without
from .textscan import ALNUM, LOWER, U, mixed, pieces, words

WINDOW = 10
BLOCK_BYTES = 2_000_000
#: Bits of the bitmaps: 16 a pair, and no more than 64 MB.
PAIR_BITS = 1 << 29
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGES = "row long, doc_id long, t1 long, t2 long, n_words long, at array<long>, passages array<string>"
#: Documents with hits that a search hands on at a time.
HANDED = 256
FOUND = "row long, spans array<long>, items array<string>, n_items long, items_sha256 string, longest long, longest_at long, longest_item string"
RESULT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at", "longest_item")


def pair_codes(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    return mixed(left * U(0xD6E8FEB86659FD93) + right) & U(bits - 1)


def marked(codes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, dtype=np.uint8)
    np.bitwise_or.at(out, (codes >> U(3)).astype(np.int64), np.uint8(1) << (codes & U(7)).astype(np.uint8))
    return out


def has(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (bitmap[(codes >> U(3)).astype(np.int64)] >> (codes & U(7)).astype(np.uint8)) & 1 > 0


def pair_filter(texts: Iterator[str], total_bytes: int) -> dict:
    """Bitmaps of the pairs of words of all items, and of the words or pairs with which short items begin, by their length."""
    bits = min(PAIR_BITS, max(1 << 16, 1 << (16 * (total_bytes // 4)).bit_length()))
    pairs, starts, long = np.zeros(bits // 8, dtype=np.uint8), {}, False
    held: list[str] = []

    def add() -> None:
        nonlocal long
        for first, end, data, offsets in pieces(pa.array(held, pa.string())):
            hashes, _, ranges = words(data, offsets, ALNUM)
            sizes = np.diff(ranges)
            inside = np.ones(max(0, len(hashes) - 1), dtype=bool)
            cut = ranges[1:-1]
            inside[cut[(cut > 0) & (cut < len(hashes))] - 1] = False
            np.bitwise_or(pairs, marked(pair_codes(hashes[:-1], hashes[1:], bits)[inside], bits), out=pairs)
            long = long or bool((sizes >= WINDOW).any())
            for n in np.unique(sizes[(sizes > 0) & (sizes < WINDOW)]):
                at = ranges[:-1][sizes == n]
                second = hashes[at + 1] if n > 1 else np.zeros(len(at), dtype=U)
                starts.setdefault(int(n), set()).update(pair_codes(hashes[at], second, bits).tolist())
        held.clear()

    for text in texts:
        held.append(text)
        if len(held) >= 4096:
            add()
    if held:
        add()
    return {"bits": bits, "pairs": pairs, "long": long, "starts": {n: np.array(sorted(s), dtype=U) for n, s in starts.items()}}


def passages_of(broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = broadcast.value
        bits = known["bits"]
        for batch in batches:
            sizes, at, texts = [], [], []
            for first, end, data, offsets in pieces(batch.column("text")):
                hashes, begins, ranges = words(data, offsets, ALNUM)
                sizes += np.diff(ranges).tolist()
                at += [[] for _ in range(end - first)]
                texts += [[] for _ in range(end - first)]
                n = len(hashes)
                if not n:
                    continue
                row = np.repeat(np.arange(end - first), np.diff(ranges))
                linked = np.zeros(n, dtype=bool)
                linked[:-1] = has(known["pairs"], pair_codes(hashes[:-1], hashes[1:], bits)) & (row[:-1] == row[1:])
                # Words from each place on whose pairs are all known.
                stop = np.where(linked, n, np.arange(n))
                run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n) + 1
                begin = (run >= WINDOW) if known["long"] else np.zeros(n, dtype=bool)
                for length, codes in known["starts"].items():
                    maybe = np.flatnonzero(run >= length)
                    second = hashes[maybe + 1] if length > 1 else np.zeros(len(maybe), dtype=U)
                    begin[maybe[np.isin(pair_codes(hashes[maybe], second, bits), codes)]] = True
                reach = 0
                for p in np.flatnonzero(begin).tolist():
                    if p < reach:
                        continue
                    reach, r = p + int(run[p]), int(row[p])
                    last = int(begins[reach]) if reach < ranges[r + 1] else int(offsets[r + 1])
                    at[first + r].append(p - int(ranges[r]))
                    texts[first + r].append(data[begins[p] : last].tobytes().decode("utf-8", "replace"))
            carried = [batch.column(c) for c in ("row", "doc_id", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(sizes, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))], names=["row", "doc_id", "t1", "t2", "n_words", "at", "passages"])

    return scan


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER.tobytes()))


def build_index(items: list[tuple[str, str]]) -> dict:
    """The words of the items as numbers (0 between items), and their suffixes grouped by their first window, each group sorted to full depth.

    items come by name, so that a smaller number is a smaller name. before is the one word, if there is one, that stands before all
    suffixes of a group (else -1), and held the number of the group's set of items in sets.
    """
    split = [words_of(t) for _, t in items]
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in split for w in x}))}
    lengths = np.array([len(x) for x in split], dtype=np.int64)
    test = np.array([n for x in split for n in (*(vocabulary[w] for w in x), 0)], dtype=np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    item = np.repeat(np.arange(len(items)), lengths + 1)
    depth = np.minimum(WINDOW, lengths)[item] if len(items) else lengths
    starts = np.flatnonzero((np.arange(len(test)) - first[item] + depth <= lengths[item]) & (depth > 0)) if len(items) else lengths
    padded = np.concatenate([test, np.zeros(WINDOW, dtype=np.int64)])
    place = np.empty(len(test), dtype=np.int64)
    place[suffix_array(test, int(lengths.max()) + 1 if len(items) else 1)] = np.arange(len(test))
    rows = padded[starts[:, None] + np.arange(WINDOW)] * (np.arange(WINDOW) < depth[starts][:, None])
    _, which = np.unique(np.column_stack([rows, depth[starts]]), axis=0, return_inverse=True) if len(starts) else (None, np.zeros(0, dtype=np.int64))
    which = which.ravel()
    order = np.lexsort((place[starts], which))
    begin = np.searchsorted(which[order], np.arange(int(which.max()) + 2 if len(starts) else 1))
    suffixes = starts[order]
    sets: dict[bytes, int] = {}
    held, before = np.zeros(len(begin) - 1, dtype=np.int64), np.full(len(begin) - 1, -1, dtype=np.int64)
    for k, (i, j) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        own = suffixes[i:j]
        held[k] = sets.setdefault(np.unique(item[own]).tobytes(), len(sets))
        words_before = np.unique(np.where(own > 0, test[own - 1], 0))
        if len(words_before) == 1 and words_before[0] > 0:
            before[k] = words_before[0]
    return {
        "vocabulary": vocabulary, "names": [n for n, _ in items], "test": padded, "item": item, "depth": depth, "suffixes": suffixes, "begin": begin,
        "before": before, "held": held, "sets": [np.frombuffer(x, dtype=np.int64) for x in sets],
    }


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text in the order of the suffixes that begin there, compared over depth numbers at least, by prefix doubling."""
    rank, k, n = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1, len(text)
    order = np.argsort(rank, kind="stable")
    while k < depth and n and rank.max() < n:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]]))
        k *= 2
    return order


def bounds(array: np.ndarray, text: np.ndarray, test: np.ndarray, starts: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each test suffix, taken to its depth, the interval of the suffixes that begin with it: a binary search of all at once."""
    sides = []
    for upper in (False, True):
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(array), dtype=np.int64)
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go]) // 2
            sign, same, at = np.zeros(len(go), dtype=np.int64), np.arange(len(go)), array[mid]
            for d in range(WINDOW):
                same = same[depth[go[same]] > d]
                apart = np.sign(text[at[same] + d] - test[starts[go[same]] + d])
                sign[same] = apart
                same = same[apart == 0]
            right = sign <= 0 if upper else sign < 0
            low[go[right]] = mid[right] + 1
            high[go[~right]] = mid[~right]
        sides.append(low)
    return sides[0], sides[1]


def occurrences(index: dict, text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of all occurrences in a shard's text, padded by zeros, whose passages have at most longest words."""
    none = np.zeros(0, dtype=np.int64)
    windows = index["suffixes"][index["begin"][:-1]] if len(index["suffixes"]) else none
    if not len(windows) or len(text) <= WINDOW:
        return none, none
    test, depth = index["test"], index["depth"][windows]
    n, wide = len(text) - WINDOW, len(index["vocabulary"]) + 1
    # Suffixes that begin with a word or, longer than one word, with a pair that the shard does not have are not looked for.
    here = np.isin(test[windows], text[:n]) & ((depth < 2) | np.isin(test[windows] * wide + test[windows + 1], text[:n] * wide + text[1 : n + 1]))
    asked = np.flatnonzero(here)
    array = suffix_array(text[:n], longest)
    low, high = bounds(array, text, test, windows[asked], depth[asked])
    many = high - low
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return np.repeat(asked, many), array[place]


def common(text: np.ndarray, test: np.ndarray, p: np.ndarray, s: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from each place p of text on equal those from s of test on, most at most. No word (0) equals nothing."""
    size, go, wide = np.zeros(len(p), dtype=np.int64), np.flatnonzero(most > 0), 8
    while len(go):
        k = size[go, None] + np.arange(wide)
        inside = k < most[go, None]
        x, y = (a[np.minimum(b[go, None] + k, len(a) - 1)] for a, b in ((text, p), (test, s)))
        same = inside & (x == y) & (x > 0)
        n = np.where(same.all(axis=1), wide, same.argmin(axis=1))
        size[go] += n
        go = go[n == wide]
        wide = max(8, min(2 * wide, (1 << 20) // max(1, len(go))))
    return size


def searched(index: dict, text: np.ndarray, window: np.ndarray, place: np.ndarray, most: np.ndarray, after: bool = False) -> np.ndarray:
    """Where in the sorted suffixes of its window each place's text, cut after most words, belongs: before the suffixes that begin with it, or after them. A binary search of all at once."""
    low, high = index["begin"][window].copy(), index["begin"][window + 1].copy()
    while len(go := np.flatnonzero(low < high)):
        mid = (low[go] + high[go]) // 2
        s = index["suffixes"][mid]
        n = common(text, index["test"], place[go], s, most[go])
        x = text[np.minimum(place[go] + n, len(text) - 1)]
        over = (n >= most[go]) | (x == 0)  # all of it is in the suffix
        right = np.where(over, after, index["test"][np.minimum(s + n, len(index["test"]) - 1)] < x)
        low[go[right]] = mid[right] + 1
        high[go[~right]] = mid[~right]
    return low


def longest_matches(index: dict, text: np.ndarray, owner: np.ndarray, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, words, item) of the longest verbatim match of each owner; of equals the first place, then the first item.

    A place is searched to full depth among the sorted suffixes of its window, of which its neighbours have the most in common with
    it. Places at which all these suffixes go on from one word before, which the text has too, are within a longer match.
    """
    told = index["before"][window]
    begins = (told < 0) | (place == 0) | (text[place - 1] != told)
    window, place = window[begins], place[begins]
    own, whole = owner[place], np.full(len(place), len(text), dtype=np.int64)
    at = searched(index, text, window, place, whole)
    size = np.zeros(len(place), dtype=np.int64)
    for near in (at - 1, at):
        inside = np.flatnonzero((near >= index["begin"][window]) & (near < index["begin"][window + 1]))
        size[inside] = np.maximum(size[inside], common(text, index["test"], place[inside], index["suffixes"][near[inside]], whole[inside]))
    order = np.lexsort((place, -size, own))
    order = order[np.flatnonzero(np.diff(own[order], prepend=-1))]
    own, window, place, size = own[order], window[order], place[order], size[order]
    low, high = (searched(index, text, window, place, size, after) for after in (False, True))
    item = [int(index["item"][index["suffixes"][a:b]].min()) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    return own, place, size, np.array(item, dtype=np.int64)


def told(names: list[str]) -> tuple[int, str]:
    return len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def searcher(broadcast, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """whole: the benchmark is one block, so that items are told by number and digest, and not listed."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        for batch in batches:
            numbers, owner, doc_place, longest = [], [], [], 1
            for r, (at, passages) in enumerate(zip(batch.column("at").to_pylist(), batch.column("passages").to_pylist(), strict=True)):
                for p, passage in zip(at, passages, strict=True):
                    own = [index["vocabulary"].get(w, 0) for w in words_of(passage)]
                    longest = max(longest, len(own))
                    numbers += [*own, 0]
                    owner.append(np.full(len(own) + 1, r))
                    doc_place.append(np.arange(p, p + len(own) + 1))
            text = np.array(numbers + [0] * WINDOW, dtype=np.int64)
            owner, doc_place = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (owner, doc_place))
            window, place = occurrences(index, text, longest)
            if not len(place):
                continue
            depth = index["depth"][index["suffixes"][index["begin"][window]]]
            spans: dict[int, list] = {}
            for r, p, n in zip(owner[place].tolist(), doc_place[place].tolist(), depth.tolist(), strict=True):
                spans.setdefault(r, []).append((p, p + n))
            sets: dict[int, list] = {}
            for r, k in np.unique(np.stack([owner[place], index["held"][window]]), axis=1).T.tolist():
                sets.setdefault(r, []).append(k)
            own, at, size, item = longest_matches(index, text, owner, window, place)
            known: dict[tuple, tuple] = {}
            for begin in range(0, len(own), HANDED):
                rows = own[begin : begin + HANDED].tolist()
                listed = []
                for r in rows:
                    key = tuple(sets[r])
                    if key not in known or not whole:
                        names = sorted({index["names"][i] for i in np.unique(np.concatenate([index["sets"][k] for k in key])).tolist()})
                        known = known if whole else {}
                        known[key] = ([], *told(names)) if whole else (names, None, None)
                    listed.append(known[key])
                part = slice(begin, begin + HANDED)
                columns = [
                    batch.column("row").take(pa.array(rows, pa.int64())), pa.array([united(spans[r]) for r in rows], pa.list_(pa.int64())), *(pa.array([x[k] for x in listed], t) for k, t in enumerate((pa.list_(pa.string()), pa.int64(), pa.string()))),
                    pa.array(size[part]), pa.array(doc_place[at[part]]), pa.array([index["names"][i] for i in item[part].tolist()], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "spans", "items", "n_items", "items_sha256", "longest", "longest_at", "longest_item"])

    return search


def united(spans: list[tuple[int, int]]) -> list[int]:
    """first, end, first, end, ... of the union of spans."""
    out: list[int] = []
    for first, end in sorted(spans):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites what the blocks of the benchmark found in a document, a document at a time."""
    for batch in batches:
        spans, counts, digests_, hit = [], [], [], []
        for k in range(batch.num_rows):
            x = batch.column("spans")[k].as_py()
            spans.append(united(list(zip(x[::2], x[1::2], strict=True))))
            hit.append(sum(spans[-1][1::2]) - sum(spans[-1][::2]))
            n, digest = batch.column("n_items")[k].as_py(), batch.column("items_sha256")[k].as_py()
            n, digest = (n, digest) if digest else told(sorted(set(batch.column("items")[k].as_py())))
            counts.append(n)
            digests_.append(digest)
        columns = [batch.column("row"), pa.array(hit, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests_, pa.string()), *(batch.column(c) for c in ("longest", "longest_at", "longest_item")), pa.array(spans, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_hit", "n_items", "items_sha256", "longest", "longest_at", "longest_item", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The hits of every row of docs: RESULT, spans (first and end words of what is hit) and t1, t2 (digests of the text)."""
    spark = docs.sparkSession
    items = materialize(benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"]).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct(), "benchmark-items")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    known = spark.sparkContext.broadcast(pair_filter((r.text for r in items.select("text").toLocalIterator()), size))
    rows = with_row(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], *[d.alias(k) for k, d in digests(docs).items()]))
    base = materialize(in_arrow(rows, passages_of(known), PASSAGES), "passages")
    some = base.filter(F.size("at") > 0).select("row", "at", "passages")
    blocks, found = max(1, -(-size // BLOCK_BYTES)), None
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(build_index(sorted(tuple(r) for r in part.toLocalIterator())))
        own = in_arrow(some, searcher(index, blocks == 1), FOUND)
        own = own if blocks == 1 else materialize(own, "passages-found")
        found = own if found is None else found.union(own)
    if blocks > 1:
        best = F.min(F.struct((-F.col("longest")).alias("n"), "longest_at", "longest_item")).alias("best")
        found = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), best)
        found = found.select("row", "spans", "items", F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"), (-F.col("best.n")).alias("longest"), "best.longest_at", "best.longest_item")
    done = materialize(in_arrow(found, finished, "row long, n_hit long, n_items long, items_sha256 string, longest long, longest_at long, longest_item string, spans array<long>"), "passages-done")
    out = base.select("row", "doc_id", "t1", "t2", "n_words").join(small(done, SMALL_ROWS), "row", "left")
    none = {"n_hit": F.lit(0), "n_items": F.lit(0), "longest": F.lit(0), "items_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": F.array().cast("array<bigint>")}
    out = out.withColumn("contaminated", F.col("n_hit").isNotNull()).withColumns({c: F.coalesce(c, x) for c, x in none.items()})
    return out.select(*RESULT, "spans", "t1", "t2")


#: Rows with hits up to which they are broadcast: some hundred bytes each.
SMALL_ROWS = 100_000


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text has no hit."""
    return without(docs, contamination(docs, benchmark).filter("contaminated").select("t1", "t2"))
