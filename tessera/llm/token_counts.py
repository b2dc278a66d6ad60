"""Token counts of documents in flat token files without an index, by scanning for end-of-document identifiers.

A flat file is a sequence of token numbers of fixed width, each document closed by a separator. It is
held as blocks (file, block, payload) of at most BLOCK_TOKENS tokens, cut without regard to documents.
The scan views each block as a NumPy array and finds all separators at once. Boundaries are stitched by
a prefix scan over one small row a block (tokens, separators, place of the last separator): it gives
each block its place in the file, the ordinal of its first document and the last separator before it,
so a document may span any number of blocks. Only these rows are ordered by file; the places of
separators stay in their block's row.

Defined results: a null or empty text has 0 tokens; tokens after the last separator of a file are one
more document; special-token strings in texts are ordinary text; a null doc_id stays null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as file_systems
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 18

_encodings: dict[int, tiktoken.Encoding] = {}


def encoding(ranks: bytes) -> tiktoken.Encoding:
    key = hash(ranks)
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def width_of(separator: int) -> int:
    """Bytes of a token: two while the separator, the largest one, fits."""
    return 2 if separator < 1 << 16 else 4


def writer(ranks, separator: int, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of blocks, and rows (payload null) with the doc_ids of the file's documents in order."""
    kind = f"<u{width_of(separator)}"
    names = ["file", "block", "payload", "doc_ids"]

    def row(file: str, block: int, payload: bytes | None, ids: list | None) -> pa.RecordBatch:
        columns = [pa.array([file], pa.string()), pa.array([block], pa.int64()), pa.array([payload], pa.binary()), pa.array([ids], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoding(ranks.value).encode_ordinary, str(TaskContext.get().partitionId())
        block, documents, held, n = 0, 0, [], 0
        for batch in batches:
            for text in batch.column("text"):
                tokens = np.array([*encode(text.as_py() or ""), separator], dtype=kind)
                while n + len(tokens) >= block_tokens:
                    cut = block_tokens - n
                    yield row(file, block, np.concatenate([*held, tokens[:cut]]).tobytes(), None)
                    block, held, n, tokens = block + 1, [], 0, tokens[cut:]
                if len(tokens):
                    held.append(tokens)
                    n += len(tokens)
            yield row(file, documents, None, batch.column("doc_id").to_pylist())
            documents += batch.num_rows
        if n:
            yield row(file, block, np.concatenate(held).tobytes(), None)

    return write


def write_flat(docs: DataFrame, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(blocks of flat token files: file, block, payload; order of their documents: file, ordinal, doc_id)."""
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    made = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(writer(ranks, separator, block_tokens), "file string, block long, payload binary, doc_ids array<long>")
    made = materialize(made, "flat-tokens")
    order = made.filter("doc_ids IS NOT NULL").select("file", F.col("block").alias("first"), F.posexplode("doc_ids").alias("at", "doc_id"))
    return made.filter("payload IS NOT NULL").select("file", "block", "payload"), order.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")


def read_flat(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw token files, each read by its place in the file: a file may have any size, and is one file to itself.

    Files are listed by Spark and read by pyarrow's file systems (a local or mounted folder, HDFS, S3, GCS).
    Bytes after the last whole token are no token.
    """
    wide, names = width_of(separator), ["file", "block", "payload"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.floor(F.col("length") / wide).alias("tokens"))
    blocks = files.filter("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, where = file_systems.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", row["file"]), safe=":/@"))
                first = row["block"] * block_tokens
                with system.open_input_file(where) as f:
                    payload = f.read_at(min(block_tokens, row["tokens"] - first) * wide, first * wide)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([payload], pa.binary())], names=names)

    return blocks.repartition("file", "block").mapInArrow(read, "file string, block long, payload binary")


def separators(separator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = f"<u{width_of(separator)}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [np.frombuffer(x.as_buffer(), dtype=kind) for x in batch.column("payload")]
            found = [np.flatnonzero(b == separator) for b in blocks]
            columns = [batch.column("file"), batch.column("block"), pa.array([len(b) for b in blocks], pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "tokens", "places"])

    return scan


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """file, ordinal and n_tokens of every document of the files."""
    found = materialize(blocks.select("file", "block", "payload").mapInArrow(separators(separator), "file string, block long, tokens long, places array<long>"), "separators")
    rows = found.select("file", "block", "tokens", F.size("places").cast("long").alias("documents"), F.element_at(F.when(F.size("places") > 0, F.col("places")), -1).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"base": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "first": F.coalesce(F.sum("documents").over(before), F.lit(0))})
    placed = placed.withColumn("ended", F.coalesce(F.max(F.col("base") + F.col("last")).over(before), F.lit(-1)))
    joined = found.select("file", "block", "places").join(placed, ["file", "block"]).filter("documents > 0")
    each = joined.select("file", "first", "base", "ended", "places", F.posexplode("places").alias("at", "place"))
    previous = F.when(F.col("at") > 0, F.col("base") + F.get("places", F.col("at") - 1)).otherwise(F.col("ended"))
    closed = each.select("file", (F.col("first") + F.col("at")).alias("ordinal"), (F.col("base") + F.col("place") - previous - 1).alias("n_tokens"))
    whole = placed.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("ordinal"), F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(-1)).alias("ended"))
    return closed.union(whole.filter("ended + 1 < tokens").select("file", "ordinal", F.expr("tokens - ended - 1")))


def document_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of every row of docs, counted in the flat files written from them."""
    blocks, order = write_flat(docs, tokenizer, separator, block_tokens)
    return order.join(count_tokens(blocks, separator), ["file", "ordinal"]).select("doc_id", "n_tokens")
