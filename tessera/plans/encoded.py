"""A registered query of compressed images, drawn from the embeddings, and the writer of such files that it and the tests use."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import driver_tables as tables
from ..sources import encapsulated, files
from .registry import query


def element(group: int, number: int, vr: bytes, value: bytes) -> bytes:
    value += b"\0" * (len(value) % 2)
    if vr in files.LONG_FORM:
        return struct.pack("<HH2sHI", group, number, vr, 0, len(value)) + value
    return struct.pack("<HH2sH", group, number, vr, len(value)) + value


def image_file(syntax: bytes, image: np.ndarray, pixel_data: bytes | list[bytes], bits: int = 16, signed: bool = False, count: int = 1) -> bytes:
    """A file of an image (rows x columns x samples); a list has the fragments of compressed pixel data, the table of frames first."""
    rows, columns, samples = image.shape
    out = bytes(128) + b"DICM" + element(2, 0x10, b"UI", syntax)
    numbers = {0x02: samples, 0x10: rows, 0x11: columns, 0x100: bits, 0x103: int(signed)}
    heads = [element(0x28, n, b"US", struct.pack("<H", v)) for n, v in numbers.items()]
    heads.insert(1, element(0x28, 0x08, b"IS", str(count).encode()))
    out += b"".join(heads)
    if isinstance(pixel_data, bytes):
        return out + element(0x7FE0, 0x10, b"OW", pixel_data)
    out += struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, 0xFFFFFFFF)
    for part in pixel_data:
        part += b"\0" * (len(part) % 2)
        out += encapsulated.ITEM + struct.pack("<I", len(part)) + part
    return out + encapsulated.ITEMS_END + bytes(4)


def packed(plane: bytes) -> bytes:
    """Bytes as runs: repeats of 3 and more, literals between."""
    out, literal, at = bytearray(), bytearray(), 0

    def flush() -> None:
        for k in range(0, len(literal), 128):
            out.extend([len(literal[k : k + 128]) - 1, *literal[k : k + 128]])
        literal.clear()

    while at < len(plane):
        n = 1
        while n < 128 and at + n < len(plane) and plane[at + n] == plane[at]:
            n += 1
        if n > 2:
            flush()
            out += bytes([257 - n, plane[at]])
        else:
            literal.extend(plane[at : at + n])
        at += n
    flush()
    return bytes(out) + b"\x80" * (len(out) % 2)


def run_length(image: np.ndarray, width: int) -> bytes:
    """An image (rows x columns x samples) as planes of packed bytes, the most significant first."""
    planes = [packed(((image[..., s].astype(np.int64) >> (8 * b)) & 255).astype(np.uint8).tobytes()) for s in range(image.shape[2]) for b in reversed(range(width))]
    begins = np.cumsum([64, *map(len, planes)])[:-1].tolist()
    return struct.pack("<16I", len(planes), *begins, *[0] * (15 - len(begins))) + b"".join(planes)


def guesses(image: np.ndarray, selector: int, first: int) -> np.ndarray:
    """The prediction of every sample of an image (rows x columns)."""
    a, b, c = np.roll(image, 1, 1), np.roll(image, 1, 0), np.roll(image, (1, 1), (0, 1))
    out = {1: a, 2: b, 3: c, 4: a + b - c, 5: a + ((b - c) >> 1), 6: b + ((a - c) >> 1), 7: (a + b) >> 1}[selector].copy()
    out[:, 0] = b[:, 0]
    out[0] = a[0]
    out[0, 0] = first
    return out


def lossless_jpeg(image: np.ndarray, selector: int, precision: int = 16, shift: int = 0, strip: int = 0) -> bytes:
    """An image (rows x columns) as lossless JPEG; strip: rows to a restart. All 17 sizes have codes of 5 bits."""
    rows, columns = image.shape
    out = encapsulated.IMAGE_BEGIN + struct.pack(">BBHBHHBBBB", 0xFF, encapsulated.FRAME, 11, precision, rows, columns, 1, 1, 0x11, 0)
    out += struct.pack(">BBHB16s17s", 0xFF, encapsulated.TABLES, 36, 0, bytes([0, 0, 0, 0, 17, *[0] * 11]), bytes(range(17)))
    if strip:
        out += struct.pack(">BBHH", 0xFF, encapsulated.RESTARTS, 4, strip * columns)
    out += struct.pack(">BBHBBBBBB", 0xFF, encapsulated.SCAN, 8, 1, 1, 0, selector, 0, shift)
    for k, y in enumerate(range(0, rows, strip or rows)):
        part = image[y : y + (strip or rows)].astype(np.int64) >> shift
        change = (part - guesses(part, selector, 1 << (precision - shift - 1)) + 32767) % 65536 - 32767
        bits = []
        for v in change.reshape(-1).tolist():
            size = abs(v).bit_length()
            bits.append(f"{size:05b}" + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if 0 < size < 16 else ""))
        line = "".join(bits)
        line += "1" * (-len(line) % 8)
        coded = int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\x00")
        out += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + coded
    return out + encapsulated.IMAGE_END


#: Rows and columns of the images of compressed_pixels.
SHAPE = (8, 8)


def encoded(kind: int, values: np.ndarray) -> bytes:
    """A file of a vector's image: plain, run-length coded or lossless JPEG by one of the seven predictions, by number."""
    image = values.reshape(*SHAPE, 1)
    if kind % 3 == 0:
        return image_file(encapsulated.PLAIN[2], image, image.astype("<u2").tobytes())
    if kind % 3 == 1:
        return image_file(encapsulated.RUN_LENGTH, image, [b"", run_length(image, 2)])
    return image_file(encapsulated.LOSSLESS_JPEG[1], image, [b"", lossless_jpeg(image[..., 0], kind % 7 + 1)])


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding[1:64], lambda c: floor(c::DOUBLE * 8000)::BIGINT + 32768) AS px FROM embeddings)
SELECT vec_id, ['plain', 'run-length', 'lossless JPEG'][vec_id % 3 + 1] AS kind, len(px)::BIGINT AS n, list_min(px) AS least, list_max(px) AS most,
list_sum(list_transform(px, lambda p, i: p * i))::BIGINT AS weighed FROM v"""
)
def compressed_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as an image of 16 bits in a file, compressed in a way of its own, and read again."""
    e = tables.read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, SHAPE[0] * SHAPE[1]), lambda c: F.floor(c.cast("double") * 8000) + 32768).alias("px"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "content": [encoded(k, np.asarray(px)) for k, px in zip(pdf["vec_id"], pdf["px"], strict=True)]})

    read = e.mapInPandas(write, "vec_id long, content binary").withColumn("px", files.pixels(F.col("content")))
    weighed = F.aggregate(F.transform("px", lambda p, i: p * (i + 1)), F.lit(0).cast("long"), lambda acc, v: acc + v)
    kind = F.get(F.array(*map(F.lit, ("plain", "run-length", "lossless JPEG"))), (F.col("vec_id") % 3).cast("int"))
    return read.select("vec_id", kind.alias("kind"), F.size("px").cast("long").alias("n"), F.array_min("px").cast("long").alias("least"), F.array_max("px").cast("long").alias("most"), weighed.alias("weighed"))
