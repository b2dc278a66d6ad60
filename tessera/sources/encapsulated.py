"""Compressed pixel data: the fragments of an image file, run-length coding and lossless JPEG, decoded with NumPy.

Run-length coding has a plane of packed bytes for each byte of a sample. Lossless JPEG has Huffman-coded differences
from one of seven predictions; only images of one component are decoded. What is broken or of another kind
raises ValueError.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Fixed values of the format: transfer syntaxes, and the tags that delimit fragments.
RUN_LENGTH = b"1.2.840.10008.1.2.5"
LOSSLESS_JPEG = (b"1.2.840.10008.1.2.4.57", b"1.2.840.10008.1.2.4.70")
PLAIN = (b"", b"1.2.840.10008.1.2", b"1.2.840.10008.1.2.1")
ITEM, ITEMS_END = b"\xfe\xff\x00\xe0", b"\xfe\xff\xdd\xe0"
#: Fixed values of lossless JPEG: markers.
FRAME, TABLES, RESTARTS, SCAN, IMAGE_BEGIN, IMAGE_END = 0xC3, 0xC4, 0xDD, 0xDA, b"\xff\xd8", b"\xff\xd9"
OTHER_FRAMES = frozenset(range(0xC0, 0xD0)) - {FRAME, TABLES, 0xC8, 0xCC}


def frames(data: bytes, first: int, count: int) -> list[bytes]:
    """The compressed frames of pixel data whose items begin at first: a table of offsets, then fragments.

    One frame has all fragments; else each fragment is a frame, or the table says where frames begin.
    """
    items, places, at = [], [], first
    while data[at : at + 4] != ITEMS_END:
        length = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] != ITEM or at + 8 + length > len(data):
            raise ValueError("broken fragment")
        items.append(data[at + 8 : at + 8 + length])
        places.append(at)
        at += 8 + length
    if len(items) < 2:
        raise ValueError("no fragments")
    table, parts = np.frombuffer(items[0], "<u4"), items[1:]
    if count == 1:
        return [b"".join(parts)]
    if len(parts) == count:
        return parts
    if len(table) != count:
        raise ValueError("fragments without a table of frames")
    owner = np.searchsorted(table, np.array(places[1:]) - places[1], "right") - 1
    return [b"".join(p for p, o in zip(parts, owner, strict=True) if o == k) for k in range(count)]


def unpacked(packed: bytes, n: int) -> bytes:
    """n bytes of literal and repeated runs."""
    out, at = bytearray(), 0
    while len(out) < n:
        if at >= len(packed):
            raise ValueError("run-length data end early")
        head = packed[at]
        if head < 128:
            out += packed[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            if head > 128:
                out += packed[at + 1 : at + 2] * (257 - head)
            at += 2 if head > 128 else 1
    return bytes(out[:n])


def run_length(frame: bytes, n: int, samples: int, width: int) -> np.ndarray:
    """n pixels of so many samples of width bytes each, the samples of a pixel side by side."""
    if len(frame) < 64:
        raise ValueError("run-length data without header")
    planes, *begins = np.frombuffer(frame, "<u4", 16).tolist()
    if planes != samples * width or planes > 15:
        raise ValueError("run-length planes do not fit the image")
    values = np.zeros((n, samples), np.uint32)
    for k, (begin, end) in enumerate(zip(begins[:planes], [*begins[1:planes], len(frame)], strict=True)):
        plane = np.frombuffer(unpacked(frame[begin:end], n), np.uint8)
        values[:, k // width] = (values[:, k // width] << 8) | plane
    return values.reshape(-1)


def huffman(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits the length of the code that they begin with (0: none), and its value."""
    lengths, found, at, taken = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
    for length, count in enumerate(counts, 1):
        for value in values[taken : taken + count]:
            end = at + (1 << (16 - length))
            lengths[at:end], found[at:end], at = length, value, end
        taken += count
    if at > 1 << 16 or found.max() > 16:
        raise ValueError("broken Huffman table")
    return lengths, found


def differences(coded: bytes, table: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """n coded differences. Lengths are looked up at every bit at once; only the steps from code to code are a loop."""
    held = np.frombuffer(coded + bytes(8), np.uint8).astype(np.int64)
    words = (held[:-2] << 16) | (held[1:-1] << 8) | held[2:]
    window = ((words[:, None] >> (8 - np.arange(8))) & 0xFFFF).reshape(-1)
    lengths, sizes = table[0][window], table[1][window]
    steps = (lengths + np.where(sizes == 16, 0, sizes)).tolist()
    places, at, end = [0] * n, 0, 8 * len(coded)
    for k in range(n):
        if at >= end:
            raise ValueError("scan ends early")
        places[k] = at
        at += steps[at]
    where = np.array(places, np.int64)
    if at > end or not lengths[where].all():
        raise ValueError("broken scan")
    size = sizes[where]
    bits = window[where + lengths[where]] >> (16 - size)
    value = np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)
    return np.where(size == 16, 1 << 15, np.where(size == 0, 0, value))


def restored(change: np.ndarray, selector: int, first: int) -> np.ndarray:
    """Samples from their differences (rows x columns) to the predictions of a selector, modulo 2**16."""
    out = np.empty_like(change)
    out[0] = (first + np.cumsum(change[0])) & 0xFFFF
    for y in range(1, len(change)):
        above, row = out[y - 1], change[y].copy()
        row[0] += above[0]
        up, corner = above[1:], above[:-1]
        if selector in (1, 4, 5):
            row[1:] += {1: 0, 4: up - corner, 5: (up - corner) >> 1}[selector]
            row = np.cumsum(row)
        elif selector in (2, 3):
            row[1:] += up if selector == 2 else corner
        else:
            left, line = int(row[0]) & 0xFFFF, row.tolist()
            for x, (u, c) in enumerate(zip(up.tolist(), corner.tolist(), strict=True), 1):
                left = line[x] = (line[x] + (u + ((left - c) >> 1) if selector == 6 else (left + u) >> 1)) & 0xFFFF
            row = np.array(line)
        out[y] = row & 0xFFFF
    return out


def lossless_jpeg(frame: bytes) -> np.ndarray:
    """The samples of a lossless JPEG image of one component, row by row."""
    if frame[:2] != IMAGE_BEGIN:
        raise ValueError("no JPEG image")
    at, tables, shape, every = 2, {}, None, 0
    while True:
        if frame[at : at + 1] != b"\xff" or at + 4 > len(frame):
            raise ValueError("broken JPEG marker")
        marker, (length,) = frame[at + 1], struct.unpack_from(">H", frame, at + 2)
        body, at = frame[at + 4 : at + 2 + length], at + 2 + length
        if marker == FRAME:
            precision, rows, columns, components = struct.unpack_from(">BHHB", body)
            if components != 1 or not rows or not columns:
                raise ValueError("not one component")
            shape = rows, columns
        elif marker in OTHER_FRAMES:
            raise ValueError("JPEG image of another process")
        elif marker == TABLES:
            while body:
                total = sum(body[1:17])
                tables[body[0] & 15] = huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == RESTARTS:
            (every,) = struct.unpack(">H", body)
        elif marker == SCAN:
            break
    if shape is None or len(body) < 6 or body[0] != 1 or body[2] >> 4 not in tables or not 1 <= body[3] <= 7:
        raise ValueError("broken JPEG scan")
    rows, columns = shape
    table, selector, shift = tables[body[2] >> 4], body[3], body[5] & 15
    coded = re.split(rb"\xff[\xd0-\xd7]", frame[at:].split(IMAGE_END)[0])
    strip = every // columns or rows
    if every % columns or len(coded) != -(-rows // strip):
        raise ValueError("broken JPEG restarts")
    parts = []
    for k, part in enumerate(coded):
        size = min(strip, rows - k * strip), columns
        change = differences(part.replace(b"\xff\x00", b"\xff"), table, size[0] * size[1]).reshape(size)
        parts.append(restored(change, selector, 1 << (precision - shift - 1)))
    return (np.concatenate(parts) << shift).reshape(-1)
