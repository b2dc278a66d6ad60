import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import encoded
from tessera.sources import encapsulated, files


def images():
    rng = np.random.default_rng(5)
    smooth = np.add.outer(np.arange(23) * 40, np.arange(17) * 11) + rng.integers(0, 9, (23, 17))
    return {"smooth": smooth, "noise": rng.integers(0, 65536, (12, 31)), "flat": np.full((9, 200), 4000), "edges": rng.choice([0, 65535, 32768], (14, 14)), "one": np.array([[7]]), "line": rng.integers(0, 4096, (1, 50)), "column": rng.integers(0, 4096, (50, 1))}


@pytest.mark.parametrize("selector", range(1, 8))
def test_lossless_jpeg_round_trip(selector):
    for name, image in images().items():
        assert (encapsulated.lossless_jpeg(encoded.lossless_jpeg(image, selector)) == image.reshape(-1)).all(), name
        strips = encoded.lossless_jpeg(image, selector, strip=3)
        assert (encapsulated.lossless_jpeg(strips) == image.reshape(-1)).all(), name
        shifted = encapsulated.lossless_jpeg(encoded.lossless_jpeg(image, selector, shift=2))
        assert (shifted == (image.reshape(-1) >> 2 << 2)).all(), name
    low = images()["smooth"] % 4096
    assert (encapsulated.lossless_jpeg(encoded.lossless_jpeg(low, selector, precision=12)) == low.reshape(-1)).all()


def test_run_length_round_trip():
    for name, image in images().items():
        for width, kind in ((2, np.uint16), (1, np.uint8)):
            colours = np.stack([image, image[::-1], image * 3], -1).astype(kind)
            for samples in (1, 3):
                one = colours[..., :samples]
                found = encapsulated.run_length(encoded.run_length(one, width), image.size, samples, width)
                assert (found == one.reshape(-1)).all(), name


def test_fixed_bytes():
    """Runs and a scan written out by hand."""
    assert encapsulated.unpacked(bytes([2, 5, 6, 7, 128, 254, 9, 0, 1]), 7) == bytes([5, 6, 7, 9, 9, 9, 1])
    # Codes: 0 is size 0, 10 size 1, 110 size 2. Differences 0, 1, -1, 2 from 128, to the left: 0 101 100 11010.
    scan = bytes([0b01011001, 0b10101111])
    jpeg = b"\xff\xd8\xff\xc3\x00\x0b\x08\x00\x01\x00\x04\x01\x01\x11\x00\xff\xc4\x00\x16\x00" + bytes([1, 1, 1, *[0] * 13, 0, 1, 2]) + b"\xff\xda\x00\x08\x01\x01\x00\x01\x00\x00" + scan + b"\xff\xd9"
    assert encapsulated.lossless_jpeg(jpeg).tolist() == [128, 129, 128, 130]


def test_frames():
    parts = [b"table", b"aaaa", b"bb", b"cccccc"]
    data = b"".join(encapsulated.ITEM + len(p).to_bytes(4, "little") + p for p in [b"", *parts[1:]]) + encapsulated.ITEMS_END + bytes(4)
    assert encapsulated.frames(data, 0, 1) == [b"aaaabbcccccc"] and encapsulated.frames(data, 0, 3) == parts[1:]
    table = np.array([0, 22], "<u4").tobytes()
    data = b"".join(encapsulated.ITEM + len(p).to_bytes(4, "little") + p for p in [table, *parts[1:]]) + encapsulated.ITEMS_END + bytes(4)
    assert encapsulated.frames(data, 0, 2) == [b"aaaabb", b"cccccc"]
    for broken in (data[:20], b"", data[8 + len(table) :][-8:]):
        with pytest.raises(ValueError):
            encapsulated.frames(broken, 0, 2)


def test_pixels_of_files(spark):
    image = images()["smooth"][..., None]
    signed = (image - 400).astype(np.int16)
    jpeg = encoded.lossless_jpeg(image[..., 0], 4)
    two = [encoded.run_length(image, 2), encoded.run_length(image[::-1], 2)]
    rows = {
        "plain": (encoded.image_file(encapsulated.PLAIN[2], image, image.astype("<u2").tobytes()), image),
        "signed": (encoded.image_file(encapsulated.RUN_LENGTH, image, [b"", encoded.run_length(signed, 2)], signed=True), signed),
        "bytes": (encoded.image_file(encapsulated.RUN_LENGTH, image, [b"", encoded.run_length(image % 256, 1)], bits=8), image % 256),
        "jpeg": (encoded.image_file(encapsulated.LOSSLESS_JPEG[0], image, [b"", jpeg[:52], jpeg[52:]]), image),
        "two": (encoded.image_file(encapsulated.RUN_LENGTH, image, [b"", *two], count=2), np.concatenate([image, image[::-1]])),
        "other": (encoded.image_file(b"1.2.840.10008.1.2.4.90", image, [b"", jpeg]), None),
        "short": (encoded.image_file(encapsulated.LOSSLESS_JPEG[0], image, [b"", jpeg[: len(jpeg) // 2]]), None),
        "cut": (encoded.image_file(encapsulated.RUN_LENGTH, image, [b"", two[0][:-30]]), None),
        "size": (encoded.image_file(encapsulated.LOSSLESS_JPEG[0], image[:5], [b"", jpeg]), None),
        "text": (b"no image", None),
        "empty": (b"", None),
        "null": (None, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "name string, content binary")
    found = {r.name: r.px for r in df.select("name", files.pixels(F.col("content")).alias("px")).collect()}
    assert found == {k: None if v[1] is None else v[1].reshape(-1).tolist() for k, v in rows.items()}
