import hashlib
import io
import zlib

import numpy as np
import pytest

from quillgraph.llm import media as M
from quillgraph.llm.tables import table


def plain_resize(image, height, width):
    h, w = image.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            total = area = 0
            for y in range(h):
                for x in range(w):
                    a = max(0, min(y + 1, (i + 1) * h / height) - max(y, i * h / height)) * max(0, min(x + 1, (j + 1) * w / width) - max(x, j * w / width))
                    total, area = total + a * float(image[y, x]), area + a
            out[i, j] = total / area
    return out


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 9), (17, 10), (24, 24)])
def test_resize_and_round_trips(shape):
    image = np.random.default_rng(3).integers(0, 256, shape).astype(np.uint8)
    for size in ((8, 9), (2, 3), (16, 16)):
        assert np.allclose(M.area_resize(image, *size), plain_resize(image, *size))
    assert (M.decode(M.encode_pgm(image)) == image).all()
    assert (M.decode(M.encode_bmp(image)) == image).all()
    assert np.load(io.BytesIO(M.npy_tile(image))).shape == (16, 16)
    assert len(M.difference_hash(image)) == 16


def test_other_forms():
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode(b"P2 2 1 15\n0 15").tolist() == [[0, 255]]
    assert M.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    assert M.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    import struct
    bmp = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, -2, 1, 24, 0, 0, 0, 0, 0, 0) + b"\x03\x02\x01\x00\x06\x05\x04\x00"
    assert M.decode(bmp).tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    for bad in (b"", b"GIF89a", b"P5\n2 2\n255\n\x00", b"P5\nx"):
        with pytest.raises(ValueError):
            M.decode(bad)


def check(rows, got, form):
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        n = max(576, -(-len(raw) // 576) * 576)
        p = raw + b"\xff" * (n - len(raw))
        media = f"P5\n24 {n // 24}\n255\n".encode() + p
        if form == "bmp" or form == "mixed" and zlib.crc32(p) % 4 == 0:
            media = M.encode_bmp(np.frombuffer(p, np.uint8).reshape(-1, 24))
        want.append((d, len(raw), n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = M.op1_media_columns(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = got.collect()
    check(rows, got, "mixed")
    assert len({len(r.feature) for r in got}) == 1 and 0.1 < sum((r.media_bytes - r.payload_bytes) > 1000 for r in got) / len(got) < 0.5


@pytest.mark.parametrize("form", ["pgm", "bmp", "mixed"])
def test_edges(spark, tmp_path, form):
    rows = [(None, None), (1, ""), (1, ""), (2, "é" * 288), (3, "a" * 577), (4, "long " * 200_000), (None, "é" * 288)]
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, media binary, n_bytes int")
    got = M.text_media(df, f"{tmp_path}/m", form=form).collect()
    assert len(got) == len(rows) and all(len(r.tile) > 256 for r in got)
    by = {}
    for r in got:
        by.setdefault((r.n_bytes, r.payload_sha256), set()).add((r.feature, r.media_sha256, r.tail_crc32))
    assert all(len(v) == 1 for v in by.values())
    check(rows, got, form)
    for r in got:
        tile = np.load(io.BytesIO(r.tile))  # as a reader of NPY files sees what was stored
        assert tile.shape == (16, 16) and r.feature.endswith(f"-{zlib.crc32(bytes(r.tile)):08x}")
    stored = spark.read.parquet(f"{tmp_path}/m/tiles")
    assert sorted(bytes(x.tile) for x in stored.collect()) == sorted(bytes(r.tile) for r in got)
    assert M.text_media(df.limit(0), f"{tmp_path}/none").count() == 0
    assert M.media_features(spark.createDataFrame([(1, None)], "k int, media binary")).collect()[0].feature is None
