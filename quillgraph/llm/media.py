"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, and written as NPY tiles
with difference hashes.

Images are a binary column of a table, stored as Parquet in the shared folder and read back from there by row groups; one image at
a time is decoded in a task. Tiles are written there, too, each an NPY file in a binary column, and what is said of them is read from there.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.files import new_folder
from quillgraph.llm.tables import table

UNIT, WIDTH = 576, 24
TILE = 16


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey samples (rows x columns) as binary Netpbm."""
    return f"P5\n{samples.shape[1]} {samples.shape[0]}\n255\n".encode() + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey samples as BMP with a grey palette, rows from the bottom up and padded to 4 bytes."""
    height, width = samples.shape
    rows = np.zeros((height, -(-width // 4) * 4), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    first = 14 + 40 + len(palette)
    return struct.pack("<2sIHHI", b"BM", first + rows.size, 0, 0, first) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette + rows.tobytes()


def _decode_netpbm(raw: bytes) -> np.ndarray:
    kind, at, numbers = raw[:2], 2, []
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header has no number where one belongs")
        numbers.append(int(raw[at:end]))
        at = end
    width, height, top = (*numbers, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = b"\n".join(x.partition(b"#")[0] for x in raw[at:].split(b"\n"))
        digits = [c - 48 for c in body if c in b"01"] if kind == b"P1" else body.split()
        values = np.array(digits[:n], np.int64)
    elif kind == b"P4":
        row = -(-width // 8)
        values = np.unpackbits(np.frombuffer(raw, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(values) < n:
        raise ValueError("a Netpbm image has too few samples")
    if kind in (b"P1", b"P4"):
        values = 1 - values  # 1 is black
    if top != 255:
        values = (values.astype(np.int64) * 510 + top) // (2 * top)
    return values.astype(np.uint8).reshape((height, width, 3) if channels == 3 else (height, width))


def _decode_bmp(raw: bytes) -> np.ndarray:
    first = struct.unpack_from("<I", raw, 10)[0]
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", raw, 14)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packing} isn't read")
    row = -(-width * bits // 32) * 4
    rows = np.frombuffer(raw, np.uint8, row * abs(height), first).reshape(abs(height), row)[:, : width * bits // 8]
    rows = rows if height < 0 else rows[::-1]
    if bits == 8:
        n = struct.unpack_from("<I", raw, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:n] = np.frombuffer(raw, np.uint8, 4 * n, 14 + size).reshape(-1, 4)[:, 2::-1]
        image = palette[rows]
        return image[:, :, 0] if (palette == palette[:, :1]).all() else image
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    """An image of 8-bit samples, (rows, columns) if grey or (rows, columns, 3), from Netpbm P1 to P6 or BMP with 8, 24 or 32 bits."""
    if raw[:2] in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        return _decode_netpbm(raw)
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the (fractional) rectangles that the new samples cover, from an integral image."""
    h, w = image.shape[:2]
    total = np.zeros((h + 1, w + 1, *image.shape[2:]))
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    for axis, (n, m) in enumerate(((h, height), (w, width))):
        edge = np.arange(m + 1) * n / m
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape([-1 if k == axis else 1 for k in range(total.ndim)])
        total = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
        total = np.diff(total, axis=axis)
    return total * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as 16 hex digits: whether each of 8 x 8 areas is darker than its right neighbour."""
    small = area_resize(grey(image), 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side, as an NPY file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.rint(area_resize(image, side, side)).clip(0, 255).astype(np.uint8), version=(1, 0))
    return out.getvalue()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and these with bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def encode_mixed(samples: np.ndarray) -> bytes:
    """BMP for payloads whose CRC-32 is divisible by 4, Netpbm for the others: the same form for equal payloads."""
    return (encode_pgm if zlib.crc32(samples) % 4 else encode_bmp)(samples)


def _to_media(form: str):
    encode = {"pgm": encode_pgm, "bmp": encode_bmp, "mixed": encode_mixed}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found = [payload_of(t.as_py()) for t in batch.column("_text").slice(k, 256)]
                media = [encode(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for _, p in found]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(k, 256), pa.array([n for n, _ in found], pa.int64()), pa.array(media, pa.binary())], names=["_id", "n_bytes", "media"])

    return run


def store_texts(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm") -> DataFrame:
    """(_id, n_bytes, media) for every row, written to `folder` as images 24 samples wide, and read from there. Null texts are empty."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_bytes long, media binary"
    src.mapInArrow(_to_media(form), schema).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


FEATURES = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary()}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "media"]
        for k in range(0, batch.num_rows, 1000):
            rows = []
            for m in batch.column("media").slice(k, 1000):
                if (raw := m.as_py()) is None:
                    rows.append((None,) * len(FEATURES))
                    continue
                image = decode(raw)
                payload = np.ascontiguousarray(image).tobytes()
                tile = npy_tile(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(image), tile))
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), FEATURES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1000) for c in rest), *columns], names=[*rest, *FEATURES])


def media_features(media: DataFrame) -> DataFrame:
    """The columns of `media` but the binary column `media` itself, and digests, a feature and an NPY tile of each image, all from its stored
    bytes. The feature is the difference hash. A null image has null features; one that can't be decoded raises ValueError."""
    base = media.drop("media")
    extra = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), extra])
    return media.mapInArrow(_features, schema)


def stored_tiles(media: DataFrame, folder: str) -> DataFrame:
    """`media_features`, written to `folder` with the tiles and read from there. The feature has the CRC-32 of the tile's stored file behind the difference hash."""
    media_features(media).write.option("compression", "zstd").parquet(folder)
    kept = media.sparkSession.read.parquet(folder)
    return kept.withColumn("feature", F.concat_ws("-", "feature", F.lower(F.lpad(F.hex(F.crc32("tile")), 8, "0"))))


def text_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", form: str = "mixed") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tile) for every row of `docs`.

    Texts of any length, null ones as empty, are stored whole; equal texts give equal values. Null and repeated ids are carried along. An empty table gives an
    empty result. `form` is pgm, bmp or mixed.
    """
    return stored_tiles(store_texts(docs, f"{folder}/media", id_col, text_col, form), f"{folder}/tiles").withColumnRenamed("_id", id_col)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an image, stored and read back, and what its stored tile gives. A null text is an empty one."""
    return text_media(table(spark, sf_dir, "documents"), new_folder(spark, "media")).drop("tile")


QUERIES = {"op1_media_columns": op1_media_columns}
ORACLES: dict[str, str] = {}
