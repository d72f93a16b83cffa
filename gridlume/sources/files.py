"""Frame files, images and fingerprints, read by Spark's own readers."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUICK = 64 << 10  #: bytes at each end of a file that a fingerprint covers
#: Format, and the hex digits that a file of it begins with.
MAGIC = (("png", "89504E47"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"))
EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "tif", "tiff", "bmp")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def read_f32(files: DataFrame, width: int, height: int) -> DataFrame:
    """(path, width, height, pixels, problem) of raw little-endian 32-bit frames; another length than width x height x 4 is a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [len(c) == 4 * width * height for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "width": width, "height": height, "pixels": [np.frombuffer(c, "<f4") if g else None for c, g in zip(batch["content"], good)], "problem": [None if g else "byte_length" for g in good]})

    return files.select("path", "content").mapInPandas(run, "path STRING, width INT, height INT, pixels ARRAY<FLOAT>, problem STRING")


def f32_bytes(pixels: np.ndarray) -> bytes:
    return np.ascontiguousarray(pixels, "<f4").tobytes()


def image_format(content: Column, path: Column) -> Column:
    """By the first bytes, or null: only still-image formats count."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for name, magic in MAGIC:
        out = out.when(head.startswith(magic), name)
    return F.when(F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*EXTENSIONS), out)


def _gif_images(content: bytes, most: int) -> int:
    """How many images a GIF has, counted up to ``most``."""
    at, found = 13, 0
    if len(content) > 10 and content[10] & 128:
        at += 3 << (content[10] & 7) + 1
    while at < len(content) and found < most:
        kind, at = content[at], at + 1
        if kind == 0x21:
            at += 1
        elif kind == 0x2C and at + 9 <= len(content):
            found += 1
            at += 9 + (3 << (content[at + 8] & 7) + 1 if content[at + 8] & 128 else 0) + 1
        else:
            break
        while at < len(content) and content[at]:
            at += content[at] + 1
        at += 1
    return found


def has_animation(content: bytes | None, format: str | None) -> bool:
    """GIFs with two images, PNGs with an animation chunk before their data, WebPs with the animation flag or chunk; by their blocks and chunks, whatever bytes these hold."""
    if content is None:
        return False
    if format == "gif":
        return _gif_images(content, 2) > 1
    if format not in ("png", "webp"):
        return False
    at = 8 if format == "png" else 12
    while at + 8 <= len(content):
        first, second = content[at : at + 4], content[at + 4 : at + 8]
        size, kind = (int.from_bytes(first, "big"), second) if format == "png" else (int.from_bytes(second, "little"), first)
        if kind in (b"acTL", b"ANIM"):
            return True
        if kind in (b"IDAT", b"IEND"):
            return False
        if kind == b"VP8X" and at + 9 <= len(content) and content[at + 8] & 2:
            return True
        at += 12 + size if format == "png" else 8 + size + (size & 1)
    return False


def is_animated(content: Column, format: Column) -> Column:
    """``has_animation`` of the formats that can have one; no other file's bytes leave the JVM."""

    @F.pandas_udf("boolean")
    def found(contents: pd.Series, formats: pd.Series) -> pd.Series:
        return pd.Series([has_animation(None if c is None else bytes(c), f) for c, f in zip(contents, formats)], dtype=bool)

    able = format.isin("gif", "png", "webp")
    return F.coalesce(found(F.when(able, content), F.when(able, format)), F.lit(False))


def little_endian(length: Column) -> Column:
    """A 64-bit length as 8 bytes."""
    digits = F.lpad(F.hex(length.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(7, -1, -1))))


def fingerprint(content: Column) -> Column:
    """``quick-sha256-v1:`` and the SHA-256 of the size, the first 64 KiB and, of larger files, the last."""
    size = F.octet_length(content).cast("long")
    tail = F.when(size > QUICK, F.substring(content, -QUICK, QUICK)).otherwise(F.unhex(F.lit("")))
    return F.concat(F.lit("quick-sha256-v1:"), F.sha2(F.concat(little_endian(size), F.substring(content, 1, QUICK), tail), 256))


def changed(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources (path, fingerprint) whose file has another fingerprint now."""
    now = files.select("path", fingerprint(F.col("content")).alias("_now"))
    return sources.where("fingerprint IS NOT NULL").join(now, "path").where("fingerprint <> _now").drop("_now")


def probe(files: DataFrame) -> DataFrame:
    """(path, kind, size, width, height, fingerprint) of image files; sizes come from PNG, GIF and BMP headers."""
    head = F.hex(F.substring("content", 1, 32))
    number = lambda start, n, big: F.conv(F.substring(head, 2 * start + 1, 2 * n) if big else F.concat(*(F.substring(head, 2 * (start + k) + 1, 2) for k in range(n - 1, -1, -1))), 16, 10).cast("int")
    rows = files.withColumn("format", image_format(F.col("content"), F.col("path")))
    place = {"png": (16, 20, 4, True), "gif": (6, 8, 2, False), "bmp": (18, 22, 4, False)}
    width, height = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (w, h, n, big) in place.items():
        width = F.when(F.col("format") == name, number(w, n, big)).otherwise(width)
        height = F.when(F.col("format") == name, number(h, n, big)).otherwise(height)
    kind = F.when(F.col("format").isNull(), "video").when(is_animated(F.col("content"), F.col("format")), "animated").otherwise("still")
    return rows.select("path", kind.alias("kind"), F.col("length").alias("size"), width.alias("width"), height.alias("height"), fingerprint(F.col("content")).alias("fingerprint"))


def _unfiltered(raw: np.ndarray, stride: int) -> np.ndarray:
    """PNG lines, each after its filter's byte, to their bytes; ``stride`` bytes are a pixel."""
    out = np.zeros((len(raw) + 1, stride + raw.shape[1] - 1), np.uint8)
    for y in range(len(raw)):
        line, up, kind = raw[y, 1:].astype(np.int64), out[y, stride:].astype(np.int64), raw[y, 0]
        if kind == 2:
            line = line + up
        elif kind == 1 and len(line) % stride == 0:
            line = line.reshape(-1, stride).cumsum(0).ravel()
        elif kind in (1, 3, 4):
            done = np.zeros(stride + len(line), np.int64)
            corner = out[y].astype(np.int64)
            for x in range(len(line)):
                a, b, c = done[x], up[x], corner[x]
                if kind == 4:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                else:
                    near = a if kind == 1 else (a + b) // 2
                done[x + stride] = (line[x] + near) & 255
            line = done[stride:]
        out[y + 1, stride:] = line & 255
    return out[1:, stride:]


def decode_png(content: bytes) -> np.ndarray | None:
    """(height, width, channels) from 0 to 1 of a PNG of any depth, with a palette or not; None for interlaced ones and others."""
    import zlib

    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, header, palette = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
    if header is None or header[6] or header[3] not in channels or header[2] not in (1, 2, 4, 8, 16) or header[3] == 3 and palette is None:
        return None
    width, height, depth = header[:3]
    n = channels[header[3]]
    line = -(-width * n * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if not width or not height or len(raw) != height * (line + 1):
        return None
    lines = _unfiltered(raw.reshape(height, line + 1), max(1, n * depth // 8))
    if depth == 16:
        values = np.ascontiguousarray(lines).view(">u2").astype(np.int64)
    elif depth == 8:
        values = lines.astype(np.int64)
    else:
        bits = np.unpackbits(np.ascontiguousarray(lines), axis=1).reshape(height, -1, depth)
        values = (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, : width * n]
    values = values.reshape(height, width, n)
    if header[3] == 3:
        return palette[np.minimum(values[:, :, 0], len(palette) - 1)] / 255
    return values / ((1 << depth) - 1)


def decode_bmp(content: bytes) -> np.ndarray | None:
    """(height, width, 3) from 0 to 1 of an uncompressed BMP of 8, 24 or 32 bits a pixel; None for others."""
    if content[:2] != b"BM" or len(content) < 54:
        return None
    start, header, width, height, _, depth, packed = struct.unpack("<IIiiHHI", content[10:34])
    line = (abs(width) * depth // 8 + 3) // 4 * 4
    if width <= 0 or not height or packed or depth not in (8, 24, 32) or start + line * abs(height) > len(content):
        return None
    lines = np.frombuffer(content, np.uint8, line * abs(height), start).reshape(abs(height), line)
    lines = lines[::-1] if height > 0 else lines
    if depth == 8:
        colours = np.frombuffer(content[14 + header : start], np.uint8)
        colours = colours[: len(colours) // 4 * 4].reshape(-1, 4)
        if not len(colours):
            return None
        pixels = colours[np.minimum(lines[:, :width], len(colours) - 1)]
    else:
        pixels = lines[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    return pixels[:, :, 2::-1] / 255


def _lzw(data: bytes, least: int, most: int) -> bytes:
    """The indexes of a GIF's packed data, up to ``most``."""
    clear, table, out = 1 << least, [], bytearray()
    width, hold, held, last = least + 1, 0, 0, None
    table = [bytes([k]) for k in range(clear)] + [b"", b""]
    for byte in data:
        hold |= byte << held
        held += 8
        while held >= width:
            code, hold, held = hold & (1 << width) - 1, hold >> width, held - width
            if code == clear:
                table, width, last = table[: clear + 2], least + 1, None
                continue
            if code == clear + 1 or code > len(table) or last is None and code >= clear:
                return bytes(out[:most])
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                width += len(table) == 1 << width and width < 12
            last = entry
            if len(out) >= most:
                return bytes(out[:most])
    return bytes(out)


def decode_gif(content: bytes) -> np.ndarray | None:
    """(height, width, 3) from 0 to 1 of a GIF's first image, which must fill its screen and not be interlaced; None for others."""
    if content[:4] != b"GIF8" or len(content) < 13:
        return None
    width, height, flags = struct.unpack("<HHB", content[6:11])
    at, colours = 13, b""
    if flags & 128:
        colours = content[13 : 13 + (3 << (flags & 7) + 1)]
        at += len(colours)
    while at < len(content) and content[at] == 0x21:
        at += 2
        while at < len(content) and content[at]:
            at += content[at] + 1
        at += 1
    if at + 11 > len(content) or content[at] != 0x2C:
        return None
    x, y, w, h, flags = struct.unpack("<HHHHB", content[at + 1 : at + 10])
    at += 10
    if (x, y, w, h) != (0, 0, width, height) or flags & 64 or not w or not h:
        return None
    if flags & 128:
        colours = content[at : at + (3 << (flags & 7) + 1)]
        at += len(colours)
    least, at, data = content[at], at + 1, bytearray()
    while at < len(content) and content[at]:
        data += content[at + 1 : at + 1 + content[at]]
        at += content[at] + 1
    indexes = np.frombuffer(_lzw(bytes(data), least, w * h), np.uint8) if 1 < least < 9 else np.zeros(0, np.uint8)
    palette = np.frombuffer(colours, np.uint8).reshape(-1, 3)
    if len(indexes) != w * h or not len(palette):
        return None
    return palette[np.minimum(indexes, len(palette) - 1)].reshape(h, w, 3) / 255


def decode_still(content: bytes | None) -> np.ndarray | None:
    """(height, width, channels) from 0 to 1 of a PNG, BMP or GIF that one of the decoders takes, else None."""
    import zlib

    for decode in (decode_png, decode_bmp, decode_gif) if content is not None else ():
        try:
            image = decode(content)
        except (ValueError, IndexError, struct.error, zlib.error):
            return None  # a damaged file is a problem of its row
        if image is not None:
            return image
    return None


def still_luma(files: DataFrame) -> DataFrame:
    """(path, width, height, pixels, problem): luma 0 to 1 of PNG, BMP and GIF files; others are a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                image = decode_still(None if content is None else bytes(content))
                if image is None:
                    rows.append((path, None, None, None, "unsupported_image"))
                    continue
                rgb = image[:, :, :3] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, 2)
                rows.append((path, image.shape[1], image.shape[0], (rgb @ [0.2126, 0.7152, 0.0722]).astype(np.float32).ravel(), None))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "pixels", "problem"])

    return files.select("path", "content").mapInPandas(run, "path STRING, width INT, height INT, pixels ARRAY<FLOAT>, problem STRING")


def default_stream(streams: DataFrame) -> DataFrame:
    """(path, stream_index): the first video stream that is no attached picture, else the first attached picture."""
    rank = F.struct(F.col("attached_picture").cast("int").alias("a"), "stream_index")
    return streams.where("kind = 'video'").groupBy("path").agg(F.min(rank)["stream_index"].alias("stream_index"))


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit grey PNG of values 0 to 1."""
    import zlib

    pixels = np.clip(np.rint(image * 255), 0, 255).astype(np.uint8)
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    out = io.BytesIO(b"")
    out.write(b"\x89PNG\r\n\x1a\n")
    for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b"")):
        out.write(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
    return out.getvalue()
