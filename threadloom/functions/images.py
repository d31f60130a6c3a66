"""Images inside transcript lines: sizes by header, search at any depth, replacement."""

from __future__ import annotations

import base64
import binascii
import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PNG = b"\x89PNG\r\n\x1a\n"
BLANK_OVER = 1024
#: How the text of a block begins that stands for an image.
REMOVED = "[image removed:"


def png_size(data: Column) -> Column:
    """struct(width, height) of PNG bytes, natively; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    ok = (F.hex(F.substring(data, 1, 8)) == PNG.hex().upper()) & (F.hex(F.substring(data, 13, 4)) == b"IHDR".hex().upper()) & (F.octet_length(data) >= 24)
    return F.when(ok, F.struct(number(17).alias("width"), number(21).alias("height")))


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) by a PNG's header or a JPEG's frame header."""
    if data[:8] == PNG and len(data) >= 24 and data[12:16] == b"IHDR":
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            # a stray byte: the next marker is looked for
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 1 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def any_image_size(data: pd.Series) -> pd.DataFrame:
    sizes = [image_size(d) if d is not None else None for d in data]
    return pd.DataFrame({"width": pd.array([s and s[0] for s in sizes], "Int32"), "height": pd.array([s and s[1] for s in sizes], "Int32")})


def blocks_of(value):
    """(holder, key, block) of each base64 image block at any depth."""
    todo = [value]
    while todo:
        v = todo.pop()
        for key, x in list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else ():
            if isinstance(x, dict) and x.get("type") == "image" and isinstance(x.get("source"), dict) and x["source"].get("type") == "base64" and isinstance(x["source"].get("data"), str):
                yield v, key, x
            elif isinstance(x, (dict, list)):
                todo.append(x)


def removed_before(line: str) -> int:
    """Blocks of a line, at any depth, that stand for images removed earlier."""
    if REMOVED not in line:
        return 0
    try:
        todo, n = [json.loads(line)], 0
    except ValueError:
        return 0
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            n += v.get("type") == "text" and isinstance(v.get("text"), str) and v["text"].startswith(REMOVED)
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return n


def excess(width: int | None, height: int | None, size: int, max_dim: int, max_bytes: int) -> str | None:
    """Why an image is too large: dimension, byte_size or both."""
    wide = max(width or 0, height or 0) > max_dim
    heavy = size > max_bytes
    return "both" if wide and heavy else "dimension" if wide else "byte_size" if heavy else None


def scrub_line(line: str, max_dim: int, max_bytes: int) -> tuple[str, list[tuple[int | None, int | None, int, str]]]:
    """The line with a text block in place of each oversized image, and what was replaced. Other lines come back as they are."""
    try:
        value = json.loads(line)
    except ValueError:
        return line, []
    found = []
    for holder, key, block in blocks_of([value]):
        try:
            data = base64.b64decode(block["source"]["data"])
        except (binascii.Error, ValueError):
            continue
        size = image_size(data) or (None, None)
        why = excess(*size, len(data), max_dim, max_bytes)
        if why:
            shape = f"{size[0]}x{size[1]}" if size[0] else "unknown size"
            holder[key] = {"type": "text", "text": f"{REMOVED} {shape}, {len(data)} bytes, {why}]"}
            found.append((*size, len(data), why))
    if not found:
        return line, []
    raw = value.get("toolUseResult") if isinstance(value, dict) else None
    file = raw.get("file") if isinstance(raw, dict) else None
    if isinstance(file, dict) and isinstance(file.get("base64"), str) and len(file["base64"]) > BLANK_OVER:
        file["base64"] = ""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")), found
