"""Oversized images out of transcript files."""

from __future__ import annotations

import os
import shutil
import urllib.parse
import uuid
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.images import removed_before, scrub_line

MAX_DIM, MAX_BYTES = 2000, 5 << 20


def scrub(lines: DataFrame, max_dim: int = MAX_DIM, max_bytes: int = MAX_BYTES) -> DataFrame:
    """lines (file_path, pos, line) with what each has after scrubbing and the images replaced: line, modified, images. Idempotent."""

    def run(frames):
        for pdf in frames:
            done = [scrub_line(x or "", max_dim, max_bytes) for x in pdf.line]
            yield pdf.assign(line=[d[0] for d in done], modified=[bool(d[1]) for d in done], images=[[{"width": w, "height": h, "bytes": n, "reason": why} for w, h, n, why in d[1]] for d in done])

    return lines.select("file_path", "pos", "line").mapInPandas(run, "file_path string, pos int, line string, modified boolean, images array<struct<width:int,height:int,bytes:long,reason:string>>")


FOUND = "file_path string, modified boolean, lines int, images int, bytes long, removed_before int, backup string"


def _scrub_file(name: str, max_dim: int, max_bytes: int, dry_run: bool, backup: bool) -> tuple:
    """One file's row. The new text goes to a file of its own, which replaces the old one at once; other readers see one or the other."""
    path = urllib.parse.unquote(name.removeprefix("file://")) if name.startswith("file://") else urllib.parse.unquote("/" + name.removeprefix("file:").lstrip("/")) if name.startswith("file:") else name
    temp, kept = f"{path}.scrub-{uuid.uuid4().hex}.tmp", None
    lines = images = size = before = 0
    try:
        with open(path, encoding="utf-8", newline="") as r, open(temp, "w", encoding="utf-8", newline="") as w:
            for raw in r:
                text = raw.rstrip("\r\n")
                before += removed_before(text)
                new, found = scrub_line(text, max_dim, max_bytes)
                lines += bool(found)
                images += len(found)
                size += sum(f[2] for f in found)
                w.write(new + raw[len(text) :])
        if lines and not dry_run:
            if backup:
                kept = f"{path}.bak.{datetime.now(UTC):%Y%m%d-%H%M%S}"
                shutil.copy2(path, kept)
            shutil.copymode(path, temp)
            os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    return name, bool(lines) and not dry_run, lines, images, size, before, kept


def scrub_files(files: DataFrame, max_dim: int = MAX_DIM, max_bytes: int = MAX_BYTES, dry_run: bool = False, backup: bool = True) -> DataFrame:
    """(file_path, modified, lines, images, bytes, removed_before, backup) of each file (column file_path) after its oversized images are gone.

    Files are rewritten where they are, one by one in the tasks, so they have to lie in a folder that all executors mount. A file is
    copied to `<name>.bak.<UTC time>` first, unless backup is off, and only if it changes; dry_run changes nothing and counts what
    would go. A repeated task finds nothing left to do. The work is done once, when this is called.
    """

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([_scrub_file(p, max_dim, max_bytes, dry_run, backup) for p in pdf.file_path], columns=[c.split()[0] for c in FOUND.split(", ")])

    done = files.select("file_path").distinct().mapInPandas(run, FOUND).toPandas()
    return files.sparkSession.createDataFrame([tuple(None if x is None else x for x in r) for r in done.itertuples(index=False)], FOUND)


def scrub_report(done: DataFrame) -> dict:
    """Totals over scrub_files()."""
    sums = [F.count(F.lit(1)).alias("scanned"), F.count_if("modified").alias("modified"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "images", "bytes", "removed_before"))]
    return done.agg(*sums).first().asDict()
