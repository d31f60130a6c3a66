"""Folders of an archive against the projects that should have one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKERS = ("Documents",)


def is_old_style(slug, markers=MARKERS):
    return F.arrays_overlap(F.split(slug, "-"), F.array(*map(F.lit, markers)))


def successors(slugs: DataFrame, candidates: DataFrame, markers=MARKERS) -> DataFrame:
    """(slug, successor): the first candidate (by `ord`) that isn't the slug and ends with a dash and its last part that isn't a marker.

    The join is on the candidate's last parts: every ending of a candidate that begins at a dash is a key, so it is an equality.
    """
    parts = F.filter(F.split("slug", "-"), lambda p: (p != "") & ~F.array_contains(F.array(*map(F.lit, markers)), p))
    tails = slugs.select("slug", F.element_at(parts, -1).alias("tail")).where("tail is not null")
    # a tail holds no dash, so it can only be a candidate's last part
    ends = candidates.select(F.col("slug").alias("candidate"), "ord", F.element_at(F.split("slug", "-"), -1).alias("tail")).where(F.col("candidate").contains("-"))
    return tails.join(ends, "tail").where("candidate <> slug").groupBy("slug").agg(F.min_by("candidate", "ord").alias("successor"))


def reconcile(found: DataFrame, expected: DataFrame, markers=MARKERS) -> DataFrame:
    """(slug, state, successor, severity): folders that no project expects (pre_migration if old in style and with a live successor: ERROR; else orphan: WARN) and expected slugs without a folder (missing: OK). Both have `slug`; `expected` is compared as written."""
    f = found.select("slug").distinct()
    e = expected.select("slug").distinct()
    order = e.withColumn("ord", F.concat(F.lit("0"), "slug")).unionByName(f.withColumn("ord", F.concat(F.lit("1"), "slug")))
    lost = f.join(e, "slug", "left_anti")
    old = lost.where(is_old_style(F.col("slug"), markers))
    next_ = successors(old, order, markers)
    orphan = lost.join(next_, "slug", "left").select("slug", F.when(F.col("successor").isNotNull(), "pre_migration").otherwise("orphan").alias("state"), "successor", F.when(F.col("successor").isNotNull(), "ERROR").otherwise("WARN").alias("severity"))
    missing = e.join(f, "slug", "left_anti").select("slug", F.lit("missing").alias("state"), F.lit(None).cast("string").alias("successor"), F.lit("OK").alias("severity"))
    return orphan.unionByName(missing)


def exit_code(findings: DataFrame) -> int:
    """2 with an ERROR, 1 with a WARN, else 0."""
    r = findings.agg(F.max(F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARN", 1).otherwise(0))).first()[0]
    return r or 0
