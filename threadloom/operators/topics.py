"""Themes: leader clustering of vectors, labels, samples, ranking."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.words import label_words, preview
from threadloom.operators.search import envelope

THRESHOLD, MIN_SIZE, LIMIT, TERMS, SAMPLES, SHARE = 0.75, 4, 20, 3, 3, 0.5
DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
NO_TERMS = "(no distinctive terms)"


def parse_since(spec: str | None, now: datetime | None = None) -> datetime | None:
    """A cutoff from an ISO date or time (UTC unless it says) or a count of days, weeks, months (30 days) or years (365). ValueError for anything else."""
    text = (spec or "").strip()
    if not text:
        return None
    if m := re.fullmatch(r"(\d+)([dwmy])", text.lower()):
        return (now or datetime.now(UTC)) - timedelta(days=int(m[1]) * DAYS[m[2]])
    try:
        when = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"{spec!r} is neither an ISO date, an ISO time nor a span like 7d, 4w, 6m or 1y") from e
    return when if when.tzinfo else when.replace(tzinfo=UTC)


def candidates(vectors: DataFrame, messages: DataFrame, sessions: DataFrame, project: str | None = None, since: datetime | None = None) -> DataFrame:
    """Vectors with their messages and sessions: thoughts and messages without a kind; with `since`, a null timestamp is out. Vectors that aren't as long as the first message's are left out."""
    m = messages.where(F.col("content_kind").isNull() | (F.col("content_kind") == "THOUGHT"))
    s = sessions if project is None else sessions.where(F.lower("project_slug") == project.lower())
    if since is not None:
        m = m.where(F.col("timestamp") >= since.isoformat())
    rows = vectors.select("msg_id", "vector").join(m, "msg_id").join(s.select("session_id", "project_slug", "started_at"), "session_id")
    dim = rows.agg(F.min_by(F.size("vector"), "msg_id").alias("__dim"))
    return rows.crossJoin(F.broadcast(dim)).where(F.size("vector") == F.col("__dim")).drop("__dim")


def leader_clusters(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(msg_id, cluster_id, similarity): in msg_id order a vector joins the cluster whose centroid is closest, if close enough, or opens one; similarity is to the final centroid.

    Each step depends on the one before, so this is one task over ids and vectors alone. Vectors of zeros form no direction;
    they count as they are. See bucketed_clusters for a form that spreads.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("msg_id")
        x = np.stack(pdf.vector.to_numpy()).astype(np.float64)
        x /= np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1)[:, None]
        sums, centers, of = np.zeros((16, x.shape[1])), np.zeros((16, x.shape[1])), []
        k = 0
        for v in x:
            best = int(np.argmax(sims := centers[:k] @ v)) if k else -1
            if k == 0 or sims[best] < threshold:
                best, k = k, k + 1
                if k > len(sums):
                    sums, centers = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([centers, np.zeros_like(centers)])
            sums[best] += v
            centers[best] = sums[best] / (np.linalg.norm(sums[best]) or 1)
            of.append(best)
        return pd.DataFrame({"msg_id": pdf.msg_id, "cluster_id": of, "similarity": (x * centers[of]).sum(1)})

    return rows.select("msg_id", "vector").groupBy(F.lit(0).alias("g")).applyInPandas(run, "msg_id long, cluster_id int, similarity double")


def bucketed_clusters(rows: DataFrame, threshold: float = THRESHOLD, planes: int = 12, seed: int = 0) -> DataFrame:
    """leader_clusters inside each bucket of random hyperplanes, in parallel: another result (no cluster spans buckets), for archives that one task can't take."""
    dim = rows.select(F.size("vector")).first()
    if dim is None:
        return leader_clusters(rows, threshold)
    normals = np.random.default_rng(seed).normal(size=(planes, dim[0])).tolist()
    sign = lambda p: (F.aggregate(F.zip_with("vector", F.array(*map(F.lit, p)), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) > 0).cast("int")
    bucket = F.concat(*[sign(p).cast("string") for p in normals])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.vector.to_numpy()).astype(np.float64)
        x /= np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1)[:, None]
        order, sums, of = np.argsort(pdf.msg_id.to_numpy()), [], np.zeros(len(x), int)
        for i in order:
            c = np.stack(sums) if sums else np.empty((0, x.shape[1]))
            sims = c @ x[i] / np.maximum(np.linalg.norm(c, axis=1), 1e-12) if sums else np.empty(0)
            of[i] = int(sims.argmax()) if len(sims) and sims.max() >= threshold else len(sums)
            if of[i] == len(sums):
                sums.append(x[i].copy())
            else:
                sums[of[i]] += x[i]
        c = np.stack(sums)
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
        return pd.DataFrame({"msg_id": pdf.msg_id, "bucket": pdf.bucket, "local": of, "similarity": (x * c[of]).sum(1)})

    found = rows.select("msg_id", "vector", bucket.alias("bucket")).groupBy("bucket").applyInPandas(run, "msg_id long, bucket string, local int, similarity double")
    return found.select("msg_id", F.xxhash64("bucket", "local").alias("cluster_id"), "similarity")


def centroid_similarity(rows: DataFrame) -> DataFrame:
    """(msg_id, cluster_id, similarity) to the normalised mean of a given cluster's normalised vectors, natively."""
    from threadloom.functions.vectors import cosine, normalized

    unit = rows.select("msg_id", "cluster_id", "vector", normalized(F.col("vector")).alias("u"))
    center = unit.select("cluster_id", F.posexplode("u").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x")).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))
    return unit.join(center, "cluster_id").select("msg_id", "cluster_id", cosine(F.col("center"), F.col("vector")).alias("similarity"))


def labels(rows: DataFrame, terms: int = TERMS) -> DataFrame:
    """(cluster_id, label): the words of highest tf * ln(clusters / df), ties by first use; words in more than half of all clusters don't count.

    A word's first use is one number, its message's id before its place there: a pair of both would be aggregated by sorting
    every word of the corpus, a number is in a hash table with one entry for each word of a cluster.
    """
    words = rows.select("cluster_id", (F.col("msg_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")).alias("before"), F.posexplode_outer(label_words(F.col("content"))).alias("pos", "term")).where("term is not null")
    tf = words.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.min(F.col("before") + F.col("pos")).alias("first"))
    df = F.count(F.lit(1)).over(Window.partitionBy("term"))
    n = rows.agg(F.count_distinct("cluster_id").alias("n"))
    scored = tf.withColumn("df", df).crossJoin(F.broadcast(n)).where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * SHARE))).withColumn("w", F.col("tf") * F.ln(F.col("n") / F.col("df")))
    top = Window.partitionBy("cluster_id").orderBy(F.desc("w"), "first")
    best = scored.withColumn("k", F.row_number().over(top)).where(F.col("k") <= terms)
    named = best.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda s: s["term"]), " / ").alias("label"))
    known = rows.select("cluster_id").distinct().withColumn("label", F.lit(None).cast("string")).unionByName(named).groupBy("cluster_id").agg(F.max("label").alias("label"))
    return known.select("cluster_id", F.coalesce(F.when(F.col("cluster_id").isNotNull(), F.col("label")), F.lit(NO_TERMS)).alias("label"))


def themes(rows: DataFrame, min_size: int = MIN_SIZE, limit: int = LIMIT) -> DataFrame:
    """Ranked themes of clustered rows (cluster_id, similarity, msg_id, content, role, session_id, project_slug, started_at): size times projects, ties by cluster; each with its samples closest to the centroid."""
    big = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"), F.array_sort(F.collect_set("project_slug")).alias("project_slugs")).where(F.col("cluster_size") >= min_size)
    kept = rows.join(big.select("cluster_id"), "cluster_id", "left_semi")
    near = Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "msg_id")
    sample = F.struct("k", "session_id", "started_at", "role", preview(F.col("content")).alias("content_preview"), "similarity")
    samples = kept.withColumn("k", F.row_number().over(near)).where(F.col("k") <= SAMPLES).groupBy("cluster_id").agg(F.array_sort(F.collect_list(sample)).alias("sample_messages"))
    scored = big.withColumn("project_count", F.size("project_slugs")).withColumn("score", F.col("cluster_size") * F.col("project_count"))
    top = scored.orderBy(F.desc("score"), "cluster_id").limit(limit)
    ranked = top.join(labels(kept), "cluster_id").join(samples, "cluster_id")
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "cluster_id")))


def topics(vectors: DataFrame, messages: DataFrame, sessions: DataFrame, *, project: str | None = None, threshold: float = THRESHOLD, min_size: int = MIN_SIZE, limit: int = LIMIT, since: datetime | None = None, spread: bool = False) -> dict:
    """The response: counts and themes. Empty archives and clusters that are too small give no themes."""
    rows = candidates(vectors, messages, sessions, project, since)
    found = (bucketed_clusters if spread else leader_clusters)(rows, threshold)
    rows = rows.join(found, "msg_id").drop("vector")
    sizes = found.groupBy("cluster_id").count().agg(F.sum("count"), F.count_if(F.col("count") >= min_size), F.sum(F.when(F.col("count") < min_size, F.col("count")).otherwise(0))).first()
    out = [r.asDict(recursive=True) for r in themes(rows, min_size, limit).orderBy("rank").collect()] if sizes[1] else []
    return {"total_messages_clustered": sizes[0] or 0, "total_clusters": sizes[1], "noise_count": sizes[2] or 0, "themes": out, "project_slug": project, "since": since and since.isoformat()}


def format_topics(r: dict, form: str = "text", title: str = "Recurring themes from the archive:") -> str:
    if form == "json":
        return json.dumps(r, indent=2, ensure_ascii=False)
    if form == "agent-context":
        lines = [f"{t['rank']}. [{t['label']}] across {t['project_count']} project(s), {t['cluster_size']} message(s)" for t in r["themes"]]
        return envelope("\n".join([title, "", *lines]) if lines else "")
    if not r["total_messages_clustered"]:
        return "No messages with vectors found.\n"
    head = f"clustered {r['total_messages_clustered']:,} messages into {r['total_clusters']} themes (noise: {r['noise_count']})"
    head += f", since: {r['since'][:10]}" if r["since"] else ""
    head += f", scope: project={r['project_slug']}" if r["project_slug"] else ""
    body = []
    for t in r["themes"]:
        body.append(f"{t['rank']}. [{t['label']}]  size={t['cluster_size']}  projects={t['project_count']}  score={t['score']}")
        body += [f"     [{s['session_id'][:8]} {(s['started_at'] or '')[:10]} {s['role']}] {s['content_preview']}" for s in t["sample_messages"]]
    return "\n".join([head, "", *(body or ["No theme is large enough."])]) + "\n"
