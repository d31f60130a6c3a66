"""Exact top-k by inner product as a Voronoi join.

Data and queries are divided by the pivot that is nearest (the cells of a Voronoi diagram). Of each cell only a summary is
needed to bound scores: its pivot, its radius, how many vectors it holds. For a query q and a cell with pivot p and radius r,

    q.p - |q| r  <=  q.x  <=  q.p + |q| r     for each x of the cell.

Lower bounds with counts give each group of queries a score that its k-th best reaches for certain; a cell whose upper bound
stays below it for every query of the group isn't visited. A first pass over each query's own cell gives real scores and a
sharper bound; the second pass visits the other cells that are still needed. Data lie in blocks of bounded size, and what is
joined is a group and a block, each by a key of its own, so that neither a cell nor a query with many of all rows is a hot key.
Blocks are solved locally and give at most k rows a query, none below what the first pass secured.

The number of pivots grows with the root of the data. Scores are exact: products are made in floating point only where all of
them are integers below 2^53, and in 64-bit integers else; bounds are in floating point with slack.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, shuffle_partitions, table

SCALE = 64
TOP = 20
#: Pivots: half the root of the number of vectors, within these bounds (the upper one is for what the driver and a task hold).
PIVOTS = 48, 16_384
BLOCK = 4096
QUERY_BLOCK = 1024
#: Shares that the groups of a cell are dealt to where they meet its list of blocks.
SHARES = 16
#: Relative slack of bounds in floating point.
SLACK = 1e-12


def quantized(vector, scale: int = SCALE):
    """floor(scale * x) of each component, as array of long; null where the vector or a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def _matrix(col, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), dim).astype(np.int64) if len(col) else np.empty((0, dim), np.int64)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x.astype(np.float64) ** 2).sum(1)[:, None] - 2.0 * x.astype(np.float64) @ pivots.T.astype(np.float64) + (pivots.astype(np.float64) ** 2).sum(1)
    cell = d.argmin(1)
    # from the differences, as those of squares lose all digits for large components
    return cell, np.sqrt(((x.astype(np.float64) - pivots[cell]) ** 2).sum(1)) * (1 + SLACK) + 1e-3


def _assigned(x: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """(cell, id, dist, v) of each vector, v as bytes."""

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1), dim)
            cell, dist = _nearest(vectors, pivots)
            kind = "<i4" if not len(vectors) or (vectors.min() >= -(1 << 31) and vectors.max() < 1 << 31) else "<i8"
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(kind[2]) * dim), len(batch), [None, pa.py_buffer(vectors.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), pa.array(dist), raw.cast(pa.binary())], ["cell", "id", "dist", "v"])

    return x.mapInArrow(run, "cell long, id long, dist double, v binary")


def _blocks(x: DataFrame, pivots: np.ndarray, dim: int, size: int) -> DataFrame:
    """Rows (cell, block, n, radius, ids, vectors) of at most `size` vectors of a cell. Tasks get ranges of (cell, id), so a cell of any size is spread over tasks."""

    def run(batches):
        k, held, cell = TaskContext.get().partitionId() << 24, [], None

        def out():
            ids, dist, v = (sum(c, []) for c in zip(*held))
            if len({len(b) for b in v}) > 1:
                v = [b if len(b) == 8 * dim else np.frombuffer(b, "<i4").astype("<i8").tobytes() for b in v]
            return pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([k]), pa.array([len(ids)]), pa.array([max(dist)]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(v)], pa.binary())], ["cell", "block", "n", "radius", "ids", "vectors"])

        for batch in batches:
            cells = np.asarray(batch.column(0))
            at = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(at, at[1:]):
                while a < b:
                    if held and (cells[a] != cell or sum(len(h[0]) for h in held) >= size):
                        yield out()
                        k, held = k + 1, []
                    cell = int(cells[a])
                    stop = min(b, a + size - sum(len(h[0]) for h in held))
                    held.append([batch.column(i).slice(a, stop - a).to_pylist() for i in (1, 2, 3)])
                    a = stop
        if held:
            yield out()

    parts = shuffle_partitions(x.sparkSession)
    dealt = _assigned(x, pivots, dim).repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")
    return dealt.mapInArrow(run, BLOCKS)


BLOCKS = "cell long, block long, n long, radius double, ids binary, vectors binary"


def _load(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; vectors are 32-bit integers, or 64-bit ones in blocks that hold larger components."""
    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8" if n and len(vectors) == 8 * dim * n else "<i4").reshape(-1, dim)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, in floating point where that is exact, else in 64-bit integers; an error where these could overflow."""
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    most = float(np.sqrt((qf**2).sum(1).max(initial=0)) * np.sqrt((xf**2).sum(1).max(initial=0)))
    if most < 2**52 / max(1, q.shape[1]):
        return qf @ xf.T
    if most >= 2**63:
        raise OverflowError("inner products of these vectors can exceed 64 bits")
    return q.astype(np.int64) @ x.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, least: float) -> np.ndarray:
    """Places of the k best of one query's scores that are at least `least`, ties to smaller ids; its own id takes no part."""
    ok = np.flatnonzero((scores >= least) & (ids != own))
    if len(ok) > k:
        cut = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= cut]
        ok = ok[np.lexsort((ids[ok], -scores[ok]))[:k]]
    return ok


def top_k(queries: DataFrame, data: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, pivots: int | None = None, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over data, ties to the smaller id.

    Vectors that are null or empty, or hold nulls or non-finite components, take no part on either side, nor do rows without an
    id. Vectors are compared with those of their own length. A query's own id is no candidate; each row of data is a candidate of
    its own, repeated rows too, while rows of queries that repeat are one query. Fewer than k candidates give fewer rows; an
    empty side gives none. Scores that could exceed 64 bits raise OverflowError. Only id_col and vec_col are read, whatever other
    columns are called. Pivots are vectors of least hashed id; they are all that is collected, besides a summary of each cell.
    """
    spark = data.sparkSession

    def clean(df):
        v = df.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vec_col), scale).alias("v"))
        return v.where("id is not null and v is not null and size(v) > 0")

    x, q = clean(data), clean(queries).distinct()
    out = None
    for r in x.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        least, most = PIVOTS
        n = pivots or min(most, max(least, math.isqrt(r["count"]) // 2))
        part = _top_k(q.where(F.size("v") == r.d), x.where(F.size("v") == r.d), r.d, k, n, block)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


RESULT = "query_id long, rank int, vec_id long, score long"


def _top_k(q: DataFrame, x: DataFrame, dim: int, k: int, pivots: int, block: int) -> DataFrame:
    """top_k() for vectors (id, v) of one length."""
    centers = np.array([r.v for r in x.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()], np.int64)
    blocks = materialize(_blocks(x, centers, dim, block), "data-blocks")
    groups = materialize(_blocks(q, centers, dim, QUERY_BLOCK), "query-blocks").withColumnRenamed("block", "grp")
    cells = blocks.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()
    cell_ids = np.array([c.cell for c in cells], np.int64)
    radius, held = np.array([c.radius for c in cells]), np.array([c.n for c in cells])
    middle = centers[cell_ids].astype(np.float64)
    listed = blocks.select("cell", "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))

    def solve(with_bound: bool):
        def run(batches):
            for batch in batches:
                cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
                for row in zip(*cols):
                    qi, qv = _load(row[0], row[1], dim)
                    xi, xv = _load(row[2], row[3], dim)
                    least = np.frombuffer(row[4], "<f8") if with_bound else np.full(len(qi), -np.inf)
                    scores = _scores(qv, xv)
                    found = [_best(scores[j], xi, qi[j], k, least[j]) for j in range(len(qi))]
                    n = [len(f) for f in found]
                    at = np.concatenate(found) if found else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, n)), pa.array(xi[at]), pa.array(scores[np.repeat(np.arange(len(qi)), n), at].astype(np.int64))], ["query_id", "vec_id", "score"])

        return run

    found = "query_id long, vec_id long, score long"
    queried = groups.select("grp", F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    theirs = blocks.select("block", F.col("ids").alias("xi"), F.col("vectors").alias("xv"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(visits: DataFrame, by: DataFrame) -> DataFrame:
        """Groups (with the columns of `by`) and the blocks of the cells that they visit (grp, cell)."""
        pairs = visits.withColumn("share", F.pmod(F.xxhash64("grp"), F.lit(SHARES)).cast("int")).join(listed, ["cell", "share"]).select("grp", "block")
        return pairs.join(by, "grp").join(theirs, "block")

    # first pass: each query against its own cell
    home = met(groups.select("grp", "cell"), queried).select("qi", "qv", "xi", "xv").mapInArrow(solve(False), found)
    home = materialize(home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "home")
    secured = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    # the bounds of a group's queries, in the order of its ids
    each = groups.select("grp", "cell", "ids", "vectors")

    def ids_of(batches):
        for batch in batches:
            for g, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), g)), pa.array(np.arange(len(ids))), pa.array(ids)], ["grp", "at", "query_id"])

    member = each.select("grp", "ids").mapInArrow(ids_of, "grp long, at long, query_id long")
    sharp = member.join(secured, "query_id", "left").groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "least"))), lambda s: s["least"]).alias("least"))

    def route(batches):
        for batch in batches:
            for g, cell, ids, vectors, least in zip(*(batch.column(i).to_pylist() for i in range(5))):
                qv = _load(ids, vectors, dim)[1].astype(np.float64)
                norm = np.sqrt((qv**2).sum(1))[:, None]
                near = qv @ middle.T
                slack = 1e-3 + SLACK * norm * (radius + np.sqrt((middle**2).sum(1)))
                low, high = near - norm * radius - slack, near + norm * radius + slack
                order = np.argsort(-low, axis=1)
                # k others besides the query itself lie in the cells of the highest lower bounds
                reach = np.cumsum(held[order], axis=1) >= k + 1
                sure = np.where(reach.any(1), low[np.arange(len(qv)), order[np.arange(len(qv)), reach.argmax(1)]], -np.inf)
                bound = np.maximum(sure, np.array([-np.inf if v is None else v for v in least], np.float64))
                bound = np.where(np.isfinite(bound), bound - SLACK * np.abs(bound), bound)
                need = cell_ids[(high >= bound[:, None]).any(0) & (cell_ids != cell)]
                # the bounds go with the first row only
                raw = [bound.astype("<f8").tobytes(), *[None] * len(need)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(raw), pa.int64()), pa.array([None, *need.tolist()], pa.int64()), pa.array(raw, pa.binary())], ["grp", "cell", "least"])

    routed = materialize(each.join(sharp, "grp").select("grp", "cell", "ids", "vectors", "least").mapInArrow(route, "grp long, cell long, least binary"), "routes")
    bounded = queried.join(routed.where("least is not null").select("grp", "least"), "grp")
    away = met(routed.where("cell is not null").select("grp", "cell"), bounded).select("qi", "qv", "xi", "xv", "least").mapInArrow(solve(True), found)
    every = home.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk_search(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings")
    return top_k(data.where(F.col("vec_id") % 20 == 0), data)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e::DOUBLE[], d.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
