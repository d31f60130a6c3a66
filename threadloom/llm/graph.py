"""Connected components of a link table, without links or components on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize


#: At most so many links are solved by one task (a few MB) instead of by further rounds.
FEW = 16_384


def _local(batches):
    """Union-find over a task's own links; each node but the least of its tree is linked to that one."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), 10_000):
        some = [(x, find(x)) for x in nodes[at : at + 10_000]]
        some = [x for x in some if x[0] != x[1]]
        if some:
            a, b = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type), pa.array(b, batch.column(0).type)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b), comp the least node that links reach.

    Alternates large-star and small-star steps (Kiveris and others, 2014), each after a task-local union-find that shrinks its
    links to stars, until the links stay as they are or are at most FEW. Each round's links are written to the shared folder. An
    empty table of links gives no rows; nulls aren't allowed. Sums of a node's neighbours are pre-aggregated; the joins on a
    hub's key are plain shuffled joins, which adaptive execution splits.
    """
    kind = links.schema["a"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    stars = materialize(links.select("a", "b").mapInArrow(_local, schema).distinct(), "stars")
    sign = None
    while stars.count() > FEW:
        # large star: larger neighbours go to the least of a node and its neighbours
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to the least of them; rows have a > b
        large = large.where("a <> b")
        down = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b")
        stars = materialize(small.mapInArrow(_local, schema).distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    else:
        stars = materialize(stars.coalesce(1).mapInArrow(_local, schema), "stars")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
