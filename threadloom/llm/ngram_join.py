"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct 4-word shingles. Shingles are ordered by the number of documents that hold
them (exact counts over the corpus, by request and reply), then by hash. Two sets whose Jaccard similarity is at least t share
one of the first n - ceil(t n) + 1 shingles of each in that order, its prefix; shingles that one document alone holds can be
left out of it. Documents with one set are one node. Nodes whose prefixes and sizes are the same form a group, and only groups
are listed under the shingles of their prefix.

Groups are joined in two steps. First, along each list (and inside each group), ordered by size and then by a hash of its own,
only neighbours are verified: a list of any length is dealt out by ranges, gives no more pairs than it has rows, and most links
of a family of near copies show up. Then every pair of groups on a list that can still hold a link between different components is filtered by size and
position, expanded to members and verified. Pairs within a component can't change the result and are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.chunks import pack_chunks, totals, with_totals
from threadloom.llm.common import drop, materialize, shuffle_partitions, table, trim
from threadloom.llm.graph import components

WORDS = 4
PERCENT = 85
#: Odd multiplier for sums over words (the golden ratio in 64 bits).
MIX = np.uint64(0x9E3779B97F4A7C15)
INFO = "doc_id long, n long, node binary, grp binary, tokens binary, members binary"


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of a shorter text's words as a whole; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(h) < k:
            out = np.uint64(len(h))
            for x in h:
                out = out * MIX + x
            return np.array([_stir(out)], np.uint64)
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = out * MIX + h[i : len(h) - k + 1 + i]
        return np.unique(_stir(out))


def _stir(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * MIX
        return x ^ (x >> np.uint64(29))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def document_sets(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """A row a document: its set's size, digest (node), prefix digest (grp), the prefix's shared shingles in order with their places (tokens), and the set itself where there are such."""
    chunks = pack_chunks(docs, id_col, text_col)

    def request(ids, texts):
        every = [shingles(t, k) for t in texts]
        keys, counts = np.unique(np.concatenate(every or [np.empty(0, np.uint64)]), return_counts=True)
        return [(0, keys, counts)]

    def use(chunk, ids, texts, got):
        every = [shingles(t, k) for t in texts]
        keys, where = np.unique(np.concatenate(every), return_inverse=True)
        held = got[0][where] if len(keys) else np.empty(0, np.uint64)
        ends = np.cumsum([len(s) for s in every]).tolist()
        cols: list[list] = [[] for _ in range(6)]
        for doc_id, s, b in zip(ids, every, ends):
            n = len(s)
            df = held[b - n : b]
            # 20 bits of document count, then 44 of the hash: an order that all documents share
            order = np.sort((np.minimum(df, np.uint64((1 << 20) - 1)) << np.uint64(44)) | (s >> np.uint64(20)))
            prefix = order[: prefix_length(n, percent)] if n else order
            at = np.flatnonzero(prefix >> np.uint64(44) > 1)
            raw = s.tobytes()
            row = (doc_id, n, hashlib.md5(raw).digest(), hashlib.md5(prefix.tobytes() + n.to_bytes(8, "little")).digest(), np.concatenate([prefix[at], at.astype(np.uint64)]).tobytes() if len(at) else None, raw if len(at) else None)
            for c, x in zip(cols, row):
                c.append(x)
            if len(cols[0]) >= 4000:
                yield _info(cols)
                cols = [[] for _ in range(6)]
        yield _info(cols)

    replies = totals(chunks, request)
    sets = materialize(with_totals(chunks, replies, use, INFO), "sets")
    drop(chunks, replies)
    return sets


def _info(cols):
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in INFO.split(", ")])


def _list_tokens(batches):
    for batch in batches:
        tokens, before, at, of = [], [], [], []
        for i, raw in enumerate(batch.column(2)):
            a = np.frombuffer(raw.as_py(), np.uint64)
            m = len(a) // 2
            t = a[:m].view(np.int64)
            tokens.append(t)
            before.append(np.concatenate([[-1], t[:-1]]))
            at.append(a[m:].view(np.int64))
            of.append(np.full(m, i))
        of = pa.array(np.concatenate(of))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(before)), pa.array(np.concatenate(at)), batch.column(0).take(of), batch.column(1).take(of)], ["token", "before", "at", "grp", "n"])


def _neighbours(batches):
    """(a, b) of nodes next to each other under the same key and in different components; columns: key, node, component."""
    last = None
    for batch in batches:
        a, b = [], []
        for k, v, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if last is not None and last[0] == k and last[2] != c:
                a.append(min(last[1], v))
                b.append(max(last[1], v))
            last = (k, v, c)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _verifier(percent: int):
    def verify(batches):
        trim()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                if 100 * len(a) < percent * len(b):
                    keep.append(False)
                    continue
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _links(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes that the sets themselves confirm."""
    sets = nodes.select("node", "members")
    full = pairs.join(sets.withColumnsRenamed({"node": "a", "members": "ma"}), "a").join(sets.withColumnsRenamed({"node": "b", "members": "mb"}), "b")
    return full.select("a", "b", "ma", "mb").mapInArrow(_verifier(percent), "a binary, b binary")


def _stars(comp: DataFrame) -> DataFrame:
    return comp.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))


def _open(nodes: DataFrame, lists: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with their components, the least and greatest component of each group, and the lists on which components meet."""
    placed = nodes.select("node", "grp", "n").join(comp, "node", "left").select("node", "grp", "n", F.coalesce("comp", "node").alias("comp"))
    spread = materialize(placed.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "spread")
    both = lists.join(spread, "grp")
    mixed = both.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    return placed, spread, materialize(both.join(mixed, "token", "left_semi"), "open-lists")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: the components of the graph of links.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles (words: A-Z lower-cased,
    divided by ASCII white space). Rows without words, null texts included, have no shingles and are linked with nothing.
    component_id is the least id that links reach; null ids count as above all others. Repeated rows are linked with each
    other. Only id_col and text_col are read, whatever other columns are called. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    info = document_sets(docs, id_col, text_col, k, percent)
    shared = info.where("tokens is not null")
    nodes = materialize(shared.groupBy("node").agg(F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("members").alias("members")), "nodes")
    groups = nodes.groupBy("grp").agg(F.min("node").alias("head"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("size"))
    lists = materialize(groups.select("grp", "n", "tokens").mapInArrow(_list_tokens, "token long, before long, at long, grp binary, n long"), "lists")
    heads = groups.select("grp", "head")
    # first: neighbours along the lists, and along the groups of several nodes
    along = lists.join(heads, "grp").repartitionByRange(parts, "token", "n", "head").sortWithinPartitions("token", "n", "head").select("token", "head", F.col("head").alias("comp")).mapInArrow(_neighbours, "a binary, b binary")
    inside = nodes.select("grp", "node").repartitionByRange(parts, "grp", "node").sortWithinPartitions("grp", "node").select("grp", "node", F.col("node").alias("comp")).mapInArrow(_neighbours, "a binary, b binary")
    found = materialize(_links(along.unionByName(inside).distinct(), nodes, percent), "links")
    comp = materialize(components(found), "components")
    # again, in an order of its own for each list, where components still meet: what these links join needs no pairs below
    _, _, open_lists = _open(nodes, lists, comp)
    mixed = open_lists.join(heads, "grp").withColumn("place", F.xxhash64("token", "head"))
    mixed = mixed.repartitionByRange(parts, "token", "place").sortWithinPartitions("token", "place", "head").select("token", "head", F.col("lo").alias("comp"))
    found = materialize(_links(mixed.mapInArrow(_neighbours, "a binary, b binary").distinct(), nodes, percent), "links")
    comp = materialize(components(_stars(comp).unionByName(found)), "components")
    # then: what can still link different components
    placed, spread, open_lists = _open(nodes, lists, comp)
    left = open_lists.select("token", "before", "at", F.col("grp").alias("ga"), F.col("n").alias("na"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = open_lists.select(F.col("token").alias("t"), F.col("before").alias("before_b"), F.col("at").alias("at_b"), F.col("grp").alias("gb"), F.col("n").alias("nb"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    sizes = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    # A pair counts at the first shingle that its prefixes share: what is common lies from there on. Where the listed shingles
    # before it are the same, they have met on an earlier list.
    place = (100 + percent) * F.least(F.col("na") - F.col("at"), F.col("nb") - F.col("at_b")) >= percent * (F.col("na") + F.col("nb"))
    place &= (F.col("before") != F.col("before_b")) | (F.col("before") == -1)
    apart = ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")))
    pairs = left.join(right, (F.col("token") == F.col("t")) & (F.col("ga") < F.col("gb")) & sizes & place & apart).select("ga", "gb").distinct()
    within = spread.where("lo <> hi").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    member = placed.select("grp", "node", "comp")
    expanded = pairs.unionByName(within).join(member.withColumnsRenamed({"grp": "ga", "node": "x", "comp": "cx"}), "ga").join(member.withColumnsRenamed({"grp": "gb", "node": "y", "comp": "cy"}), "gb").where("cx <> cy and (ga <> gb or x < y)")
    rest = materialize(expanded.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    more = materialize(_links(rest, nodes, percent), "links")
    comp = components(_stars(comp).unionByName(more))
    # a class is a component of nodes; nodes without links are classes of their own
    classed = info.where("n > 0").join(comp, "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("class"))
    classed = materialize(classed, "classes")
    # a table of its own, so that what follows is a plain join, whose large partitions can be split
    least = materialize(classed.groupBy("class").agg(F.min("doc_id").alias("component_id")), "least")
    empty = info.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return classed.join(least, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def op8_ngram_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), held AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN held b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON s.doc_id = m.x
"""
