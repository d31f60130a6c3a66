"""Line dedup with DataFrame functions only.

Lines are compared by the hash of their key (stripped, A-Z lower-cased). Keys held by very many documents are found by a
pre-aggregated count; with n line rows and p partitions, those with more than n / (4 p) rows number at most 4 p, so their
deciding facts (how many documents, the last one) are broadcast. All other hashes are range-partitioned, with a secondary sort
by document and position, and the first occurrence in that order is taken from the stream of a key's rows. What is returned per
document is a compressed bitmap of its lines, the runs of dropped ones, not text; drop_lines() applies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, materialize, scratch, shuffle_partitions, table

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hash(line: Column, min_chars: int) -> Column:
    """The key's hash; null for keys that are too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.md5(key))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_hash, dropped_runs) for each row of docs that loses lines.

    dropped_runs is the run-length form of the row's bitmap: array of (first, n), by first line, from 0. A line goes if its key
    has at least min_chars code points, at least min_docs rows of docs hold it, and the row isn't (one of those with) the
    largest id among them. Each row counts as a document of its own, so of repeated rows all or none keep a line. Null ids come
    before all others. row_hash tells rows with equal ids apart. Null or empty texts lose nothing; nor does an empty table.
    """
    spark = docs.sparkSession
    n_parts = shuffle_partitions(spark)
    hashes = F.transform(lines_of(F.col(text_col)), lambda x: _hash(x, min_chars))
    # hashed once; what follows reads this table instead of the texts
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), hashes.alias("hashes")), "line-hashes")
    held = rows.select("doc_id", F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))).alias("h"))
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    path = scratch(spark, "line-counts")
    counts.where(F.col("n") > 1).write.parquet(path)
    counts = spark.read.parquet(path)
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(min_docs, total // (4 * n_parts) + 1)
    hot = F.broadcast(counts.where(F.col("n") >= least).withColumnRenamed("h", "hot_h"))
    lines = rows.select("doc_id", "row_hash", F.posexplode("hashes").alias("pos", "h")).where("h is not null")
    marked = lines.join(hot, F.col("h") == F.col("hot_h"), "left")
    of_hot = marked.where("hot_h is not null and not (doc_id <=> last)").select("doc_id", "row_hash", "pos")
    rest = marked.where("hot_h is null").select("h", "doc_id", "row_hash", "pos")
    rest = rest.repartitionByRange(n_parts, "h").sortWithinPartitions("h", F.desc("doc_id"), "row_hash", "pos")
    key = Window.partitionBy("h")
    stream = key.orderBy(F.desc("doc_id"), "row_hash", "pos")
    # within a key, a row's own lines come by rising position: anything else begins another row
    before = [F.lag(c).over(stream) for c in ("doc_id", "row_hash", "pos")]
    same_row = before[0].eqNullSafe(F.col("doc_id")) & before[1].eqNullSafe(F.col("row_hash")) & (before[2] < F.col("pos"))
    rest = rest.withColumn("new_row", F.when(F.coalesce(same_row, F.lit(False)), 0).otherwise(1))
    rest = rest.withColumn("last", F.first("doc_id").over(stream)).withColumn("n", F.sum("new_row").over(key))
    of_rest = rest.where((F.col("n") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "row_hash", "pos")
    # repeated rows have the same bitmap
    dropped = of_hot.unionByName(of_rest).repartition(n_parts, "doc_id", "row_hash").dropDuplicates(["doc_id", "row_hash", "pos"])
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "row_hash").orderBy("pos"))
    runs = dropped.withColumn("run", run).groupBy("doc_id", "row_hash", "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("n"))
    return runs.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("dropped_runs"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, in order."""
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["first"] + r["n"]))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text_col cut down to the lines that stay, and two more columns, n_lines (before) and n_dropped, of type long.

    A null text stays null where it loses nothing (it never does) and counts one line. Columns of docs that are called n_lines or
    n_dropped are replaced; names that begin with `__line_dedup_` are this function's own. Repeated rows lose the same lines. An
    empty table gives an empty result.
    """
    maps = drop_bitmaps(docs, id_col, text_col, min_chars, min_docs).withColumnsRenamed({"doc_id": "__line_dedup_id", "row_hash": "__line_dedup_row", "dropped_runs": "__line_dedup_runs"})
    joined = docs.withColumn("__line_dedup_hash", F.xxhash64(text_col)).join(maps, F.col(id_col).eqNullSafe(F.col("__line_dedup_id")) & (F.col("__line_dedup_hash") == F.col("__line_dedup_row")), "left")
    lines = lines_of(F.col(text_col))
    text = F.when(F.col("__line_dedup_runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept_lines(lines, F.col("__line_dedup_runs")), "\n"))
    n_dropped = F.when(F.col("__line_dedup_runs").isNull(), F.lit(0)).otherwise(F.aggregate("__line_dedup_runs", F.lit(0), lambda a, r: a + r["n"])).cast("long")
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")], F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


def op7_line_dedup(spark, sf_dir):
    kept = drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), decided AS (
  SELECT doc_id, pos, line, c.k IS NOT NULL AND doc_id <> c.last AS gone FROM keyed LEFT JOIN common c ON keyed.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM decided GROUP BY doc_id
"""
