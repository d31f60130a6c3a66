"""Registered queries of the archive engine over whole tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import kinds as K
from threadloom.functions.vectors import cosine, norm, pack_vector, unpack_vector
from threadloom.functions.words import STOP_WORDS, keywords_of, path_of, preview, slug_of
from threadloom.operators import archive_views as V
from threadloom.operators import fts, ingest, orphans, search, topics
from threadloom.schema import content_hash
from threadloom.sources import tables as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- SQL shared by the oracles

_PREFIX_SQL = "CASE (conv_id + turn) % 5 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(T.PREFIXES)) + " END"
_TIME_SQL = "CASE WHEN conv_id % 11 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 60 + turn AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') END"


def _messages(prefixed: bool = False) -> str:
    content = f"{_PREFIX_SQL} || text" if prefixed else "text"
    return f"""messages AS (SELECT conv_id * 1000 + turn AS msg_id, 'conv-' || conv_id AS session_id, role, {content} AS content,
  turn::INTEGER AS turn_index, {_TIME_SQL} AS timestamp, 'Proj-' || (conv_id % 7) AS project_slug, conv_id FROM conversations)"""


_SESSIONS = f"""sessions AS (SELECT 'conv-' || conv_id AS session_id, 'Proj-' || (conv_id % 7) AS project_slug, arg_min(ts, turn) AS started_at,
  arg_max(ts, turn) AS ended_at, count(*)::INTEGER AS turn_count FROM (SELECT conv_id, turn, {_TIME_SQL} AS ts FROM conversations) GROUP BY conv_id)"""
_INDEX = r"""tokens AS (SELECT msg_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS term FROM messages),
  postings AS (SELECT term, msg_id, count(*) AS tf FROM tokens GROUP BY term, msg_id),
  doc_stats AS (SELECT msg_id, len(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS dl FROM messages),
  corpus AS (SELECT count(*) AS n_docs, sum(dl)::DOUBLE AS total FROM doc_stats),
  dfs AS (SELECT term, count(*) AS n FROM postings GROUP BY term),
  weights AS (SELECT p.term, p.msg_id, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n_docs))) AS w FROM postings p JOIN dfs USING (term) JOIN doc_stats USING (msg_id), corpus)"""


def _bm25(condition: str, terms: list[str]) -> str:
    t = ", ".join(f"'{x}'" for x in terms)
    return f"matches AS (SELECT msg_id, sum(w) AS score FROM weights WHERE term IN ({t}) GROUP BY msg_id HAVING {condition})"


def _has(term: str) -> str:
    return f"count(*) FILTER (WHERE term = '{term}') > 0"


def _plain_index(spark, sf_dir):
    m = T.messages(spark, sf_dir)
    return m, fts.index(m, stemmed=False)


def _top(rows, k=10):
    return rows.orderBy(F.desc("score"), "msg_id").limit(k).select("msg_id", F.round("score", 4).alias("score"))


_TOP = "SELECT msg_id, round(score, 4) AS score FROM (SELECT * FROM matches ORDER BY score DESC, msg_id LIMIT 10)"

# --- full-text search


@_query(f"WITH {_messages()}, {_INDEX}, {_bm25('true', ['thing', 'sich', 'thwh'])} {_TOP}")
def bm25_or(spark, sf_dir):
    return _top(fts.search_index(_plain_index(spark, sf_dir)[1], "thing OR sich OR thwh"))


@_query(f"WITH {_messages()}, {_INDEX}, {_bm25(_has('ther') + ' AND ' + _has('thea'), ['ther', 'thea'])} {_TOP}")
def bm25_and(spark, sf_dir):
    return _top(fts.search_index(_plain_index(spark, sf_dir)[1], "ther thea"))


@_query(f"WITH {_messages()}, {_INDEX}, {_bm25(_has('thth') + ' AND NOT ' + _has('ther'), ['thth', 'ther'])} {_TOP}")
def bm25_not(spark, sf_dir):
    return _top(fts.search_index(_plain_index(spark, sf_dir)[1], "thth NOT ther"))


@_query(f"WITH {_messages()}, {_INDEX}, {_bm25('(' + _has('thou') + ' AND ' + _has('erin') + ') OR ' + _has('thwh'), ['thou', 'erin', 'thwh'])} SELECT count(*) AS n FROM matches")
def bm25_nested_count(spark, sf_dir):
    return fts.search_index(_plain_index(spark, sf_dir)[1], "(thou AND erin) OR thwh").agg(F.count(F.lit(1)).alias("n"))


@_query(rf"""WITH {_messages()} SELECT msg_id FROM messages WHERE regexp_matches(lower(content), '(^|[^\p{{L}}\p{{N}}])of[^\p{{L}}\p{{N}}]+the([^\p{{L}}\p{{N}}]|$)')""")
def phrase_matches(spark, sf_dir):
    return fts.search_index(_plain_index(spark, sf_dir)[1], '"of the"').select("msg_id")


@_query(rf"""WITH {_messages()} SELECT msg_id FROM messages WHERE regexp_matches(lower(content), '(^|[^\p{{L}}\p{{N}}])ththe')""")
def prefix_matches(spark, sf_dir):
    return fts.search_index(_plain_index(spark, sf_dir)[1], "ththe*").select("msg_id")


@_query(rf"""WITH {_messages()} SELECT msg_id FROM messages WHERE regexp_extract(lower(content), '[\p{{L}}\p{{N}}]+') = 'the'""")
def first_word_matches(spark, sf_dir):
    return fts.search_index(_plain_index(spark, sf_dir)[1], "^the").select("msg_id")


@_query(rf"""WITH {_messages()}, pos AS (SELECT msg_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) AS term, generate_subscripts(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+'), 1) AS i FROM messages)
SELECT DISTINCT a.msg_id FROM pos a JOIN pos b ON a.msg_id = b.msg_id AND a.term = 'thin' AND b.term = 'that' WHERE abs(a.i - b.i) - 1 <= 5""")
def near_matches(spark, sf_dir):
    return fts.search_index(_plain_index(spark, sf_dir)[1], "NEAR(thin that, 5)").select("msg_id")


@_query(f"""WITH {_messages(True)}, {_INDEX}, {_bm25('true', ['the', 'thing'])}
SELECT msg_id, round(score, 4) AS score FROM matches JOIN messages USING (msg_id)
WHERE lower(project_slug) = 'proj-3' AND (timestamp IS NULL OR timestamp >= '2024-01-02T00:00:00+00:00')""")
def bm25_scoped(spark, sf_dir):
    m = T.messages(spark, sf_dir, prefixed=True)
    found = fts.search_index(fts.index(m, stemmed=False), "the OR thing")
    return search.scoped(found, m, T.sessions(spark, sf_dir), since="2024-01-02T00:00:00+00:00", project="PROJ-3").select("msg_id", F.round("score", 4).alias("score"))


@_query(f"""WITH {_messages()}, {_INDEX}, {_bm25('true', ['thing', 'sich'])}, pool AS (SELECT * FROM matches ORDER BY score DESC, msg_id LIMIT 50)
SELECT msg_id, round(score, 4) AS score FROM pool WHERE score >= 3.0""")
def bm25_threshold_pool(spark, sf_dir):
    pool = fts.search_index(_plain_index(spark, sf_dir)[1], "thing OR sich").orderBy(F.desc("score"), "msg_id").limit(50)
    return pool.where("score >= 3.0").select("msg_id", F.round("score", 4).alias("score"))


@_query(rf"""WITH messages AS (SELECT doc_id AS msg_id, text AS content FROM documents), {_INDEX},
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
s AS (SELECT item_id AS query_id, msg_id, sum(w) AS score FROM q JOIN weights USING (term) GROUP BY item_id, msg_id)
SELECT query_id, msg_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, msg_id)::INTEGER AS rank FROM s) WHERE rank <= 3""")
def bm25_batch_benchmark(spark, sf_dir):
    idx = fts.index(T.document_messages(spark, sf_dir), stemmed=False)
    q = T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rows = search.search_batch(idx, q, top=20)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "msg_id")
    return rows.withColumn("rank", F.row_number().over(best).cast("int")).where("rank <= 3").select("query_id", "msg_id", "rank")


@_query(f"WITH {_messages()}, {_INDEX} SELECT term, msg_id, tf::INTEGER AS tf FROM postings")
def postings_build(spark, sf_dir):
    return _plain_index(spark, sf_dir)[1].postings.select("term", "msg_id", "tf")


@_query(f"WITH {_messages()}, {_INDEX} SELECT msg_id, dl::INTEGER AS dl FROM doc_stats")
def doc_stats(spark, sf_dir):
    return _plain_index(spark, sf_dir)[1].doc_stats


@_query(f"WITH {_messages()}, {_INDEX} SELECT n_docs, total::BIGINT AS total_tokens FROM corpus")
def corpus_stats(spark, sf_dir):
    return fts.corpus_stats(_plain_index(spark, sf_dir)[1])


@_query(f"WITH {_messages()}, {_INDEX} SELECT term, n AS df FROM dfs ORDER BY n DESC, term LIMIT 50")
def term_df_topk(spark, sf_dir):
    p = _plain_index(spark, sf_dir)[1].postings
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(50)


@_query()
def stemmed_search(spark, sf_dir):
    return fts.search_index(fts.index(T.messages(spark, sf_dir)), "things OR ther").select("msg_id", F.round("score", 4).alias("score"))


@_query()
def snippet_top(spark, sf_dir):
    m = T.messages(spark, sf_dir)
    rows = fts.search_index(fts.index(m), "thing OR sich").orderBy(F.desc("score"), "msg_id").limit(10).join(m, "msg_id")
    return rows.select("msg_id", fts.snippets(F.col("content"), "thing OR sich").alias("snippet"))


# --- text functions


@_query(rf"""SELECT item_id, array_to_string(found, ' ') AS keywords FROM (
SELECT item_id, list_filter(w, lambda x, i: length(x) >= 3 AND x NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}) AND list_position(w, x) = i) AS found
FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\-]+'), lambda x: lower(x)) AS w FROM benchmark))""")
def keyword_extract(spark, sf_dir):
    return T.read(spark, sf_dir, "benchmark").select("item_id", F.array_join(keywords_of(F.col("text")), " ").alias("keywords"))


@_query(r"""SELECT doc_id, CASE WHEN length(f) <= 200 THEN f ELSE regexp_replace(substring(f, 1, 200), '\s+$', '') || '...' END AS preview
FROM (SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS f FROM documents)""")
def preview_text(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@_query(r"""SELECT page_id, translate(p, ':\/', '---') AS slug FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'e:' ELSE '' END || url AS p FROM pages)""")
def slug_from_path(spark, sf_dir):
    p = F.concat(F.when(F.col("page_id") % 2 == 0, "E:").otherwise(""), F.col("url"))
    return T.read(spark, sf_dir, "pages").select("page_id", slug_of(p).alias("slug"))


@_query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'd:/work/' || replace(s_name, '-', '/') END AS path FROM supplier""")
def path_from_slug(spark, sf_dir):
    slug = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("work-"), "s_name")).otherwise(F.concat(F.lit("d--work-"), "s_name"))
    return T.read(spark, sf_dir, "supplier").select("s_suppkey", path_of(slug).alias("path"))


def _any(prefixes, lead: str) -> str:
    return "(" + " OR ".join(f"""starts_with({lead}, '{p.replace("'", "''")}')""" for p in prefixes) + ")"


_LEFT, _STRIPPED = r"regexp_replace(content, '^\s+', '')", r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
_TOKENS = "regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')"
_KIND_SQL = rf"""CASE WHEN coalesce(content, '') = '' THEN 'THOUGHT'
WHEN {_any(K.SUMMARY_OPENERS + K.WRAPPER_TAGS, _LEFT)} OR role = 'system' AND length({_LEFT}) <= 200 THEN 'HARNESS'
WHEN role = 'assistant' AND length(content) >= 80 AND (len({_TOKENS}) > 0 AND
  len(list_filter({_TOKENS}, lambda t: lower(t) IN ({", ".join(f"'{w}'" for w in K.CODE_WORDS)})))
  + len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '[a-z][A-Z]|[A-Z][a-z].*[A-Z]|_'))) >= 0.30 * len({_TOKENS})
  OR (length(content) - length(regexp_replace(content, '[{{}};()=<>\[\]]', '', 'g'))) / length(content) >= 0.04) THEN 'TOOL_RESULT_EMBEDDED'
WHEN role = 'assistant' AND {_STRIPPED} <> '' AND ({_any(K.NARRATION_OPENERS, f"lower({_STRIPPED})")} OR regexp_matches({_STRIPPED}, '(?i)^now\s+\S+:?\s*$')
  OR length({_STRIPPED}) <= 200 AND regexp_matches(lower({_STRIPPED}), '{"|".join(K.STATUS_TERMS)}')) THEN 'PROCEDURAL'
ELSE 'THOUGHT' END"""


@_query(f"WITH {_messages(True)} SELECT msg_id, {_KIND_SQL} AS kind FROM messages")
def kind_classify(spark, sf_dir):
    m = T.messages(spark, sf_dir, prefixed=True)
    return m.select("msg_id", K.kind_of(F.col("content"), F.col("role")).alias("kind"))


@_query(f"WITH {_messages(True)} SELECT {_KIND_SQL} AS kind, count(*) AS n FROM messages GROUP BY 1")
def kind_distribution(spark, sf_dir):
    return kind_classify(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _with_old_kind(spark, sf_dir):
    """Messages with kinds as an earlier index may have had them: some missing, the rest thoughts."""
    return T.messages(spark, sf_dir, prefixed=True).withColumn("content_kind", F.when(F.col("msg_id") % 3 != 0, "THOUGHT"))


@_query(f"""WITH {_messages(True)}, k AS (SELECT msg_id, CASE WHEN msg_id % 3 <> 0 THEN 'THOUGHT' END AS old_kind, {_KIND_SQL} AS new_kind FROM messages)
SELECT * FROM k WHERE old_kind IS DISTINCT FROM new_kind""")
def reclassify_delta(spark, sf_dir):
    return V.reclassified(_with_old_kind(spark, sf_dir))


@_query(f"""WITH {_messages(True)}, k AS (SELECT unnest(['THOUGHT', {_KIND_SQL}]) AS kind, unnest([1, 0]) AS b, unnest([0, 1]) AS a FROM messages)
SELECT kind, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM k GROUP BY kind""")
def reclassify_distribution(spark, sf_dir):
    return V.kind_changes(_with_old_kind(spark, sf_dir))


# --- catalog


@_query(f"""WITH {_messages()}, {_SESSIONS}, f AS (SELECT session_id, arg_min(content, turn_index) AS first_user FROM messages WHERE role = 'user' GROUP BY session_id)
SELECT session_id, project_slug, started_at, ended_at, turn_count, first_user FROM sessions LEFT JOIN f USING (session_id) ORDER BY started_at DESC NULLS LAST, session_id LIMIT 20""")
def session_list_first_user(spark, sf_dir):
    return V.list_sessions(T.sessions(spark, sf_dir), T.messages(spark, sf_dir)).select("session_id", "project_slug", "started_at", "ended_at", "turn_count", "first_user")


@_query(f"WITH {_messages()} SELECT msg_id, role, turn_index FROM (SELECT *, row_number() OVER (ORDER BY turn_index) - 1 AS p FROM messages WHERE session_id = 'conv-12') WHERE p >= 1 AND p < 4")
def session_show_turns(spark, sf_dir):
    return V.show_turns(T.messages(spark, sf_dir), "conv-12", *V.turn_range("1-3", 99)).select("msg_id", "role", "turn_index")


@_query(f"WITH {_SESSIONS} SELECT session_id, turn_count FROM sessions WHERE session_id = 'conv-17'")
def session_prefix_lookup(spark, sf_dir):
    return V.find_session(T.sessions(spark, sf_dir), "conv-17").select("session_id", "turn_count")


def _holes(spark, sf_dir):
    return T.messages(spark, sf_dir).where("msg_id % 5 <> 0")


@_query(f"""WITH {_messages()}, {_SESSIONS}, m AS (SELECT session_id, count(*) AS actual FROM messages WHERE msg_id % 5 <> 0 GROUP BY session_id)
SELECT session_id, project_slug, turn_count, coalesce(actual, 0) AS actual FROM sessions LEFT JOIN m USING (session_id) WHERE turn_count <> coalesce(actual, 0)""")
def integrity_gaps(spark, sf_dir):
    return V.turn_gaps(T.sessions(spark, sf_dir), _holes(spark, sf_dir))


@_query(f"""WITH {_messages()}, {_SESSIONS}, v AS (SELECT vec_id AS msg_id FROM embeddings),
m AS (SELECT session_id, count(*) AS m, count(v.msg_id) AS v FROM messages LEFT JOIN v USING (msg_id) GROUP BY session_id)
SELECT project_slug, count(*) AS n_sessions, sum(turn_count)::BIGINT AS turns, coalesce(sum(m), 0)::BIGINT AS n_messages, coalesce(sum(v), 0)::BIGINT AS n_vectors
FROM sessions LEFT JOIN m USING (session_id) GROUP BY project_slug""")
def integrity_by_project(spark, sf_dir):
    return V.project_totals(T.sessions(spark, sf_dir), T.messages(spark, sf_dir), T.vectors(spark, sf_dir))


@_query(f"WITH {_messages()} SELECT msg_id, session_id FROM messages WHERE conv_id % 10 = 3")
def orphan_messages(spark, sf_dir):
    kept = T.sessions(spark, sf_dir).where(F.col("file_mtime") % 10 != 3)
    return V.orphan_messages(kept, T.messages(spark, sf_dir)).select("msg_id", "session_id")


@_query(f"WITH {_messages()} SELECT msg_id FROM messages WHERE length(content) >= 600")
def index_missing_messages(spark, sf_dir):
    m = T.messages(spark, sf_dir)
    return V.missing_from_index(m, fts.index(m.where(F.length("content") < 600), stemmed=False).doc_stats)


@_query(f"WITH {_messages()} SELECT msg_id FROM messages WHERE msg_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded_backlog(spark, sf_dir):
    return V.unembedded(T.messages(spark, sf_dir), T.vectors(spark, sf_dir)).select("msg_id")


@_query(f"""WITH {_messages()}, {_SESSIONS} SELECT (SELECT count(*) FROM sessions) AS n_sessions, (SELECT count(*) FROM messages) AS n_messages, (SELECT count(*) FROM embeddings) AS n_vectors,
(SELECT max(ended_at) FROM sessions) AS last_message_at, '2024-06-01T00:00:00+00:00' AS last_indexed_at,
round((SELECT count(*) FROM embeddings) / (SELECT count(*) FROM messages), 4) AS coverage, round((SELECT count(*) FROM embeddings) / (SELECT count(*) FROM messages), 4) >= 0.95 AS semantic_ready""")
def vector_coverage(spark, sf_dir):
    return V.status(T.sessions(spark, sf_dir), T.messages(spark, sf_dir), T.vectors(spark, sf_dir))


# --- vectors and topics

_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _query_vector(spark, sf_dir, vec_id: int) -> list[float]:
    r = T.read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(r[0]) if r else []


@_query(f"SELECT b.vec_id AS msg_id, round({_COS}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY round({_COS}, 6) DESC, b.vec_id LIMIT 20")
def knn_cosine(spark, sf_dir):
    q = F.array(*map(F.lit, _query_vector(spark, sf_dir, 7)))
    rows = T.vectors(spark, sf_dir).select("msg_id", F.round(cosine(q, F.col("vector")), 6).alias("cosine"))
    return rows.orderBy(F.desc("cosine"), "msg_id").limit(20)


def _pool(spark, sf_dir):
    """The fifty best of all documents by BM25, with the language as project."""
    m = T.document_messages(spark, sf_dir)
    found = fts.search_index(fts.index(m, stemmed=False), "thing OR sich OR les")
    return search.ranked(found.orderBy(F.desc(F.round("score", 6)), "msg_id").limit(50).withColumn("score", F.round("score", 6))).join(m.select("msg_id", "project_slug"), "msg_id")


_POOL_SQL = f"""messages AS (SELECT doc_id AS msg_id, text AS content FROM documents WHERE doc_id < 500), {_INDEX}, {_bm25('true', ['thing', 'sich', 'les'])},
pool AS (SELECT msg_id, row_number() OVER (ORDER BY round(score, 6) DESC, msg_id) - 1 AS bm25_rank FROM matches ORDER BY round(score, 6) DESC, msg_id LIMIT 50),
c AS (SELECT p.msg_id, bm25_rank, lang AS project_slug, {_COS} AS cosine FROM pool p JOIN documents d ON d.doc_id = p.msg_id LEFT JOIN embeddings b ON b.vec_id = p.msg_id AND b.vec_id % 4 <> 1 LEFT JOIN embeddings a ON a.vec_id = 3)"""
_RANKED_SQL = "SELECT msg_id, bm25_rank::INTEGER AS bm25_rank, (row_number() OVER (ORDER BY cosine DESC NULLS LAST, bm25_rank) - 1)::INTEGER AS semantic_rank FROM "


@_query(f"WITH {_POOL_SQL} {_RANKED_SQL} c")
def rerank_pool(spark, sf_dir):
    v = T.vectors(spark, sf_dir).where("msg_id % 4 <> 1")
    return search.rerank(_pool(spark, sf_dir), v, _query_vector(spark, sf_dir, 3)).select("msg_id", "bm25_rank", "semantic_rank")


@_query(f"""WITH {_POOL_SQL}, b AS (SELECT msg_id, bm25_rank, cosine * CASE WHEN (SELECT count(DISTINCT project_slug) FROM c) >= 2
THEN least(1 + 0.05 * (count(*) OVER (PARTITION BY project_slug) - 1), 1.5) ELSE 1 END AS cosine FROM c) {_RANKED_SQL} b""")
def rerank_boost(spark, sf_dir):
    v = T.vectors(spark, sf_dir).where("msg_id % 4 <> 1")
    return search.rerank(_pool(spark, sf_dir), v, _query_vector(spark, sf_dir, 3), boost=True).select("msg_id", "bm25_rank", "semantic_rank")


@_query("""SELECT vec_id AS msg_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings""")
def vector_codec_norm(spark, sf_dir):
    v = T.vectors(spark, sf_dir).select("msg_id", unpack_vector(pack_vector("vector"), "dim").alias("vector"))
    return v.select("msg_id", F.round(norm(F.col("vector")), 6).alias("norm"))


_UNIT_SQL = """u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS n FROM embeddings),
x AS (SELECT label, unnest(n) AS v, generate_subscripts(n, 1) AS i FROM u), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i),
center AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY label),
sim AS (SELECT vec_id, u.label, round(list_inner_product(c, e) / sqrt(list_inner_product(c, c)) / sqrt(list_inner_product(e, e)), 6) AS similarity FROM u JOIN center USING (label))"""


@_query(f"WITH {_UNIT_SQL} SELECT label AS cluster_id, vec_id AS msg_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS k FROM sim) WHERE k <= 3")
def cluster_centroid_samples(spark, sf_dir):
    sim = topics.centroid_similarity(T.vectors(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))
    near = Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "msg_id")
    return sim.withColumn("k", F.row_number().over(near)).where("k <= 3").select("cluster_id", "msg_id", "similarity")


def _labelled(spark, sf_dir):
    """Documents in the clusters of the vectors with their ids."""
    m = T.document_messages(spark, sf_dir)
    return m.join(T.vectors(spark, sf_dir).select("msg_id", "cluster_id"), "msg_id")


_LABEL_SQL = f"""r AS (SELECT label AS cluster_id, doc_id AS msg_id, text AS content, source, lang FROM documents JOIN embeddings ON vec_id = doc_id),
w AS (SELECT cluster_id, msg_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT cluster_id, msg_id, regexp_extract_all(lower(content), '[a-z][a-z0-9]+') AS t FROM r)),
k AS (SELECT * FROM w WHERE length(term) >= 3 AND term NOT IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})),
tf AS (SELECT cluster_id, term, count(*) AS tf, min(msg_id * 10000000 + pos) AS first FROM k GROUP BY cluster_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT cluster_id) AS n FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY tf * ln(n / df) DESC, first) AS k FROM tf JOIN df USING (term), n WHERE df <= greatest(1, floor(n * 0.5))),
labels AS (SELECT cluster_id, string_agg(term, ' / ' ORDER BY k) AS label FROM s WHERE k <= 3 GROUP BY cluster_id)"""


@_query(f"WITH {_LABEL_SQL} SELECT c.cluster_id, coalesce(label, '(no distinctive terms)') AS label FROM (SELECT DISTINCT cluster_id FROM r) c LEFT JOIN labels USING (cluster_id)")
def cluster_labels_tfidf(spark, sf_dir):
    return topics.labels(_labelled(spark, sf_dir))


@_query(f"""WITH {_LABEL_SQL}, g AS (SELECT cluster_id, count(*) AS cluster_size, count(DISTINCT lang) AS project_count FROM r GROUP BY cluster_id HAVING count(*) >= 4)
SELECT cluster_id, cluster_size, project_count::INTEGER AS project_count, cluster_size * project_count AS score, (row_number() OVER (ORDER BY cluster_size * project_count DESC, cluster_id))::INTEGER AS rank FROM g""")
def theme_rank(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumns({"similarity": F.lit(1.0), "role": F.lit("user"), "started_at": F.lit(None).cast("string")})
    return topics.themes(rows).select("cluster_id", "cluster_size", "project_count", "score", "rank")


@_query()
def topics_leader(spark, sf_dir):
    return topics.leader_clusters(T.vectors(spark, sf_dir), threshold=0.2)


# --- upkeep


def _old_and_new(spark, sf_dir):
    """An archive before and after: every seventh message edited, every eleventh cut off at the end, every thirteenth new."""
    m = T.messages(spark, sf_dir)
    old = m.where("msg_id % 13 <> 0")
    new = m.where("msg_id % 11 <> 0").withColumn("content", F.when(F.col("msg_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return old, new.withColumn("content_hash", content_hash(F.col("content")))


_DIFF_SQL = f"""WITH {_messages()}, o AS (SELECT session_id, turn_index, msg_id, sha256(content) AS h FROM messages WHERE msg_id % 13 <> 0),
n AS (SELECT session_id, turn_index, sha256(CASE WHEN msg_id % 7 = 0 THEN content || '!' ELSE content END) AS h FROM messages WHERE msg_id % 11 <> 0)
SELECT session_id, turn_index, coalesce(msg_id, -1) AS msg_id, CASE WHEN n.h IS NULL THEN 'DELETE' WHEN o.h IS NULL THEN 'INSERT' WHEN o.h = n.h THEN 'KEEP' ELSE 'REPLACE' END AS action
FROM o FULL JOIN n USING (session_id, turn_index)"""


@_query(_DIFF_SQL)
def hash_diff_actions(spark, sf_dir):
    return ingest.turn_actions(*_old_and_new(spark, sf_dir)).withColumn("msg_id", F.coalesce("msg_id", F.lit(-1)))


@_query(f"""WITH d AS ({_DIFF_SQL}) SELECT count(*) FILTER (WHERE action = 'KEEP') AS kept, count(*) FILTER (WHERE action IN ('INSERT', 'REPLACE')) AS fresh FROM d""")
def upsert_counts(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    after, _ = ingest.upsert_messages(old, new)
    kept = F.col("was").isNotNull()
    both = after.join(old.select("msg_id", F.lit(1).alias("was")), "msg_id", "left")
    return both.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("fresh"))


@_query(f"""WITH {_SESSIONS} SELECT session_id, CASE WHEN project_slug = 'Proj-2' THEN 'Moved' ELSE project_slug END AS project_slug,
CASE WHEN project_slug = 'Proj-2' THEN '/new/Moved' ELSE '/archive/' || project_slug END || '/' || session_id || '.jsonl' AS file_path FROM sessions""")
def migrate_slug(spark, sf_dir):
    return ingest.migrate_project(T.sessions(spark, sf_dir), "Proj-2", "Moved", "/archive/Proj-2", "/new/Moved").select("session_id", "project_slug", "file_path")


@_query(f"WITH {_messages()} SELECT count(DISTINCT session_id) AS n_sessions, count(*) AS n_messages FROM messages WHERE project_slug = 'Proj-2'")
def migrate_totals(spark, sf_dir):
    return ingest.migration_totals(T.sessions(spark, sf_dir), T.messages(spark, sf_dir), "Proj-2")


@_query(f"WITH {_SESSIONS} SELECT session_id FROM sessions WHERE project_slug IN ('Proj-1', 'Proj-4') AND turn_count < 4")
def missing_sessions(spark, sf_dir):
    s = T.sessions(spark, sf_dir)
    return ingest.missing_sessions(s, s.where("turn_count >= 4"), ["Proj-1", "Proj-4"]).select("session_id")


@_query("""WITH slugs AS (SELECT 'e--Documents-' || c_mktsegment || '-' || n_name AS slug, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT DISTINCT slug FROM slugs), live AS (SELECT 'e--dev-' || n_name AS slug, n_nationkey AS ord FROM nation WHERE n_nationkey % 2 = 0)
SELECT s.slug, arg_min(live.slug, ord) AS successor FROM s JOIN live ON ends_with(live.slug, '-' || list_extract(string_split(s.slug, '-'), -1)) AND live.slug <> s.slug GROUP BY s.slug""")
def orphan_slug_theta(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer").join(T.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    slugs = c.select(F.concat(F.lit("e--Documents-"), "c_mktsegment", F.lit("-"), "n_name").alias("slug")).distinct()
    live = T.read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("e--dev-"), "n_name").alias("slug"), F.col("n_nationkey").alias("ord"))
    return orphans.successors(slugs, live)


@_query()
def png_dims(spark, sf_dir):
    from threadloom.functions.images import png_size

    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex("p_size"), 8, "0")), F.unhex(F.lpad(F.hex(F.col("p_partkey")), 8, "0")))
    return T.read(spark, sf_dir, "part").select("p_partkey", png_size(head).alias("s")).select("p_partkey", "s.width", "s.height")


ORACLE["png_dims"] = "SELECT p_partkey, p_size AS width, p_partkey::INTEGER AS height FROM part"


# --- the operators' scopes and upkeep over whole tables

_POOL_ALL_SQL = f"""messages AS (SELECT doc_id AS msg_id, text AS content FROM documents), {_INDEX}, {_bm25('true', ['thing', 'sich', 'les'])},
pool AS (SELECT msg_id, row_number() OVER (ORDER BY round(score, 6) DESC, msg_id) - 1 AS bm25_rank FROM matches ORDER BY round(score, 6) DESC, msg_id LIMIT 50),
c AS (SELECT p.msg_id, bm25_rank, lang AS project_slug, {_COS} AS cosine FROM pool p JOIN documents d ON d.doc_id = p.msg_id LEFT JOIN embeddings b ON b.vec_id = p.msg_id LEFT JOIN embeddings a ON a.vec_id = 3)"""


@_query(f"WITH {_POOL_ALL_SQL} {_RANKED_SQL} c")
def rerank_pool_all_vectors(spark, sf_dir):
    return search.rerank(_pool(spark, sf_dir), T.vectors(spark, sf_dir), _query_vector(spark, sf_dir, 3)).select("msg_id", "bm25_rank", "semantic_rank")


@_query(f"""WITH {_POOL_ALL_SQL}, b AS (SELECT msg_id, bm25_rank, cosine * CASE WHEN (SELECT count(DISTINCT project_slug) FROM c) >= 2
THEN least(1 + 0.05 * (count(*) OVER (PARTITION BY project_slug) - 1), 1.5) ELSE 1 END AS cosine FROM c) {_RANKED_SQL} b""")
def rerank_boost_all_vectors(spark, sf_dir):
    return search.rerank(_pool(spark, sf_dir), T.vectors(spark, sf_dir), _query_vector(spark, sf_dir, 3), boost=True).select("msg_id", "bm25_rank", "semantic_rank")


@_query(f"""WITH {_messages(True)}, {_INDEX}, {_bm25('true', ['the', 'thing'])}, k AS (SELECT msg_id, CASE WHEN msg_id % 3 <> 0 THEN {_KIND_SQL} END AS kind FROM messages)
SELECT msg_id, round(score, 4) AS score FROM matches JOIN k USING (msg_id) WHERE kind IS NULL OR kind IN ('PROCEDURAL', 'HARNESS')""")
def bm25_kinds(spark, sf_dir):
    m = T.messages(spark, sf_dir, prefixed=True)
    m = m.withColumn("content_kind", F.when(F.col("msg_id") % 3 != 0, K.kind_of(F.col("content"), F.col("role"))))
    found = fts.search_index(fts.index(m, stemmed=False), "the OR thing")
    return search.scoped(found, m, T.sessions(spark, sf_dir), kinds=["PROCEDURAL", "HARNESS"]).select("msg_id", F.round("score", 4).alias("score"))


@_query(f"WITH {_SESSIONS}, p AS (SELECT lpad(substring(session_id, 6), 6, '0') || '-Tail' AS session_id, turn_count FROM sessions) SELECT * FROM p WHERE starts_with(lower(session_id), '000017-t')")
def session_by_prefix(spark, sf_dir):
    s = T.sessions(spark, sf_dir).withColumn("session_id", F.concat(F.lpad(F.expr("substring(session_id, 6)"), 6, "0"), F.lit("-Tail")))
    return V.find_session(s, "000017-t").select("session_id", "turn_count")


@_query(f"""WITH {_messages()} SELECT session_id, turn_index, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY session_id, turn_index) AS msg_id FROM messages""")
def message_ids(spark, sf_dir):
    return ingest.number_messages(T.messages(spark, sf_dir), T.document_messages(spark, sf_dir)).select("session_id", "turn_index", "msg_id")


@_query(f"""WITH {_SESSIONS}, n AS (SELECT CASE WHEN turn_count >= 5 THEN session_id ELSE session_id || '-new' END AS session_id, started_at, turn_count + 1 AS turn_count FROM sessions)
SELECT session_id, CASE WHEN o.turn_count IS NULL THEN n.started_at ELSE '2023' END AS started_at, coalesce(n.turn_count, o.turn_count)::INTEGER AS turn_count
FROM n FULL JOIN (SELECT session_id, turn_count FROM sessions) o USING (session_id)""")
def session_upsert(spark, sf_dir):
    """An archive of all sessions meets new ones: the longer ones grown by a turn, the others under ids of their own."""
    s = T.sessions(spark, sf_dir)
    new = s.withColumn("session_id", F.when(F.col("turn_count") >= 5, F.col("session_id")).otherwise(F.concat("session_id", F.lit("-new")))).withColumn("turn_count", F.col("turn_count") + 1)
    return ingest.upsert_sessions(s.withColumn("started_at", F.lit("2023")), new).select("session_id", "started_at", "turn_count")


def _document_archive(spark, sf_dir):
    """Documents as messages of one session for each source and language, with kinds and times that follow from their ids, and the sessions."""
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("msg_id") % 28).cast("string"), 2, "0"))
    rows = T.document_messages(spark, sf_dir).withColumn("session_id", F.concat("session_id", F.lit("/"), "project_slug"))
    rows = rows.withColumns({"content_kind": F.element_at(F.array(F.lit("HARNESS"), F.lit(None), F.lit("THOUGHT")), (F.col("msg_id") % 3 + 1).cast("int")), "timestamp": F.when(F.col("msg_id") % 7 != 0, day)})
    return rows.drop("project_slug"), rows.select("session_id", "project_slug").distinct().withColumn("started_at", F.lit("2024-01-01"))


@_query("""WITH r AS (SELECT vec_id AS msg_id, CASE WHEN vec_id % 5 = 4 THEN 32 ELSE len(embedding) END AS dim FROM embeddings JOIN documents ON doc_id = vec_id
WHERE lower(lang) = 'en' AND vec_id % 3 <> 0 AND vec_id % 7 <> 0 AND '2024-01-' || lpad((1 + vec_id % 28)::VARCHAR, 2, '0') >= '2024-01-08T00:00:00+00:00')
SELECT msg_id FROM r WHERE dim = (SELECT arg_min(dim, msg_id) FROM r)""")
def theme_candidates(spark, sf_dir):
    """What `topics` clusters: thoughts of one project since a day, with vectors as long as the first one's; each fifth vector is a short one."""
    v = T.vectors(spark, sf_dir).withColumn("vector", F.when(F.col("msg_id") % 5 == 4, F.slice("vector", 1, 32)).otherwise(F.col("vector")))
    return topics.candidates(v, *_document_archive(spark, sf_dir), project="EN", since=topics.parse_since("2024-01-08")).select("msg_id")


@_query("SELECT vec_id AS msg_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lower(lang) = 'en')")
def vectors_after_delete(spark, sf_dir):
    return ingest.delete_vectors(T.vectors(spark, sf_dir), *_document_archive(spark, sf_dir), project="EN").select("msg_id")


@_query(f"WITH {_messages()} SELECT vec_id AS msg_id FROM embeddings WHERE vec_id IN (SELECT msg_id FROM messages)")
def vectors_surviving(spark, sf_dir):
    return ingest.surviving_vectors(T.vectors(spark, sf_dir), T.messages(spark, sf_dir)).select("msg_id")


@_query("""SELECT coalesce(o.vec_id, n.vec_id) AS msg_id, CASE WHEN n.vec_id IS NULL THEN '2024-06-01T00:00:00+00:00' ELSE '2024-07-02' END AS embedded_at
FROM embeddings o FULL JOIN (SELECT vec_id + 250 AS vec_id FROM embeddings) n ON o.vec_id = n.vec_id""")
def vectors_newest(spark, sf_dir):
    """Vectors meet two later versions of vectors whose ids are 250 higher."""
    v = T.vectors(spark, sf_dir).drop("cluster_id")
    new = v.withColumn("msg_id", F.col("msg_id") + 250).withColumn("embedded_at", F.explode(F.array(F.lit("2024-07-01"), F.lit("2024-07-02"))))
    return ingest.upsert_vectors(v, new).select("msg_id", "embedded_at")


_FOUND_SQL = "SELECT DISTINCT 'e--Documents-' || c_mktsegment || '-' || n_name AS slug FROM customer JOIN nation ON c_nationkey = n_nationkey"


@_query(f"""WITH f AS ({_FOUND_SQL} UNION SELECT 'x--' || s_name FROM supplier), e AS (SELECT DISTINCT CASE WHEN n_regionkey < 3 THEN 'e--dev-' || n_name ELSE 'e--dev-new' || n_name END AS slug FROM nation),
c AS (SELECT slug AS candidate, '0' || slug AS ord FROM e UNION ALL SELECT slug, '1' || slug FROM f),
s AS (SELECT f.slug, arg_min(candidate, ord) AS successor FROM f JOIN c ON candidate <> slug AND string_split(candidate, '-')[-1] = string_split(slug, '-')[-1] WHERE list_contains(string_split(slug, '-'), 'Documents') GROUP BY f.slug)
SELECT slug, CASE WHEN successor IS NULL THEN 'orphan' ELSE 'pre_migration' END AS state, successor, CASE WHEN successor IS NULL THEN 'WARN' ELSE 'ERROR' END AS severity FROM f LEFT JOIN s USING (slug) WHERE slug NOT IN (SELECT slug FROM e)
UNION ALL SELECT slug, 'missing', NULL, 'OK' FROM e WHERE slug NOT IN (SELECT slug FROM f)""")
def orphan_states(spark, sf_dir):
    n = T.read(spark, sf_dir, "nation")
    found = T.read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("e--Documents-"), "c_mktsegment", F.lit("-"), "n_name").alias("slug"))
    found = found.unionByName(T.read(spark, sf_dir, "supplier").select(F.concat(F.lit("x--"), "s_name").alias("slug")))
    expected = n.select(F.concat(F.when(F.col("n_regionkey") < 3, "e--dev-").otherwise("e--dev-new"), "n_name").alias("slug"))
    return orphans.reconcile(found, expected)
