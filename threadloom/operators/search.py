"""Ranked search: fallbacks, scoping, reranking, formats."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.vectors import cosine
from threadloom.functions.words import any_of, keywords, preview, sanitized
from threadloom.operators.fts import END_MARK, MARK, Index, QueryError, search_index, snippets

BOOST_STEP, BOOST_MOST = 0.05, 1.5
#: Ranges of messages of a batch for each shuffle partition: a posting takes little room, but meets all queries with its word in one task.
SPREAD = 4
RESULT = ["session_id", "project_slug", "started_at", "turn_index", "role", "score", "snippet", "content_preview", "bm25_rank", "semantic_rank"]


@dataclass
class Response:
    query: str
    total_matches: int
    returned: int
    threshold: float
    results: list[dict]
    semantic_used: bool = False
    semantic_fallback_reason: str | None = None


def since_days(days: int, now: datetime | None = None) -> str:
    """ISO text of the moment `days` ago; timestamps are compared as text."""
    return ((now or datetime.now(UTC)) - timedelta(days=days)).isoformat()


def scoped(matches: DataFrame, messages: DataFrame, sessions: DataFrame, since: str | None = None, project: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Matches (msg_id, score) with their messages and sessions. A null timestamp passes `since`, a null kind passes `kinds`, projects are compared without case. Scores stay those of the whole index."""
    s = sessions.select("session_id", "project_slug", "started_at")
    m = messages
    if since is not None:
        m = m.where(F.col("timestamp").isNull() | (F.col("timestamp") >= since))
    if kinds:
        m = m.where(F.col("content_kind").isNull() | F.col("content_kind").isin(list(kinds)))
    if project is not None:
        s = s.where(F.lower("project_slug") == project.lower())
    return matches.join(m, "msg_id").join(s, "session_id")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bm25_rank", F.row_number().over(Window.orderBy(F.desc("score"), "msg_id")) - 1)


def rerank(pool: DataFrame, vectors: DataFrame, query_vector: list[float], boost: bool = False) -> DataFrame:
    """The pool (a bounded number of rows, with bm25_rank) by cosine to the query; rows without a vector of its length come last, in BM25 order.

    With boost and two or more projects in the pool, a cosine is multiplied by 1 + 0.05 for each further hit of its project,
    1.5 at most; negative ones too, which moves them down.
    """
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    rows = pool.join(vectors.select("msg_id", "vector"), "msg_id", "left").withColumn("cosine", cosine(q, F.col("vector"))).drop("vector")
    if boost:
        of_project = Window.partitionBy("project_slug")
        whole = Window.partitionBy(F.lit(1))
        hits = F.count(F.lit(1)).over(of_project)
        projects = F.size(F.collect_set("project_slug").over(whole))
        rows = rows.withColumn("cosine", F.col("cosine") * F.when(projects >= 2, F.least(1 + BOOST_STEP * (hits - 1), F.lit(BOOST_MOST))).otherwise(1.0))
    return rows.withColumn("semantic_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("cosine"), "bm25_rank")) - 1)


def search(idx: Index, messages: DataFrame, sessions: DataFrame, query: str, *, days: int = 90, limit: int = 10, project: str | None = None, threshold: float = 0.0, extract_keywords: bool = False, vectors: DataFrame | None = None, embedder=None, pool_size: int = 50, boost: bool = False, kinds: list[str] | None = None, now: datetime | None = None) -> Response:
    """Search as one call. The query is tried as it is, then its words with any of them, if it doesn't parse or finds nothing.

    With an embedder and vectors, the best max(limit, pool_size) rows are reranked by cosine to the query that was searched
    for; if that fails, BM25's order stays and the response says why. The threshold applies after the pool's limit. Only result
    rows reach the driver.
    """
    asked = query
    if extract_keywords:
        asked = any_of(keywords(query))
    semantic = embedder is not None and vectors is not None
    rows, error, used, got, matched, held = None, None, asked, [], 0, []
    best_first = (F.desc("score"), "msg_id")
    try:
        for attempt in dict.fromkeys((asked, sanitized(asked))):
            if not attempt.strip():
                continue
            try:
                found = search_index(idx, attempt).persist()
            except QueryError as e:
                error = e
                continue
            held.append(found)
            rows, used = scoped(found, messages, sessions, since_days(days, now), project, kinds), attempt
            # ranks are given to a bounded number of rows; whatever else matched is only counted
            if semantic:
                rows = ranked(rows.orderBy(*best_first).limit(max(limit, pool_size))).where(F.col("score") >= threshold)
                matched = rows.count()
            else:
                rows = rows.where(F.col("score") >= threshold)
                matched = rows.count()
                rows = ranked(rows.orderBy(*best_first).limit(limit))
            if matched:
                break
        if rows is None:
            raise QueryError(f"no searchable words in {query!r}" if error is None else str(error))
        reason, used_vectors, order = None, False, "bm25_rank"
        if semantic and matched:
            try:
                vector = embedder.embed(asked)
                if vectors.join(rows.select("msg_id"), "msg_id", "left_semi").isEmpty():
                    reason = "no vectors for the results"
                else:
                    rows, order, used_vectors = rerank(rows, vectors, vector, boost and project is None), "semantic_rank", True
            except Exception as e:  # an embedding service may fail in any way; the ranking by words stands
                reason = f"embedding failed: {e}"
        if matched:
            shown = rows.orderBy(order).limit(limit)
            shown = shown.withColumn("snippet", snippets(F.col("content"), used, idx.stemmed)).withColumn("content_preview", preview(F.col("content"))).withColumn("score", F.round("score", 4))
            if not used_vectors:
                shown = shown.withColumn("bm25_rank", F.lit(None).cast("int")).withColumn("semantic_rank", F.lit(None).cast("int"))
            got = [r.asDict() for r in shown.select(*RESULT).collect()]
    finally:
        for found in held:
            found.unpersist()
    return Response(query, matched, len(got), threshold, got, used_vectors, reason)


def search_batch(idx: Index, queries: DataFrame, top: int = 10, among: DataFrame | None = None) -> DataFrame:
    """(query_id, msg_id, score, rank): each query's words (column `text`), any of them, ranked by BM25 rounded to 6 places, then id, so that copies' ranks don't depend on the order of summation. One join for all queries; `among` (msg_id) are the messages that are ranked, all if not given.

    The queries' words, with their weights, are broadcast. Postings of other words don't leave the tasks that read them; the
    rest are dealt by message once, and where they meet the lengths, scores are summed and each task keeps its best.
    """
    from threadloom.functions.stems import stemmed_texts
    from threadloom.functions.words import native_tokens
    from threadloom.operators.fts import B, K1, RARE_IDF

    words = stemmed_texts(queries, "query_id", "text") if idx.stemmed else queries.select("query_id", native_tokens(F.col("text")).alias("tokens"))
    q = words.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    postings = idx.postings.select("term", "msg_id", "tf").join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
    parts = SPREAD * int(idx.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows without an id count in the statistics only; they are apart, so that statistics and scores read the same shuffles
    no_id, lengths = F.col("msg_id").isNull(), idx.doc_stats.where("msg_id is not null").repartition(parts, "msg_id")
    rows = postings.where(~no_id)
    df = rows.unionByName(postings.where(no_id)).groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("n"))
    totals = lengths.select("dl").unionByName(idx.doc_stats.where(no_id).select("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))
    idf = F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    known = df.crossJoin(F.broadcast(totals)).select("term", F.when(idf > 0, idf).otherwise(RARE_IDF).alias("idf"), "n_docs", "total_tokens")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * F.col("n_docs") / F.col("total_tokens")))
    if among is not None:
        rows = rows.join(among, "msg_id", "left_semi")
    weights = rows.repartition(parts, "msg_id").join(lengths.hint("shuffle_hash"), "msg_id").join(F.broadcast(known), "term").select("term", "msg_id", weight.alias("w"))
    scores = weights.join(q, "term").groupBy("query_id", "msg_id").agg(F.sum("w").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "msg_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def context_text(response: Response, title: str = "Relevant prior-session context:") -> str:
    lines = [f"[Session {r['session_id'][:8]}, {(r['started_at'] or '')[:10]}] {r['role']}: {r['snippet'].replace(MARK, '').replace(END_MARK, '')}" for r in response.results]
    return "\n".join([title, "", *lines]) if lines else ""


def envelope(text: str, event: str = "UserPromptSubmit") -> str:
    """The JSON that a prompt hook reads; an empty object for an empty text."""
    return json.dumps({"hookSpecificOutput": {"hookEventName": event, "additionalContext": text}} if text else {}, ensure_ascii=False)


def compose_context(interventions: str, found: str) -> str:
    """Standing instructions before what was found, with a rule between them."""
    return "\n\n---\n\n".join(x for x in (interventions.strip(), found) if x)


def format_response(r: Response, form: str = "text") -> str:
    if form == "agent-context":
        return envelope(context_text(r))
    if form == "json":
        return json.dumps({"query": r.query, "total_matches": r.total_matches, "returned": r.returned, "threshold": r.threshold, "results": r.results}, indent=2, ensure_ascii=False)
    if not r.results:
        return f"No matches for {r.query!r}."
    body = [f"{k}. [{x['session_id'][:8]} {(x['started_at'] or '')[:10]} turn {x['turn_index']} {x['role']}] score={x['score']}\n   {x['snippet']}\n" for k, x in enumerate(r.results, 1)]
    return "\n".join([f"query: {r.query}", f"returned: {r.returned} / total: {r.total_matches}", "", *body])


def prompt_of(envelope_text: str) -> str:
    """The prompt of a hook's input; empty for anything else."""
    try:
        value = json.loads(envelope_text)
    except ValueError:
        return ""
    prompt = value.get("prompt") if isinstance(value, dict) else None
    return prompt if isinstance(prompt, str) else ""
