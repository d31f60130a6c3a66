"""What an agent is told beside a prompt: standing instructions, then what the archive knows. One prompt, or a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import search
from threadloom.plans.archive import Archive
from threadloom.sources.config import Config
from threadloom.sources.projects import interventions


def prompt_context(archive: Archive, envelope_text: str, config: Config | None = None, project: str | None = None, instructions: str | None = None, embedder=None) -> str:
    """The JSON for a prompt hook's input: `{}` without a prompt or anything to say. A failing search leaves the instructions: a prompt is never held up."""
    prompt = search.prompt_of(envelope_text)
    if not prompt:
        return search.envelope("")
    c = config or Config()
    try:
        found = search.context_text(archive.search(prompt, project=project, days=c.search.hook_days, limit=c.search.hook_limit, threshold=c.search.hook_threshold, extract_keywords=True, embedder=embedder, pool_size=c.embeddings.rerank_pool_size))
    except Exception:  # whatever fails in the archive, the prompt goes on
        found = ""
    return search.envelope(search.compose_context(interventions(instructions), found))


def batch_context(archive: Archive, prompts: DataFrame, limit: int = 3, project: str | None = None) -> DataFrame:
    """(query_id, rank, msg_id, score, session_id, project_slug, role, content_preview) of each prompt (query_id, text): its words' best messages, of one project if given. One join for all prompts; prompts that are null or without words give no rows."""
    from threadloom.functions.words import preview

    sessions = archive.sessions if project is None else archive.sessions.where(F.lower("project_slug") == project.lower())
    wanted = archive.messages.join(sessions.select("session_id", "project_slug"), "session_id")
    idx = archive.text_index
    if project is not None:
        # statistics stay those of the whole archive: the scope applies to what is ranked
        best = search.search_batch(idx, prompts, limit, wanted.select("msg_id"))
    else:
        best = search.search_batch(idx, prompts, limit)
    return best.join(wanted, "msg_id").select("query_id", "rank", "msg_id", F.round("score", 4).alias("score"), "session_id", "project_slug", "role", preview(F.col("content")).alias("content_preview"))
