"""The training-data operators' queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from threadloom.llm.decontaminate import op2_decontamination
from threadloom.llm.knn import OP5_SQL, op5_topk_search
from threadloom.llm.line_dedup import OP7_SQL, op7_line_dedup
from threadloom.llm.lm_scores import op6_lm_scores
from threadloom.llm.ngram_join import OP8_SQL, op8_ngram_join
from threadloom.llm.packing import op10_packing
from threadloom.llm.quality import op3_quality
from threadloom.llm.records import op9_binary_records
from threadloom.llm.token_counts import op4_token_counts
from threadloom.llm.wrapper import op1_html_extraction

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_decontamination, op3_quality, op4_token_counts, op5_topk_search, op6_lm_scores, op7_line_dedup, op8_ngram_join, op9_binary_records, op10_packing)}
ORACLE: dict[str, str] = {"op5_topk_search": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL}
