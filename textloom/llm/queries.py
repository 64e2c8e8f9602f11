"""The queries of this subpackage and the SQL for those that SQL can express."""

from textloom.llm.chat_format import OP4_SQL, op4_chat_format
from textloom.llm.decontaminate import op2_benchmark_decontamination
from textloom.llm.embedding_dedup import OP5_SQL, op5_embedding_neardup
from textloom.llm.html_extract import op6_html_extraction
from textloom.llm.line_dedup import OP1_SQL, op1_line_dedup
from textloom.llm.lm_score import op10_lm_score
from textloom.llm.packing import op8_best_fit_packing
from textloom.llm.simhash import op9_simhash_neardup
from textloom.llm.suffix_dedup import op3_suffix_dedup
from textloom.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_benchmark_decontamination, op3_suffix_dedup, op4_chat_format, op5_embedding_neardup, op6_html_extraction, op7_toxicity, op8_best_fit_packing, op9_simhash_neardup, op10_lm_score)}
SQL = {"op1_line_dedup": OP1_SQL, "op4_chat_format": OP4_SQL, "op5_embedding_neardup": OP5_SQL}
