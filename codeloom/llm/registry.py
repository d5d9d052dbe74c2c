"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from codeloom.llm.op1_html import op1_html_extraction
from codeloom.llm.op2_bpe import op2_bpe_round_trip
from codeloom.llm.op3_chat import SQL as OP3_SQL
from codeloom.llm.op3_chat import op3_chat_format
from codeloom.llm.op4_jaccard import SQL as OP4_SQL
from codeloom.llm.op4_jaccard import op4_jaccard_join
from codeloom.llm.op5_topk import SQL as OP5_SQL
from codeloom.llm.op5_topk import op5_exact_top_k
from codeloom.llm.op6_toxicity import op6_toxicity
from codeloom.llm.op7_pii import SQL as OP7_SQL
from codeloom.llm.op7_pii import op7_pii
from codeloom.llm.op8_counts import op8_token_counts
from codeloom.llm.op9_packing import op9_best_fit_packing
from codeloom.llm.op10_audio import op10_telephony_audio
from codeloom.llm.op11_kmeans import SQL as OP11_SQL
from codeloom.llm.op11_kmeans import op11_sort_means
from codeloom.llm.op12_fim import SQL as OP12_SQL
from codeloom.llm.op12_fim import op12_fill_in_middle
from codeloom.llm.op13_sharding import SQL as OP13_SQL
from codeloom.llm.op13_sharding import op13_jump_sharding
from codeloom.runtime import shipped

QUERIES = {
    f.__name__: shipped(f)
    for f in (
        op1_html_extraction,
        op2_bpe_round_trip,
        op3_chat_format,
        op4_jaccard_join,
        op5_exact_top_k,
        op6_toxicity,
        op7_pii,
        op8_token_counts,
        op9_best_fit_packing,
        op10_telephony_audio,
        op11_sort_means,
        op12_fill_in_middle,
        op13_jump_sharding,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op7_pii": OP7_SQL,
    "op11_sort_means": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_jump_sharding": OP13_SQL,
}
