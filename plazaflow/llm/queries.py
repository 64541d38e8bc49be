"""Queries of this folder, by name, and their SQL where SQL can express them."""

from plazaflow.llm.bpe import op3_byte_bpe
from plazaflow.llm.decontaminate import OP10_SQL, op10_decontaminate
from plazaflow.llm.html_text import OP8_SQL, op8_html_text
from plazaflow.llm.lm_score import op9_lm_score
from plazaflow.llm.quality import op5_quality
from plazaflow.llm.sharding import OP7_SQL, op7_sharding
from plazaflow.llm.simhash import op4_simhash
from plazaflow.llm.token_blocks import op1_token_blocks
from plazaflow.llm.topk import OP6_SQL, op6_topk
from plazaflow.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_url_filter": op2_url_filter,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_sharding": op7_sharding,
    "op8_html_text": op8_html_text,
    "op9_lm_score": op9_lm_score,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL = {
    "op2_url_filter": OP2_SQL,
    "op6_topk": OP6_SQL,
    "op7_sharding": OP7_SQL,
    "op8_html_text": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
}
