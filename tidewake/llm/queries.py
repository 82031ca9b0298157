"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewake.llm.bpe import op6_byte_bpe
from tidewake.llm.chat import OP9_SQL, op9_chat
from tidewake.llm.decontaminate import OP10_SQL, op10_decontamination
from tidewake.llm.html_text import op3_html
from tidewake.llm.neighbours import op7_neighbours
from tidewake.llm.quality import op2_quality
from tidewake.llm.secrets import op5_secrets
from tidewake.llm.sharding import op1_sharding
from tidewake.llm.simhash import op8_simhash
from tidewake.llm.token_counts import op4_token_counts

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_html": op3_html,
    "op4_token_counts": op4_token_counts,
    "op5_secrets": op5_secrets,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_neighbours": op7_neighbours,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
}
#: Only where SQL can express an operator.
ORACLE_SQL = {"op9_chat": OP9_SQL, "op10_decontamination": OP10_SQL}
