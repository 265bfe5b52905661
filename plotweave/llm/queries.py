"""The operators as named queries, and SQL for those that SQL can express."""

from __future__ import annotations

from plotweave.llm.chat_format import op10_chat_format
from plotweave.llm.decontaminate import OP9_SQL, op9_decontamination
from plotweave.llm.digest_index import OP11_SQL, op11_exact_dedup
from plotweave.llm.filter_audit import OP12_SQL, op12_filter_audit
from plotweave.llm.mixing import OP1_SQL, op1_source_mix
from plotweave.llm.near_copies import op8_near_copies
from plotweave.llm.ngram_score import OP3_SQL, op3_ngram_score
from plotweave.llm.personal_data import op7_personal_data
from plotweave.llm.quality_model import op6_quality_model
from plotweave.llm.quality_rules import op2_quality_rules
from plotweave.llm.source_divergence import OP13_SQL, op13_source_divergence
from plotweave.llm.token_files import op5_token_files
from plotweave.llm.url_filter import op4_url_filter

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_score": op3_ngram_score,
    "op4_url_filter": op4_url_filter,
    "op5_token_files": op5_token_files,
    "op6_quality_model": op6_quality_model,
    "op7_personal_data": op7_personal_data,
    "op8_near_copies": op8_near_copies,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op1_source_mix": OP1_SQL,
    "op3_ngram_score": OP3_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
