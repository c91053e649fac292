"""The queries of the corpus operators and, where SQL expresses them, their SQL."""

from __future__ import annotations

from assurelake.llm.bpe import op1_bpe
from assurelake.llm.chat import OP13_SQL, op13_chat_format
from assurelake.llm.filter_audit import OP12_SQL, op12_filter_audit
from assurelake.llm.jaccard import op10_jaccard
from assurelake.llm.langid import op3_language_id
from assurelake.llm.mixing import op7_mixing
from assurelake.llm.negatives import OP11_SQL, op11_hard_negatives
from assurelake.llm.pii import op6_pii
from assurelake.llm.quality import OP4_SQL, op4_quality
from assurelake.llm.token_counts import op5_token_counts
from assurelake.llm.topk import OP9_SQL, op9_top_k
from assurelake.llm.url_filter import URL_RULES_SQL, op2_url_filter, url_rules
from assurelake.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_top_k": op9_top_k,
    "op10_jaccard": op10_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_chat_format": op13_chat_format,
    "url_rules": url_rules,
}
ORACLE: dict[str, str] = {
    "op4_quality": OP4_SQL,
    "op8_warc": OP8_SQL,
    "op9_top_k": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_chat_format": OP13_SQL,
    "url_rules": URL_RULES_SQL,
}
