"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from graphloom.llm.decontaminate import OP2_SQL, op2_decontamination
from graphloom.llm.html_text import op8_html
from graphloom.llm.language_id import op10_language_id
from graphloom.llm.licenses import op4_licenses
from graphloom.llm.packing import op3_packing
from graphloom.llm.secrets_scan import op7_secrets
from graphloom.llm.simhash import op5_simhash
from graphloom.llm.suffix_lm import op6_suffix_lm
from graphloom.llm.topk_search import OP1_SQL, op1_topk
from graphloom.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_topk": op1_topk,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_suffix_lm": op6_suffix_lm,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL = {"op1_topk": OP1_SQL, "op2_decontamination": OP2_SQL, "op9_warc": OP9_SQL}
