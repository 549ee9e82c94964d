"""Registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from matforge.llm.chat import OP10_SQL, op10_chat_format
from matforge.llm.collocations import OP13_SQL, op13_collocations
from matforge.llm.decontaminate import op1_decontamination
from matforge.llm.html_text import OP3_SQL, op3_html_extraction
from matforge.llm.licenses import op4_license_scan
from matforge.llm.lm_score import op7_lm_scoring
from matforge.llm.mtree import OP9_SQL, op9_mtree_topk
from matforge.llm.packing import op6_best_fit_packing
from matforge.llm.repeats import OP5_SQL, op5_suffix_array_dedup
from matforge.llm.runs import OP12_SQL, op12_periodic_runs
from matforge.llm.secrets import op11_secret_scan
from matforge.llm.simhash import op8_simhash_near_dedup
from matforge.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_html_extraction": op3_html_extraction,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_mtree_topk": op9_mtree_topk,
    "op10_chat_format": op10_chat_format,
    "op11_secret_scan": op11_secret_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

ORACLE = {
    "op3_html_extraction": OP3_SQL,
    "op5_suffix_array_dedup": OP5_SQL,
    "op9_mtree_topk": OP9_SQL,
    "op10_chat_format": OP10_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
