"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from carrylens.llm.op1_spotsigs import op1_spotsigs
from carrylens.llm.op2_packing import op2_cost_balanced_packing
from carrylens.llm.op3_minhash import op3_minhash_near_dedup
from carrylens.llm.op4_licenses import OP4_SQL, op4_license_sentence_rules
from carrylens.llm.op5_suffix_repeats import op5_common_prefix_intervals
from carrylens.llm.op6_personal import op6_bootstrapped_pii
from carrylens.llm.op7_decontaminate import op7_fm_index_decontamination
from carrylens.llm.op8_language import op8_ppm_language
from carrylens.llm.op9_pages import op9_template_deduction
from carrylens.llm.op10_repeats import op10_seed_extend_repeats
from carrylens.llm.op11_hard_negatives import op11_cover_tree_negatives
from carrylens.llm.op12_simhash import op12_simhash_ball
from carrylens.llm.op13_prefix_trie import op13_splitter_skeleton_trie

QUERIES = {f.__name__: f for f in (
    op1_spotsigs, op2_cost_balanced_packing, op3_minhash_near_dedup, op4_license_sentence_rules, op5_common_prefix_intervals,
    op6_bootstrapped_pii, op7_fm_index_decontamination, op8_ppm_language, op9_template_deduction, op10_seed_extend_repeats,
    op11_cover_tree_negatives, op12_simhash_ball, op13_splitter_skeleton_trie,
)}

#: Where DuckDB can state the same result; the other queries are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op4_license_sentence_rules": OP4_SQL}
