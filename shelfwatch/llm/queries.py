"""The corpus operators as queries, and their SQL where SQL can express them."""

from shelfwatch.llm.decontaminate import op4_decontamination
from shelfwatch.llm.exact_dedup import op1_exact_dedup
from shelfwatch.llm.filter_audit import op11_filter_audit
from shelfwatch.llm.grid_order import op12_grid_order
from shelfwatch.llm.jaccard_join import op9_jaccard_join
from shelfwatch.llm.katz import op6_katz_scoring
from shelfwatch.llm.langid import op8_language_id
from shelfwatch.llm.mixing import op2_mixing
from shelfwatch.llm.oracles import ORACLES
from shelfwatch.llm.pii import op3_pii
from shelfwatch.llm.prefix_doubling import op7_prefix_doubling
from shelfwatch.llm.sharding import op10_sharding
from shelfwatch.llm.suffix_trees import op5_substring_dedup
from shelfwatch.llm.whitening import op13_whitening

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_katz_scoring": op6_katz_scoring,
    "op7_prefix_doubling": op7_prefix_doubling,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_grid_order": op12_grid_order,
    "op13_whitening": op13_whitening,
}
