"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerlens.llm.collocations import OP12_SQL, op12_de_bruijn_phrases
from ledgerlens.llm.decontaminate import OP2_SQL, op2_benchmark_windows
from ledgerlens.llm.language import op7_string_kernel_language
from ledgerlens.llm.media import op6_tar_media
from ledgerlens.llm.near_dups import op3_weighted_minhash
from ledgerlens.llm.notices import op9_fuzzy_notices
from ledgerlens.llm.packing import op8_power_of_two_packing
from ledgerlens.llm.quality import op5_subword_embeddings
from ledgerlens.llm.spelling import OP13_SQL, op13_asymmetric_chunks
from ledgerlens.llm.token_counts import op1_separator_scan
from ledgerlens.llm.tool_calls import OP4_SQL, op4_tool_call_linking
from ledgerlens.llm.toxicity import op10_naive_bayes_ngrams
from ledgerlens.llm.urls import OP11_SQL, op11_path_templates

QUERIES = {
    f.__name__: f
    for f in (
        op1_separator_scan,
        op2_benchmark_windows,
        op3_weighted_minhash,
        op4_tool_call_linking,
        op5_subword_embeddings,
        op6_tar_media,
        op7_string_kernel_language,
        op8_power_of_two_packing,
        op9_fuzzy_notices,
        op10_naive_bayes_ngrams,
        op11_path_templates,
        op12_de_bruijn_phrases,
        op13_asymmetric_chunks,
    )
}
SQL = {"op2_benchmark_windows": OP2_SQL, "op4_tool_call_linking": OP4_SQL, "op11_path_templates": OP11_SQL, "op12_de_bruijn_phrases": OP12_SQL, "op13_asymmetric_chunks": OP13_SQL}
