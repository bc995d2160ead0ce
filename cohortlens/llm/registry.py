"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from cohortlens.llm.contamination import OP2_SQL, op2_decontaminate
from cohortlens.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from cohortlens.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from cohortlens.llm.license_scan import op6_license_scan
from cohortlens.llm.line_dedup import OP1_SQL, op1_line_dedup
from cohortlens.llm.merkle import OP13_SQL, op13_merkle_manifest
from cohortlens.llm.mixing import op5_mix_sources
from cohortlens.llm.packing import op11_packing
from cohortlens.llm.simhash import op3_simhash
from cohortlens.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from cohortlens.llm.token_counts import op8_token_counts
from cohortlens.llm.token_ids import op10_token_ids
from cohortlens.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_token_ids": op10_token_ids,
    "op11_packing": op11_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op1_line_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
