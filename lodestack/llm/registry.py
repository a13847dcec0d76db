"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from lodestack.llm import decontaminate, fill_in_middle, langid, lexical, mixing, mtree, packing, preferences, rans, simhash, substring_dedup, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_rans_token_ids": rans.op1_rans_token_ids,
        "op2_mtree_top_k": mtree.op2_mtree_top_k,
        "op3_preference_formatting": preferences.op3_preference_formatting,
        "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
        "op5_nnpu_toxicity": toxicity.op5_nnpu_toxicity,
        "op6_countmin_substring_dedup": substring_dedup.op6_countmin_substring_dedup,
        "op7_viterbi_language_id": langid.op7_viterbi_language_id,
        "op8_simhash_covering_lsh": simhash.op8_simhash_covering_lsh,
        "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
        "op10_nnls_packing": packing.op10_nnls_packing,
        "op11_curriculum_mixing": mixing.op11_curriculum_mixing,
        "op12_sorted_lexical_search": lexical.op12_sorted_lexical_search,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mtree_top_k": mtree.ORACLE_SQL,
        "op3_preference_formatting": preferences.ORACLE_SQL,
        "op6_countmin_substring_dedup": substring_dedup.ORACLE_SQL,
        "op9_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op11_curriculum_mixing": mixing.ORACLE_SQL,
        "op12_sorted_lexical_search": lexical.ORACLE_SQL,
        "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
    }
