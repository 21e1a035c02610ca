"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from escalade.llm import (
    bloom_lookup, curriculum, decontamination, fill_middle, languages, line_dedup, prefix_trie, projection_forest, quality, suffix_dedup, warc, weighted_minhash, word_bpe,
)

QUERIES = {
    "op1_bloom_lookup": bloom_lookup.op1_bloom_lookup,
    "op2_warc_derivatives": warc.op2_warc_derivatives,
    "op3_word_bpe": word_bpe.op3_word_bpe,
    "op4_curriculum_mix": curriculum.op4_curriculum_mix,
    "op5_quality": quality.op5_quality,
    "op6_languages": languages.op6_languages,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_projection_forest": projection_forest.op8_projection_forest,
    "op9_weighted_minhash": weighted_minhash.op9_weighted_minhash,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLE = {
    "op4_curriculum_mix": curriculum.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_decontamination": decontamination.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
