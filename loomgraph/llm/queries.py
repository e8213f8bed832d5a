"""Registry of the training-data queries and, where SQL can express them, their DuckDB equivalents."""

from loomgraph.llm import collocations, decontaminate, embedding_dedup, exact_dedup, langid, line_dedup, near_dedup, packing, prefix_trie, sentencepiece_fst, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_embedding_near_dedup": embedding_dedup.op2_embedding_near_dedup,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sentencepiece": sentencepiece_fst.op6_sentencepiece,
    "op7_language_id": langid.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_collocations": collocations.op12_collocations,
    "op13_decontamination": decontaminate.op13_decontamination,
}
ORACLES = {
    "op2_embedding_near_dedup": embedding_dedup.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_decontamination": decontaminate.ORACLE,
}
