"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from trialframe.llm import decontaminate, divergence, jaccard_join, language_id, line_dedup, mixing, packing, perplexity, prefix_trie, quality_rules, toxicity, url_filter, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_perplexity": perplexity.op3_quality_perplexity,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_ngram_jaccard": jaccard_join.op9_ngram_jaccard,
    "op10_language_id": language_id.op10_language_id,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_mixing": mixing.op12_mixing,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_quality_perplexity": perplexity.ORACLE,
    "op4_warc": warc.ORACLE,
    "op9_ngram_jaccard": jaccard_join.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_mixing": mixing.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
