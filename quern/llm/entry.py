"""Queries and SQL of this subpackage, by the names that __spark_entry__.py registers."""

from quern.llm import exact_dedup, html_extract, lattice_hash, mixing, ngram_join, order_minhash, packing, pii, prefix_trie, quality, secrets, source_divergence, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_mix_sources": mixing.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_best_fit_packing": packing.query,
    "op5_personal_data": pii.query,
    "op6_quality_classifier": quality.query,
    "op7_html_main_text": html_extract.query,
    "op8_secret_scan": secrets.query,
    "op9_order_minhash": order_minhash.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_source_divergence": source_divergence.query,
    "op12_lattice_hash": lattice_hash.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLE_SQL = {
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op12_lattice_hash": lattice_hash.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
