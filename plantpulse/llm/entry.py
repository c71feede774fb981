"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from plantpulse.llm import balltree, bestfit, jaccard, leaks, lines, merkle, private, quality, shards, threads, tokenrows, trie, urls

QUERIES = {
    "op1_private_data": private.query,
    "op2_url_filter": urls.query,
    "op3_quality_rules": quality.query,
    "op4_quote_threads": threads.query,
    "op5_bestfit_packing": bestfit.query,
    "op6_jaccard_join": jaccard.query,
    "op7_decontamination": leaks.query,
    "op8_line_dedup": lines.query,
    "op9_label_shards": shards.query,
    "op10_token_rows": tokenrows.query,
    "op11_merkle_manifest": merkle.query,
    "op12_prefix_trie": trie.query,
    "op13_ball_tree": balltree.query,
}
ORACLES = {
    "op2_url_filter": urls.ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op4_quote_threads": threads.ORACLE,
    "op7_decontamination": leaks.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_ball_tree": balltree.ORACLE,
}
