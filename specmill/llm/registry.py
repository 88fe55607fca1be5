"""Registered queries of this package, and checking SQL where SQL can express them."""

from __future__ import annotations

from specmill.llm import ann, conversation_trie, decontaminate, jaccard_join, license_scan, minhash, packing, secret_scan, spelling, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op10_jaccard_join": jaccard_join.query,
    "op4_toxicity": toxicity.query,
    "op8_ann": ann.query,
    "op2_warc": warc.query,
    "op9_pack": packing.query,
    "op3_url_filter": url_filter.query,
    "op6_secret_scan": secret_scan.query,
    "op5_license_scan": license_scan.query,
    "op7_decontaminate": decontaminate.query,
    "op11_conversation_trie": conversation_trie.query,
    "op12_minhash_dedup": minhash.query,
    "op13_spelling_variants": spelling.query,
}

CHECKS = {
    "op6_secret_scan": secret_scan.SQL,
    "op5_license_scan": license_scan.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
    "op13_spelling_variants": spelling.SQL,
}
