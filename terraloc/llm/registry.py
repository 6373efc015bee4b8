"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from terraloc.llm import bpe, conversation_trie, hard_negatives, jaccard, knn, media, packing, simhash, suffixes, token_counts, toxicity, urls, warc

QUERIES = {
    "op1_knn": knn.op1_knn,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_url_filter": urls.op3_url_filter,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_bpe": bpe.op6_bpe,
    "op7_simhash": simhash.op7_simhash,
    "op8_media": media.op8_media,
    "op9_warc": warc.op9_warc,
    "op10_packing": packing.op10_packing,
    "op11_jaccard_join": jaccard.op11_jaccard_join,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
SQL: dict[str, str] = {"op1_knn": knn.OP1_SQL, "op2_suffix_dedup": suffixes.OP2_SQL, "op9_warc": warc.OP9_SQL, "op11_jaccard_join": jaccard.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL, "op13_conversation_trie": conversation_trie.OP13_SQL}
