"""The queries of this subpackage, and the SQL of those that SQL can express."""

from quire.llm import jaccard_join, mixing, quality_gam, quality_rules, reply_trees, sentencepiece_bpe, suffix_dedup, topk_search, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_reply_trees": reply_trees.query,
    "op3_topk_search": topk_search.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_toxicity": toxicity.query,
    "op6_quality_gam": quality_gam.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_mixing": mixing.query,
    "op9_warc": warc.query,
    "op10_sentencepiece": sentencepiece_bpe.query,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_reply_trees": reply_trees.ORACLE,
    "op3_topk_search": topk_search.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op7_suffix_dedup": suffix_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_warc": warc.ORACLE,
}
