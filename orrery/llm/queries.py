"""Queries and DuckDB twins of the training-data operators."""

from orrery.llm import chat, decontam, html, jaccard, mixing, pipeline, quality, sharding, substring, tokens, toxicity

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_passage_dedup": substring.op2_passage_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_sharding": sharding.op7_sharding,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": pipeline.run,
}
ORACLES = {
    "op2_passage_dedup": substring.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_quality": quality.OP4_SQL,
    "op5_jaccard": jaccard.OP5_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op9_decontamination": decontam.OP9_SQL,
    "pipeline": pipeline.ORACLE_SQL,
}
