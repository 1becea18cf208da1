"""Queries of this subpackage and the SQL that checks them, by name."""

from . import chat, exact_dedup, lm_score, mixing, ngram_join, packing, pii, quality, substring_dedup, warc

QUERIES = {
    "op1_chat_formatting": chat.op1_query,
    "op2_pii": pii.op2_query,
    "op3_exact_dedup": exact_dedup.op3_query,
    "op4_mixing": mixing.op4_query,
    "op5_lm_scoring": lm_score.op5_query,
    "op6_ngram_join": ngram_join.op6_query,
    "op7_packing": packing.op7_query,
    "op8_substring_dedup": substring_dedup.op8_query,
    "op9_warc": warc.op9_query,
    "op10_quality_rules": quality.op10_query,
}

#: The others have no SQL: a trained model, a tokenizer, span alignment or files on the way; tests compare them by brute force.
SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
}
