"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import chat, embedding_dedup, langid, minhash, mixing, quality, secret_scan, sentencepiece_codec, toxicity, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_warc": warc.op2_warc,
    "op3_language_id": langid.op3_language_id,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_chat_formatting": chat.op10_chat_formatting,
}

ORACLE_SQL = {
    "op2_warc": warc.oracle(),
    "op7_embedding_near_dedup": embedding_dedup.oracle(),
    "op8_minhash_near_dedup": minhash.oracle(),
    "op9_secret_scan": secret_scan.oracle(),
    "op10_chat_formatting": chat.oracle(),
}
