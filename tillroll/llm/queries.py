"""The registered queries of this package, and those that SQL can express."""

from __future__ import annotations

from tillroll.llm import (
    chat,
    clusters,
    codes,
    fingerprint,
    language,
    lm,
    neardup,
    packing,
    quality,
    sentence,
    tokenstore,
    urls,
    warc,
)

QUERIES = {
    "op1_token_output": tokenstore.op1_token_output,
    "op2_sentencepiece": sentence.op2_sentencepiece,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_language_id": language.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_warc": warc.op6_warc,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op10_word_scoring": lm.op10_word_scoring,
    "op11_url_filter": urls.op11_url_filter,
    "op12_centroid_clustering": clusters.op12_centroid_clustering,
    "op13_vector_codes": codes.op13_vector_codes,
}

SQL = {
    "op3_quality_rules": quality.SQL,
    "op6_warc": warc.SQL,
    "op9_chat_formatting": chat.SQL,
    "op10_lm_scoring": lm.SQL,
    "op10_word_scoring": lm.WORD_SQL,
    "op11_url_filter": urls.SQL,
    "op12_centroid_clustering": clusters.SQL,
    "op13_vector_codes": codes.SQL,
}
