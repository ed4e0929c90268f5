"""The queries of this subpackage, and their SQL where SQL can say the same."""

from trawl.llm import chat, jaccard, mixing, packing, quality, secrets, sharding, substrings, tiff, warc

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_warc": warc.query,
    "op3_secret_scans": secrets.query,
    "op4_chat_formatting": chat.query,
    "op5_media_columns": tiff.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_quality_rules": quality.query,
    "op8_best_fit_packing": packing.query,
    "op9_substring_dedup": substrings.query,
    "op10_source_mixing": mixing.query,
}

SQL = {
    "op1_sharding": sharding.SQL,
    "op2_warc": warc.SQL,
    "op3_secret_scans": secrets.SQL,
    "op4_chat_formatting": chat.SQL,
    "op6_ngram_jaccard_join": jaccard.SQL,
    "op9_substring_dedup": substrings.SQL,
    "op10_source_mixing": mixing.SQL,
}
