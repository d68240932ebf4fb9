"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from evenstrand.llm import chat, decontaminate, pieces, quality, sharding, simhash, substring, suffix, tokenfile, warc

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_warc": warc.op5_warc,
    "op6_sharding": sharding.op6_sharding,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_suffix_array_dedup": suffix.op9_suffix_array_dedup,
    "op10_token_file": tokenfile.op10_token_file,
}
ORACLE_SQL = {"op2_quality_rules": quality.OP2_SQL, "op5_warc": warc.OP5_SQL, "op6_sharding": sharding.OP6_SQL, "op7_benchmark_decontamination": decontaminate.OP7_SQL}
