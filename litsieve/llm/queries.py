"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litsieve.llm import alignment, chat, classifier, decontaminate, langid, mixing, phrase_dedup
from litsieve.llm import quality_rules, repair, secrets, sketch_join, suffix_dedup, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_chat_format": chat.op2_chat_format,
    "op3_sketch_join": sketch_join.op3_sketch_join,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_token_ids": tokens.op6_token_ids,
    "op7_quality_classifier": classifier.op7_quality_classifier,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_phrase_dedup": phrase_dedup.op10_phrase_dedup,
    "op11_language_id": langid.op11_language_id,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

SQL: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op2_chat_format": chat.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op12_conversation_repair": repair.SQL,
}
