"""The queries of this folder, and the SQL that says what they return where SQL can."""

from __future__ import annotations

from custlens.llm import (
    chat_tools,
    collocations,
    decontaminate,
    language,
    lexical,
    license_scan,
    mixing,
    ngram_join,
    personal_data,
    quality_net,
    quality_rules,
    repeats,
    secret_scan,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_tool_calls": chat_tools.op2_tool_calls,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_language": language.op5_language,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_quality_classifier": quality_net.op10_quality_classifier,
    "op11_personal_data": personal_data.op11_personal_data,
    "op12_collocations": collocations.op12_collocations,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLES = {
    "op2_tool_calls": chat_tools.OP2_SQL,
    "op4_license_scan": license_scan.OP4_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
