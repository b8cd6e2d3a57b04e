"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import importlib

#: Query name, module and function; a module has its SQL in ORACLE where there is any.
QUERIES = {
    "op1_decontaminate": "q_decontaminate",
    "op4_simhash": "q_simhash",
    "op9_embedding_dups": "q_embedding",
    "op2_langid": "q_langid",
    "op3_lm_score": "q_lm",
    "op10_line_dedup": "q_lines",
    "op5_repeats": "q_substrings",
    "op8_token_counts": "q_token_counts",
    "op6_sentencepiece": "q_segment",
    "op7_surrogates": "q_private",
    "op11_resample": "q_resample",
    "op12_url_filter": "q_url",
}


def _module(name: str):
    return importlib.import_module(f"paperloom.llm.queries.{QUERIES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in QUERIES if (sql := getattr(_module(name), "ORACLE", None))}
