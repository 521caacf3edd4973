"""The registered queries of this subpackage: thin views of the operators, each over its whole table."""

from __future__ import annotations

import importlib

#: Query name -> (module, function); a module also has SQL where SQL can express the query.
_WHERE = {
    "op1_substring_dedup": "substring_dedup",
    "op2_pack_sequences": "packing",
    "op3_toxicity": "toxicity",
    "op4_media_columns": "media",
    "op5_nearest_neighbours": "ann",
    "op6_shard_documents": "sharding",
    "op7_language_id": "langid",
    "op8_ngram_jaccard_join": "jaccard",
    "op9_chat_formatting": "chat",
    "op10_mix_sources": "mixing",
}


def _load(module: str):
    return importlib.import_module(f"{__package__}.{module}")


def queries() -> dict:
    return {name: _load(module).query for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in _WHERE.items() if (sql := getattr(_load(module), "SQL", None))}
