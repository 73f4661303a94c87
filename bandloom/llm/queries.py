"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

from . import oracles

MODULES = ("decontaminate", "katz", "langid", "secrets", "quality", "mixing", "neardup", "pii", "chat", "sharding", "trie", "topk", "whitening")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
ORACLES |= {
    "op1_decontaminate": oracles.DECONTAMINATE,
    "op4_secret_ledger": oracles.SECRETS,
    "op5_quality_rules": oracles.QUALITY,
    "op7_chosen_path": oracles.NEAR_DUPLICATES,
    "op8_pii": oracles.PII,
    "op9_chat_format": oracles.CHAT,
}
