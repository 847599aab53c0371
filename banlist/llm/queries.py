"""Load every query module of this folder."""

from __future__ import annotations

import importlib

_MODULES = (
    "bpe",
    "chat_format",
    "exact_dedup",
    "fingerprint",
    "infill",
    "language_model",
    "near_dedup",
    "packing",
    "phrases",
    "sharding",
    "token_counts",
    "toxicity",
    "url_filter",
)


def load_all() -> None:
    for name in _MODULES:
        importlib.import_module(f"banlist.llm.{name}")
