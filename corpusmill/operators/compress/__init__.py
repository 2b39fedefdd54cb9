"""Compressors by content type and the engine around them."""

from corpusmill.operators.compress.engine import (
    STRATEGIES,
    compress,
    get_strategy,
    has_strategy,
    registered_types,
    register_strategy,
    type_facts,
)

__all__ = [
    "STRATEGIES", "compress", "get_strategy", "has_strategy", "registered_types",
    "register_strategy", "type_facts",
]
