"""Registered queries and their SQL checks."""


def load():
    """Import every query module and return (queries, oracles)."""
    from checks import registry
    from checks import (  # noqa: F401
        tables, text_functions, routing, line_windows, listings, reports, memory, recall, analysis, compression, quality, streams,
    )

    return registry.QUERIES, registry.ORACLES
