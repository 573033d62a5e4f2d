"""Operators for large training corpora, and their queries.

``QUERIES`` and ``ORACLES`` are filled as the modules load.
"""

from __future__ import annotations

from clickloom.llm.common import ORACLES, QUERIES


def load() -> None:
    from clickloom.llm import (  # noqa: F401
        chat,
        html,
        language,
        lexical,
        mixing,
        near_dup,
        packing,
        pii,
        quality,
        tokens,
        variants,
        vectors,
        warc,
    )


__all__ = ["ORACLES", "QUERIES", "load"]
