"""Text of a recursive component tree held as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_html

# Keys whose strings are addresses, not prose; strings longer than this are prose.
ADDRESS_KEYS = ("filepath", "logo", "imageurl", "url", "src")
PROSE_CHARS = 40


@F.pandas_udf(T.StringType())
def _tree_text(s: pd.Series) -> pd.Series:
    def prose(node: object, key: str = "") -> Iterator[str]:
        if isinstance(node, str):
            if key and ("<" in node or len(node) > PROSE_CHARS):
                yield node
        elif isinstance(node, dict):
            for k, v in node.items():
                if k.lower() not in ADDRESS_KEYS:
                    yield from prose(v, k)
        elif isinstance(node, list):
            for v in node:
                yield from prose(v)

    def text(raw: str) -> str | None:
        try:
            return " ".join(prose(json.loads(raw)))
        except ValueError:
            return None

    return s.map(text, na_action="ignore")


def component_text(raw: Column) -> Column:
    """All prose strings of the tree, at any depth and in document order, as plain text; empty for what is no JSON. The walk is the one
    step the engine cannot express without a depth limit; markup is removed by column expressions."""
    return F.trim(strip_html(_tree_text(raw)), F.lit(" \n"))
