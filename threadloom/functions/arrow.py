"""The few scalar functions without a builtin: Unicode normal forms and searches in JSON of any shape, as pandas UDFs."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(c: Column | str) -> Column:
    """Text in Unicode normal form C; null stays null."""

    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")

    return run(c)


def _walk(node) -> Iterator[tuple[str, object]]:
    """(key, value) of every member of every object, outer ones first, without recursion."""
    queue = [node]
    while queue:
        x = queue.pop(0)
        if isinstance(x, dict):
            yield from x.items()
            queue.extend(x.values())
        elif isinstance(x, list):
            queue.extend(x)


def _search(c: Column | str, keys: tuple[str, ...], longest: bool) -> Column:
    wanted = tuple(k.lower() for k in keys)

    def of(raw: str | None) -> str:
        try:
            found = [v.strip() for k, v in _walk(json.loads(raw)) if isinstance(v, str) and v.strip() and any(w in k.lower() for w in wanted)]
        except (TypeError, ValueError):
            return ""
        return (max(found, key=len) if longest else found[0]) if found else ""

    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield s.map(of)

    return run(c)


def longest_under(c: Column | str, keys: tuple[str, ...]) -> Column:
    """The longest text under a key that contains one of keys, anywhere in a JSON document; '' for none or malformed JSON."""
    return _search(c, keys, True)


def first_under(c: Column | str, keys: tuple[str, ...]) -> Column:
    """The first such text, outer objects first."""
    return _search(c, keys, False)
