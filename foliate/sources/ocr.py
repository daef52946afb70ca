"""Text lines of OCR results, whatever their nesting."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Keys whose values are texts themselves.
TEXT_KEYS = ("rec_texts", "text", "texts")


def _in_text_key(key: str, value) -> list:
    """What a text key gives: one string for ``text``, a list's items for the other two; anything else is no text."""
    if key == "text":
        return [value] if isinstance(value, str) else []
    return value if isinstance(value, list) else []


def _lines(result) -> list[str]:
    lines, waiting = [], [result]
    while waiting:
        match waiting.pop():
            case str() as text:
                lines += [text.strip()] if text.strip() else []
            case dict() as record:
                first = [x for key in TEXT_KEYS for x in _in_text_key(key, record.get(key))]
                waiting += reversed(first + [x for key, x in record.items() if key not in TEXT_KEYS])
            # A box, then its text and confidence; or a text and its confidence.
            case [_, [str() as text, *_], *_] | [str() as text, int() | float(), *_]:
                waiting.append(text)
            case list() as items:
                waiting += reversed(items)
    return lines


@F.pandas_udf(ArrayType(StringType()))
def _ocr_lines(results: pd.Series) -> pd.Series:
    def parse(result):
        if result is None:
            return []
        try:
            return _lines(json.loads(result))
        except (ValueError, RecursionError):
            return _lines(result)

    return results.map(parse, na_action=None)


def ocr_lines(result: Column) -> Column:
    """The trimmed lines, in order, of a result in JSON; a text that is no JSON is one line; null and blank give none. Repeats stay."""
    return _ocr_lines(result)
