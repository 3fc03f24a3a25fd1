"""The first whole JSON object within a text, as language models put it among other words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What moves the scan within an object: a string with its escapes (or one without an end), or a brace.
_MARKS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}]', re.DOTALL)


def first_balanced(text: str | None) -> str | None:
    """From the first opening brace to the one that closes it; braces in strings don't count; None without a whole object.

    The scan goes from mark to mark and reads each character once, so it is linear in the text.
    """
    start = text.find("{") if text else -1
    if start < 0:
        return None
    depth = 0
    for mark in _MARKS.finditer(text, start):
        if mark[0] == "{":
            depth += 1
        elif mark[0] == "}":
            depth -= 1
            if not depth:
                return text[start : mark.end()]
    return None


def first_object(text: Column) -> Column:
    """``first_balanced`` of a column, on Arrow batches."""

    def of(values: pd.Series) -> pd.Series:
        return values.map(first_balanced)

    return F.pandas_udf(of, "string")(text)
