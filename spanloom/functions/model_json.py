"""JSON objects in model replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A whole string, an opening or closing brace, or the begin of a string that never ends.
_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[{}"]', re.S)


def balanced_object(text: str | None) -> str | None:
    """The first balanced {...} of a reply that parses to an object, braces in strings apart; None if there is none.

    One pass: an outermost object that doesn't parse is left behind as a whole.  Closing braces that close nothing are
    passed over.
    """
    text = re.sub(r"<think>.*?</think>", " ", text or "", flags=re.S)
    opened: list[int] = []
    for mark in _MARK.finditer(text):
        if mark[0] == "{":
            opened.append(mark.start())
        elif mark[0] == '"':
            return None
        elif mark[0] == "}" and opened:
            begin = opened.pop()
            if not opened:
                try:
                    json.loads(text[begin : mark.end()])
                except ValueError:
                    continue
                return text[begin : mark.end()]
    return None


@F.pandas_udf(T.StringType())
def _balanced(texts: pd.Series) -> pd.Series:
    return texts.map(balanced_object)


def extract_object(text: Column) -> Column:
    """JSON text of the reply's object: the reply itself if it parses, else its first balanced object (Arrow batches)."""
    whole = F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)
    return F.coalesce(whole, _balanced(text))
