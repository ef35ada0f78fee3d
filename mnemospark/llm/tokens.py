"""Token counts of the public word-and-punctuation tokenizer.

A token is a maximal run of word characters (letters, digits, underscore) or a maximal run
of characters that are neither word characters nor white space. Counting needs no
tokens: each character's class comes from a table, and a token begins wherever the class
changes to one that isn't white space.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Characters classified at a time; longer texts are counted in slices.
SLICE = 2_000_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 white space, 1 word character, 2 anything else, by code point."""
    table = np.full(0x110000, 2, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalnum() or c == "_":
            table[code] = 1
        elif c.isspace():
            table[code] = 0
    return table


def _starts(text: str, before: int) -> tuple[np.ndarray, int]:
    """Where tokens begin in ``text``, which follows a character of class ``before``."""
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = kinds != 0
    starts[1:] &= kinds[1:] != kinds[:-1]
    starts[0] &= kinds[0] != before
    return starts, int(kinds[-1])


def count_tokens(texts: list[str | None]) -> np.ndarray:
    """Tokens of each text; 0 for None."""
    out = np.zeros(len(texts), np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            starts, _ = _starts("\n".join(texts[i] for i in group) + "\n", 0)
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            total = np.concatenate([[0], np.cumsum(starts)])[np.concatenate([[0], ends])]
            out[group] = np.diff(total)
        group.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > SLICE:
            before = 0
            for at in range(0, len(text), SLICE):
                starts, before = _starts(text[at : at + SLICE], before)
                out[i] += int(starts.sum())
            continue
        group.append(i)
        size += len(text)
        if size > SLICE:
            flush()
    flush()
    return out


@F.pandas_udf(LongType())
def _n_tokens(texts: pd.Series) -> pd.Series:
    return pd.Series(count_tokens(texts.tolist()))


def n_tokens(text: str | Column) -> Column:
    """Tokens of a text column; 0 for null and empty texts."""
    return _n_tokens(F.col(text) if isinstance(text, str) else text)
