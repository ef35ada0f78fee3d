"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is first cut into atomic segments, at every paragraph, line and sentence end; sentences
that are too long at words, words that are too long at punctuation, and only what holds
none of these by force. Adjacent pairs wait in a heap, and the pair with the weakest boundary
between them is merged first, as long as the two and the overlap fit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary, weakest first.
FORCED, PUNCTUATION, WORD, SENTENCE, LINE, PARAGRAPH, END = range(7)
NAMES = ("forced", "punctuation", "word", "sentence", "line", "paragraph", "end")

_ENDS = ".!?。！？"
_BREAK = re.compile(r"(?:(?<=[.!?。！？])|(?<=[.!?。！？][\"'”’»)\]]))\s+|\s*\n\s*|(?<=[。！？])(?=[^。！？\s\"'”’»)\]])")
_WORDS = re.compile(r"\S+\s*|\s+")
_RUNS = re.compile(rf"[^{_ENDS}]+|[{_ENDS}]+")


def _sliced(start: int, end: int, step: int, inner: int, last: int) -> Iterator[tuple[int, int]]:
    for at in range(start, end, step):
        stop = min(at + step, end)
        yield stop, last if stop == end else inner


def _word(text: str, start: int, end: int, kind: int, limit: int, step: int) -> Iterator[tuple[int, int]]:
    """Ends of the segments of one word and the blanks after it, which together are too long."""
    bare = start + len(text[start:end].rstrip())
    if bare > start:
        if bare - start <= step:
            yield bare, WORD
        else:
            runs = [(m.start() + start, m.end() + start) for m in _RUNS.finditer(text[start:bare])]
            for i, (a, b) in enumerate(runs):
                after = PUNCTUATION if i < len(runs) - 1 else (WORD if bare < end else kind)
                if text[a] in _ENDS:
                    yield from _sliced(a, b, step, PUNCTUATION, after)
                elif b - a <= limit:
                    yield b, after
                else:
                    yield from _sliced(a, b, step, FORCED, after)
    if bare < end:
        yield from _sliced(bare, end, step, WORD, kind)


def atoms(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(end, kind of the boundary there) of the atomic segments, in order; none is longer than ``limit``."""
    step, out, start = limit - overlap, [], 0
    breaks = []
    for m in _BREAK.finditer(text):
        lines = m.group().count("\n")
        if m.end() > 0:
            breaks.append((m.end(), PARAGRAPH if lines > 1 else LINE if lines else SENTENCE))
    if not breaks or breaks[-1][0] < len(text):
        breaks.append((len(text), END))
    for end, kind in breaks:
        if end <= start:
            continue
        if end - start <= step:
            out.append((end, kind))
        else:
            for m in _WORDS.finditer(text, start, end):
                last = kind if m.end() == end else WORD
                if m.end() - m.start() <= step:
                    out.append((m.end(), last))
                else:
                    out.extend(_word(text, m.start(), m.end(), last, limit, step))
        start = end
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, characters shared with the piece before, boundary at the end) of each piece."""
    cells = atoms(text, limit, overlap)
    n = len(cells)
    start = [0, *(e for e, _ in cells)][:n]
    end, kind = [e for e, _ in cells], [k for _, k in cells]
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            size = end[j] - start[i]
            if size + (overlap if start[i] else 0) <= limit:
                heapq.heappush(heap, (kind[i], size, i, j))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not alive[i] or after[i] != j or end[j] - start[i] != size:
            continue
        alive[j] = False
        end[i], kind[i], after[i] = end[j], kind[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        shared = 0
        if out:
            shared = min(overlap, limit - (end[i] - start[i]), out[-1][1] - out[-1][0])
            window = text[start[i] - shared : start[i]]
            if shared and shared < out[-1][1] - out[-1][0] and not text[start[i] - shared - 1].isspace():
                m = re.search(r"\s+(?=\S)", window)
                if m:
                    shared -= m.end()
        out.append((start[i], end[i], shared, kind[i]))
        i = after[i]
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """``keys, piece_no, start_char, end_char, shared_chars, boundary, piece`` of texts over ``limit``.

    A piece is at most ``limit`` characters and begins with the last ``shared_chars`` (up to
    ``overlap``, from a word's beginning where there is one) of the piece before; without
    these the pieces are the text, ``text[start_char:end_char]``. ``boundary`` says what the
    piece ends at: paragraph, line, sentence, word, punctuation, forced, or the end of the text.
    Forced cuts occur only in runs of more than ``limit`` characters without blanks and sentence punctuation.

    Texts up to ``limit``, empty and null ones give no rows; repeated rows of a text count
    once; rows whose keys are null stay (their keys are null).
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")).where(F.length("t") > limit)
    kept = [f"k{i}" for i in range(len(keys))]
    rows = rows.dropDuplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *key, t in frame.itertuples(index=False, name=None):
                out += [(*key, no, a, b, o, NAMES[k], t[a - o : b]) for no, (a, b, o, k) in enumerate(pieces(t, limit, overlap))]
            yield pd.DataFrame(out, columns=[*kept, "piece_no", "start_char", "end_char", "shared_chars", "boundary", "piece"])

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    out = rows.mapInPandas(run, f"{types}, piece_no int, start_char int, end_char int, shared_chars int, boundary string, piece string")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "piece_no", "start_char", "end_char", "shared_chars", "boundary", "piece")
