"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_CHARS = 4_000_000  # of texts whose pieces come out together
COLUMNS = ["id", "piece_no", "start_pos", "text"]
_HEADINGS = [re.compile(rf"^(?:[ \t]*={{{n}}}[^=\n][^\n]*={{{n}}}[ \t]*|[ \t]*#{{{n}}}[ \t][^\n]*|[ \t]*<h{n}\b)", re.M | re.I) for n in range(1, 7)]
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*\s+|[;:]\s+")
_WORD = re.compile(r"\s+")


def _cuts(text: str, start: int, end: int, level: int) -> list[int]:
    """Where the children of a node begin, the first left out.  Levels: six of headings, paragraphs, lines and list items, sentences, words."""
    if level < 6:
        return [m.start() for m in _HEADINGS[level].finditer(text, start, end) if m.start() > start]
    pattern = (_PARAGRAPH, _LINE, _SENTENCE, _WORD)[level - 6]
    return [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]


def _pack(text: str, start: int, end: int, level: int, room: int) -> list[tuple[int, int]]:
    """The spans of a subtree, each of at most ``room`` characters: siblings are merged as far as they fit, only oversized nodes are opened."""
    if end - start <= room:
        return [(start, end)]
    if level == 10:
        spans = []
        while end - start > room:
            cut = start + room
            while cut > start + 1 and (unicodedata.combining(text[cut]) or text[cut] in "‍️"):
                cut -= 1
            spans.append((start, cut))
            start = cut
        return [*spans, (start, end)]
    edges = [start, *_cuts(text, start, end, level), end]
    if len(edges) == 2:
        return _pack(text, start, end, level + 1, room)
    merged: list[tuple[int, int]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        for x, y in [(a, b)] if b - a <= room else _pack(text, a, b, level + 1, room):
            if merged and y - merged[-1][0] <= room:
                merged[-1] = (merged[-1][0], y)
            else:
                merged.append((x, y))
    return merged


def pieces(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of ``text`` of at most ``max_chars`` code points; each but the first begins ``overlap`` before the end of the one before.

    A text within the limit is one span, an empty one none.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if len(text) <= max_chars:
        return [(0, len(text))] if text else []
    spans = _pack(text, 0, len(text), 0, max_chars - overlap)
    while len(spans) > 1 and spans[0][1] < overlap:  # the first span is too short to be shared: it takes in what follows
        first, (a, b) = spans[0], spans[1]
        if b <= max_chars:
            spans[:2] = [(0, b)]
            continue
        head = _pack(text, a, b, 6, max_chars - first[1])[0]
        if head[1] <= overlap:
            head = (a, max_chars)
        spans[:2] = [(0, head[1]), (head[1], b)]
        break
    return [(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(spans)]


def split_oversized(df: DataFrame, key: str, text: str, max_chars: int, overlap: int) -> DataFrame:
    """``id, piece_no, start_pos, text``: the pieces of each text of more than ``max_chars`` code points.

    The text is read as a tree of headings, paragraphs, lines and list items, sentences and words; sibling subtrees are merged up to
    the limit and only oversized nodes are opened, so a cut falls inside a word only where a single word is over the limit.  Consecutive
    pieces share exactly ``overlap`` characters; ``start_pos`` is 1-based.  Texts within the limit never reach Python; null texts and
    ids are dropped; a repeated row gives its pieces once; other columns are ignored; an empty table gives an empty result.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be at least 0 and below the limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, chars = [], 0
            for i, t in zip(batch["id"], batch["text"], strict=True):
                rows += [(i, n, a + 1, t[a:b]) for n, (a, b) in enumerate(pieces(t, max_chars, overlap), 1)]
                chars += len(t)
                if chars > FRAME_CHARS:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, chars = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS)

    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") > max_chars))
    return rows.dropDuplicates(["id"]).mapInPandas(cut, "id string, piece_no int, start_pos int, text string")
