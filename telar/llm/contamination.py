"""Evaluation texts leaking into training text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.plans.filters import bit_filter, hits
from telar.plans.lineage import Scratch
from telar.plans.shared import Shared
from telar.plans.skew import fits

SPAN = 12
#: Spaced seeds over a window of SPAN words: 1 is compared, 0 may differ.  A window of equal words is met by each of them; any given position
#: is ignored by one, so a window with one substituted word is found for certain.
SEEDS = ("111011101110", "110111011101", "101110111011", "011101110111")
KNOWN = 1_000_000  # words whose hash a task keeps
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


def words_of(text: str) -> list[str]:
    """The words of a text regardless of case, accents, punctuation and line breaks."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text.lower())


class Seeds:
    """Hashes of words, and of the windows of words under each mask."""

    def __init__(self) -> None:
        rng = np.random.default_rng(12)
        self.factor = rng.integers(1, 1 << 62, (len(SEEDS), SPAN), dtype=np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(known) < KNOWN:
                    known[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def hashes(self, codes: np.ndarray) -> list[np.ndarray]:
        """Of every window that begins at a word, by mask."""
        n = len(codes) - SPAN + 1
        if n <= 0:
            return [np.zeros(0, np.uint64) for _ in SEEDS]
        out = []
        with np.errstate(over="ignore"):
            x = codes ^ (codes >> np.uint64(29))
            for seed, factor in zip(SEEDS, self.factor, strict=True):
                h = np.zeros(n, np.uint64)
                for i, c in enumerate(seed):
                    if c == "1":
                        h += x[i : i + n] * factor[i]
                h ^= h >> np.uint64(31)
                out.append(h * np.uint64(0x9E3779B97F4A7C15))
        return out

    def sorted(self, text: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The words of an item, and of each mask the hashes of its windows in order and where they begin."""
        codes = self.codes(words_of(text))
        orders = [(h, np.argsort(h, kind="stable")) for h in self.hashes(codes)]
        return codes, [(h[at], at) for h, at in orders]


def diagonals(text: list[np.ndarray], item: list[tuple[np.ndarray, np.ndarray]]) -> set[int]:
    """By how much the places of windows differ that some mask finds equal."""
    out: set[int] = set()
    for a, (keys, at) in zip(text, item, strict=True):
        if not len(keys):
            continue
        left = np.searchsorted(keys, a, "left")
        p = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == a)
        if len(p):
            left, times = left[p], np.searchsorted(keys, a[p], "right") - left[p]
            place = np.repeat(p, times)
            entry = at[np.repeat(left, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)]
            out.update((place - entry).tolist())
    return out


def verify(codes: np.ndarray, item: np.ndarray, diagonal: int, slack: float) -> tuple[int, int, int, int]:
    """Longest equal run along a diagonal; best run that tolerates single substitutions: length and equal words; its place in the text."""
    a, b = max(0, diagonal), min(len(codes), diagonal + len(item))
    same = codes[a:b] == item[a - diagonal : b - diagonal]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    longest = int((ends - starts).max()) if len(starts) else 0
    best = (0, 0, a)
    i = 0
    while i < len(starts):  # runs that are one word apart belong together
        j, equal = i, int(ends[i] - starts[i])
        while j + 1 < len(starts) and starts[j + 1] - ends[j] <= 1 and (equal + ends[j + 1] - starts[j + 1]) >= slack * (ends[j + 1] - starts[i]):
            j += 1
            equal += int(ends[j] - starts[j])
        best = max(best, (int(ends[j] - starts[i]), equal, a + int(starts[i])), key=lambda x: x[1])
        i = j + 1
    return longest, best[0], best[1], best[2]


def _windows(rows: DataFrame, wanted: Shared | None = None) -> DataFrame:
    """``k, seed, h``: the windows of each text under each mask, each once a text; only those that the filter may have, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds()
        bits = None if wanted is None else wanted.value
        for batch in batches:
            told = [words_of(t) for t in batch.column(1).to_pylist()]
            length = np.array([len(w) for w in told], dtype=np.int64)
            codes = seeds.codes([w for words in told for w in words])
            doc = np.repeat(np.arange(len(told)), length)
            if len(codes) < SPAN:
                continue
            whole = doc[: len(codes) - SPAN + 1] == doc[SPAN - 1 :]  # windows that end in the text they begin in
            for s, h in enumerate(seeds.hashes(codes)):
                hit = whole
                if bits is not None:
                    hit = whole & hits(bits, h)
                p = np.flatnonzero(hit)
                if len(p):
                    found = np.unique(np.column_stack((doc[p].astype(np.uint64), h[p])), axis=0)
                    k = batch.column(0).take(pa.array(found[:, 0].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([k, pa.array(np.full(len(found), s, np.int8)), pa.array(found[:, 1].view(np.int64))], names=["k", "seed", "h"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, seed tinyint, h bigint")


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, slack: float = 0.8) -> DataFrame:
    """``doc_id, item_id, longest_run, span_words, equal_words, word_pos``: test items of which a passage stands in a corpus text.

    Windows of ``SPAN`` words are hashed under the ``SEEDS``, each of which ignores some positions; windows of corpus and items with the same
    hash under the same mask give the pairs, which are then compared word by word along every diagonal that a mask finds.  A pair comes
    out if an equal run has ``SPAN`` words (``longest_run``), or if a stretch of that many words tolerating single substitutions has at least
    ``slack`` of them equal (``equal_words`` of ``span_words``).  ``word_pos`` is 1-based.  Keys may be of any type and keep it.

    No text goes to the driver.  A filter of bounded size made of the items' hashes goes to every task, so of the corpus only windows
    that an item may have are joined; there may be any number of items.  Texts of pairs alone are read again.  A hash that very many corpus
    texts have is split by Spark's skew join.  Null texts and keys are dropped, texts and items of fewer than ``SPAN`` words match nothing,
    equal items are reported one by one, repeated rows once, other columns are ignored, empty tables give no leaks.
    """
    spark = corpus.sparkSession
    scratch = Scratch(spark, "leaks")
    docs, tests = _texts(corpus, key, text), _texts(items, item_key, item_text)
    theirs = scratch.cut(_windows(tests).withColumnRenamed("k", "item_id"), "items")
    ours = _windows(docs, Shared(spark, bit_filter(theirs, "h"))).withColumnRenamed("k", "doc_id")
    joined = scratch.cut(ours, "hits").join(theirs, ["seed", "h"]).select("doc_id", "item_id").distinct()
    pairs = scratch.cut(joined, "pairs")
    near = F.broadcast(pairs) if fits(pairs) else pairs
    both = docs.withColumnRenamed("k", "doc_id").join(near, "doc_id").join(tests.select(F.col("k").alias("item_id"), F.col("t").alias("item")).distinct(), "item_id")
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, last, codes, windows = Seeds(), None, np.zeros(0, np.uint64), []
        item_of = lru_cache(maxsize=4096)(seeds.sorted)
        for batch in batches:
            rows = []
            for d, i, t, item in zip(batch["doc_id"], batch["item_id"], batch["t"], batch["item"], strict=True):
                if t != last:
                    last, codes = t, seeds.codes(words_of(t))
                    windows = seeds.hashes(codes)
                other, keys = item_of(item)
                best = (0, 0, 0, 0)
                for diagonal in diagonals(windows, keys):
                    v = verify(codes, other, diagonal, slack)
                    if v[0] >= SPAN or (v[1] >= SPAN and v[2] >= slack * v[1]):
                        best = max(best, v)
                if best[0]:
                    rows.append((d, i, *best[:3], best[3] + 1))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest_run", "span_words", "equal_words", "word_pos"])

    return both.mapInPandas(check, f"doc_id {kinds[0]}, item_id {kinds[1]}, longest_run int, span_words int, equal_words int, word_pos int").distinct()
