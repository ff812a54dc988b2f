"""Language of a text by a vote of function words, JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from telar.functions import rx

# Frequent words that tell one of the languages from the others, without accents.
VOTES = {
    "es": "el los las del y con por para su como mas pero porque era habia muy cuando hasta sin lo una segun entre desde al".split(),
    "en": "the and of to in was with that for were from but not because there when before after until on a".split(),
    "pt": "o os da dos das em no na nos nas com ao um uma nao mais foi ate pelo pela do e as".split(),
    "fr": "le les des et du dans avec qui etait pas une un est au sur avant il jusqu par l d".split(),
    "de": "der die das und den ein eine einen mit nicht war im am von zu auf bis es weil ohne".split(),
}


def _count(plain: Column, words: list[str]) -> Column:
    return F.regexp_count(plain, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"))


def votes(col: Column) -> dict[str, Column]:
    """The number of words of a text that belong to each language's list."""
    plain = rx.fold(col)
    return {lang: _count(plain, words) for lang, words in VOTES.items()}


def language_column(col: Column, least: int = 2) -> Column:
    """The language with the most votes, ties in alphabetical order; null below ``least`` votes and for null.

    The folded text and the ranking are bound by lambdas, so each is made once per text.
    """
    rank = lambda plain: F.element_at(F.array_sort(F.array(*[F.struct((-_count(plain, words)).alias("n"), F.lit(lang).alias("lang")) for lang, words in VOTES.items()])), 1)
    best = F.filter(F.transform(F.array(rx.fold(col)), rank), lambda b: -b["n"] >= least)
    return F.get(F.transform(best, lambda b: b["lang"]), F.lit(0))


def language_share(col: Column, lang: str) -> Column:
    """The part of all votes that goes to one language, 0 without votes."""
    counted = votes(col)
    total = reduce(lambda a, b: a + b, counted.values())
    return F.when(total > 0, counted[lang] / total).otherwise(F.lit(0.0))
