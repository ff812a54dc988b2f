"""Curators as SQL functions: ``select curate_regex(text)``."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import SparkSession

from telar.functions.text import fix_text, main_text, over_strings, safe_name, tree_text


def _rules(text: str) -> str:
    out = unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", html.unescape(text)))
    out = re.sub(r"\s+", " ", out).strip()
    out = re.sub(r"\s+([.,;:!?])", r"\1", out)
    return re.sub(r"\s+\)", ")", re.sub(r"([¿¡(])\s+", r"\1", out))


def register(spark: SparkSession) -> list[str]:
    """Register the functions in a session; their names."""
    functions = {
        "curate_regex": _rules, "curate_ftfy": lambda s: _rules(fix_text(s)), "curate_beautifulsoup": lambda s: _rules(tree_text(s)),
        "curate_trafilatura": lambda s: _rules(main_text(s)), "safe_filename": safe_name,
    }
    for name, fn in functions.items():
        spark.udf.register(name, over_strings(fn))
    return sorted(functions)
