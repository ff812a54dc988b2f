"""Regular expressions that mean the same in Spark as in Python's ``re``."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of Python's ``\s``, as the inside of a Java character class.
WS = r"\p{IsWhite_Space}\x{1c}-\x{1f}"


def px(pattern: str, flags: str = "") -> str:
    """A Python pattern for Spark: Unicode classes, exact white space, ``\\Z`` as ``\\z``.  ``flags``: of ``i``, ``m``, ``s``.

    Within a character class ``\\s`` must be written as ``{WS}`` by the caller; outside, it is replaced here.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            out.append({"s": WS if inside else f"[{WS}]", "S": f"[^{WS}]" if not inside else "\\S", "Z": r"\z"}.get(n, c + n))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside and out[-1] not in ("[", "[^"):
            inside = False
        out.append(c + "^" if c == "[" and pattern[i + 1 : i + 2] == "^" else c)
        i += 2 if c == "[" and pattern[i + 1 : i + 2] == "^" else 1
    return f"(?U{''.join(sorted(set(flags + ('d' if 'm' in flags else ''))))})" + "".join(out)


def sub(col: Column, pattern: str, to: str, flags: str = "") -> Column:
    """``re.sub`` with a literal or ``$n`` replacement."""
    return F.regexp_replace(col, px(pattern, flags), to)


def strip(col: Column) -> Column:
    """``str.strip``."""
    return F.regexp_replace(col, rf"^[{WS}]+|[{WS}]+\z", "")


def squeeze(col: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, rf"[{WS}]+", " "))


def words(col: Column) -> Column:
    """Longest runs of letters and digits; combining marks are no letters."""
    return F.regexp_extract_all(col, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _folds() -> tuple[str, str]:
    src, dst = [], []
    for point in range(0xC0, min(0x2000, sys.maxunicode)):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and unicodedata.category(c)[0] == "L":
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _folds()


def fold(col: Column) -> Column:
    """Lower case without accents, JVM-side: precomposed letters by a table made from the Unicode data, then all marks dropped."""
    return F.regexp_replace(F.translate(F.lower(col), ACCENTED, PLAIN), r"\p{M}+", "")
