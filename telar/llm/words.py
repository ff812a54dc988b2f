"""Letters regardless of case and accents, in Python: what ``telar.functions.rx.fold`` is for columns."""

from __future__ import annotations

import unicodedata


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
