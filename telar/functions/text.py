"""Text functions that Spark lacks, as Arrow UDFs on the standard library, and the cleaning rules that every curator shares."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from telar.functions import rx

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
_TAG = re.compile(r"<[^>]+>")


@dataclass(frozen=True)
class CleanOptions:
    """Switches of the common rules."""

    normalize_unicode: bool = True
    unicode_form: str = "NFKC"
    lowercase: bool = False
    strip_html: bool = True
    remove_urls: bool = False
    remove_emails: bool = False
    collapse_whitespace: bool = True
    replacements: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.unicode_form not in FORMS:
            raise ValueError(f"unicode_form must be one of {', '.join(FORMS)}")


def over_strings(fn: Callable[[str], str | None]):
    """An Arrow UDF from a function of one string; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return F.pandas_udf(run, "string")


def decoded(col: Column, strip_html: bool = True, form: str | None = "NFKC") -> Column:
    """Entities decoded once, then tags as spaces, then the Unicode form: one pass through Python, as these steps do not commute."""

    if not re.fullmatch(r"Column<'[\w.`]+'>", str(col)):  # what is computed would be computed again for the test
        return _decoder(strip_html, form)(col)
    # what holds no entity, tag or character that the form changes need not leave the JVM: the UDF gets null for it
    beyond = None if form is None else {"NFC": r"[^\x00-\xff]", "NFKC": r"[\xa0\xa8\xaa\xaf\xb2-\xb5\xb8-\xba\xbc-\xbe]|[^\x00-\xff]"}.get(form, r"[^\x00-\x7f]")
    needs = col.rlike("|".join(["&", *(["<"] if strip_html else []), *([beyond] if beyond else [])]))
    return F.when(needs, _decoder(strip_html, form)(F.when(needs, col))).otherwise(col)


@lru_cache
def _decoder(strip_html: bool, form: str | None):
    def one(text: str) -> str:
        out = html.unescape(text) if "&" in text else text
        if strip_html and "<" in out:
            out = _TAG.sub(" ", out)
        return out if form is None or out.isascii() else unicodedata.normalize(form, out)

    return over_strings(one)


def tidy_spaces(col: Column) -> Column:
    """White space collapsed; none before ``.,;:!?`` and ``)``, none after ``¿¡(``."""
    out = rx.squeeze(col)
    out = F.regexp_replace(out, r" +([.,;:!?])", "$1")
    out = F.regexp_replace(out, r"([¿¡(]) +", "$1")
    return F.regexp_replace(out, r" +\)", ")")


def common_rules(col: Column, options: CleanOptions = CleanOptions()) -> Column:
    """The rules of all curators, in their order: decode, strip, normalise, URLs, e-mails, replacements, spaces, case.  Null stays null."""
    # The patterns of URLs and e-mail addresses here, of tags and of spaces above.
    out = decoded(col, options.strip_html, options.unicode_form if options.normalize_unicode else None)
    if options.remove_urls:
        out = rx.sub(out, r"https?://\S+|www\.\S+", " ")
    if options.remove_emails:
        out = rx.sub(out, r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", " ")
    for old, new in options.replacements.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    if options.collapse_whitespace:
        out = tidy_spaces(out)
    return F.lower(out) if options.lowercase else out


class TreeText(HTMLParser):
    """Visible text of HTML: scripts, styles, comments and templates are left out; optionally only the body's, optionally block by block."""

    SKIPPED = frozenset({"script", "style", "template", "noscript", "head"})
    BLOCKS = frozenset("p div li ul ol table tr td th h1 h2 h3 h4 h5 h6 br section article header footer nav aside main blockquote pre figure figcaption dl dt dd form".split())
    BARE = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipping = 0
        self.path: list[str] = []
        self.parts: list[tuple[tuple[str, ...], str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.SKIPPED and tag != "head":
            self.skipping += 1
        if tag not in self.BARE:
            self.path.append(tag)
        if tag in self.BLOCKS:
            self.parts.append(((*self.path, tag), "\n"))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED and tag != "head" and self.skipping:
            self.skipping -= 1
        if tag in self.path:
            del self.path[len(self.path) - 1 - self.path[::-1].index(tag) :]
        if tag in self.BLOCKS:
            self.parts.append(((*self.path, tag), "\n"))

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append((tuple(self.path), data))


def tree_text(source: str, body_only: bool = False) -> str:
    """All visible text, pieces separated by a space."""
    parser = TreeText()
    parser.feed(source)
    parser.close()
    parts = parser.parts
    if body_only and any("body" in path for path, _ in parts):
        parts = [x for x in parts if "body" in x[0]]
    return " ".join(t.strip() for _, t in parts if t.strip())


def block_text(source: str, blocks: frozenset[str] = frozenset({"p", "br", "div", "li"})) -> str:
    """Text with a line end at each of the given elements, spaces collapsed within lines and blank lines dropped."""
    parser = TreeText()
    parser.feed(source)
    parser.close()
    text = "".join("\n" if t == "\n" and path[-1] in blocks else " " if t == "\n" else t for path, t in parser.parts)
    lines = (re.sub(r"[^\S\n]+", " ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


_CLUTTER = frozenset({"nav", "header", "footer", "aside", "form", "table", "button", "select"})


def main_text(source: str) -> str:
    """The main content: blocks outside page furniture that are long or end like sentences and are not mostly links; the source if none."""
    parser = TreeText()
    parser.feed(source)
    parser.close()
    kept, block, linked = [], [], 0
    for path, text in [*parser.parts, ((), "\n")]:
        if text == "\n" and path[-1:] != ("br",):
            joined = re.sub(r"\s+", " ", "".join(block)).strip()
            if joined and linked <= len(joined) / 2 and (len(joined) >= 80 or joined[-1] in ".!?…»”\""):
                kept.append(joined)
            block, linked = [], 0
        elif not _CLUTTER & set(path):
            block.append(text)
            linked += len(text) if "a" in path else 0
    return "\n".join(kept) if kept else source


def partitioned_text(source: str) -> str:
    """Elements of a text joined by spaces: HTML blocks if there is markup, paragraphs if not."""
    if "<" in source and ">" in source:
        return " ".join(block_text(source, TreeText.BLOCKS).split("\n"))
    return " ".join(p.strip() for p in re.split(r"\n\s*\n", source) if p.strip())


_PAIR = re.compile("[Â-ôƒ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")


def _sloppy(text: str) -> bytes:
    return b"".join(c.encode("cp1252", "ignore") or (c.encode("latin-1", "ignore") if ord(c) < 256 else b"\xff") for c in text)


def fix_text(text: str) -> str:
    """UTF-8 that was read as code page 1252 or Latin-1, also twice, read again; uncurled quotes; no control characters; NFC."""
    for _ in range(3):

        def again(m: re.Match[str]) -> str:
            try:
                return _sloppy(m[0]).decode("utf-8")
            except UnicodeDecodeError:
                return m[0]

        fixed = _PAIR.sub(again, text)
        if fixed == text:
            break
        text = fixed
    text = text.translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0xFEFF: None, **dict.fromkeys([*range(0, 9), 11, *range(14, 32), 127])})
    return unicodedata.normalize("NFC", re.sub(r"\r\n?", "\n", text))


def safe_name(text: str, limit: int = 120) -> str:
    """A file name of ASCII letters, digits and ``._-``."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-zA-Z0-9._-]+", "-", plain).strip("-._")[:limit] or "untitled"


def fixpoint_removed(pattern: str, flags: int = 0) -> Callable[[str], str]:
    """Replaces matches by a space until none is left."""
    compiled = re.compile(pattern, flags)

    def run(text: str) -> str:
        while True:
            shorter = compiled.sub(" ", text)
            if shorter == text:
                return text
            text = shorter

    return run
