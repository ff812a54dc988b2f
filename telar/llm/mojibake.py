"""Garbled text from wrong character encoding."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.plans.lineage import Scratch
from telar.plans.shared import Shared

ROWS, WIDTH = 3, 19  # of the count-min table of all n-grams of all clean records that goes to every task: rows of 2 ** WIDTH counts
FINEST, FARTHEST = 100, 100  # gains are told apart to a hundredth, between -100 and 100
_SPACE = r"[ \t\r\n\x0b\f]+"
TOKEN = re.compile(r"[^ \t\r\n\x0b\f]+")
LOST = "�"
NO_BREAK = math.log(0.02)


def _to_bytes(text: str, name: str) -> bytes | None:
    """Bytes of a text; the code page 1252 keeps its five undefined bytes, as browsers do."""
    if name != "cp1252":
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            if 0x80 <= ord(c) < 0xA0:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def _from_utf8(data: bytes) -> str | None:
    """UTF-8; a sequence that lost its end counts as one lost character, a byte that begins none makes it no UTF-8."""
    out, at = [], 0
    while True:
        try:
            return "".join(out) + data[at:].decode("utf-8")
        except UnicodeDecodeError as e:
            if e.end - e.start < 2:
                return None
            out += [data[at : at + e.start].decode("utf-8"), LOST]
            at += e.end


def _to_text(data: bytes, name: str) -> str | None:
    try:
        if name == "cp1252":
            return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)
        return _from_utf8(data) if name == "utf-8" else data.decode(name)
    except UnicodeDecodeError:
        return None


_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437")
#: What was done to the text, last step first: encode with the one, decode with the other to undo it.
CHAINS: list[tuple[tuple[str, str], ...]] = [((x, "utf-8"),) for x in _READ_AS]
CHAINS += [((x, "utf-8"), (y, "utf-8")) for x in _READ_AS[:3] for y in _READ_AS[:3]]
CHAINS += [((x, y),) for x in ("cp1252", "mac_roman", "cp850", "cp437") for y in ("cp1252", "mac_roman", "cp850", "cp437") if x != y]
CHAINS += [(("cp1252", "utf-8"), ("cp1252", "utf-8"), ("cp1252", "utf-8"))]


def undo(token: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for wrong, right in chain:
        data = _to_bytes(token, wrong)
        back = _to_text(data, right) if data is not None else None
        if back is None or back == token:
            return None
        token = back
    return token


def candidates(token: str) -> dict[int, str]:
    """What each chain, by its number, would make of a word; a text that several chains give counts for the first."""
    out: dict[int, str] = {}
    for k, chain in enumerate(CHAINS):
        back = undo(token, chain)
        if back is not None and not any(unicodedata.category(c) in ("Cc", "Cn", "Co") for c in back):
            out[k] = back
    return out


def _plain(token: str) -> str:
    return re.sub(r"[0-9]", "0", unicodedata.normalize("NFC", token).lower())


def looks_clean(token: str) -> bool:
    """Whether a word may be learned from: no lost characters, no symbols inside a word, nothing that reads as UTF-8."""
    if LOST in token or any(unicodedata.category(c) in ("Cc", "Cn", "Co") for c in token):
        return False
    for a, b, c in zip(token, token[1:], token[2:], strict=False):
        if a.isalpha() and c.isalpha() and ord(b) > 127 and unicodedata.category(b)[0] in "SPNZ" and b not in "·’-‐–—":
            return False
    for wrong in _READ_AS:
        data = _to_bytes(token, wrong)
        if data is not None:
            back = _to_text(data, "utf-8")
            if back is not None and back != token:
                return False
    return True


def grams(token: str) -> Iterator[str]:
    for word in token.split("\xa0"):
        s = f"^^{_plain(word)}$" if word else ""
        for i in range(2, len(s)):
            yield s[i]
            yield s[i - 1 : i + 1]
            yield s[i - 2 : i + 1]


def buckets(gram: str) -> list[int]:
    """Where the count of an n-gram stands in each row; under a context (``\\x01`` and the n-gram) everything that goes on from it is counted."""
    h = xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"))
    return [(r << WIDTH) + (h >> (r * 21) & ((1 << WIDTH) - 1)) for r in range(ROWS)]


class CharModel:
    """Interpolated character trigrams of words with letters beyond ASCII, over a count-min table: of fixed size, a count at most too high."""

    def __init__(self, counts: np.ndarray, total: int, margin: float = 4.0):
        self.counts, self.total, self.margin = counts, max(1, total), margin
        self._at: dict[str, int] = {}
        self._cache: dict[str, dict[int, tuple[float, str]]] = {}

    def _count(self, gram: str) -> int:
        n = self._at.get(gram)
        if n is None:
            n = min(int(self.counts[b]) for b in buckets(gram))
            if len(self._at) < 500_000:
                self._at[gram] = n
        return n

    def score(self, token: str) -> float:
        """Log likelihood of a word, or of words joined by no-break spaces; a lost character costs as much as one in a thousand."""
        parts = token.split("\xa0")
        return sum(self._score(p) for p in parts if p) + (len(parts) - 1) * NO_BREAK

    def _score(self, word: str) -> float:
        s, total = f"^^{_plain(word)}$", 0.0
        for i in range(2, len(s)):
            if s[i] == LOST:
                total += math.log(1e-3)
                continue
            one = (self._count(s[i]) + 0.01) / (self.total + 20)
            two = (self._count(s[i - 1 : i + 1]) + 4 * one) / (self._count("\x01" + s[i - 1]) + 4)
            total += math.log((self._count(s[i - 2 : i + 1]) + 4 * two) / (self._count("\x01" + s[i - 2 : i]) + 4))
        return total

    def gains(self, token: str) -> dict[int, tuple[float, str]]:
        """By chain: by how much the word's origin beats the word itself, and that origin."""
        hit = self._cache.get(token)
        if hit is None:
            own, scores = self.score(token), {}
            for back in set((found := candidates(token)).values()):
                scores[back] = self.score(back) - own
            hit = {k: (scores[back] - 1.5 * len(CHAINS[k]), back) for k, back in found.items()}
            if len(self._cache) < 200_000:
                self._cache[token] = hit
        return hit

    def best(self, token: str) -> tuple[str, float]:
        """The likeliest origin of a word and by how much it beats the word itself."""
        gain, back = max(self.gains(token).values(), default=(float("-inf"), token))
        return back, gain

    def repair(self, text: str) -> tuple[str, int, int]:
        """A text as it was, the number of its garbled words, and of those that lost something.

        Words are judged one by one; the chain that gains most over the garbled ones then goes first for all of them, and mends words of
        the same text that it gains less than the margin for.
        """
        words = [m for m in TOKEN.finditer(text) if not m[0].isascii()]
        found = [self.gains(m[0]) for m in words]
        sure = [max(g.values(), default=(float("-inf"), ""))[0] > self.margin for g in found]
        total: Counter[int] = Counter()
        for g, ok in zip(found, sure, strict=True):
            for k, (gain, _) in g.items() if ok else ():
                total[k] += max(0.0, gain)
        common = max(total, key=lambda k: (total[k], -k)) if total else None
        parts, at, bad, lost = [], 0, 0, 0
        for m, g, ok in zip(words, found, sure, strict=True):
            back = m[0]
            if ok:
                back = g[common][1] if common in g and g[common][0] > self.margin else max(g.values())[1]
            elif common in g and g[common][0] > 0 and total[common] > 2 * self.margin:
                back = g[common][1]
            if back != m[0] or LOST in m[0]:
                bad += 1
                lost += LOST in back
                parts += [text[at : m.start()], back]
                at = m.end()
        return "".join(parts) + text[at:], bad, lost


def _margin(words: DataFrame, counts: np.ndarray, total: int) -> float:
    """The margin: above every gain by which a clean word would be changed, yet below most gains of the same words once garbled.

    Over all clean words with characters beyond ASCII.  A word whose origin is at least twenty times as frequent as the word itself, or is seen as often and
    the word only once, is taken for a garbled one and says nothing.
    """
    model = Shared(words.sparkSession, CharModel(counts, total))
    told = "w string, n bigint, back string, kind int, gain int"

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        place = lambda gain: round(max(-FARTHEST, min(FARTHEST, gain)) * FINEST)
        for batch in batches:
            rows = []
            for w, n in zip(batch["w"], batch["n"], strict=True):
                if not looks_clean(w):
                    continue
                back, gain = m.best(w)
                if gain > -FARTHEST:
                    rows.append((w, n, back, 0, place(gain)))
                wrong = _to_bytes(w, "utf-8")
                for chain in CHAINS[:5]:
                    bad = _to_text(wrong, chain[0][0]) if wrong else None
                    if bad and bad != w:
                        rows.append((None, 0, None, 1, place(m.best(bad)[1])))
            yield pd.DataFrame(rows, columns=["w", "n", "back", "kind", "gain"])

    seen = words.mapInPandas(gains, told)
    known = words.select(F.col("w").alias("back"), F.col("n").alias("n_back"))
    clean = seen.where("kind = 0").join(known, "back", "left").withColumn("n_back", F.coalesce("n_back", F.lit(0)))
    clean = clean.where((F.col("n_back") < 20 * F.col("n")) & ~((F.col("n") == 1) & (F.col("n_back") >= 1)))
    top = clean.agg(F.max("gain")).first()[0]
    places = sorted((r.gain, r.n) for r in seen.where("kind = 1").groupBy("gain").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2 * FARTHEST * FINEST + 1 rows
    if top is None or not places:
        return 4.0
    upto, low = sum(n for _, n in places) // 100, 0.0
    for place, n in places:
        low, upto = place / FINEST, upto - n
        if upto < 0:
            break
    top = top / FINEST
    return min(max(2.0, top + 0.5), max(4.0, (max(top, 0.0) + low) / 2 if low > top else 6.0))


def train(values: DataFrame) -> CharModel:
    """A model of the words with letters beyond ASCII in column ``value``: counted over all rows, words written once, n-grams summed before they come together."""
    words = (
        values.where("value is not null").select(F.explode(F.split("value", _SPACE)).alias("w"))
        .where(F.col("w").rlike(r"[^\x00-\x7f]")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    )
    words = Scratch(values.sparkSession, "garbled").cut(words, "words")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter[int] = Counter()  # no more keys than the table has counts
        for batch in batches:
            for w, n in zip(batch["w"], batch["n"], strict=True):
                if looks_clean(w):
                    for g in grams(w):
                        for b in [*buckets(g), *(buckets("\x01" + g[:-1]) if len(g) > 1 else [-1])]:
                            sums[b] += n
        if sums:
            yield pd.DataFrame({"b": list(sums), "n": list(sums.values())})

    counts, total = np.zeros(ROWS << WIDTH, np.int64), 0
    for r in words.mapInPandas(count, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toLocalIterator():  # no more rows than the table has counts
        if r.b < 0:
            total = r.n
        else:
            counts[r.b] = r.n
    return CharModel(counts, total, _margin(words, counts, total))


def _fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.col(key).cast("string").alias("id"), F.explode(pairs).alias("p")).select("id", "p.field_name", "p.value")


def find_garbled(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``id, field_name, n_garbled, n_lost, repaired``: the values of which any part was read in a wrong encoding, as far as it can be restored.

    A character n-gram model is trained on the words of the clean values; for each word with characters beyond ASCII every chain of
    encodings that could have garbled it is undone, and the likeliest origin is taken if it beats the word by more than a margin that
    is validated on clean words and on the same words garbled.  A replacement character shows a loss that cannot be undone; a sequence
    that lost its end is restored but for one such character.

    Null values and ids are dropped, empty values are clean, repeated rows count once, other columns are ignored; with no clean word to
    learn from only replacement characters and what reads as UTF-8 are found.
    """
    values = _fields(df, key, fields)
    model = Shared(df.sparkSession, train(values))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = model.value.repair
        for batch in batches:
            rows = []
            for i, f, v in zip(batch["id"], batch["field_name"], batch["value"], strict=True):
                back, bad, lost = repair(v)
                if bad:
                    rows.append((i, f, bad, lost, back))
            yield pd.DataFrame(rows, columns=["id", "field_name", "n_garbled", "n_lost", "repaired"])

    suspects = values.where(F.col("id").isNotNull() & F.col("value").rlike(r"[^\x00-\x7f]"))
    return suspects.mapInPandas(scan, "id string, field_name string, n_garbled int, n_lost int, repaired string").distinct()
