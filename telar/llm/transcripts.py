"""Speech transcripts into clean speaker turns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telar.llm.peg import Grammar, Node, alt, brackets, first, many, ref, seq, term
from telar.plans.lineage import Scratch

# Words for interviewers and informants, and their abbreviations.
INTERVIEWERS = r"entrevistador(?:es|as|a)?|encuestador(?:es|as|a)?|investigador(?:es|as|a)?|interviewer|entrev|entr|enc|inv"
INFORMANTS = r"entrevistad[oa]s?|encuestad[oa]s?|informantes?|informador(?:a)?|interviewee|infte|inft|inf"
HESITATION = re.compile(r"(?:e+h+m*|e+m+|h*m+h*m*|h+[aeu]*m+|u+h+m*|u+m+|a+h+m+|e{2,}|mhm|ajm+)\Z")
_WORD = re.compile(r"[^\W_]+")
_HESITANT = frozenset("eEhHmMuUaAéÉúÚáÁèÈàÀùÙëËüÜäÄêÊâÂûÛ")  # letters that hesitation sounds begin with, accents or not

_WORDS = rf"(?:{INTERVIEWERS}|{INFORMANTS})\.?"
_NUM = r"[ .]?[ ]?\d{1,2}"
_NAME = rf"(?:[EI]{_NUM}|[EI]|{_WORDS}[ ]?(?:\d{{1,2}})?)"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,-]\d{1,3})?"
_TAIL = r"(?:[ \t]*:|[ \t]*\.-|[ \t]+[-–—](?=[ \t]))"

LABEL = re.compile(rf"[\s*\[<({{]*(?:({INTERVIEWERS}|E)|({INFORMANTS}|I))\.?[ .]*(\d{{1,2}})?(?![^\W\d_])", re.I)


def _fresh(state: dict) -> bool:
    return bool(state["fresh"])


def _set_fresh(state: dict, text: str, at: int, end: int) -> None:
    state["fresh"] = True


def _after_words(state: dict, text: str, at: int, end: int) -> None:
    state["fresh"] = text[at:end].rstrip(" \t*\"'»”)")[-1:] in ".?!…"


def grammar() -> Grammar:
    """Labels, time marks, nested annotations and speech."""
    return Grammar(
        {
            "transcript": many(
                alt(
                    first(" \t\r\n", ref("break")), first("0123456789[({<#", ref("stamp")), first("[({<", ref("aside")), first("*[<EeIi", ref("label")),
                    first("EeIi", ref("opening")), first("[({<*", ref("note")), ref("words"), ref("other"),
                )
            ),
            "break": term(r"[ \t]*(?:\r?\n|\r)[ \t]*"),
            # a bare minute mark counts only where an utterance may begin, a bare hour mark anywhere
            "stamp": alt(
                term(rf"(?:\d+[ \t]*\r?\n)?{_CLOCK}[ \t]*-->[ \t]*{_CLOCK}[ \t]*"),
                term(rf"(?:\[{_CLOCK}\]|\({_CLOCK}\)|\{{{_CLOCK}\}}|<{_CLOCK}>|#{_CLOCK}#)[ \t]*"),
                term(r"(?<![\w:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?(?![\w:])[ \t]*"),
                ref("minute"),
            ),
            "minute": term(rf"(?<![\w:])\d{{1,2}}:\d{{2}}(?![\w:])[ \t]*(?=[*\[<]*{_NAME})", re.I),
            "aside": seq(
                term(rf"[\[({{<][ \t]*(?:[EI]{_NUM}|[EI](?=[ \t]*:)|{_WORDS}[ ]?\d{{0,2}})[ \t]*:", re.I),
                many(alt(term(r"[^\n\])}>\[({<*#\d]+"), ref("stamp"), ref("note"), term(r"[^\n\])}>]"))),
                term(r"[\])}>][ \t]*"),
            ),
            "label": alt(
                term(rf"\*\*[ \t]*{_NAME}[ \t]*:?[ \t]*\*\*[ \t]*:?[ \t]*", re.I),
                term(rf"[\[<][ \t]*(?:[EI]{_NUM}|{_WORDS}[ ]?\d{{0,2}}|[EI])[ \t]*[\]>][ \t]*:?[ \t]*", re.I),
                term(rf"(?<!\w)[EI]{_NUM}{_TAIL}[ \t]*", re.I),
            ),
            "opening": alt(term(rf"(?<!\w){_WORDS}[ ]?(?:\d{{1,2}})?{_TAIL}[ \t]*", re.I), term(r"(?<!\w)[EI](?:[ \t]*:|\.-)[ \t]*")),
            "note": brackets(r"\(\s*[\d\s,.–-]+\s*\)"),
            # a clause without anything that may begin a mark, a label or an annotation, else one word
            "words": term(r"(?:(?![EI][ .]?[ ]?\d)[^\s\[\](){}<>*#.?!…\d][^\s\[\](){}<>*#.?!…]*[ \t]*)+[.?!…]*[ \t]*|[^\s\[\](){}<>*#]+[ \t]*", re.I),
            "other": term(r"[\s\S]"),
        },
        when={"opening": _fresh, "minute": _fresh},
        after={"break": _set_fresh, "words": _after_words, "label": _set_fresh, "opening": _set_fresh},
    )


def speaker_of(label: str | None) -> str | None:
    """``E`` or ``I`` plus number, 1 if none is given; null for what is no label."""
    m = LABEL.match(label or "")
    return ("E" if m[1] else "I") + str(int(m[3] or 1) or 1) if m else None


def has_speech(text: str) -> bool:
    """Whether words other than hesitation sounds are left."""
    found = (m[0] for m in _WORD.finditer(text))
    return any(w[0] not in _HESITANT or not HESITATION.match("".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))) for w in found)


def tidy(text: str) -> str:
    """Speech without hesitation sounds and stray marks, white space collapsed."""
    # what begins with a letter that begins no hesitation sound needs no closer look
    kept = [w for w in text.split() if (w[0].isalnum() and w[0] not in _HESITANT) or not ((said := "".join(_WORD.findall(w))) and HESITATION.match(said.lower()))]
    return re.sub(r"\s+([,.;:!?…])", r"\1", " ".join(kept)).strip(" *#")


class Reader:
    """Reads one text into utterances of speaker and speech, in order."""

    def __init__(self) -> None:
        self.grammar = grammar()

    def utterances(self, text: str, speaker: str | None = None) -> list[tuple[str | None, str]]:
        tree: Node = self.grammar.parse("transcript", text, fresh=True)
        out: list[tuple[str | None, list[str]]] = [(speaker, [])]
        for node in tree.children:
            if node.rule in ("label", "opening"):
                out.append((speaker_of(text[node.start : node.end]), []))
            elif node.rule in ("words", "other"):
                out[-1][1].append(text[node.start : node.end])
            elif node.rule == "break":
                out[-1][1].append(" ")
        return [(s, "".join(p)) for s, p in out]

    def turns(self, text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for speaker, said in self.utterances(text):
            if speaker is None or not has_speech(said):
                continue
            if out and out[-1][0] == speaker:
                out[-1] = (speaker, out[-1][1] + " " + tidy(said))
            else:
                out.append((speaker, tidy(said)))
        return out


def _from_texts(rows: DataFrame) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            out = [(c, i + 1, s, t) for c, x in zip(batch["code"], batch["transcript"], strict=True) for i, (s, t) in enumerate(reader.turns(x))]
            yield pd.DataFrame(out, columns=["code", "turn_no", "speaker", "text"])

    return rows.mapInPandas(read, "code string, turn_no bigint, speaker string, text string")


def _from_segments(rows: DataFrame, scratch: Scratch) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            out = []
            for c, a, n, s, x in zip(batch["code"], batch["start_ms"], batch["seg_no"], batch["speaker"], batch["text"], strict=True):
                for k, (who, said) in enumerate(reader.utterances(x or "", speaker_of(s))):
                    if k and who is None:
                        continue
                    speech = has_speech(said)
                    out.append((c, a, n, k, who, tidy(said) if speech else None))
            yield pd.DataFrame(out, columns=["code", "at", "seg_no", "part", "who", "text"])

    parts = scratch.cut(rows.mapInPandas(read, "code string, at bigint, seg_no bigint, part int, who string, text string"), "parts")  # ranging reads it twice
    # Ranges of the whole order, cut anywhere: a recording of any length spreads over as many of them as it needs.
    order = ["at", "seg_no", "part"]
    ranged = parts.repartitionByRange("code", *order).withColumn("range", F.spark_partition_id())
    ranged = scratch.cut(ranged, "ranged")
    inside = Window.partitionBy("range", "code").orderBy(*order)
    before = Window.partitionBy("code").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = ranged.where("who is not null").groupBy("range", "code").agg(F.max_by("who", F.struct(*order)).alias("who"))
    ends = ranged.select("range", "code").distinct().join(last, ["range", "code"], "left")
    carried = ends.select("range", "code", F.last("who", True).over(before).alias("carried"))
    running = ranged.withColumn("who", F.last("who", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    spoken = running.join(carried, ["range", "code"]).withColumn("who", F.coalesce("who", "carried")).where("who is not null and text is not null").drop("carried")
    spoken = scratch.cut(spoken, "spoken")
    marked = spoken.withColumn("changed", F.coalesce((F.col("who") != F.lag("who").over(inside)).cast("int"), F.lit(0)))
    edges = spoken.groupBy("range", "code").agg(F.min_by("who", F.struct(*order)).alias("first"), F.max_by("who", F.struct(*order)).alias("last"))
    changes = marked.groupBy("range", "code").agg(F.sum("changed").alias("changes"))
    by_range = Window.partitionBy("code").orderBy("range")
    joined = edges.join(changes, ["range", "code"]).withColumn("starts", F.coalesce((F.col("first") != F.lag("last").over(by_range)).cast("int"), F.lit(1)))
    offset = joined.select("range", "code", (F.coalesce(F.sum(F.col("changes") + F.col("starts")).over(before), F.lit(0)) + F.col("starts")).alias("offset"))
    numbered = marked.join(offset, ["range", "code"]).withColumn("turn_no", F.col("offset") + F.sum("changed").over(inside))
    said = F.array_sort(F.collect_list(F.struct(*order, "text")))
    out = numbered.groupBy("code", "turn_no", F.col("who").alias("speaker")).agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"))
    return out.select("code", "turn_no", "speaker", "text")


def speaker_turns(recordings: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """``code, turn_no, speaker, text``: the ordered turns of every recording.

    ``recordings`` has ``code`` and ``transcript``, ``segments`` has ``code, seg_no, start_ms, speaker, text`` for recordings without a
    transcript.  A grammar reads labels, time marks, nested annotations and speech; annotations, marks, interjections and whatever
    stands before the first label are dropped, then utterances without words or with hesitation sounds only, then neighbours of one speaker
    are joined.  A segment without a label goes on with the speaker of the one before, in order of ``start_ms`` (ties: ``seg_no``).

    Null codes and blank transcripts are dropped, repeated rows count once, other columns are ignored, empty tables give no turns.
    Segments are ordered in ranges that may end anywhere, with the speaker and turn number carried from range to range by small
    summaries, so one recording may have any part of all segments.
    """
    scratch = Scratch(recordings.sparkSession, "turns")
    texts = recordings.select(F.col("code").cast("string"), F.col("transcript").cast("string")).where(F.col("code").isNotNull() & F.col("transcript").rlike(r"\S"))
    texts = texts.dropDuplicates(["code"])
    out = _from_texts(texts)
    if segments is None:
        return out
    rows = segments.select(F.col("code").cast("string"), F.col("seg_no").cast("bigint"), F.col("start_ms").cast("bigint"), F.col("speaker").cast("string"), F.col("text").cast("string"))
    rows = rows.where("code is not null").join(texts.select("code"), "code", "left_anti")
    rows = rows.groupBy("code", "start_ms", "text", "speaker").agg(F.min("seg_no").alias("seg_no"))  # a segment that came again; two may say the same at once
    return out.unionByName(_from_segments(rows, scratch))
