"""Attachments of records: kind by MIME type or file name."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODALITIES = ("audio", "image", "video", "document", "other")
# File endings of each kind.
SUFFIXES = {
    "audio": ".mp3 .wav .m4a .ogg .flac".split(),
    "image": ".jpg .jpeg .png .gif .webp .svg".split(),
    "video": ".mp4 .mov .avi .mkv .webm".split(),
    "document": ".txt .pdf .doc .docx .csv .json .jsonl".split(),
}
_TYPES = {s: mimetypes.types_map[s] for s in sorted({s for group in SUFFIXES.values() for s in group} | {".htm", ".html", ".md", ".xml", ".tif", ".bmp", ".zip"}) if s in mimetypes.types_map}


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))


def mime_type(name: Column) -> Column:
    """The MIME type of a path or URL, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    return F.try_element_at(table, suffix(name))


def modality(mime: Column, name: Column) -> Column:
    """MIME type first, then the ending, else ``other``."""
    out = F.when(F.startswith(mime, F.lit("audio/")), "audio").when(F.startswith(mime, F.lit("image/")), "image").when(F.startswith(mime, F.lit("video/")), "video")
    out = out.when(F.startswith(mime, F.lit("text/")) | (mime == "application/pdf"), "document")
    for kind, endings in SUFFIXES.items():
        out = out.when(suffix(name).isin(*endings), kind)
    return out.otherwise("other")


def attachment(path: Column | None = None, url: Column | None = None) -> Column:
    name = path if path is not None else url
    mime = mime_type(name)
    none = F.lit(None).cast("string")
    return F.struct(modality(mime, name).alias("modality"), (path if path is not None else none).alias("path"), (url if url is not None else none).alias("url"), mime.alias("mime_type"), F.lit("{}").alias("metadata"))


def wanted(files: Column, modalities: tuple[str, ...]) -> Column:
    return F.filter(files, lambda a: a["modality"].isin(*modalities))


def attachments(df: DataFrame) -> DataFrame:
    """A row per attachment; records without any have none."""
    return df.select("id", "source", F.explode("attachments").alias("a")).select("id", "source", "a.*")


def attachments_by_modality(df: DataFrame) -> DataFrame:
    return attachments(df).groupBy("modality").agg(F.count(F.lit(1)).alias("n"))


def records_by_modality(df: DataFrame) -> DataFrame:
    """The number of records that have an attachment of each kind."""
    kinds = df.select(F.explode(F.array_distinct(F.transform("attachments", lambda a: a["modality"]))).alias("modality"))
    return kinds.groupBy("modality").agg(F.count(F.lit(1)).alias("n"))


def of_modality(files: Column, kind: str) -> Column:
    return F.filter(files, lambda a: a["modality"] == kind)
