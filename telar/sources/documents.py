"""Knowledge files of any supported format as documents ``source, path, doc_id, title, text``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.functions import rx
from telar.operators.retrieval import chunk_id, normalize
from telar.sources import files
from telar.sources.lines import numbered, placed

# Where a document's id, title and text may stand, and the known folders.
ID_KEYS, TITLE_KEYS = ("id", "doc_id"), ("title", "name", "question", "term")
TEXT_KEYS = ("text", "content", "body", "description", "answer", "article")
NOT_TEXT = ("id", "doc_id", "title", "name")
FOLDERS = ("academia_canaria", "canariwiki", "gevic")
COLUMNS = ("source", "path", "doc_id", "title", "text")


def _first(values: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def normalize_document(df: DataFrame, raw: str = "raw", fallback_id: str = "fallback_id", fallback_title: str = "fallback_title") -> DataFrame:
    """``doc_id, title, text`` beside the other columns from JSON text in ``raw``: the first known key that is not blank of each.

    Without a text key, the scalar values become lines of key and value; a document without any text, or no object, is dropped.
    """
    v = F.try_parse_json(raw)
    get = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    rows = df.withColumn("_v", v).where("_v is not null").withColumn("_m", F.from_json(F.col(raw), "map<string,string>")).where(F.col("_m").isNotNull())
    scalars = F.map_filter("_m", lambda k, x: ~k.isin(*NOT_TEXT) & x.isNotNull() & ~F.startswith(F.ltrim(x), F.lit("[")) & ~F.startswith(F.ltrim(x), F.lit("{")))
    joined = F.array_join(F.transform(F.map_entries(scalars), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")
    text = _first([normalize(get(k)) for k in TEXT_KEYS] + [normalize(joined)])
    title = _first([normalize(_first([get(k) for k in TITLE_KEYS])), F.col(fallback_title)])
    out = rows.select(*df.columns, _first([get(k) for k in ID_KEYS] + [F.col(fallback_id)]).alias("doc_id"), title.alias("title"), text.alias("text"))
    return out.where(F.coalesce("text", F.lit("")) != "")


def _stem() -> Column:
    return F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)


def _named(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source)).withColumn("stem", _stem())


def read_documents(spark: SparkSession, root: str, source: str) -> DataFrame:
    """All json, jsonl, csv, txt and md files below a folder; bad lines and files of other kinds are skipped.

    Files are listed and read in tasks: the driver knows none but the csv tables.
    """
    every = files.listed(spark, root)
    of = lambda *kinds: every.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*kinds))
    lines = files.lines(of("jsonl")).where(rx.strip(F.col("value")) != "").withColumnRenamed("value", "raw")
    whole = files.whole(of("json")).withColumnRenamed("value", "raw")
    listed = F.from_json(F.when(F.ltrim("raw").startswith("["), F.col("raw")), T.ArrayType(T.StringType()))
    items = whole.select("path", F.posexplode(F.coalesce(listed, F.array("raw"))).alias("line", "raw")).withColumn("line", F.col("line") + 1)
    kinds = [lines, items]
    tables = sorted(re.sub(r"([\[\]{}*?,\\])", r"\\\1", r.path) for r in of("csv").select("path").toLocalIterator())
    if tables:  # a table without files has no columns to infer
        table = spark.read.csv(tables, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
        kinds.append(numbered(placed(table, F.to_json(F.struct(*table.columns)).alias("raw"))))
    known = [
        normalize_document(_named(df, source).withColumn("fallback_id", F.concat_ws(":", "stem", "line")).withColumn("fallback_title", F.col("stem"))).select(*COLUMNS) for df in kinds
    ]
    plain = files.whole(of("txt", "md")).select("path", normalize(F.col("value")).alias("text"))
    plain = _named(plain.where("text != ''"), source).select("source", "path", F.col("stem").alias("doc_id"), F.col("stem").alias("title"), "text")
    return reduce(lambda a, b: a.unionByName(b), [*known, plain])


def read_knowledge(spark: SparkSession, root: str, folders: tuple[str, ...] = FOLDERS) -> DataFrame:
    """The documents of those of the known folders that exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [f for f in folders if path(f"{root}/{f}").getFileSystem(conf).exists(path(f"{root}/{f}"))]
    if not there:
        raise FileNotFoundError(f"none of {', '.join(folders)} is below {root}")
    return reduce(lambda a, b: a.unionByName(b), [read_documents(spark, f"{root}/{f}", f) for f in there])


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` from source, path, document and number; a repeated document id gets its chunks' order as a suffix by the caller's key."""
    return chunks.withColumn("chunk_id", chunk_id(F.col("source"), F.col("path"), F.col("doc_id"), F.col("chunk_no")))
