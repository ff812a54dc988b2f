"""Loaders: file formats into records ``id, source, title, text, metadata, attachments``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telar.functions import rx
from telar.sources.attachments import MODALITIES, attachment, wanted
from telar.sources.files import exists

COLUMNS = ("id", "source", "title", "text", "metadata", "attachments")
ATTACHMENTS = "array<struct<modality:string,path:string,url:string,mime_type:string,metadata:string>>"


@dataclass(frozen=True)
class LoaderOptions:
    data_dir: str
    include_attachments: bool = False
    modalities: tuple[str, ...] = field(default=MODALITIES)


Loader = Callable[[SparkSession, LoaderOptions], DataFrame]
_REGISTRY: dict[str, Loader] = {}


def register_loader(name: str, loader: Loader) -> None:
    _REGISTRY[name] = loader


def loader_names() -> list[str]:
    return sorted(_REGISTRY)


def get_loader(name: str) -> Loader:
    if name not in _REGISTRY:
        raise ValueError(f"unknown loader {name!r}; known: {', '.join(loader_names())}")
    return _REGISTRY[name]


def load(spark: SparkSession, names: list[str] | str, options: LoaderOptions) -> DataFrame:
    """The records of the chosen sources, or of ``all``."""
    chosen = loader_names() if names == "all" else [names] if isinstance(names, str) else list(names)
    if not chosen:
        raise ValueError("at least one loader is needed")
    return reduce(lambda a, b: a.unionByName(b), [get_loader(n)(spark, options) for n in chosen])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped, a bad line fails."""
    return spark.read.option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def _numbered(df: DataFrame) -> DataFrame:
    """Rows numbered from 1 in the order of files and of rows in them; what is ordered in one place is one row per part of a file."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    parts = rows.groupBy("_path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return rows.join(starts, ["_path", "_block"]).withColumn("_idx", F.col("_at") + F.col("_start")).drop("_path", "_block", "_at", "_start")


def _rest(df: DataFrame, consumed: tuple[str, ...]) -> Column:
    kept = [c for c in df.columns if c not in consumed and not c.startswith("_")]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}) if kept else F.lit("{}")


def _record(df: DataFrame, source: str, key: Column, title: Column, text: Column, consumed: tuple[str, ...], attached: Column | None, options: LoaderOptions) -> DataFrame:
    files = wanted(attached, options.modalities) if options.include_attachments and attached is not None else F.array()
    return df.select(
        F.concat_ws(":", F.lit(source), key.cast("string")).alias("id"), F.lit(source).alias("source"), title.cast("string").alias("title"), rx.strip(F.coalesce(text, F.lit(""))).alias("text"),
        _rest(df, consumed).alias("metadata"), files.cast(ATTACHMENTS).alias("attachments"),
    )


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _blank(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def consultations(spark: SparkSession, o: LoaderOptions) -> DataFrame:
    df = _numbered(read_jsonl(spark, f"{o.data_dir}/academia_canaria/consultations/consultations.jsonl"))
    text = F.concat(F.lit("Pregunta: "), _blank(_has(df, "question")), F.lit("\nRespuesta: "), _blank(_has(df, "answer")))
    return _record(df, "academia_consultations", F.col("_idx"), _has(df, "question"), text, ("question", "answer"), None, o)


def dictionary(spark: SparkSession, o: LoaderOptions) -> DataFrame:
    df = read_jsonl(spark, f"{o.data_dir}/academia_canaria/dictionary/entries.jsonl")
    urls = F.transform(F.coalesce(_has(df, "image_urls", "array<string>"), F.array().cast("array<string>")), lambda u: attachment(url=u))
    return _record(df, "academia_dictionary", F.col("word"), F.col("word"), F.concat_ws("\n", "word", _blank(_has(df, "definitions_text"))), ("word", "definitions_text"), urls, o)


def _folder() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1)


def is_redirect(col: Column) -> Column:
    """Whether a page only points to another: the rule of the loader, which the word ``REDIRECCIÓN`` alone does not meet."""
    return col.rlike(rx.px(r"^\s*#redirect\b", "i"))


def wiki(spark: SparkSession, o: LoaderOptions) -> DataFrame:
    """Pages of one folder each, with ``raw.json`` and ``metadata.json``; redirects are dropped; ``raw`` joins the keys of the metadata."""
    base = f"{o.data_dir}/canariwiki/pages/*"
    text = lambda name: spark.read.text(f"{base}/{name}.json", wholetext=True).select(_folder().alias("_dir"), F.try_parse_json("value").alias(name))
    df = text("raw").join(text("metadata").withColumnRenamed("metadata", "meta"), "_dir", "left")
    body = F.coalesce(F.try_variant_get("raw", '$.revisions[0].slots.main["*"]', "string"), F.lit(""))
    title = F.coalesce(F.nullif(F.try_variant_get("meta", "$.title", "string"), F.lit("")), F.try_variant_get("raw", "$.title", "string"))
    key = F.coalesce(F.nullif(F.try_variant_get("meta", "$.pageid", "string"), F.lit("")), F.element_at(F.split("_dir", "/"), -1))
    image = "array<struct<local_path:string,url:string,mime:string>>"
    images = F.transform(
        F.coalesce(F.try_variant_get("meta", "$.images", image), F.array().cast(image)),
        lambda i: F.when(i["local_path"].isNotNull(), attachment(path=i["local_path"])).otherwise(attachment(url=i["url"])),
    )
    keys = F.map_filter(F.coalesce(F.try_variant_get("meta", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: k != "raw")
    rows = df.withColumn("body", body).where(~is_redirect(F.col("body"))).select("*", key.alias("_key"), title.alias("_title"), images.alias("_files"))
    return rows.select(
        F.concat_ws(":", F.lit("canariwiki"), "_key").alias("id"), F.lit("canariwiki").alias("source"), F.col("_title").alias("title"), rx.strip(F.col("body")).alias("text"),
        F.to_json(F.map_concat(keys, F.create_map(F.lit("raw"), F.col("raw")))).alias("metadata"), (wanted(F.col("_files"), o.modalities) if o.include_attachments else F.array()).cast(ATTACHMENTS).alias("attachments"),
    )


def _beside(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """Folder names and the contents of a file of each; folders without it are missing."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], f"_name string, {name} string")
    return spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(_folder(), "/"), -1).alias("_name"), F.col("value").alias(name))


def _local(spark: SparkSession, pattern: str, reserved: tuple[str, ...]) -> DataFrame:
    """Paths of the other files of each folder, subfolders too; only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path")
    named = files.where(~F.element_at(F.split("path", "/"), -1).isin(*reserved)).withColumn("_name", F.regexp_extract("path", r"/(?:fichas|articles)/([^/]+)/", 1))
    return named.groupBy("_name").agg(F.array_sort(F.collect_list("path")).alias("_files"))


def corpus(spark: SparkSession, o: LoaderOptions) -> DataFrame:
    """Recordings: the index with each folder's transcript, and its ``metadata.json`` and ``raw.json`` beside the index's own keys."""
    base = f"{o.data_dir}/corpecan"
    df = read_jsonl(spark, f"{base}/index.jsonl")
    df = df.withColumn("_name", F.element_at(F.split(F.regexp_replace("local_path", "/+$", ""), "/"), -1))
    for name, column in (("transcript.txt", "_said"), ("metadata.json", "_meta"), ("raw.json", "_raw")):
        df = df.join(_beside(spark, f"{base}/fichas/*/{name}", column), "_name", "left")
    none = F.parse_json(F.lit("{}"))
    df = df.withColumns({"metadata": F.coalesce(F.try_parse_json("_meta"), none), "raw": F.coalesce(F.try_parse_json("_raw"), none)})
    if o.include_attachments:
        df = df.join(_local(spark, f"{base}/fichas", ("transcript.txt", "metadata.json", "raw.json", ".DS_Store")), "_name", "left")
    place = F.try_variant_get("metadata", "$.visible_metadata.location", "string")
    files = F.transform(F.coalesce(_has(df, "_files", "array<string>"), F.array().cast("array<string>")), lambda p: attachment(path=p))
    return _record(df, "corpecan", F.coalesce(F.nullif("code", F.lit("")), F.col("_name")), F.coalesce(F.nullif(place, F.lit("")), F.col("_name")), F.col("_said"), (), files, o)


def encyclopedia(spark: SparkSession, o: LoaderOptions) -> DataFrame:
    """Articles: the index with each folder's text, the raw text where there is none; URLs before local files."""
    base = f"{o.data_dir}/gevic"
    df = read_jsonl(spark, f"{base}/index.jsonl")
    df = df.withColumn("_name", F.element_at(F.split(F.regexp_replace("local_path", "/+$", ""), "/"), -1)).join(_beside(spark, f"{base}/articles/*/text.txt", "_text"), "_name", "left")
    df = df.join(_beside(spark, f"{base}/articles/*/raw.json", "_json"), "_name", "left").withColumn("_raw", F.try_parse_json("_json"))
    if o.include_attachments:
        df = df.join(_local(spark, f"{base}/articles", ("text.txt", "raw.json", "metadata.json")), "_name", "left")
    none = F.array().cast("array<string>")
    urls = F.transform(F.coalesce(_has(df, "image_urls", "array<string>"), none), lambda u: attachment(url=u))
    files = F.transform(F.coalesce(_has(df, "_files", "array<string>"), none), lambda p: attachment(path=p))
    text = F.coalesce(F.nullif("_text", F.lit("")), F.try_variant_get("_raw", "$.text", "string"))
    title = F.coalesce(F.nullif(F.try_variant_get("_raw", "$.title", "string"), F.lit("")), _has(df, "title"))
    return _record(df, "gevic", F.coalesce(F.nullif(F.col("ids.idcon").cast("string"), F.lit("")), F.col("_name")), title, text, (), F.concat(urls, files), o)


def heritage(spark: SparkSession, o: LoaderOptions) -> DataFrame:
    df = _numbered(read_csv(spark, f"{o.data_dir}/patrimonio/patrimonio.csv"))
    return _record(df, "patrimonio", F.col("_idx"), _has(df, "titulo"), F.concat_ws("\n", _blank(_has(df, "titulo")), _blank(_has(df, "descripcion"))), ("titulo", "descripcion"), None, o)


for _name, _loader in (("academia_consultations", consultations), ("academia_dictionary", dictionary), ("canariwiki", wiki), ("corpecan", corpus), ("gevic", encyclopedia), ("patrimonio", heritage)):
    register_loader(_name, _loader)


def by_source(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.col("source") == source)
