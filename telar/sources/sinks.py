"""Sinks: records, pairs, chat examples, chunks and run settings as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions.text import over_strings, safe_name
from telar.operators.retrieval import Index, build_index

_EXPLICIT = {"ignoreNullFields": "false"}


def _compact(value: object) -> object:
    if isinstance(value, dict):
        return {k: _compact(v) for k, v in value.items() if k != "raw"}
    return [_compact(v) for v in value] if isinstance(value, list) else value


def compact_metadata(col):
    """JSON text without any key ``raw``, at any depth; what is no JSON stays as it is."""

    def one(text: str) -> str:
        try:
            return json.dumps(_compact(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return text

    return over_strings(one)(col)


def record_json(df: DataFrame) -> DataFrame:
    """One JSON line per record, nulls written."""
    slim = df.withColumn("metadata", compact_metadata(F.col("metadata").cast("string")))
    return slim.select("source", F.to_json(F.struct("id", "source", "title", "text", F.try_parse_json("metadata").alias("metadata"), "attachments"), _EXPLICIT).alias("value"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``all`` with every record, and a folder per source."""
    lines = record_json(df)
    lines.select("value").write.mode(mode).text(f"{path}/all")
    lines.withColumn("source", over_strings(safe_name)(F.col("source"))).write.mode(mode).partitionBy("source").text(f"{path}/by_source")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lists and structures as JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').csv(path)


def write_index(chunks: DataFrame, path: str, mode: str = "overwrite") -> Index:
    """Chunks and their full-text index, which ``retrieval.open_index`` reads for searches."""
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    return build_index(chunks.sparkSession.read.parquet(f"{path}/chunks"), path, mode=mode)


def augmented_rows(df: DataFrame) -> DataFrame:
    """``id, messages, metadata`` of chat rows: their own metadata (JSON text, if there is any) with the split and the mark of augmentation."""
    own = F.from_json(F.col("metadata"), "map<string,variant>") if "metadata" in df.columns else F.lit(None).cast("map<string,variant>")
    own = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin("split", "rag_augmented"))
    marks = F.create_map(F.lit("split"), F.col("split").cast("variant"), F.lit("rag_augmented"), F.lit(True).cast("variant"))
    return df.select(F.col("example_id").alias("id"), "messages", F.map_concat(own, marks).alias("metadata"))


def write_augmented(df: DataFrame, path: str) -> None:
    """Chat rows with their metadata, split and the mark of augmentation."""
    write_jsonl(augmented_rows(df), path)


MAX_SPLITS = 1000


def run_settings(spark: SparkSession, settings: dict[str, object], counts: DataFrame) -> DataFrame:
    """One row: the settings as JSON and the number of rows of each split; an error if there are more than ``MAX_SPLITS`` splits."""
    rows = counts.limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    n = {r["split"]: r["n"] for r in rows}
    return spark.createDataFrame([(json.dumps({**settings, **{f"{k}_examples": v for k, v in sorted(n.items())}}, ensure_ascii=False, sort_keys=True),)], "settings string")


def new_only(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been written yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")
