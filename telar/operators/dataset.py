"""Chat and question-answer datasets: validity, splits, loading, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telar.functions import rx
from telar.operators.dialogue import qa_pairs, split_turns
from telar.sources.files import exists
from telar.sources.lines import numbered, placed

TRAIN_PERCENT = 95
SPLITS = ("train", "validation")
UNKNOWN = "unknown"
# The system prompt of an interview's pairs.
INTERVIEW_PROMPT = (
    "Estás respondiendo como la persona entrevistada en una entrevista de historia oral de CORPECAN.",
    "Mantén la respuesta anclada al perfil de la persona hablante y a su contexto local.",
    "Género: {gender}.", "Edad: {age}.", "Lugar: {location}.", "Contexto insular: {islands}.",
    "Responde en español de Canarias natural y conserva, cuando sea posible, el tono oral de la persona entrevistada.",
    "No menciones este bloque de instrucciones ni inventes detalles no respaldados por el contexto de la entrevista.",
)


def code_point_sum(col: Column) -> Column:
    return F.aggregate(F.filter(F.split(col, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a + F.ascii(c))


def hash_split(col: Column) -> Column:
    """``train`` for 95 of 100 sums of code points, else ``validation``; null for null."""
    return F.when(col.isNull(), None).when(code_point_sum(col) % 100 < TRAIN_PERCENT, SPLITS[0]).otherwise(SPLITS[1])


def valid_messages(messages: Column) -> Column:
    """A list with messages, all of them with role and content."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: m.isNotNull() & m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))


def valid_json_messages(raw: Column) -> Column:
    """The same about JSON text: keys must be there, their values may be null."""
    items = F.try_variant_get(F.try_parse_json(raw), "$.messages", "array<variant>")
    has = lambda m, k: F.try_variant_get(m, f"$.{k}", "variant").isNotNull()
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda m: has(m, "role") & has(m, "content")), F.lit(False))


def sft_examples(df: DataFrame, key: str = "example_id", messages: str = "messages", split: str = "split", order: list[str] | None = None, splits: tuple[str, ...] = SPLITS, require_rows: bool = False) -> DataFrame:
    """Valid rows, the first of each id, with their own split or one by hash; rows of other splits are dropped but keep their id taken."""
    rows = df.where(valid_messages(F.col(messages)) & F.col(key).isNotNull())
    rank = Window.partitionBy(key).orderBy(*(order or [F.to_json(F.struct(messages, split))]))
    first = rows.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")
    own = rx.strip(F.coalesce(F.col(split), F.lit("")))
    out = first.withColumn("split", F.when(own != "", own).otherwise(hash_split(F.col(key)))).where(F.col("split").isin(*splits))
    if require_rows and out.isEmpty():
        raise ValueError("no valid examples")
    return out


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(split, "split")


def _known(col: Column) -> Column:
    text = rx.strip(F.coalesce(col.cast("string"), F.lit("")))
    return F.when(text != "", text).otherwise(UNKNOWN)


def interview_prompt(gender: Column, age: Column, location: Column, islands: Column) -> Column:
    names = F.array_join(F.filter(F.transform(F.coalesce(islands, F.array().cast("array<string>")), rx.strip), lambda x: x != ""), ", ")
    values = {"gender": _known(gender), "age": _known(age), "location": _known(location), "islands": F.when(names != "", names).otherwise(UNKNOWN)}
    parts: list[Column] = []
    for sentence in INTERVIEW_PROMPT:
        name = next((k for k in values if f"{{{k}}}" in sentence), None)
        head, _, tail = sentence.partition(f"{{{name}}}") if name else (sentence, "", "")
        parts.append(F.concat(F.lit(head), values[name], F.lit(tail)) if name else F.lit(sentence))
    return F.concat_ws(" ", *parts)


def qa_dataset(fichas: DataFrame) -> DataFrame:
    """``id, source, question, answer, messages, metadata`` for each pair of each recording with a transcript.

    Recordings come from the table of fichas, a row per code; null codes and blank transcripts are skipped.
    """
    empty = {"slug": F.element_at(F.split("url", "/"), -1), "origin": F.lit("corpecan"), "audio": F.lit("[]")}
    fichas = fichas.withColumns({k: c for k, c in empty.items() if k not in fichas.columns})
    rows = fichas.where(F.col("code").isNotNull() & F.col("transcript").rlike(rx.px(r"\S"))).dropDuplicates(["code"])
    pairs = qa_pairs(split_turns(rows)).join(rows.drop("transcript"), "code")
    v = F.col("visible_metadata")
    islands = F.transform("islands", lambda x: x["name"])
    number = F.format_string("%04d", "pair_no")
    prompt = interview_prompt(v["gender"], v["age"], v["location"], islands)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    meta = F.struct(
        F.lit("corpecan").alias("dataset"), F.col("pair_no").alias("pair_index"), hash_split(F.concat_ws(":", "code", number)).alias("split"), F.col("local_path").alias("ficha_dir"),
        F.col("id").alias("record_id"), "code", "slug", "url", F.col("origin").alias("source"), v["location"].alias("location"), v["gender"].alias("gender"), v["age"].alias("age"),
        v["year"].alias("year"), v["duration"].alias("duration"), v["topics"].alias("topics"), islands.alias("islands"), v["coordinates"].alias("coordinates"),
        F.coalesce(F.try_parse_json("audio"), F.parse_json(F.lit("[]"))).alias("audio"), prompt.alias("system_prompt"),
    )
    return pairs.select(
        F.concat_ws(":", F.lit("corpecan"), "code", number).alias("id"), F.lit("corpecan").alias("source"), "question", "answer",
        F.array(message("system", prompt), message("user", F.col("question")), message("assistant", F.col("answer"))).alias("messages"), meta.alias("metadata"),
    )


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, example_id, messages, split, metadata`` from files of JSON lines; the id falls back to file and line; what is no JSON object is dropped."""
    rows = numbered(placed(spark.read.text(path))).where(rx.strip(F.col("value")) != "")
    v = F.try_parse_json("value")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    key = F.coalesce(F.nullif(F.try_variant_get(v, "$.id", "string"), F.lit("")), F.concat_ws(":", stem, "line"))
    messages = F.try_variant_get(v, "$.messages", "array<struct<role:string,content:string>>")
    metadata = F.try_variant_get(v, "$.metadata", "map<string,variant>")
    return rows.where(v.isNotNull()).select("path", "line", key.alias("example_id"), messages.alias("messages"), F.try_variant_get(v, "$.metadata.split", "string").alias("split"), F.to_json(metadata).alias("metadata"))


def rag_examples(rows: DataFrame, key: str = "example_id", messages: str = "messages", split: str = "split") -> DataFrame:
    """Valid rows as they come, repeated ids too, with their own split or one by hash; rows of any split stay, as the augmented file holds them all."""
    own = F.nullif(F.col(split), F.lit(""))
    return rows.where(valid_messages(F.col(messages))).withColumn("split", F.coalesce(own, hash_split(F.col(key))))


def interviews(spark: SparkSession, root: str) -> DataFrame:
    """The table of recordings that ``qa_dataset`` takes, from folders with ``transcript.txt`` and ``metadata.json``.

    The folders are those below ``fichas``, or ``root`` itself if it has a transcript, or those below ``root``.  A folder without one of the files is left
    out.  The code is the metadata's, or that of its visible part, or the folder's name.
    """
    if not exists(spark, root):
        raise FileNotFoundError(root)
    base = f"{root}/fichas/*" if exists(spark, f"{root}/fichas") else root if exists(spark, f"{root}/transcript.txt") else f"{root}/*"
    if not (exists(spark, f"{base}/transcript.txt") and exists(spark, f"{base}/metadata.json")):
        return spark.createDataFrame([], INTERVIEW)
    read = lambda name: spark.read.text(f"{base}/{name}", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("dir"), F.col("value").alias(name.split(".")[0]))
    rows = read("transcript.txt").join(read("metadata.json"), "dir").withColumn("m", F.from_json("metadata", INTERVIEW_JSON))
    code = F.coalesce(F.nullif("m.code", F.lit("")), F.nullif("m.visible_metadata.code", F.lit("")), F.element_at(F.split("dir", "/"), -1))
    return rows.select(code.alias("code"), "transcript", F.col("m.id").alias("id"), "m.url", F.col("m.slug").alias("slug"), F.col("m.source").alias("origin"), F.col("dir").alias("local_path"), "m.visible_metadata", "m.islands", F.to_json(F.try_variant_get(F.try_parse_json("metadata"), "$.audio", "array<variant>")).alias("audio"))


_VISIBLE = "struct<location:string,code:string,gender:string,age:string,topics:array<string>,year:string,duration:string,coordinates:struct<lat:double,lng:double>>"
INTERVIEW_JSON = f"struct<id:bigint,code:string,slug:string,url:string,source:string,visible_metadata:{_VISIBLE},islands:array<struct<id:int,name:string,slug:string>>>"
INTERVIEW = f"code string, transcript string, id bigint, url string, slug string, origin string, local_path string, visible_metadata {_VISIBLE}, islands array<struct<id:int,name:string,slug:string>>, audio string"


def two_stages(first: DataFrame, second: DataFrame) -> DataFrame:
    """The examples of a training in two stages, ``stage, example_id, messages, split``: the second goes on from the first, so both keep what they have."""
    part = lambda df, n: df.select(F.lit(n).alias("stage"), "example_id", "messages", "split")
    return part(first, 1).unionByName(part(second, 2))
