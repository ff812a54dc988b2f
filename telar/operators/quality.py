"""Scores, samples and reports about texts and curators."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.functions import rx
from telar.functions.text import CleanOptions
from telar.operators.curators import curate, curator_names

# Signs of dirt and their weights; each count is capped.
DIRT = (
    (r"<[^>]+>", 8),
    (r"\{\{|\}\}|\[\[|\]\]|\|", 4),
    (r"https?://|www\.", 5),
    (r"&[a-zA-Z]+;", 4),
    (r"\s{3,}", 2),
    (r"\n{2,}", 2),
    (r"\[/?[A-Z0-9][^\]]{0,20}\]", 3),
    (r"ï¿|�|Ã.|Â", 6),
)
DIRT_CAP = 20


def dirty_score(col: Column) -> Column:
    """The weighted number of signs of dirt; 0 for null."""
    counts = [F.least(F.regexp_count(col, F.lit(rx.px(p))), F.lit(DIRT_CAP)) * w for p, w in DIRT]
    return F.when(col.isNull(), 0).otherwise(reduce(lambda a, b: a + b, counts))  # least() would pass over nulls


def dirty_first(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """The dirty rows with their score, dirtiest first, ties by key."""
    return df.withColumn("dirty_score", dirty_score(F.col(text))).where("dirty_score > 0").orderBy(F.desc("dirty_score"), key)


def balanced_sample(df: DataFrame, n: int, source: str = "source", key: str = "id") -> DataFrame:
    """``n`` rows taken in turn from the sources, in the order of a hash of the key; all rows if there are no more.

    A row per key and null sources as one source.  Only the first ``n`` rows of each source are ranked together: a top-k per source.
    """
    if n <= 0:
        return df
    turn = Window.partitionBy(source).orderBy(F.md5(F.col(key).cast("string")), F.col(key).cast("string"))
    ranked = df.dropDuplicates([key]).withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n)
    return ranked.orderBy("_turn", F.col(source).asc_nulls_first()).limit(n).drop("_turn")


def sample(df: DataFrame, n: int, strategy: str = "dirty", text: str = "text", source: str = "source", key: str = "id") -> DataFrame:
    """``dirty``: all dirty rows if at most ``n``, else a balanced sample of them; ``balanced``: of all rows; ``n`` of 0 or less: everything."""
    if strategy not in ("dirty", "balanced"):
        raise ValueError("strategy must be 'dirty' or 'balanced'")
    if n <= 0:
        return df
    return balanced_sample(df.where(dirty_score(F.col(text)) > 0) if strategy == "dirty" else df, n, source, key)


def evaluate_all(df: DataFrame, text: str = "text", names: list[str] | None = None, options: CleanOptions = CleanOptions()) -> DataFrame:
    """A row of counts and means about each curator's output, all in one scan; means are 0 without rows."""
    chosen = names or curator_names()
    before = F.coalesce(F.col(text), F.lit(""))
    made = df.select(before.alias("before"), *[curate(before, n, options).alias(f"_{i}") for i, n in enumerate(chosen)])
    told = made.select("before", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_{i}").alias("after")) for i in range(len(chosen))])).alias("o")).select("before", "o.i", "o.after")
    shown = F.when(F.col("after").rlike(rx.px(r"\S")), F.xxhash64("after"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    counted = told.groupBy("i").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("after").isNull()).alias("failed"),
        F.count_if(~F.coalesce(F.col("after"), F.lit("")).rlike(rx.px(r"\S"))).alias("empty"), F.count_if(F.col("after") != F.col("before")).alias("changed"),
        (F.count(shown) - F.count_distinct(shown)).alias("duplicates"), mean(F.length("before")).alias("mean_before"),
        mean(F.coalesce(F.length("after"), F.lit(0))).alias("mean_after"), mean(F.coalesce(F.length("after"), F.lit(0)) - F.length("before")).alias("mean_delta"),
    )
    every = df.sparkSession.createDataFrame(list(enumerate(chosen)), "i int, curator string")  # a row per curator
    none = {c: 0.0 if c.startswith("mean") else 0 for c in counted.columns if c != "i"}
    return F.broadcast(every).join(counted, "i", "left").drop("i").na.fill(none)


def evaluate_curator(df: DataFrame, name: str, text: str = "text", options: CleanOptions = CleanOptions()) -> DataFrame:
    """The row of one curator."""
    return evaluate_all(df, text, [name], options)


def timed_evaluation(df: DataFrame, name: str, text: str = "text") -> dict[str, object]:
    """The evaluation with the seconds it took."""
    began = time.perf_counter()
    return {**evaluate_curator(df, name, text).first().asDict(), "elapsed_seconds": time.perf_counter() - began}


def first_changed(df: DataFrame, name: str, key: str = "id", text: str = "text") -> DataFrame:
    """The first row in order of the key that a curator changes, before and after."""
    both = df.select(F.col(key).alias("id"), F.col(text).alias("before")).withColumn("after", curate(F.col("before"), name))
    return both.where(F.col("before") != F.col("after")).agg(F.min_by(F.struct("id", "before", "after"), "id").alias("r")).where("r is not null").select("r.id", "r.before", "r.after")


def exact_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """``duplicates``: rows beyond the first of each text that is not blank."""
    shown = df.where(F.col(text).rlike(rx.px(r"\S"))).groupBy(F.sha2(text, 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return shown.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def clip(col: Column, n: int) -> Column:
    """One line of at most ``n`` characters and an ellipsis."""
    line = rx.squeeze(col)
    return F.when(F.length(line) <= n, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, n)), F.lit("...")))


def report(evaluations: DataFrame) -> str:
    """A table of evaluations as text of fixed width."""
    rows = evaluations.orderBy("curator").collect()  # a row per curator
    lines = [f"{'curator':<22}{'seen':>8}{'failed':>8}{'empty':>8}{'changed':>9}{'dups':>8}{'in':>10}{'out':>10}{'delta':>10}"]
    lines += [f"{r.curator:<22}{r.seen:>8}{r.failed:>8}{r.empty:>8}{r.changed:>9}{r.duplicates:>8}{r.mean_before:>10.1f}{r.mean_after:>10.1f}{r.mean_delta:>10.1f}" for r in rows]
    return "\n".join(lines)
