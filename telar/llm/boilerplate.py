"""Lines repeated across one source's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.functions import rx
from telar.llm.graph import connected_components
from telar.plans.lineage import Scratch
from telar.plans.skew import join_counted

MIN_IDS = 6


def line_key(line: Column) -> Column:
    """What two lines must have in common to count as the same."""
    return rx.squeeze(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"))


def _records(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))


def _lines(records: DataFrame) -> DataFrame:
    """One row per line that counts: ``line_no`` is its number, ``k`` its place among the lines that count, h1 and h2 identify source and line."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), line_key(x).alias("line")))
    counted = F.filter(numbered, lambda s: s["line"] != "")
    return (
        records.where("id is not null and source is not null and text != ''")
        .select("id", "source", F.posexplode(counted).alias("k", "s"))
        .select("id", "source", "k", "s.line_no", F.xxhash64("source", "s.line").alias("h1"), F.xxhash64(F.lit(11), "source", "s.line").alias("h2"))
    )


class Boilerplate:
    """The lines of ``df`` that stand in at least ``min_ids`` records of one source.

    The nodes of the graph are the lines of a source, weighted by the number of different ids they stand in; the edges join lines
    that follow each other, weighted likewise.  Nodes and edges of at least ``min_ids`` are kept, and the connected components of what
    is left are the blocks of boilerplate; a line without such a neighbour is a block of its own.  All occurrences of all blocks are
    to be removed.

    For the result every frequent line goes, so the blocks only say which lines belong together; with ``blocks_only`` a line goes only where it
    stands next to another line of its block, as a line that is frequent by itself may be a phrase of the texts.

    Rows without id or source are left as they are, null and empty texts have no lines, a repeated row counts once, and other columns
    are ignored.  Texts are read once: what identifies their lines is written.  A line that stands in a third of all records is counted by
    partial aggregates and joined by ``join_counted``.
    """

    def __init__(self, df: DataFrame, key: str = "id", source: str = "source", text: str = "text", min_ids: int = MIN_IDS, blocks_only: bool = False):
        self.records, self.min_ids = _records(df, key, source, text), min_ids
        self.scratch = Scratch(df.sparkSession, "boilerplate")
        lines = self.scratch.cut(_lines(self.records), "lines")
        support = lines.select("h1", "h2", "source", "id").distinct().groupBy("h1", "h2", "source").agg(F.count(F.lit(1)).alias("n"))
        self.nodes = self.scratch.cut(support.where(F.col("n") >= min_ids), "nodes")
        total = self.nodes.agg(F.sum("n")).first()[0] or 0
        kept = join_counted(lines.drop("source"), self.nodes, ["h1", "h2"], "n", total).select("id", "source", "line_no", "k", "h1", "n").distinct()
        following = Window.partitionBy("id").orderBy("k", "line_no")  # the frequent lines of one text
        kept = kept.withColumn("next", F.lead(F.struct("h1", "k")).over(following)).withColumn("last", F.lag(F.struct("h1", "k")).over(following))
        beside = lambda c, step: F.when(F.col(f"{c}.k") == F.col("k") + step, F.col(f"{c}.h1"))
        kept = self.scratch.cut(kept.select("id", "source", "line_no", "h1", "n", beside("next", 1).alias("after"), beside("last", -1).alias("before")), "kept")
        edges = kept.select(F.col("h1").alias("a"), F.col("after").alias("b"), "id").where("a != b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        self.edges = self.scratch.cut(edges.where(F.col("n") >= min_ids), "links")
        parts = connected_components(self.edges, self.scratch).withColumnRenamed("node", "h1").withColumnRenamed("component", "block")
        self.blocks = self.scratch.cut(self.nodes.join(parts, "h1", "left").withColumn("block", F.coalesce("block", "h1")), "blocks")
        self._kept, self._total, self._blocks_only = kept, total, blocks_only

    def occurrences(self) -> DataFrame:
        """``id, source, line_no, block``: one row per line to be removed."""
        out = join_counted(self._kept.drop("source", "n"), self.blocks.drop("h2"), ["h1"], "n", self._total)
        if self._blocks_only:
            self_block = self.blocks.select(F.col("h1").alias("other"), F.col("block").alias("other_block"), F.col("n"))
            near = out.select("id", "line_no", "block", F.explode(F.array("before", "after")).alias("other"))
            near = join_counted(near, self_block, ["other"], "n", self._total).where("block = other_block").select("id", "line_no").distinct()
            out = out.join(near, ["id", "line_no"], "left_semi")
        return out.select("id", "source", "line_no", "block")

    def listing(self) -> DataFrame:
        """``source, block, line, n_ids``: the removed lines of each source, as one record writes them."""
        first = self._kept.groupBy("h1").agg(F.min(F.struct("id", "line_no")).alias("at")).select("h1", "at.id", "at.line_no")
        texts = self.records.where("id is not null").join(first, "id").select("h1", rx.squeeze(F.element_at(F.split("text", "\n", -1), F.col("line_no").cast("int"))).alias("line"))
        one = texts.groupBy("h1").agg(F.min("line").alias("line"))
        return self.blocks.join(one, "h1").select("source", F.hex("block").alias("block"), "line", F.col("n").alias("n_ids"))

    def cleaned(self) -> DataFrame:
        """``id, source, text, n_removed``: the records without those lines, one row per id and source; rows without id as they are."""
        gone = self.occurrences().groupBy("id").agg(F.collect_set("line_no").alias("gone"))  # as many as one text has lines
        rows = self.records.where("id is not null").dropDuplicates(["id", "source"]).unionByName(self.records.where("id is null")).join(gone, "id", "left")
        left = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).cast("bigint").alias("no"), x.alias("line"))), lambda s: ~F.array_contains("gone", s["no"]))
        return rows.select("id", "source", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda s: s["line"]), "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
