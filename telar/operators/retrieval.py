"""Chunks, full-text ranking and contexts for retrieval."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telar.functions import rx
from telar.plans.lineage import Scratch
from telar.plans.shared import Shared
from telar.plans.skew import fits

CHUNK_CHARS, CHUNK_OVERLAP, CONTEXT_CHARS, TOP_K, QUERY_WORDS = 1200, 200, 1800, 5, 8
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
NO_CONTEXT = "No context was retrieved."
NO_STYLE = "- No additional style examples."


def normalize(col: Column) -> Column:
    """White space as single spaces."""
    return rx.squeeze(col)


def chunk(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``key, chunk_no, chunk``: windows of ``size`` characters that overlap; one for a short text, none for a blank one; numbered without gaps."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the size")
    step = size - overlap
    told = df.select(F.col(key), normalize(F.col(text)).alias("_t")).where("_t != ''")
    last = F.greatest(F.lit(0), F.ceil((F.length("_t") - size) / step)).cast("int")
    windows = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(F.col("_t"), i * step + 1, F.lit(size)))), lambda x: x != "")
    return told.select(F.col(key), F.posexplode(windows).alias("_p", "chunk")).select(key, (F.col("_p") + 1).alias("chunk_no"), "chunk")


def chunk_id(source: Column, path: Column, doc_id: Column, number: Column) -> Column:
    """``source:file:document:number`` with twelve digits of the path's SHA-1."""
    return F.concat_ws(":", source, F.substring(F.sha1(path), 1, 12), doc_id.cast("string"), number.cast("string"))


def query_terms(col: Column) -> Column:
    """The first words of more than two letters of a query."""
    tokens = F.regexp_extract_all(normalize(col), F.lit("[0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"), F.lit(0))
    return F.slice(F.filter(tokens, lambda t: F.length(t) > 2), 1, QUERY_WORDS)


def fts_query(col: Column) -> Column:
    terms = query_terms(col)
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR ")).otherwise("canarias")


def _tokens(columns: list[str]) -> Column:
    return rx.words(rx.fold(F.concat_ws(" ", *[F.col(c) for c in columns])))


@dataclass(frozen=True)
class Index:
    """A written full-text index: ``docs`` (key, dl, words as they come), ``terms`` (term, df), ``stats`` (n_docs, avg_len: one row)."""

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str



def _documents(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Each document's words as they come, and their number."""
    return df.where(F.col(key).isNotNull()).select(F.col(key), _tokens(list(columns)).alias("words")).select(key, F.size("words").alias("dl"), "words")


def postings(df: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("source", "title", "text")) -> DataFrame:
    """``term, key, tf, dl``: the inverted index over the given columns."""
    words = _documents(df, key, columns).select(key, "dl", F.explode("words").alias("term"))
    return words.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", key, "tf", "dl")


def corpus_stats(df: DataFrame, columns: tuple[str, ...] = ("source", "title", "text")) -> DataFrame:
    """``n_docs, avg_len``."""
    return df.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.size(_tokens(list(columns)))), 6).alias("avg_len"))


def build_index(df: DataFrame, path: str, key: str = "chunk_id", columns: tuple[str, ...] = ("source", "title", "text"), mode: str = "overwrite") -> Index:
    """Write the index of a table with unique keys; null keys are left out.  Words are made once; terms are sorted, so readers prune them."""
    _documents(df, key, columns).write.mode(mode).parquet(f"{path}/docs")
    docs = df.sparkSession.read.parquet(f"{path}/docs")
    terms = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms.sort("term").write.mode(mode).parquet(f"{path}/terms")
    docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len")).write.mode(mode).parquet(f"{path}/stats")
    return open_index(df.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    docs, terms, stats = (spark.read.parquet(f"{path}/{part}") for part in ("docs", "terms", "stats"))
    return Index(docs, terms, stats, docs.columns[0])


def bm25(docs: DataFrame | Index, queries: DataFrame, key: str = "chunk_id", query_key: str = "item_id", query: str = "text", columns: tuple[str, ...] = ("source", "title", "text"), k: int = TOP_K) -> DataFrame:
    """``query_key, rank, key, score``: the best documents of each query; the smaller the score the better, ties by key.

    ``docs`` is a written index, or a table whose index is then written first.  Repeated query words count twice; document frequency and lengths
    are over all documents.  The queries' words with their weights go to every task where they were counted to be at most ``BROADCAST_ROWS`` rows;
    beyond, they meet the documents' words in a shuffle join, in which Spark splits words that are in very many documents.  The scores of a
    document are summed where the document is, and each task keeps the best ``k`` of each query before they meet.
    Rows need unique keys; null keys are dropped; documents without a query word never come out.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "bm25")
    index = docs if isinstance(docs, Index) else build_index(docs, f"{scratch.root}/index", key, columns)
    said = query_terms(F.col(query))
    given = queries.select(F.col(query_key), F.explode(F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("canarias")))).alias("term"))
    weights = given.select(query_key, rx.fold(F.col("term")).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("times"))
    rated = weights.join(index.terms, "term").join(F.broadcast(index.stats)).withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    rated = rated.withColumn("idf", F.when(F.col("idf") <= 0, F.lit(IDF_FLOOR)).otherwise(F.col("idf"))).select("term", query_key, "times", "idf", "avg_len")
    rated = scratch.cut(rated, "rated")
    # by document first where all else goes to every task: counts and sums need no shuffle after that, and a document is less than its pairs with the queries
    small = fits(rated)
    words = (index.docs.repartition(index.key) if small else index.docs).select(index.key, "dl", F.explode("words").alias("term"))
    terms = rated.select("term").distinct()
    counted = words.join(F.broadcast(terms) if small else terms, "term").groupBy(index.key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    found = counted.join(F.broadcast(rated) if small else rated, "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    scores = found.groupBy(query_key, index.key).agg(F.round(-F.sum(part), 6).alias("score"))
    best = Window.partitionBy(query_key).orderBy("score", index.key)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_key, "rank", index.key, "score")


BLOCK_CHARS = 8_000_000  # of queries that go to every task at once


def _contained(docs: DataFrame, asked: list[tuple[int, str]], k: int) -> DataFrame:
    """``q, key``: of each task the first ``k`` keys of documents (``key, text``) that contain each query."""
    shared = Shared(docs.sparkSession, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        trie = ahocorasick.Automaton()
        for q, text in shared.value:
            trie.add_word(text, (*trie.get(text, ()), q))
        trie.make_automaton()
        best: dict[int, list] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for q in {q for _, qs in trie.iter(text) for q in qs}:
                    kept = best.setdefault(q, [])
                    if len(kept) < k or key < kept[-1]:
                        insort(kept, key)
                        del kept[k:]
            type_ = batch.schema.field(0).type
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([q for q, x in best.items() for _ in x], pa.int64()), pa.array([key for x in best.values() for key in x], type_)], names=["q", "key"])

    return docs.mapInArrow(run, f"q bigint, key {docs.schema['key'].dataType.simpleString()}")


def like_fallback(docs: DataFrame, queries: DataFrame, hits: DataFrame, key: str = "chunk_id", query_key: str = "item_id", query: str = "text", text: str = "text", k: int = TOP_K) -> DataFrame:
    """``query_key, rank, key``: for queries without a hit, the first documents that contain the whole query, regardless of case.

    The queries without a hit go to every task in blocks of at most ``BLOCK_CHARS`` characters, and each block is looked for in one pass over the
    documents, all its queries at once.  Null and empty queries, null keys and null texts give nothing; ties do not occur among unique keys.
    """
    scratch = Scratch(docs.sparkSession, "like")
    missed = queries.select(F.col(query_key), F.lower(F.col(query)).alias("_q")).where("_q != ''").join(hits.select(query_key).distinct(), query_key, "left_anti")
    missed = scratch.cut(missed.withColumn("_id", F.monotonically_increasing_id()), "missed")
    told = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).where("key is not null and text is not null")
    found, block, size = [], [], 0
    for r in missed.select("_id", "_q").toLocalIterator():  # the stated queries, a block at a time
        if block and size + len(r._q) > BLOCK_CHARS:
            found, block, size = [*found, scratch.cut(_contained(told, block, k), "found")], [], 0
        block.append((r._id, r._q))
        size += len(r._q)
    if block:
        found.append(_contained(told, block, k))
    every = reduce(lambda a, b: a.unionByName(b), found) if found else told.select(F.lit(0).cast("bigint").alias("q"), "key").limit(0)
    best = Window.partitionBy("q").orderBy("key")
    first = every.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return first.join(missed.select(F.col("_id").alias("q"), query_key), "q").select(query_key, "rank", F.col("key").alias(key))


def pack_context(ranked: DataFrame, query_key: str = "item_id", budget: int = CONTEXT_CHARS) -> DataFrame:
    """``query_key, n_blocks, context`` from ``query_key, rank, source, title, text``: numbered blocks until the first that would pass the budget."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] source="), F.coalesce("source", F.lit("")), F.lit(" title="), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    so_far = F.sum(F.length("block")).over(Window.partitionBy(query_key).orderBy("rank"))
    rows = ranked.withColumn("block", block).withColumn("used", so_far)
    fitting = F.array_sort(F.collect_list(F.when(F.col("used") <= budget, F.struct("rank", "block"))))  # at most top-k blocks
    packed = rows.groupBy(query_key).agg(fitting.alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n")
    return packed.select(query_key, F.size("blocks").alias("n_blocks"), F.when(F.size("blocks") > 0, text).otherwise(NO_CONTEXT).alias("context"))
