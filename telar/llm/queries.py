"""The queries of the training-data problems over the tables of a folder, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from telar.llm.boilerplate import Boilerplate
from telar.llm.contamination import SPAN, find_leaks
from telar.llm.mixing import Mixture
from telar.llm.mojibake import find_garbled
from telar.llm.near_duplicates import NearDuplicates
from telar.llm.pii import find_pii, mask_pii
from telar.llm.qa_defects import QaDefects
from telar.llm.split_text import split_oversized
from telar.llm.splits import FIELDS, LARGE_FIRST, UNKNOWN, LinkedSplits
from telar.llm.transcripts import speaker_turns

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return Boilerplate(_table(spark, folder, "text_records")).occurrences().select("id", "line_no")


def p1_lines(spark: SparkSession, folder: str) -> DataFrame:
    return Boilerplate(_table(spark, folder, "text_records")).listing()


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return Boilerplate(_table(spark, folder, "text_records")).cleaned()


def _linked(spark: SparkSession, folder: str) -> LinkedSplits:
    return LinkedSplits(_table(spark, folder, "message_examples"), "example_id", {k: F.col(f"metadata.{k}") for k in FIELDS})


MAX_ROWS = 1000  # of a table of settings


def _settings(spark: SparkSession, folder: str, name: str, key: str) -> dict[str, Row]:
    """The rows of a small table by key; an error if it has too many, or two that differ under one key."""
    rows = _table(spark, folder, name).where(f"{key} is not null").distinct().limit(MAX_ROWS + 1).collect()
    out = {r[key]: r for r in rows}
    if len(rows) > MAX_ROWS or len(out) < len(rows):
        raise ValueError(f"{name} has more than {MAX_ROWS} rows or several of one {key}")
    return out


def _targets(spark: SparkSession, folder: str) -> dict[str, float]:
    return {k: r.share for k, r in _settings(spark, folder, "split_targets", "split").items() if r.share is not None}


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    """As near to the targets as the groups allow: the largest groups are placed first."""
    return _linked(spark, folder).assign(_targets(spark, folder), large_first=LARGE_FIRST)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _linked(spark, folder).groups()


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(spark, folder)


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached, with the largest groups placed first (``actual``) and by ranges of the hash alone (``by_hash``)."""
    linked, targets = _linked(spark, folder), _targets(spark, folder)
    out = _table(spark, folder, "split_targets").select("split", "share").where("split is not null and share is not null").distinct()
    for name, first in (("actual", LARGE_FIRST), ("by_hash", 0)):
        counts = linked.assign(targets, large_first=first).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("n_all"))  # one row
        n = F.coalesce("n", F.lit(0))
        out = out.join(F.broadcast(counts), "split", "left").join(F.broadcast(total)).withColumn(name, F.round(n / F.col("n_all"), 6)).withColumn(f"n_{name}", n).drop("n", "n_all")
    return out.select("split", "share", F.col("n_actual").alias("n_examples"), "actual", "by_hash")


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    records = _table(spark, folder, "text_records").select(F.lit("text_records").alias("tbl"), "id", "text")
    chunks = _table(spark, folder, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), "text")
    return NearDuplicates(records.unionByName(chunks))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).pairs()


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).groups()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return QaDefects(_table(spark, folder, "corpecan_qa")).found()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return QaDefects(_table(spark, folder, "corpecan_qa")).report()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    limits = _settings(spark, folder, "size_limits", "tbl")
    parts = [
        split_oversized(_table(spark, folder, t), key, "text", limits[t].max_chars, limits[t].overlap_chars).withColumn("tbl", F.lit(t))
        for t, key in (("chunks", "chunk_id"), ("text_records", "id")) if t in limits
    ]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("tbl", "id", "piece_no", "start_pos", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).where("piece_no = 1").select("tbl", "id")


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(_table(spark, folder, "text_records"), "id", ["text", "title"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_repaired(spark, folder).select("id", "field_name").distinct()


def p7_turns(spark: SparkSession, folder: str) -> DataFrame:
    return speaker_turns(_table(spark, folder, "corpecan_fichas"), _table(spark, folder, "corpecan_turns"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_turns(spark, folder).select("code", "turn_no", "speaker")


def p8_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_overlaps(spark, folder).where(F.col("longest_run") >= SPAN).select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return Mixture(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets")).rows()


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return Mixture(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets")).shares()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "name_lexicon"))
    return found.where(F.col("pii_type").isin("email", "phone", "id_number", "address", "name")).select("doc_id", "pii_type", "start_pos")


def p10_masked(spark: SparkSession, folder: str) -> DataFrame:
    return mask_pii(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "name_lexicon"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_lines, p1_clean, p2_found, p2_splits, p2_shares, p3_found, p3_groups, p4_found, p4_report, p5_found, p5_pieces, p6_found, p6_repaired,
        p7_found, p7_turns, p8_found, p8_overlaps, p9_mix, p9_shares, p10_found, p10_masked,
    )
}

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PAIRS = """
    select tbl, id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as p
    from (select tbl, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w
          from (select 'text_records' as tbl, id, text from text_records union select 'chunks', chunk_id, text from chunks))"""

SQL: dict[str, str] = {
    "p1_found": f"""
        with lines as (
            select distinct source, id, i as line_no, trim(regexp_replace(regexp_replace(lower(l[i]), '\\p{{Nd}}+', '0', 'g'), '{_WS}+', ' ', 'g')) as line
            from (select source, id, string_split(text, chr(10)) as l from text_records), range(1, len(l) + 1) as r(i)),
        often as (select source, line from lines where line <> '' group by all having count(distinct id) >= 6)
        select id, line_no from lines join often using (source, line)""",
    "p5_found": """
        select distinct tbl, id from (
            select 'chunks' as tbl, chunk_id as id, text from chunks union all select 'text_records', id, text from text_records) join size_limits using (tbl)
        where length(text) > max_chars""",
    "p3_found": f"""
        with sets as ({_PAIRS}),
        one as (select tbl, id, len(p) as n, unnest(p) as g from sets),
        shared as (select a.tbl, a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as k
                   from one a join one b on a.tbl = b.tbl and a.g = b.g and a.id < b.id and least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) group by all)
        select tbl, id_a, id_b from shared where k >= 0.7 * (na + nb - k)""",
    "p8_found": """
        with t as (select 'd' as side, doc_id as k, text from documents union all select 'i', item_id, text from eval_items),
        w as (select side, k, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') as w from t),
        g as (select distinct side, k, array_to_string(w[i : i + 11], ' ') as g from w, range(1, len(w) - 10) as r(i))
        select distinct a.k as doc_id, b.k as item_id from g a join g b using (g) where a.side = 'd' and b.side = 'i'""",
}

_KNOWN_UNKNOWN = ", ".join(f"'{w}'" for w in UNKNOWN)
_LINK = f"regexp_replace(strip_accents(lower(x)), '(?:{_WS}|[\\p{{Z}}\\p{{Cf}}])+', '', 'g')"
SQL["p2_found"] = f"""
        with recursive given as (
            select example_id as id, kind, {_LINK} as v from (select example_id, unnest(['code', 'author', 'entity']) as kind, unnest([metadata.code, metadata.author, metadata.entity]) as x from message_examples)),
        known as (select distinct id, kind, v from given where regexp_replace(v, '[^\\p{{L}}\\p{{N}}]+', '', 'g') not in ('', {_KNOWN_UNKNOWN})),
        edge as (select distinct a.id as a, b.id as b from known a join known b using (kind, v) where a.id <> b.id),
        walk(id, root) as (select a, a from edge union select w.id, e.b from walk w join edge e on e.a = w.root)
        select id as example_id, min(root) as group_id from walk group by id"""
