"""The batch half of the sites' jobs: pages already fetched become records, and what is skipped is listed with the reason."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.sources import pages


def now_iso() -> str:
    """The time now in UTC, to the second, as the manifests write it."""
    return datetime.now(UTC).replace(microsecond=0).isoformat()


def distinct_json(values: Column) -> Column:
    """The values of an array of structures, each once, in order: equal ones are those of equal JSON."""
    marks = F.transform(values, lambda v: F.to_json(v))
    return F.transform(F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: F.array_position(marks, F.to_json(x["v"])) == x["i"] + 1), lambda x: x["v"])


def encyclopedia(index: DataFrame, fetched: DataFrame) -> DataFrame:
    """``url, title, text, image_urls, reason`` of an index (``url, title``) and pages (``url, page``): articles have no reason.

    Without a page the reason is ``no_page``, without text ``empty_text``; a title that the page lacks is the index's.  Null addresses are dropped, an
    address of the index counts once.
    """
    rows = index.where("url is not null").dropDuplicates(["url"]).join(fetched.select("url", "page").dropDuplicates(["url"]), "url", "left")
    rows = rows.withColumn("a", F.get(pages.encyclopedia_article(F.col("page"), F.col("url")), F.lit(0)))
    text = F.coalesce(F.col("a.text"), F.lit(""))
    reason = F.when(F.col("page").isNull(), "no_page").when(text == "", "empty_text")
    return rows.select("url", F.coalesce(F.nullif("a.title", F.lit("")), F.col("title")).alias("title"), text.alias("text"), F.col("a.image_urls").alias("image_urls"), reason.alias("reason"))


def consultations(listed: DataFrame, fetched: DataFrame) -> DataFrame:
    """``url, listing_page, question, answer, categories, reason`` of listing items (``listing_page, url, question, categories``) and pages (``url, page``).

    An address counts on its first listing page alone; question and categories that a page lacks are the listing's.
    """
    first = listed.where("url is not null").groupBy("url").agg(F.min_by(F.struct("listing_page", "question", "categories"), "listing_page").alias("l"))
    rows = first.join(fetched.select("url", "page").dropDuplicates(["url"]), "url", "left").withColumn("c", F.get(pages.consultation_page(F.col("page"), F.col("url")), F.lit(0)))
    question = F.coalesce(F.nullif("c.question", F.lit("")), F.col("l.question"))
    categories = F.when(F.size("c.categories") > 0, F.col("c.categories")).otherwise(F.col("l.categories"))
    reason = F.when(F.col("page").isNull(), "no_page")
    return rows.select("url", "l.listing_page", question.alias("question"), F.coalesce("c.answer", F.lit("")).alias("answer"), categories.alias("categories"), reason.alias("reason"))


def recordings(items: DataFrame, fetched: DataFrame, media: DataFrame, terms: DataFrame) -> DataFrame:
    """Records of the corpus from its interface: ``items`` (``id, title, slug, url, content, islands`` of ids), pages (``url, page``), media (``id, mime_type, source_url``) and terms (``id, name``).

    The visible metadata come from the page, sound files alone are kept, island ids become names, the transcript is the content with a line per block;
    an item without a page is skipped with the reason.
    """
    sounds = media.groupBy("id").agg(F.collect_list(F.struct("mime_type", "source_url")).alias("m")).select("id", pages.audio_files(F.col("m")).alias("audio"))  # the files of one recording
    rows = items.join(fetched.select("url", "page").dropDuplicates(["url"]), "url", "left").join(sounds, "id", "left")
    rows = pages.with_terms(rows, "islands", terms, "island_names")
    visible = pages.ficha_metadata(pages.dynamic_values(F.col("page")))
    code = F.coalesce(F.nullif(pages.rendered(F.col("title")), F.lit("")), F.nullif("slug", F.lit("")), F.col("id").cast("string"))
    return rows.select("id", code.alias("code"), "slug", "url", "island_names", visible.alias("visible_metadata"), F.coalesce(F.col("audio"), F.array().cast("array<struct<mime_type:string,source_url:string>>")).alias("audio"),
                       pages.html_lines(F.col("content")).alias("transcript"), F.when(F.col("page").isNull(), "no_page").alias("reason"))


def manifest(before: dict[str, object], job: str, results: DataFrame) -> dict[str, object]:
    """The manifest of a site with one job's numbers of this run merged in: seen, saved and skipped by reason."""
    counts = {r.reason: r.n for r in results.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per reason
    saved = counts.pop(None, 0)
    return {**before, f"{job}_finished_at": now_iso(), f"{job}_seen": saved + sum(counts.values()), f"{job}_saved": saved, f"{job}_skipped": dict(sorted(counts.items()))}
