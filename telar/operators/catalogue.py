"""The queries for the engine's own operators over the tables of a folder, and the SQL that they equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions import rx
from telar.functions.text import CleanOptions, over_strings, safe_name
from telar.operators import curators, dataset, dedup, dialogue, language, quality, retrieval
from telar.plans.lineage import Scratch
from telar.sources import attachments, documents, files, pages, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _chosen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key of a table of files: chosen on key and order alone, then read by its place, so texts are neither sorted nor aggregated."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    first = rows.where(F.col(key).isNotNull()).select(key, F.struct(*order, at.alias("at")).alias("o")).groupBy(key).agg(F.min("o.at").alias("at") if not order else F.min("o").alias("o"))
    place = first.select(F.col("at" if not order else "o.at").alias("_at"))
    out = rows.withColumn("_at", at).join(place, "_at", "left_semi").drop("_at")
    parts, cores = rows._jdf.queryExecution().toRdd().getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    return out.repartition(cores, key) if parts < cores else out  # a small file is one part: what follows is worth more


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A row per chunk."""
    return _chosen(_table(spark, folder, "chunks"), "chunk_id")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record, the first delivery."""
    return _chosen(_table(spark, folder, "text_records"), "id", "loaded_at").drop("saved_at", "loaded_at")


_indexes: dict[tuple[str, str], retrieval.Index] = {}


def _index(spark: SparkSession, folder: str) -> retrieval.Index:
    """The full-text index of the chunks: written once for a session and the state of the table's files, then searched by every query."""
    at = (spark.sparkContext.applicationId, files.state(spark, f"{folder}/chunks.parquet"))
    if at not in _indexes:
        _indexes[at] = retrieval.build_index(_chunks(spark, folder), f"{Scratch(spark, 'index').root}/index")
    return _indexes[at]


def _messages(spark: SparkSession, folder: str, table: str = "message_examples", key: str = "example_id") -> DataFrame:
    """``id, pos, role, content``: a row per message of each example."""
    rows = _table(spark, folder, table).select(F.col(key).alias("id"), "messages").distinct()
    return rows.select("id", F.posexplode("messages").alias("pos", "m")).select("id", "pos", "m.role", "m.content")


_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LAST = "(select id, source, title, text, metadata, attachments from text_records qualify row_number() over (partition by id order by loaded_at) = 1)"
_ONE = "(select chunk_id, any_value(source) as source, any_value(title) as title, any_value(text) as text, any_value(path) as path from chunks group by chunk_id)"


def _sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _tidy(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, ' +([.,;:!?])', '\\1', 'g'), '([¿¡(]) +', '\\1', 'g'), ' +\\)', ')', 'g')"


_PLAIN = CleanOptions(normalize_unicode=False)


def _clean(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(key, text.alias("text"))


@query(f"select doc_id, {_tidy(_sq('regexp_replace(text, $$<[^>]+>$$, $$ $$, $$g$$)'))} as text from documents")
def clean_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(_table(spark, folder, "documents"), "doc_id", curators.curate(F.col("text"), "regex", _PLAIN))


@query()
def clean_regex(spark: SparkSession, folder: str) -> DataFrame:
    options = CleanOptions(remove_urls=True, remove_emails=True)
    return _clean(_records(spark, folder), "id", curators.curate(F.col("text"), "regex", options))


@query(f"select doc_id, lower({_tidy(_sq('replace(replace(regexp_replace(text, $$<[^>]+>$$, $$ $$, $$g$$), $$barranco$$, $$valle$$), $$el valle$$, $$la vega$$)'))}) as text from documents")
def clean_lowercase_replacements(spark: SparkSession, folder: str) -> DataFrame:
    options = CleanOptions(normalize_unicode=False, lowercase=True, replacements={"barranco": "valle", "el valle": "la vega"})
    return _clean(_table(spark, folder, "documents"), "doc_id", curators.curate(F.col("text"), "regex", options))


def _dirt_sql() -> str:
    parts = []
    for pattern, weight in quality.DIRT:
        p = pattern.replace("\\s", _WS).replace("'", "''")
        parts.append(f"least(len(regexp_extract_all(text, '{p}')), {quality.DIRT_CAP}) * {weight}")
    return " + ".join(parts)


@query(f"select id, coalesce({_dirt_sql()}, 0) as dirty_score from {_LAST}")
def dirty_score(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("id", quality.dirty_score(F.col("text")).alias("dirty_score"))


@query(f"select id, source, dirty_score from (select id, source, {_dirt_sql()} as dirty_score from {_LAST}) where dirty_score > 0 order by dirty_score desc, id limit 20")
def dirty_filter_topk(spark: SparkSession, folder: str) -> DataFrame:
    return quality.dirty_first(_records(spark, folder)).select("id", "source", "dirty_score").limit(20)


@query(f"""select id, source from (select id, source, row_number() over (partition by source order by md5(id), id) as turn from {_LAST}) order by turn, source limit 60""")
def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quality.balanced_sample(_table(spark, folder, "text_records").select("id", "source"), 60)


@query()
def curator_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return quality.evaluate_all(_records(spark, folder).select("text"))


@query()
def first_changed(spark: SparkSession, folder: str) -> DataFrame:
    return quality.first_changed(_records(spark, folder), "regex")


ROUTES = {"academia_dictionary": ("academia-dictionary",), "canariwiki": ("wikitext",), "gevic": ("gevic",)}


@query()
def source_routed_clean(spark: SparkSession, folder: str) -> DataFrame:
    return curators.clean_routed(_records(spark, folder).select("id", "source", "text"), ROUTES)


@query("select count(*) - count(distinct text) as duplicates from documents where regexp_matches(text, '[^\\s]')")
def exact_dup_count(spark: SparkSession, folder: str) -> DataFrame:
    return quality.exact_duplicates(_table(spark, folder, "documents"))


@query("select min(doc_id) as doc_id from documents where regexp_matches(text, '[^\\s]') group by text")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_dedup(_table(spark, folder, "documents"), "doc_id")


@query("select chunk_id, path from chunks qualify row_number() over (partition by chunk_id order by path) = 1")
def id_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.first_by(_table(spark, folder, "chunks").select("chunk_id", "path"), ["chunk_id"], "path")


@query()
def minhash_lsh_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.minhash_dedup(_clean(_table(spark, folder, "documents"), "doc_id", curators.curate(F.col("text"), "datasketch")), "doc_id")


@query()
def fuzzy_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.fuzzy_dedup(_clean(_records(spark, folder), "id", curators.curate(F.col("text"), "rapidfuzz")))


@query(f"""with t as (select doc_id, {_sq('text')} as t from documents),
    w as (select doc_id, i, trim(substr(t, i * 1000 + 1, 1200)) as chunk from t, range(0, 1 + greatest(0, ceil((length(t) - 1200) / 1000.0)::int)) as r(i) where t <> '')
    select doc_id, row_number() over (partition by doc_id order by i)::int as chunk_no, chunk from w where chunk <> ''""")
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.chunk(_table(spark, folder, "documents"))


@query(f"""with t as (select doc_id, source, path, {_sq('text')} as t from documents)
    select doc_id, concat_ws(':', source, substr(sha1(path), 1, 12), doc_id, i + 1) as chunk_id from t, range(0, 1 + greatest(0, ceil((length(t) - 1200) / 1000.0)::int)) as r(i) where t <> ''""")
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return documents.with_chunk_ids(retrieval.chunk(docs).join(docs.select("doc_id", "source", "path"), "doc_id")).select("doc_id", "chunk_id")


@query(f"""select item_id, coalesce(nullif(array_to_string(list_filter(regexp_extract_all({_sq('text')}, '[0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+'), lambda t: length(t) > 2)[1:8], ' OR '), ''), 'canarias') as query from eval_items""")
def fts_query_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "eval_items").select("item_id", retrieval.fts_query(F.col("text")).alias("query"))


_TOKENS = f"(select chunk_id, regexp_extract_all(strip_accents(lower(concat_ws(' ', source, title, text))), '[\\p{{L}}\\p{{N}}]+') as t from {_ONE})"


@query(f"select chunk_id, len(t) as dl, unnest(t) as term, 1 as one from {_TOKENS}".join(("select term, chunk_id, sum(one)::bigint as tf, dl from (", ") group by all")))
def bm25_postings(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.postings(_chunks(spark, folder))


@query(f"select count(*) as n_docs, round(avg(len(t)), 6) as avg_len from {_TOKENS}")
def bm25_corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.corpus_stats(_chunks(spark, folder))


_BM25 = f"""
    tok as (select chunk_id, len(t) as dl, t from {_TOKENS}), st as (select count(*) as n, avg(dl) as a from tok),
    asked as (select item_id, strip_accents(lower(unnest(list_filter(regexp_extract_all({_sq('text')}, '[0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+'), lambda t: length(t) > 2)[1:8]))) as term from eval_items),
    w as (select item_id, term, count(*) as times from asked group by all),
    p as (select chunk_id, dl, term, count(*) as tf from (select chunk_id, dl, unnest(t) as term from tok) where term in (select term from w) group by all),
    d as (select term, count(*) as df from p group by term),
    idf as (select item_id, term, times, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end as idf, a from w join d using (term), st),
    sc as (select item_id, chunk_id, round(-sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) as score from p join idf using (term) group by all),
    top as (select item_id, row_number() over (partition by item_id order by score, chunk_id)::int as rank, chunk_id, score from sc qualify rank <= 5)"""


@query(f"with {_BM25} select * from top")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25(_index(spark, folder), _table(spark, folder, "eval_items"))


_PROBES = ((-1, "en los altos de"), (-2, "ltos de l"), (-3, "100%"), (-4, "egún la costumbr"), (-5, "rranc"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The test passages, and some pieces of words that ranking cannot find."""
    return _table(spark, folder, "eval_items").select("item_id", "text").unionByName(spark.createDataFrame(list(_PROBES), "item_id bigint, text string"))


@query(f"""with {_BM25.replace("from eval_items", "from (select item_id, text from eval_items union all select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in _PROBES) + ") v(item_id, text))")},
    q as (select item_id, text from eval_items union all select * from (values {", ".join(f"({i}, '{t}')" for i, t in _PROBES)}) v(item_id, text))
    select item_id, row_number() over (partition by item_id order by chunk_id)::int as rank, chunk_id
    from (select * from q where item_id not in (select item_id from top)) q join {_ONE} c on contains(lower(c.text), lower(q.text)) qualify rank <= 5""")
def like_fallback(spark: SparkSession, folder: str) -> DataFrame:
    asked = _asked(spark, folder)
    return retrieval.like_fallback(_chunks(spark, folder), asked, retrieval.bm25(_index(spark, folder), asked))


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return retrieval.pack_context(bm25_topk(spark, folder).join(chunks.select("chunk_id", "source", "title", "text"), "chunk_id"))


@query(f"""with {_BM25},
    b as (select item_id, rank, '[' || rank || '] source=' || coalesce(source, '') || ' title=' || coalesce(title, '') || chr(10) || coalesce(text, '') as block from top join {_ONE} using (chunk_id)),
    u as (select *, sum(length(block)) over (partition by item_id order by rank) as used from b)
    select item_id, (count(*) filter (used <= 1800))::int as n_blocks, coalesce(string_agg(block, chr(10) || chr(10) order by rank) filter (used <= 1800), 'No context was retrieved.') as context from u group by item_id""")
def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _contexts(spark, folder)


@query()
def turn_parse(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.split_turns(_table(spark, folder, "corpecan_fichas"))


@query()
def qa_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.qa_pairs(dialogue.split_turns(_table(spark, folder, "corpecan_fichas")))


@query()
def qa_dataset(spark: SparkSession, folder: str) -> DataFrame:
    rows = dataset.qa_dataset(_table(spark, folder, "corpecan_fichas"))
    return rows.select("id", "question", "answer", "metadata.split", "metadata.system_prompt")


_CODES = "list_sum(list_transform(string_split({}, ''), lambda c: unicode(c)))"


@query(f"select distinct example_id, case when {_CODES.format('example_id')} % 100 < 95 then 'train' else 'validation' end as split from message_examples")
def train_split(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "message_examples").select("example_id", dataset.hash_split(F.col("example_id")).alias("split")).distinct()


_VALID = "coalesce(len(messages) > 0 and len(list_filter(messages, lambda m: m is null or m.role is null or m.content is null)) = 0, false)"


@query(f"select distinct example_id, {_VALID} as valid from message_examples")
def valid_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "message_examples").select("example_id", dataset.valid_messages(F.col("messages")).alias("valid")).distinct()


_SFT = f"""(select distinct example_id, coalesce(nullif(trim(split), ''), case when {_CODES.format('example_id')} % 100 < 95 then 'train' else 'validation' end) as split, len(messages)::int as n_messages
    from message_examples where {_VALID}) where split in ('train', 'validation')"""


@query(f"select example_id, split, n_messages from {_SFT}")
def sft_examples(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.sft_examples(_table(spark, folder, "message_examples")).select("example_id", "split", F.size("messages").alias("n_messages"))


@query(f"select split, count(*) as n from {_SFT} group by split")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.split_counts(dataset.sft_examples(_table(spark, folder, "message_examples")))


_MESSAGES = "(select id, i - 1 as pos, messages[i].role as role, messages[i].content as content from (select distinct example_id as id, messages from message_examples), range(1, len(messages) + 1) as r(i))"


@query(f"""select id, pos::int as pos, coalesce(string_agg(coalesce(role, '') || ': ' || coalesce(content, ''), chr(10) order by pos) over (partition by id order by pos rows between 8 preceding and 1 preceding), '') as history from {_MESSAGES}""")
def history_window(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.history_window(_messages(spark, folder))


_FOLLOWS = "(" + " or ".join([f"length({{0}}) <= {dialogue.FOLLOW_UP_CHARS}"] + [f"contains({{0}}, '{m}')" for m in dialogue.FOLLOW_UP]) + ")"
_SAID = _sq("coalesce(content, '')")


@query(f"""with m as (select *, {_SAID} as said from {_MESSAGES}),
    c as (select *, last_value(case when role = 'user' and said <> '' then said end ignore nulls) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as topic from m)
    select id, pos::int as pos, case when said <> '' and {_FOLLOWS.format('lower(said)')} and topic is not null then topic || chr(10) || 'User follow-up: ' || content else content end as prompt from c where role = 'user'""")
def topic_carry_over(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.carry_topic(_messages(spark, folder))


def _quoted(words: tuple[str, ...], test: str) -> str:
    return "(" + " or ".join(test.format(w.replace("'", "''")) for w in words) + ")"


_PROMPTS = f"(select distinct id, question, lower({_sq('coalesce(question, $$$$)')}) as p from corpecan_qa union all select distinct item_id::varchar, text, lower({_sq('coalesce(text, $$$$)')}) from eval_items union all select i::varchar, q, lower(q) from (values (-1, 'hello'), (-2, 'What is gofio?'), (-3, 'tell me about the history of the islands'), (-4, 'nice bro'), (-5, ''), (-6, 'and then')) v(i, q))"


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.createDataFrame([("-1", "hello"), ("-2", "What is gofio?"), ("-3", "tell me about the history of the islands"), ("-4", "nice bro"), ("-5", ""), ("-6", "and then")], "id string, question string")
    items = _table(spark, folder, "eval_items").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question")).distinct()
    return _table(spark, folder, "corpecan_qa").select("id", "question").distinct().unionByName(items).unionByName(extra)


@query(f"""select id, case when p = '' then 'empty' when p in {dialogue.GREETINGS} or {_quoted(dialogue.OPENINGS, "starts_with(p, '{}')")} then 'greeting'
    when {_quoted(dialogue.QUESTIONS, "contains(p, '{}')")} then 'factual_question' when contains(p, '?') then 'general_question' when {_quoted(dialogue.REMARKS, "contains(p, '{}')")} then 'casual_comment' else 'general_comment' end as intent from {_PROMPTS}""")
def prompt_intent(spark: SparkSession, folder: str) -> DataFrame:
    return _prompts(spark, folder).select("id", dialogue.intent(F.col("question")).alias("intent"))


@query(f"""select id, p <> '' and ({_quoted(dialogue.FACTUAL, "contains(p, '{}')")} or {_quoted(dialogue.ASKING, "starts_with(p, '{}')")} or ({_quoted(dialogue.REQUESTS, "starts_with(p, '{}')")} and length(p) > 24)) as retrieve from {_PROMPTS}""")
def rag_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _prompts(spark, folder).select("id", dialogue.needs_retrieval(F.col("question")).alias("retrieve"))


@query(f"select id, {_FOLLOWS.format('p')} as follow_up from {_PROMPTS}")
def follow_up(spark: SparkSession, folder: str) -> DataFrame:
    return _prompts(spark, folder).select("id", dialogue.is_follow_up(F.coalesce("question", F.lit(""))).alias("follow_up"))


@query(f"select id, pos::int as pos, substr({_sq('content')}, 1, 220) as example from {_MESSAGES} where role = 'assistant' and {_sq('content')} <> '' order by id, pos limit 2")
def style_examples(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.style_examples(_messages(spark, folder), ["id", "pos"])


@query()
def rag_augment(spark: SparkSession, folder: str) -> DataFrame:
    """Every chat example with the context of its last user message, retrieved where the gate opens."""
    rows = dataset.sft_examples(_table(spark, folder, "message_examples"))
    asked = rows.select("example_id", dialogue.last_user(F.col("messages")).alias("text")).where(dialogue.needs_retrieval(F.col("text")))
    chunks = _chunks(spark, folder)
    top = retrieval.bm25(_index(spark, folder), asked, query_key="example_id").join(chunks.select("chunk_id", "source", "title", "text"), "chunk_id")
    examples = [r.example for r in style_examples(spark, folder).collect()]  # two rows
    out = dialogue.augment(rows, retrieval.pack_context(top, "example_id"), examples)
    return out.select("example_id", "split", dialogue.render(F.col("messages")).alias("prompt"))


@query()
def normalize_document(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder).select(F.to_json(F.struct("id", "title", F.col("text").alias("body"))).alias("raw"), F.col("id").alias("fallback_id"), F.col("source").alias("fallback_title"))
    return documents.normalize_document(rows).select("doc_id", "title", "text")


def _curated(name: str, source: str | None = None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = _records(spark, folder)
        return _clean(rows.where(F.col("source") == source) if source else rows, "id", curators.curate(F.col("text"), name))

    return run


for _query, _curator, _source in (
    ("html_text", "beautifulsoup", None), ("html_body_text", "selectolax", None), ("html_main_content", "trafilatura", None), ("html_elements", "unstructured", None), ("mended_text", "ftfy", None),
    ("clean_text", "clean-text", None), ("pii_mask", "presidio", None), ("lang_filter", "lingua", None), ("wikitext_clean", "wikitext", "canariwiki"), ("encyclopedia_clean", "gevic", "gevic"),
    ("dictionary_clean", "academia-dictionary", "academia_dictionary"),
):
    QUERIES[_query] = _curated(_curator, _source)


def _votes_sql() -> str:
    lists = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in language.VOTES.items()}
    counts = ", ".join(f"len(list_filter(w, lambda t: list_contains({v}, t))) as {k}" for k, v in lists.items())
    best = " ".join(f"when {k} = m then '{k}'" for k in sorted(lists))
    return f"""select doc_id, case when m < 2 then null {best} end as lang from (select *, greatest({', '.join(lists)}) as m from (
        select doc_id, {counts} from (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null)))"""


@query(_votes_sql())
def lang_detect(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").where("text is not null").select("doc_id", language.language_column(F.col("text")).alias("lang"))


@query(f"select modality, count(*) as n from (select unnest(attachments).modality as modality from {_LAST}) group by modality")
def attachments_by_modality(spark: SparkSession, folder: str) -> DataFrame:
    return attachments.attachments_by_modality(_records(spark, folder))


@query(f"select modality, count(*) as n from (select distinct id, unnest(attachments).modality as modality from {_LAST}) group by modality")
def records_by_modality(spark: SparkSession, folder: str) -> DataFrame:
    return attachments.records_by_modality(_records(spark, folder))


@query(f"select source, count(*) as n from {_LAST} group by source")
def records_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return quality.count_by(_records(spark, folder), "source")


@query()
def attachment_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = attachments.attachments(_records(spark, folder)).select("id", F.coalesce("path", "url").alias("name"))
    return rows.select("id", "name", attachments.mime_type(F.col("name")).alias("mime_type"), attachments.modality(attachments.mime_type(F.col("name")), F.col("name")).alias("modality")).distinct()


@query()
def compact_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.record_json(_records(spark, folder)).select("source", "value")


@query()
def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("id", over_strings(safe_name)(F.coalesce("title", F.lit(""))).alias("name"))


@query(f"""select code, list_filter([gender, age, year, duration], lambda x: lower(x) in ('mujer', 'hombre'))[1] as gender, list_filter([gender, age, year, duration], lambda x: contains(lower(x), 'años'))[1] as age,
    list_filter([gender, age, year, duration], lambda x: regexp_full_match(x, '\\d{{4}}'))[1] as year from (select distinct code, visible_metadata.gender as gender, visible_metadata.age as age, visible_metadata.year as year, visible_metadata.duration as duration from corpecan_fichas)""")
def ficha_metadata(spark: SparkSession, folder: str) -> DataFrame:
    v = "visible_metadata."
    rows = _table(spark, folder, "corpecan_fichas").select("code", F.array(*[F.col(v + k) for k in ("gender", "age", "year", "duration")]).alias("values")).distinct()
    return rows.select("code", pages.ficha_metadata(F.col("values")).alias("m")).select("code", "m.gender", "m.age", "m.year")


@query(f"select id, case when length(t) <= 80 then t else rtrim(substr(t, 1, 80)) || '...' end as line from (select id, {_sq('text')} as t from {_LAST})")
def clipped(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("id", quality.clip(F.col("text"), 80).alias("line"))


@query(f"select distinct id, string_agg(upper(coalesce(role, '')) || ': ' || coalesce(content, ''), chr(10) || chr(10) order by pos) as prompt from {_MESSAGES} group by id")
def rendered_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "message_examples").select(F.col("example_id").alias("id"), "messages").distinct().where(F.size("messages") > 0)
    return rows.select("id", dialogue.render(F.col("messages")).alias("prompt"))


def _paged(spark: SparkSession, folder: str, *parts: str) -> DataFrame:
    """The documents as pages of a site: title and text between the given pieces of markup."""
    head, middle, tail = (F.lit(p) for p in parts)
    return _table(spark, folder, "documents").where("title is not null and text is not null").select("doc_id", F.concat(head, "title", middle, "text", tail).alias("page"))


_LINES = "array_to_string(list_filter(list_transform(string_split({}, chr(10)), lambda x: " + "{}), lambda x: x <> ''), chr(10))"
_TOLD = _LINES.replace("{}", "text", 1).replace("{}", _tidy(_sq("x")), 1)


@query(f"select doc_id, {_tidy(_sq('title'))} as title, {_TOLD} as text from documents where title is not null and text is not null")
def page_article(spark: SparkSession, folder: str) -> DataFrame:
    rows = _paged(spark, folder, '<html><body><div id="menu">x</div><div id="tamano"><p class="epigrafe">', "</p><p>", "</p></div></body></html>")
    return rows.select("doc_id", F.get(pages.encyclopedia_article(F.col("page"), F.lit("https://site.example/")), F.lit(0)).alias("a")).select("doc_id", "a.title", "a.text")


@query(f"select doc_id, {_tidy(_sq('title'))} as question, {_tidy(_sq('text'))} as answer from documents where title is not null and text is not null")
def page_consultation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _paged(spark, folder, '<main><div class="box"><p>', '</p></div><div class="box">', "<div></div></div></main>")
    return rows.select("doc_id", F.get(pages.consultation_page(F.col("page"), F.lit("https://site.example/")), F.lit(0)).alias("a")).select("doc_id", "a.question", "a.answer")


@query(f"select doc_id, {_tidy(_sq('title'))} as word, regexp_replace({_tidy(_sq('text'))}, '( *[0-9]+ *)+$', '') as definitions_text from documents where title is not null and text is not null and regexp_replace({_tidy(_sq('text'))}, '( *[0-9]+ *)+$', '') <> ''")
def page_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _paged(spark, folder, '<h3><a href="/palabra/x">', "</a></h3><p>", " 12 </p><h5>Vea</h5>")
    return rows.select("doc_id", F.explode(pages.dictionary_entries(F.col("page"), F.lit("https://site.example/"))).alias("a")).select("doc_id", "a.word", "a.definitions_text")


@query("select doc_id, title, text as wikitext from documents where title is not null and text is not null")
def page_wiki(spark: SparkSession, folder: str) -> DataFrame:
    main = F.struct(F.struct(F.col("text").alias("*")).alias("main"))
    rows = _table(spark, folder, "documents").where("title is not null and text is not null").select("doc_id", F.to_json(F.struct("title", F.array(F.struct(main.alias("slots"))).alias("revisions"))).alias("raw"))
    return rows.select("doc_id", pages.wiki_page(F.col("raw")).alias("p")).select("doc_id", "p.title", "p.wikitext")


@query("select id, a.url as url from (select id, unnest(attachments) as a from " + _LAST + ") where starts_with(a.mime_type, 'audio/') or ends_with(lower(a.path), '.mp3')")
def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    files = F.transform("attachments", lambda a: F.struct(a["mime_type"].alias("mime_type"), F.coalesce(a["url"], a["path"]).alias("source_url"), a["url"].alias("url")))
    return _records(spark, folder).select("id", F.explode(pages.audio_files(files)).alias("a")).select("id", "a.url")


@query("with k as (select *, row_number() over (order by doc_id) - 1 as r from documents) select doc_id, r // 20 as batch from k")
def batches(spark: SparkSession, folder: str) -> DataFrame:
    return pages.batched(_table(spark, folder, "documents").select("doc_id"), 20, "doc_id")


@query("select code, array_to_string(list_transform(islands, lambda x: x.name), ', ') as names from (select distinct code, islands from corpecan_fichas)")
def taxonomy_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "corpecan_fichas").select("code", "islands").distinct()
    terms = rows.select(F.explode("islands").alias("i")).select("i.id", "i.name").distinct()
    out = pages.with_terms(rows.select("code", F.transform("islands", lambda i: i["id"]).alias("ids")), "ids", terms)
    return out.select("code", F.when(F.col("ids").isNotNull(), F.array_join("terms", ", ")).alias("names"))


@query("select id from " + _LAST + " where source <> 'gevic'")
def not_yet_written(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder).select("id", "source")
    return sinks.new_only(rows, rows.where("source = 'gevic'"), "id").select("id")


@query()
def word_fold(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "eval_items").select("item_id", F.array_join(rx.words(rx.fold(F.col("text"))), " ").alias("words"))


SQL["word_fold"] = "select item_id, array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' ') as words from eval_items"
