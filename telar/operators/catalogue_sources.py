"""Queries of loaders and sinks: the tables are written the way the sites keep them, with the package's sinks, and read by its loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.operators import dataset, dialogue
from telar.operators.catalogue import _CODES, _LAST, _VALID, _WS, SQL, _records, _sq, _table, _tidy, query
from telar.plans.lineage import Scratch
from telar.sources import attachments, documents, files, jobs, loaders, sinks


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _site(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark, f'site-{name}').root}"


def _of(spark: SparkSession, folder: str, source: str) -> DataFrame:
    return _records(spark, folder).where(F.col("source") == source)


def _loaded(spark: SparkSession, root: str, name: str) -> DataFrame:
    return loaders.load(spark, name, loaders.LoaderOptions(root, include_attachments=True)).select("id", "title", "text", F.size("attachments").alias("n_files"))


def _urls() -> Column:
    return F.coalesce(F.transform(F.filter("attachments", lambda a: a["url"].isNotNull()), lambda a: a["url"]), F.array().cast("array<string>"))


_N_URLS = "coalesce(len(list_filter(attachments, lambda a: a.url is not null)), 0)::int"
_NAME = "regexp_replace(id, '[^A-Za-z0-9]+', '-', 'g')"


def _named() -> Column:
    return F.regexp_replace("id", "[^A-Za-z0-9]+", "-")


@query(f"""select 'academia_consultations:' || row_number() over (order by id) as id, title, {_strip("'Pregunta: ' || coalesce(title, '') || chr(10) || 'Respuesta: ' || coalesce(text, '')")} as text, 0 as n_files
    from {_LAST} where source = 'academia_consultations'""")
def load_consultations(spark: SparkSession, folder: str) -> DataFrame:
    root = _site(spark, "consultations")
    rows = _of(spark, folder, "academia_consultations").repartitionByRange("id").sortWithinPartitions("id").select(F.col("title").alias("question"), F.col("text").alias("answer"), F.array(F.lit("x")).alias("categories"))
    sinks.write_jsonl(rows, f"{root}/academia_canaria/consultations/consultations.jsonl")
    return _loaded(spark, root, "academia_consultations")


@query(f"""select 'academia_dictionary:' || coalesce(title, id) as id, coalesce(title, id) as title, {_strip("coalesce(title, id) || chr(10) || coalesce(text, '')")} as text, {_N_URLS} as n_files from {_LAST} where source = 'academia_dictionary'""")
def load_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    root = _site(spark, "dictionary")
    rows = _of(spark, folder, "academia_dictionary").select(F.coalesce("title", "id").alias("word"), F.col("text").alias("definitions_text"), _urls().alias("image_urls"))
    sinks.write_jsonl(rows, f"{root}/academia_canaria/dictionary/entries.jsonl")
    return _loaded(spark, root, "academia_dictionary")


def _redirected(x: str) -> str:
    return f"regexp_matches({x}, '^{_WS}*#[rR][eE][dD][iI][rR][eE][cC][tT]\\b')"


@query(f"""select 'canariwiki:' || {_NAME} as id, title, {_strip("coalesce(text, '')")} as text, {_N_URLS} as n_files from {_LAST} where source = 'canariwiki' and not {_redirected("coalesce(text, '')")}
    union all select 'canariwiki:REDIRECCION', 'r', 'REDIRECCIÓN no es un desvío', 0""")
def load_wiki(spark: SparkSession, folder: str) -> DataFrame:
    """The wiki's pages, with a redirect and with a page that only begins with a word like one."""
    root = _site(spark, "wiki")
    rows = _of(spark, folder, "canariwiki").select(_named().alias("name"), "title", "text", _urls().alias("urls"))
    more = spark.createDataFrame([("REDIRECT", "r", " #Redirect [[x]]", []), ("REDIRECCION", "r", "REDIRECCIÓN no es un desvío", [])], "name string, title string, text string, urls array<string>")
    main = F.struct(F.struct(F.col("text").alias("*")).alias("main"))
    raw = F.to_json(F.struct(F.lit("otro").alias("title"), F.array(F.struct(main.alias("slots"))).alias("revisions")))
    meta = F.to_json(F.struct("title", F.transform("urls", lambda u: F.struct(u.alias("url"))).alias("images")))
    files.write_folders(rows.unionByName(more), f"{root}/canariwiki/pages", F.col("name"), {"raw.json": raw, "metadata.json": meta}).write.format("noop").mode("overwrite").save()
    return _loaded(spark, root, "canariwiki").withColumn("title", F.when(F.col("title") != "otro", F.col("title")))


_FICHAS = "(select code, any_value(transcript) as transcript, any_value(visible_metadata) as v, any_value(url) as url, any_value(islands) as islands from corpecan_fichas group by code)"


def _recordings(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "corpecan_fichas").where("code is not null").dropDuplicates(["code"])


def _write_fichas(rows: DataFrame, base: str) -> None:
    meta = F.to_json(F.struct("id", "url", "islands", "visible_metadata"))
    files.write_folders(rows, f"{base}/fichas", F.col("code"), {"transcript.txt": F.col("transcript"), "metadata.json": meta, "raw.json": meta, "audio.mp3": F.lit("x")}).write.format("noop").mode("overwrite").save()


@query(f"""select 'corpecan:' || code as id, coalesce(nullif(v.location, ''), code) as title, {_strip("coalesce(transcript, '')")} as text, 1 as n_files from {_FICHAS}""")
def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    root, rows = _site(spark, "corpus"), _recordings(spark, folder)
    _write_fichas(rows, f"{root}/corpecan")
    # the index says nothing of the place: it comes from the folder's metadata
    index = rows.select("id", "code", "url", F.concat(F.lit("x/fichas/"), "code").alias("local_path"), "islands", F.struct(F.lit("").alias("location")).alias("visible_metadata"))
    sinks.write_jsonl(index, f"{root}/corpecan/index.jsonl")
    return _loaded(spark, root, "corpecan")


@query(f"""select 'gevic:' || {_NAME} as id, coalesce(nullif(title, ''), 'índice') as title, {_strip("coalesce(nullif(text, ''), 'crudo ' || id)")} as text, {_N_URLS} as n_files from {_LAST} where source = 'gevic'""")
def load_encyclopedia(spark: SparkSession, folder: str) -> DataFrame:
    root = _site(spark, "encyclopedia")
    rows = _of(spark, folder, "gevic").withColumn("name", _named())
    raw = F.to_json(F.struct("title", F.concat(F.lit("crudo "), "id").alias("text")))
    files.write_folders(rows, f"{root}/gevic/articles", F.col("name"), {"text.txt": F.col("text"), "raw.json": raw}).write.format("noop").mode("overwrite").save()
    index = rows.select(F.lit("índice").alias("title"), F.struct(F.lit("").alias("idcon")).alias("ids"), F.concat(F.lit("x/articles/"), "name", F.lit("/")).alias("local_path"), _urls().alias("image_urls"))
    sinks.write_jsonl(index, f"{root}/gevic/index.jsonl")
    return _loaded(spark, root, "gevic")


@query(f"""select 'patrimonio:' || row_number() over (order by id) as id, coalesce(title, '') as title, {_strip("coalesce(title, '') || chr(10) || coalesce(text, '')")} as text, 0 as n_files from {_LAST} where source = 'patrimonio'""")
def load_heritage(spark: SparkSession, folder: str) -> DataFrame:
    root = _site(spark, "heritage")
    rows = _of(spark, folder, "patrimonio").repartitionByRange("id").sortWithinPartitions("id").select(F.col("title").alias("titulo"), F.col("text").alias("descripcion"), F.col("id").alias("zona"))
    sinks.write_csv(rows, f"{root}/patrimonio/patrimonio.csv")
    return _loaded(spark, root, "patrimonio").withColumn("title", F.coalesce("title", F.lit("")))


@query(f"select id, source, title, text, metadata->>'$.x' as x, coalesce(len(attachments), 0)::int as n_files from (select id, source, title, text, '{{}}'::json as metadata, attachments from {_LAST})")
def exported_records(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned export, read back from the file of all records."""
    root = _site(spark, "export")
    sinks.write_records(_records(spark, folder), root)
    rows = loaders.read_jsonl(spark, f"{root}/all")
    return rows.select("id", "source", "title", "text", F.lit(None).cast("string").alias("x"), F.coalesce(F.size("attachments"), F.lit(0)).alias("n_files")).withColumn("n_files", F.greatest("n_files", F.lit(0)))


@query(f"select source, count(*) as n from {_LAST} group by source")
def exported_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each source's folder of the cleaned export."""
    root = _site(spark, "export")
    sinks.write_records(_records(spark, folder), root)
    return spark.read.text(f"{root}/by_source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with d as (select doc_id, {_sq("coalesce(title, '')")} as title, {_sq("coalesce(text, '')")} as text from documents)
    select doc_id::varchar as doc_id, coalesce(nullif(title, ''), 'd') as title, text from d where text <> '' union all select 'l:2', coalesce(nullif(title, ''), 'l'), text from d where text <> '' union all select doc_id::varchar, doc_id::varchar, text from d where text <> ''""")
def knowledge_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document three times, as JSON, as the second line of JSON lines after a broken one, and as plain text."""
    root = _site(spark, "knowledge")
    name = F.col("doc_id").cast("string")
    as_json = F.to_json(F.struct(name.alias("id"), "title", F.col("text").alias("content")))
    as_line = F.concat(F.lit("{broken\n"), F.to_json(F.struct(F.col("title").alias("name"), F.col("text").alias("body"))), F.lit("\n\n"))
    rows = _table(spark, folder, "documents").withColumns({"a": as_json, "b": as_line})
    files.write_folders(rows, f"{root}/gevic", name, {"d.json": F.col("a"), "l.jsonl": F.col("b")}).write.format("noop").mode("overwrite").save()
    files.write_files(rows, f"{root}/canariwiki", F.concat(name, F.lit(".txt")), F.col("text")).write.format("noop").mode("overwrite").save()
    return documents.read_knowledge(spark, root).select("doc_id", "title", "text")


def _chat_files(spark: SparkSession, folder: str) -> DataFrame:
    root = _site(spark, "chats")
    rows = _table(spark, folder, "message_examples").select(F.col("example_id").alias("id"), "messages", F.struct("split", F.col("metadata.author").alias("author")).alias("metadata"))
    sinks.write_jsonl(rows, root)
    return dataset.read_chats(spark, root)


@query("select example_id, split, coalesce(len(messages), -1)::int as n_messages, metadata.author as author from message_examples")
def chat_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chat_files(spark, folder)
    return rows.select("example_id", "split", F.coalesce(F.size("messages"), F.lit(-1)).alias("n_messages"), F.get_json_object("metadata", "$.author").alias("author"))


_OWN = f"coalesce(nullif(split, ''), case when {_CODES.format('example_id')} % 100 < 95 then 'train' else 'validation' end)"


@query(f"select example_id as id, {_OWN} as split, true as rag_augmented, metadata.author as author, len(messages)::int as n_messages from message_examples where {_VALID}")
def rag_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the augmented file: of every split, repeated ones too, with their own metadata."""
    rows = sinks.augmented_rows(dataset.rag_examples(_chat_files(spark, folder))).withColumn("m", F.to_json("metadata"))
    get = lambda k: F.get_json_object("m", f"$.{k}")
    return rows.select("id", get("split").alias("split"), (get("rag_augmented") == "true").alias("rag_augmented"), get("author").alias("author"), F.size("messages").alias("n_messages"))


_SFT_ROWS = f"""(select distinct example_id, coalesce(nullif(trim(split), ''), case when {_CODES.format('example_id')} % 100 < 95 then 'train' else 'validation' end) as split from message_examples where {_VALID})"""


@query(f"select s.stage, example_id, split from {_SFT_ROWS}, (values (1), (2)) s(stage) where split in ('train', 'validation') and (s.stage = 1 or split = 'train')")
def two_stages(spark: SparkSession, folder: str) -> DataFrame:
    """A training in two stages: all examples, then those to train on once more."""
    rows = dataset.sft_examples(_table(spark, folder, "message_examples"))
    return dataset.two_stages(rows, rows.where("split = 'train'")).select("stage", "example_id", "split")


_LABEL = "^[A-Z]{1,3}[0-9]*[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}]*:"
_TURNS = f"""
    line as (select code, i, l[i] as line from (select code, string_split(transcript, chr(10)) as l from {_FICHAS} where code is not null and transcript is not null), range(1, len(l) + 1) as r(i)),
    told as (select *, sum(case when regexp_matches(line, '{_LABEL}') then 1 else 0 end) over (partition by code order by i) as no from line),
    part as (select code, no, string_agg(line, chr(10) order by i) as x from told where no > 0 group by code, no),
    turn as (select code, no - 1 as pos, regexp_extract(x, '^[A-Z]{{1,3}}[0-9]*') as speaker, {_sq(f"regexp_replace(regexp_replace(x, '{_LABEL}', ''), '\\[[A-Z]{{1,3}}[0-9]*:[^\\]]*\\]', '', 'g')")} as text from part),
    said as (select *, case when starts_with(speaker, 'E') then 'q' when starts_with(speaker, 'I') then 'a' end as role from turn where text <> ''),
    seg as (select *, sum(case when role = 'q' then 1 else 0 end) over (partition by code order by pos) as seg from said where role is not null),
    pair as (select code, seg, max(case when role = 'q' then text end) as question, string_agg(text, ' ' order by pos) filter (role = 'a') as answer from seg where seg > 0 group by code, seg),
    pairs as (select code, row_number() over (partition by code order by seg)::int as pair_no, question, answer from pair where answer is not null)"""
_SQL_TURNS = f"with {_TURNS} select code, pos::int as pos, speaker, text from turn where text <> ''"
_SQL_PAIRS = f"with {_TURNS} select code, pair_no, question, answer from pairs"
_ID = "code || ':' || lpad(pair_no::varchar, 4, '0')"


def _known(x: str) -> str:
    return f"coalesce(nullif({_strip(f'{x}::varchar')}, ''), 'unknown')"


def _prompt() -> str:
    names = f"coalesce(nullif(array_to_string(list_filter(list_transform(islands, lambda n: {_strip('n.name')}), lambda n: n <> ''), ', '), ''), 'unknown')"
    values = {"gender": _known("v.gender"), "age": _known("v.age"), "location": _known("v.location"), "islands": names}
    text = "'" + " ".join(dataset.INTERVIEW_PROMPT).replace("'", "''") + "'"
    for k, x in values.items():
        text = f"replace({text}, '{{{k}}}', {x})"
    return text


_SQL_DATASET = f"""with {_TURNS} select 'corpecan:' || {_ID} as id, question, answer, case when {_CODES.format(f'({_ID})')} % 100 < 95 then 'train' else 'validation' end as split, {_prompt()} as system_prompt
    from pairs join {_FICHAS} using (code)"""


@query(_SQL_DATASET)
def interview_files(spark: SparkSession, folder: str) -> DataFrame:
    """The interview dataset from folders of recordings."""
    root = _site(spark, "interviews")
    _write_fichas(_recordings(spark, folder), root)
    rows = dataset.qa_dataset(dataset.interviews(spark, root))
    return rows.select("id", "question", "answer", "metadata.split", F.get("messages", F.lit(0))["content"].alias("system_prompt"))


@query(f"select code, role, count(*) as n from (select code, case when starts_with(speaker, 'E') then 'interviewer' when starts_with(speaker, 'I') then 'interviewee' end as role from (with {_TURNS} select * from turn where text <> '')) group by all")
def speaker_roles(spark: SparkSession, folder: str) -> DataFrame:
    turns = dialogue.split_turns(_table(spark, folder, "corpecan_fichas"))
    return turns.select("code", dialogue.speaker_role(F.col("speaker")).alias("role")).groupBy("code", "role").agg(F.count(F.lit(1)).alias("n"))


def _escaped(name: str) -> Column:
    """Text as a page holds it."""
    out = F.coalesce(name, F.lit(""))
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


_TITLE, _TEXT = _tidy(_sq("coalesce(title, '')")), _tidy(_sq("coalesce(text, '')"))


@query(f"""select id as url, coalesce(nullif({_TITLE}, ''), 'índice') as title, case when {_TEXT} = '' then 'empty_text' end as reason from {_LAST} where source = 'gevic' union all select 'sin página', 'índice', 'no_page'""")
def encyclopedia_job(spark: SparkSession, folder: str) -> DataFrame:
    """The encyclopedia's articles from fetched pages: kept ones, and skipped ones with the reason; titles that are missing come from the index."""
    rows = _of(spark, folder, "gevic")
    page = F.concat(F.lit('<div id="tamano"><p class="epigrafe">'), _escaped("title"), F.lit("</p><p>"), _escaped("text"), F.lit("</p></div>"))
    index = rows.select(F.col("id").alias("url")).unionByName(spark.createDataFrame([("sin página",)], "url string")).withColumn("title", F.lit("índice"))
    out = jobs.encyclopedia(index, rows.select(F.col("id").alias("url"), page.alias("page")))
    return out.select("url", "title", "reason")


@query(f"""select id as url, 2 as listing_page, coalesce(nullif({_TITLE}, ''), 'del listado') as question, {_TEXT} as answer, 'x' as categories, null::varchar as reason
    from {_LAST} where source = 'academia_consultations' union all select 'sin página', 3, 'del listado', '', 'x', 'no_page'""")
def consultations_job(spark: SparkSession, folder: str) -> DataFrame:
    """Consultations from a listing and fetched pages; what a page lacks is the listing's."""
    rows = _of(spark, folder, "academia_consultations")
    page = F.concat(F.lit('<main><div class="box"><p>'), _escaped("title"), F.lit('</p></div><div class="box">'), _escaped("text"), F.lit("</div></main>"))
    listed = rows.select(F.explode(F.array(F.lit(5), F.lit(2))).alias("listing_page"), F.col("id").alias("url")).unionByName(spark.createDataFrame([(3, "sin página")], "listing_page int, url string"))
    listed = listed.withColumns({"question": F.lit("del listado"), "categories": F.array(F.lit("x"))})
    out = jobs.consultations(listed, rows.select(F.col("id").alias("url"), page.alias("page")))
    return out.select("url", "listing_page", "question", "answer", F.array_join("categories", ",").alias("categories"), "reason")


_FIELDS = "list_filter([v.gender, v.age, v.year, v.duration], lambda x: x is not null and x <> '')"


@query(f"""select code, url, array_to_string(list_transform(coalesce(islands, []), lambda x: x.name), ', ') as islands, list_filter(f, lambda x: lower(x) in ('mujer', 'hombre'))[1] as gender, list_filter(f, lambda x: contains(lower(x), 'años'))[1] as age,
    list_filter(f, lambda x: regexp_full_match(x, '\\d{{4}}'))[1] as year, array_to_string(list_transform(coalesce(v.topics, []), lambda x: '[t1] ' || {_sq("x")}), ', ') as topics, 1 as n_audio
    from (select *, list_distinct(list_filter(list_transform({_FIELDS}, lambda x: {_sq("x")}), lambda x: x <> '')) as g, list_filter(list_transform({_FIELDS}, lambda x: {_sq("x")}), lambda x: x <> '') as f from {_FICHAS} where code is not null)""")
def recordings_job(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus's records from its interface: fields listed on the page, sound files, names of islands."""
    rows = _recordings(spark, folder).withColumn("url0", F.col("url")).withColumn("url", F.coalesce("url", "code"))
    v = "visible_metadata."
    cell = lambda c: F.concat(F.lit('<div class="jet-listing-dynamic-field__content"><b>'), c, F.lit("</b></div>"))
    topics = F.transform(F.coalesce(v + "topics", F.array().cast("array<string>")), lambda x: F.concat(F.lit("[t1] "), x))
    page = F.concat_ws("\n", F.transform(F.concat(F.filter(F.array(*[F.col(v + k) for k in ("gender", "age", "year", "duration")]), lambda x: x.isNotNull()), topics), cell))
    items = rows.select("id", F.col("code").alias("title"), F.lit("").alias("slug"), "url", F.lit("<p>uno</p>dos").alias("content"), F.coalesce(F.transform("islands", lambda i: i["id"]), F.array().cast("array<int>")).alias("islands"), "url0")
    media = rows.select("id", F.explode(F.array(F.struct(F.lit("audio/mpeg").alias("t"), F.lit("a").alias("u")), F.struct(F.lit("image/png").alias("t"), F.lit("b").alias("u")))).alias("m")).select("id", F.col("m.t").alias("mime_type"), F.col("m.u").alias("source_url"))
    terms = rows.select(F.explode("islands").alias("i")).select("i.id", "i.name").distinct()
    out = jobs.recordings(items, rows.select("url", page.alias("page")), media, terms)
    m = "visible_metadata."
    return out.select("code", F.when(F.col("url") != F.col("code"), F.col("url")).alias("url"), F.array_join("island_names", ", ").alias("islands"), m + "gender", m + "age", m + "year", F.array_join(m + "topics", ", ").alias("topics"), F.size("audio").alias("n_audio"))


_TITLED = f"coalesce(nullif({_sq('title')}, ''), source)"
SQL["normalize_document"] = f"select id as doc_id, {_TITLED} as title, case when {_sq('text')} <> '' then {_sq('text')} else 'body:' end as text from {_LAST} where text is not null"
_SUFFIX = "lower(regexp_extract(regexp_replace(name, '[?#].*$', ''), '(\\.[A-Za-z0-9]+)$'))"
_MIME = "case " + " ".join(f"when s = '{k}' then '{t}'" for k, t in sorted(attachments._TYPES.items())) + " end"
_KIND = "case " + " ".join(f"when starts_with(m, '{k}/') then '{k}'" for k in ("audio", "image", "video")) + " when starts_with(m, 'text/') or m = 'application/pdf' then 'document' "
_KIND += " ".join("when s in (" + ", ".join(f"'{x}'" for x in ends) + f") then '{k}'" for k, ends in attachments.SUFFIXES.items()) + " else 'other' end"
SQL["attachment_kinds"] = f"""select distinct id, name, m as mime_type, {_KIND} as modality from (select id, name, s, {_MIME} as m from (select id, name, {_SUFFIX} as s
    from (select id, coalesce(a.path, a.url) as name from (select id, unnest(attachments) as a from {_LAST}))))"""
SQL["safe_names"] = f"""select id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(translate(coalesce(title, ''), '¹²³ªº' || chr(160) || '¨´¸¯', '123ao     '), '…', '...')), '[^\x00-\x7f]', '', 'g'), '[^a-zA-Z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 120), ''), 'untitled') as name from {_LAST}"""


for _name, _text in (("turn_parse", _SQL_TURNS), ("qa_pairs", _SQL_PAIRS), ("qa_dataset", _SQL_DATASET)):
    SQL[_name] = _text
