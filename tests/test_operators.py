"""Deduplication, retrieval, dialogue, datasets and sources on small fixtures, against brute force where there is one."""

import json
import random
import re
import sqlite3
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from telar.operators import dataset, dedup, dialogue, retrieval
from telar.plans.skew import join_counted
from telar.sources import attachments, documents, files, jobs, loaders, pages, sinks


def test_token_set_ratio():
    assert dedup.token_set_ratio("uno dos", "dos uno tres") == 100.0
    assert dedup.token_set_ratio("", "a") == 0.0
    assert dedup.token_set_ratio("abc", "xyz") == 0.0

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert dedup._indel(a, b) == (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)


def greedy(items, linked):
    kept = []
    for i, t in sorted(items):
        if not any(linked(t, u) for _, u in kept):
            kept.append((i, t))
    return {i for i, _ in kept}


def test_fuzzy_dedup(spark):
    rng = random.Random(5)
    words = ["romería", "de", "la", "Virgen", "Tejeda", "Agaete", "fiesta", "barranco"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(90, ""), (91, None), (None, "x")]
    got = {r.id for r in dedup.fuzzy_dedup(spark.createDataFrame(rows, "id int, text string")).collect()}
    texts = {}
    for i, t in rows:
        if i is not None and t:
            texts.setdefault(t, i)
    assert got == greedy([(i, t) for t, i in texts.items()], lambda a, b: dedup.token_set_ratio(a, b) >= 95)
    assert dedup.fuzzy_dedup(spark.createDataFrame([], "id int, text string")).count() == 0


def misspelt(rng, n):
    """Texts of rare words, and copies of earlier ones with letters of their rarest, longest words changed or left out."""
    letters = "abcdefghijklmnñopqrstuvwxyz"
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            ws = rng.choice(out).split()
            for _ in range(rng.randint(1, 1 + len(ws) // 3)):
                k = max(range(len(ws)), key=lambda k: (len(ws[k]), rng.random()))
                c = rng.randrange(len(ws[k]))
                ws[k] = ws[k][:c] + rng.choice([*letters, "", ws[k][c] + rng.choice(letters)]) + ws[k][c + 1 :] or "a"
        else:
            ws = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(rng.choice([1, 2, 4, 9, 30, 200]))]
        if rng.random() < 0.2:
            ws += [rng.choice(ws)[:-1] or "b"]
        rng.shuffle(ws)
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize(("threshold", "block", "tile"), [(95.0, 6000, 1024), (95.0, 40, 7), (80.0, 50, 16)])
def test_fuzzy_links_of_misspelt_words(spark, monkeypatch, threshold, block, tile):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    texts = ["Barranco de Guayadeque", "Barranco de Guayadequeo", "Guayadeque", "Guayadequeo", *misspelt(random.Random(11), 240)]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    want = {(i, j) for t, i in first.items() for u, j in first.items() if i < j and dedup.token_set_ratio(t, u) >= threshold}
    assert {(0, 1), (2, 3)} <= want and len(want) > 50
    got = [tuple(r) for r in dedup.fuzzy_links(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    ids = range(len(texts))
    monkeypatch.setattr(dedup, "TILE", tile)
    one = dedup._Block(list(ids), [" ".join(sorted(set(t.split()))) for t in texts])
    assert {tuple(sorted((one.ids[i], one.ids[j]))) for i, j in dedup._linked(one, one, threshold) if texts[one.ids[i]] != texts[one.ids[j]]} >= want


def test_fuzzy_links_of_unrelated_texts_make_no_matrix(monkeypatch):
    """Texts that have neither rare words nor characters in common are set aside by looking words up, and not by products over all pairs."""

    def dense(*_):
        raise AssertionError("a matrix over all pairs")

    rng = random.Random(21)
    texts = []
    for i in range(26):
        letters = [chr(97 + (7 * i + k) % 26) for k in range(5)]
        texts.append(" ".join(sorted({"de", "la", *("".join(rng.choice(letters) for _ in range(9)) for _ in range(30))})))
    held = " ".join(sorted({*texts[0].split(), *texts[1].split()}))  # has all words of two others
    one = dedup._Block(list(range(27)), [*texts, held])
    monkeypatch.setattr(dedup, "MOST_MET", 100)
    seen = []
    monkeypatch.setattr(dedup, "token_set_ratio", lambda a, b: seen.append(1) or 0.0)
    monkeypatch.setattr(dedup._Block, "_dense", staticmethod(dense))
    assert {tuple(sorted((one.ids[i], one.ids[j]))) for i, j in dedup._linked(one, one, 95.0)} == {(0, 26), (1, 26)}
    assert not seen


def test_minhash_dedup(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(80)] for _ in range(10)]
    rows = [(i, " ".join(base[i % 10])) for i in range(30)] + [(40, " ".join(base[0][1:])), (41, " ".join(base[1][::-1])), (42, ""), (43, None)]
    got = {r.id for r in dedup.minhash_dedup(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got - {40} == set(range(10))  # the one with a word less may survive, at 0.99 it hardly does
    assert dedup.minhash_dedup(spark.createDataFrame([], "id int, text string")).count() == 0


def test_join_counted(spark):
    big = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    for limit in (100_000, 0):  # all of it broadcast, and only the hot key
        out = join_counted(big, small, ["k"], "n", 2000, broadcast_rows=limit)
        assert out.columns == ["k", "id", "n"] and out.count() == 2000 and out.where("k = 0 and n = 1500").count() == 1500
        more = big.unionByName(spark.createDataFrame([(None, 1), (-5, 2)], "k bigint, id bigint"))
        out = join_counted(more, small.where("k != 1999"), ["k"], "n", 2000, broadcast_rows=limit, left=True)
        assert out.count() == 2002 and sorted(r.id for r in out.where("n is null").collect()) == [1, 2, 1999]


@pytest.mark.parametrize(("length", "n"), [(0, 0), (1, 1), (1200, 1), (1201, 2), (2200, 2), (2201, 3), (3500, 4)])
def test_chunks(spark, length, n):
    df = spark.createDataFrame([(1, "x" * length)], "doc_id int, text string")
    assert retrieval.chunk(df).count() == n
    with pytest.raises(ValueError):
        retrieval.chunk(df, size=10, overlap=10)


DOCS = [
    ("a1", "canariwiki", "Guagua", "la guagua es un bus"), ("a2", "gevic", "Otro", "bus bus bus camión árbol"), ("a3", "academia_canaria", "Tres", "nada de nada aquí en esto que es largo"),
    ("a4", "gevic", "Cuatro", "guagua guagua"), ("a5", "gevic", "x", "perro gato"), ("a6", "gevic", "y", "zorro"),
]


def test_bm25_against_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, source, title, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into t values (?, ?, ?, ?)", DOCS)
    queries = ["guagua bus", "guagua guagua", "camion", "gevic", "canaria", "un la", "AND guagua", ""]
    docs = spark.createDataFrame(DOCS, "chunk_id string, source string, title string, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "item_id int, text string")
    got = {}
    for r in retrieval.bm25(docs, asked, k=10).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.chunk_id, r.score))
    for i, q in enumerate(queries):
        terms = [t for t in re.findall(r"[0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+", q) if len(t) > 2][:8] or ["canarias"]
        rows = con.execute("select id, bm25(t) from t where t match ?", (" OR ".join(f'"{t}"' for t in terms),)).fetchall()
        assert got.get(i, []) == sorted([(d, round(s, 6)) for d, s in rows], key=lambda x: (x[1], x[0])), q


def test_bm25_of_a_written_index(spark, tmp_path, monkeypatch):
    """A third of the documents hold one word; the same result from the index, and where the queries' words are too many to be sent to every task."""
    rng = random.Random(4)
    words = [f"voz{i}" for i in range(40)]
    docs = [(f"d{i}", "s", None, " ".join(["hot"] * (i % 3 == 0) + [rng.choice(words) for _ in range(rng.randint(0, 12))])) for i in range(200)] + [(None, "s", "t", "hot")]
    df = spark.createDataFrame(docs, "chunk_id string, source string, title string, text string")
    asked = spark.createDataFrame([(i, "hot " + " ".join(rng.sample(words, 3))) for i in range(20)] + [(99, None), (98, "nada xyz")], "item_id int, text string")
    index = sinks.write_index(df.where("chunk_id is not null"), str(tmp_path / "index"))
    told = lambda out: sorted(tuple(r) for r in out.collect())
    want = told(retrieval.bm25(df, asked))
    assert len(want) == 100 and told(retrieval.bm25(retrieval.open_index(spark, str(tmp_path / "index")), asked)) == want == told(retrieval.bm25(index, asked))
    monkeypatch.setattr(retrieval, "fits", lambda table: False)
    assert told(retrieval.bm25(index, asked)) == want
    assert retrieval.bm25(df.limit(0), asked).count() == 0


def test_like_fallback(spark, monkeypatch):
    docs = [("a", "La Guagua azul"), ("b", "una guagua"), ("c", None), (None, "guagua"), ("d", "GUAGUAS"), ("e", "")]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "chunk_id string, text string, item_id int")
    asked = spark.createDataFrame([(1, "guagua"), (2, "GUA AZUL"), (3, ""), (4, None), (5, "azul"), (6, "guagua"), (None, "una")], "item_id int, text string")
    hits = spark.createDataFrame([(5,)], "item_id int")
    want = [(None, 1, "b"), (1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (6, 1, "a"), (6, 2, "b")]
    for chars in (8_000_000, 5):  # one block of queries, and one for each
        monkeypatch.setattr(retrieval, "BLOCK_CHARS", chars)
        got = retrieval.like_fallback(df, asked, hits, k=2).collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, *r)) == want
    assert retrieval.like_fallback(df, asked.limit(0), hits).count() == 0


def test_jobs(spark):
    row = spark.sql("select array(named_struct('a', 1), named_struct('a', 2), named_struct('a', 1)) as v").select(jobs.distinct_json(F.col("v")).alias("v")).first()
    assert [x.a for x in row.v] == [1, 2]
    done = spark.createDataFrame([("u", None), ("v", "no_page"), ("w", "no_page")], "url string, reason string")
    out = jobs.manifest({"kept": 1}, "gevic", done)
    assert out["kept"] == 1 and out["gevic_seen"] == 3 and out["gevic_saved"] == 1 and out["gevic_skipped"] == {"no_page": 2} and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", out["gevic_finished_at"])


def test_query_terms(spark):
    df = spark.createDataFrame([("¿Qué es una guagua en Gran Canaria?",), ("a la o",), ("uno dos tres cuatro cinco seis siete ocho nueve diez",)], "q string")
    assert [r[0] for r in df.select(retrieval.fts_query(F.col("q"))).collect()] == ["Qué OR una OR guagua OR Gran OR Canaria", "canarias", "uno OR dos OR tres OR cuatro OR cinco OR seis OR siete OR ocho"]


def test_context(spark):
    rows = [(1, 1, "s", "t", "x" * 1000), (1, 2, "s", "t", "y" * 1000), (1, 3, "s", None, "z"), (2, 1, "s", "t", "q" * 1900)]
    out = {r.item_id: r for r in retrieval.pack_context(spark.createDataFrame(rows, "item_id int, rank int, source string, title string, text string")).collect()}
    assert out[1].n_blocks == 1 and out[1].context.startswith("[1] source=s title=t\nxxx") and out[2].context == retrieval.NO_CONTEXT


def test_qa_pairs(spark):
    text = "antes\nI1:pre\nE1:q1\nE1:q2 [I1: sí]\nI1:a\nX:n\nI2:b\r\nmás\nE2:q3"
    df = spark.createDataFrame([("c", text), ("c", text), ("d", None), (None, text)], "code string, transcript string")
    turns = dialogue.split_turns(df)
    assert [(r.speaker, r.text) for r in turns.orderBy("pos").collect()] == [("I1", "pre"), ("E1", "q1"), ("E1", "q2"), ("I1", "a"), ("X", "n"), ("I2", "b más"), ("E2", "q3")]
    assert [tuple(r) for r in dialogue.qa_pairs(turns).collect()] == [("c", 1, "q2", "a b más")]


def test_prompts(spark):
    df = spark.createDataFrame([(t,) for t in ["", "hello", "hey you", "what is gofio", "is it?", "nice one", "well", "tell me everything about it all", "explain", None]], "t string")
    rows = df.select(dialogue.intent(F.col("t")), dialogue.needs_retrieval(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["empty", "greeting", "greeting", "factual_question", "general_question", "casual_comment", "general_comment", "general_comment", "general_comment", "empty"]
    assert [r[1] for r in rows] == [False, False, False, True, False, False, False, True, False, False]


def test_history_and_topic(spark):
    said = [("u", 0, "user", "cuéntame la historia de las guaguas de la isla"), ("u", 1, "assistant", "pues"), ("u", 2, "user", "go on"), ("u", 3, "user", None)]
    df = spark.createDataFrame(said, "id string, pos int, role string, content string")
    topics = [r.prompt for r in dialogue.carry_topic(df).orderBy("pos").collect()]
    assert topics == [said[0][3], f"{said[0][3]}\nUser follow-up: go on", None]
    assert dialogue.history_window(df).orderBy("pos").collect()[2].history == f"user: {said[0][3]}\nassistant: pues"
    assert dialogue.style_examples(df, ["id", "pos"], strict_compat=True).count() == 0 and dialogue.style_examples(df, ["id", "pos"]).count() == 1


def test_messages(spark):
    kind = "example_id string, messages array<struct<role:string,content:string>>, split string"
    rows = [("a", [("user", "q")], None), ("a", [("user", "q")], "train"), ("b", [], "train"), ("c", None, None), ("d", [("user", None)], None), ("e", [("system", "s"), ("user", "q"), ("assistant", "x")], "test"), ("f", [("user", "hola")], " validation ")]
    df = spark.createDataFrame(rows, kind)
    got = {r.example_id: r.split for r in dataset.sft_examples(df).collect()}
    assert set(got) == {"a", "f"} and got["f"] == "validation"
    with pytest.raises(ValueError):
        dataset.sft_examples(df.limit(0), require_rows=True)
    out = dialogue.augment(df.where("example_id = 'e'"), spark.createDataFrame([("e", "CTX")], "example_id string, context string"), ["uno"]).first()
    assert [m.role for m in out.messages] == ["system", "user", "assistant"] and "CTX" in out.messages[1].content and out.messages[0].content.startswith("s When")
    assert [m.role for m in dialogue.augment(df.where("example_id = 'f'"), spark.createDataFrame([], "example_id string, context string"), []).first().messages] == ["system", "user"]


@pytest.mark.parametrize(("value", "split"), [("a", "validation"), ("corpecan:1:0001", "train"), ("b:12", "train"), ("conv-7", "train")])
def test_hash_split(spark, value, split):
    assert spark.range(1).select(dataset.hash_split(F.lit(value))).first()[0] == split


def test_json_messages(spark):
    raw = ['{"messages":[{"role":"user","content":null}]}', '{"messages":[{"role":"user"}]}', '{"messages":[]}', '{"messages":null}', "{", '{"messages":{"role":1,"content":2}}']
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [r[0] for r in df.select(dataset.valid_json_messages(F.col("raw"))).collect()] == [True, False, False, False, False, False]


def test_attachments(spark):
    df = spark.createDataFrame([(n,) for n in ["a.MP3", "b.png", "c.pdf", "d.bin", "x/e.JSONL", "https://a.es/f.mp4?x=1", None]], "n string")
    assert [r[0] for r in df.select(attachments.modality(attachments.mime_type(F.col("n")), F.col("n"))).collect()] == ["audio", "image", "document", "other", "document", "video", "other"]


def test_loaders(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")

    put("academia_canaria/consultations/consultations.jsonl", '{"question": "¿q?", "answer": "r", "categories": ["x"]}\n\n{"question": null, "answer": "s", "categories": []}\n')
    put("academia_canaria/dictionary/entries.jsonl", '{"word": "gofio", "definitions_text": "Harina.", "letter": "g", "image_urls": ["https://a.es/i.jpg"]}\n')
    put("canariwiki/pages/1/raw.json", json.dumps({"title": "T", "pageid": 7, "revisions": [{"slots": {"main": {"*": "texto wiki"}}}]}))
    put("canariwiki/pages/1/metadata.json", json.dumps({"title": "Título", "pageid": 7, "images": [{"local_path": None, "url": "https://a/x.png"}]}))
    put("canariwiki/pages/2/raw.json", json.dumps({"pageid": 8, "revisions": [{"slots": {"main": {"*": "#REDIRECT [[x]]"}}}]}))
    put("corpecan/index.jsonl", json.dumps({"id": 1, "code": "GC-1", "local_path": "x/fichas/GC-1", "visible_metadata": {"location": "Agaete"}}) + "\n" + json.dumps({"id": 2, "code": "", "local_path": "x/fichas/TF-2", "visible_metadata": {"location": None}}) + "\n")
    put("corpecan/fichas/GC-1/transcript.txt", "E1: hola\nI1: sí")
    put("corpecan/fichas/GC-1/metadata.json", json.dumps({"id": 1, "visible_metadata": {"location": "Agaete, GC"}}))
    put("corpecan/fichas/GC-1/raw.json", json.dumps({"x": [1]}))
    put("canariwiki/pages/3/raw.json", json.dumps({"title": "Sin", "pageid": 9, "revisions": [{"slots": {"main": {"*": "REDIRECCIÓN es una palabra"}}}]}))
    put("canariwiki/pages/3/metadata.json", json.dumps({"url": "u", "raw": "viejo"}))
    put("corpecan/fichas/GC-1/audio/a.mp3", "x")
    put("gevic/index.jsonl", json.dumps({"title": "t", "ids": {"idcon": "5"}, "local_path": "x/articles/5", "image_urls": ["https://a/z.gif"]}) + "\n")
    put("gevic/articles/5/raw.json", json.dumps({"title": "Geografía", "text": "crudo"}))
    put("patrimonio/patrimonio.csv", 'titulo,descripcion,zona\nUno,"dos\nlíneas",N\n')
    o = loaders.LoaderOptions(str(tmp_path), include_attachments=True)
    rows = {r.id: r for r in loaders.load(spark, "all", o).collect()}
    assert set(rows) == {"academia_consultations:1", "academia_consultations:2", "academia_dictionary:gofio", "canariwiki:7", "canariwiki:3", "corpecan:GC-1", "corpecan:TF-2", "gevic:5", "patrimonio:1"}
    assert rows["academia_consultations:1"].text == "Pregunta: ¿q?\nRespuesta: r" and rows["academia_dictionary:gofio"].attachments[0].modality == "image"
    wiki, recording = json.loads(rows["canariwiki:3"].metadata), json.loads(rows["corpecan:GC-1"].metadata)
    assert rows["canariwiki:3"].title == "Sin" and wiki["url"] == "u" and wiki["raw"]["pageid"] == 9
    assert rows["corpecan:GC-1"].title == "Agaete, GC" and recording["raw"] == {"x": [1]} and recording["metadata"]["id"] == 1 and recording["visible_metadata"]["location"] == "Agaete"
    assert rows["canariwiki:7"].title == "Título" and rows["corpecan:GC-1"].attachments[0].path.endswith("a.mp3") and rows["corpecan:TF-2"].title == "TF-2"
    assert rows["gevic:5"].text == "crudo" and rows["gevic:5"].title == "Geografía" and rows["patrimonio:1"].text == "Uno\ndos\nlíneas"
    with pytest.raises(ValueError):
        loaders.get_loader("none")
    with pytest.raises(ValueError):
        loaders.load(spark, [], o)
    sinks.write_records(loaders.load(spark, "all", o), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/all")).count() == 9


def test_documents(spark, tmp_path):
    for name, text in {"a.jsonl": '{"id": 1, "title": "T", "text": " x  y "}\n{bad\n\n{"name": "N", "k": 2, "z": true, "l": [1]}\n', "b.json": '[{"content": "c"}, {"text": ""}]', "c.csv": "question,answer\nq,r\n", "d.txt": "uno\n dos", "e.md": " ", "f.bin": "no"}.items():
        (tmp_path / "gevic").mkdir(exist_ok=True)
        (tmp_path / "gevic" / name).write_text(text, encoding="utf-8")
    got = {(r.title, r.text) for r in documents.read_knowledge(spark, str(tmp_path)).collect()}
    ids = {r.title: r.doc_id for r in documents.read_knowledge(spark, str(tmp_path)).collect()}
    assert ids["N"] == "a:4" and ids["q"] == "c:1" and ids["T"] == "1"
    assert got == {("T", "x y"), ("N", "k: 2 z: true"), ("b", "c"), ("b", "text:"), ("q", "r"), ("d", "uno dos")}
    with pytest.raises(FileNotFoundError):
        documents.read_knowledge(spark, str(tmp_path / "none"))


def test_fuzzy_links_shuffle_no_text_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(dedup, "MOST_TASKS", 2)
    rows = [(i, f"palabra{i % 9} otra cosa larga numero{i % 7}") for i in range(40)]
    links = dedup.fuzzy_links(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    want = {(i, j) for i, t in rows for j, u in rows if i < j and t != u and dedup.token_set_ratio(" ".join(sorted(set(t.split()))), " ".join(sorted(set(u.split())))) >= 95}
    assert {tuple(r) for r in links.collect()} == want


def test_files_are_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    """No file is listed on the driver; long files of lines are read in parts, whatever ends their lines."""
    monkeypatch.setattr(files, "RANGE", 7)
    told = {"a b/ñ.jsonl": b"one\r\ntwo\rthree\n\nlonger line here\nend", "c.jsonl": b"1234567\n\r\n123456\r\n8\n", "d.jsonl": b"", "x=1/_e=2/f.jsonl": b"abcdef\nabcdefg\n", ".h/g.jsonl": b"no", "_i.jsonl": b"no", "j.txt": b"k"}
    for name, data in told.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(data)
    every = files.listed(spark, str(tmp_path / "t"))
    seen = {k: v for k, v in told.items() if v != b"no"}
    assert {(r.path, r.size) for r in every.collect()} == {(f"file:{tmp_path}/t/{k}", len(v)) for k, v in seen.items()}
    got = {(r.path, r.line, r.value) for r in files.lines(every.where("path like '%.jsonl'")).collect()}
    assert got == {(f"file:{tmp_path}/t/{k}", n, x.decode()) for k, v in seen.items() if k != "j.txt" for n, x in enumerate(v.replace(b"\r\n", b"\n").replace(b"\r", b"\n").removesuffix(b"\n").split(b"\n") if v else [], 1)}
    by_spark = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "t")).select(F.col("_metadata.file_path").alias("path")).distinct()
    assert {unquote(r.path) for r in by_spark.collect()} == {r.path for r in every.where("size > 0").collect()}


def test_documents_of_many_files(spark, tmp_path, monkeypatch):
    """The plan scans no text files by name: a table of paths does."""
    (tmp_path / "gevic").mkdir()
    for i in range(20):
        (tmp_path / "gevic" / f"{i}.txt").write_text(f"t {i}")
    df = documents.read_knowledge(spark, str(tmp_path))
    assert not [p for p in df.inputFiles() if p.endswith(".txt")] and {(r.doc_id, r.text) for r in df.collect()} == {(str(i), f"t {i}") for i in range(20)}


def test_pages(spark):
    def one(parser, page):
        return spark.createDataFrame([(page, "https://a.es/x/")], "h string, u string").select(parser(F.col("h"), F.col("u")).alias("r")).first().r

    assert [r.idcon for r in one(pages.encyclopedia_index, '<a href="mostrar_contenidos.php?idcon=5">Uno</a><a href="mostrar_contenidos.php?idcon=5">Dos</a><a href="otra">x</a>')] == ["5"]
    art = one(pages.encyclopedia_article, '<div id="tamano"><p class="epigrafe">Título</p><p>Uno <b>dos</b></p><td class="texto">pie</td><img src="i.jpg"><img src="fotos/fondo_marino.jpg"><img src="/imagenes/espacio.gif"><img src="Imprimir.gif"></div>')[0]
    assert (art.title, art.text, art.image_urls) == ("Título", "Uno dos\nImage caption: pie", ["https://a.es/x/i.jpg", "https://a.es/x/fotos/fondo_marino.jpg"])
    entries = one(pages.dictionary_entries, '<h3><a href="/palabra/gofio">gofio</a></h3><p>Harina. 12</p><h5>x</h5><h3><a href="/palabra/baifo">baifo</a></h3><p>Cría</p><footer>f</footer>')
    assert [(e.word, e.definitions_text) for e in entries] == [("gofio", "Harina."), ("baifo", "Cría")]
    assert one(pages.consultation_page, '<main><div class="box">¿Q?</div><div class="box"><div>R <b>s</b></div> t</div><a class="badge">léxico</a></main>')[0].answer == "R s t"
    assert one(pages.consultation_list, '<table><tr><td><a href="/c/1">v</a></td><td><p>¿Q?</p><a class="badge x">k</a></td></tr></table>')[0].categories == ["k"]
    df = spark.createDataFrame([(["Mujer", "30 años", "[t1] x", "1999", "12:30", "Hombre"],)], "v array<string>")
    m = df.select(pages.ficha_metadata(F.col("v")).alias("m")).first().m
    assert (m.gender, m.age, m.topics, m.year, m.duration) == ("Mujer", "30 años", ["[t1] x"], "1999", "12:30")


def test_compact_metadata(spark):
    df = spark.createDataFrame([('{"raw": 1, "a": {"raw": 2, "b": [{"raw": 3, "c": 4}]}}',), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(sinks.compact_metadata(F.col("m"))).collect()] == ['{"a": {"b": [{"c": 4}]}}', "x", None]


def test_stream(spark, tmp_path):
    from telar.streaming import cleaning

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id":"a","source":"s","text":"<p>x</p> .","loaded_at":"2024-01-01T00:00:00Z"}\n{"id":"a","source":"s","text":"<p>x</p> .","loaded_at":"2024-01-01T00:10:00Z"}\n')
    stream = cleaning.clean_stream(spark, str(tmp_path / "in"), "id string, source string, text string, loaded_at timestamp")
    cleaning.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [(r.text, r.dirty_score) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("x.", 16)]


def test_read_chats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "messages": [{"role": "user", "content": "q"}], "metadata": {"split": "train"}}\n\n{bad\n{"messages": [{"role": "user", "content": "r"}]}\n')
    rows = dataset.read_chats(spark, str(tmp_path))
    assert [(r.line, r.example_id, r.split) for r in rows.orderBy("line").collect()] == [(1, "x", "train"), (4, "a:4", None)]
    assert {r.example_id: r.split for r in dataset.sft_examples(rows, order=["path", "line"]).collect()}["x"] == "train"


def test_lines_of_a_split_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"messages": [{"role": "user", "content": f"{i} {'x' * (i % 50)}"}]}) + "\n" for i in range(3000)))
    (tmp_path / "b.jsonl").write_text('{"messages": []}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = dataset.read_chats(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3001 and all(r.example_id == f"a:{int(r.messages[0].content.split()[0]) + 1}" for r in rows if r.messages)


def test_interviews(spark, tmp_path):
    folder = tmp_path / "fichas" / "GC-1"
    folder.mkdir(parents=True)
    (folder / "transcript.txt").write_text("E1: ¿Y eso?\nI1: Pues nada.")
    (folder / "metadata.json").write_text(json.dumps({"id": 4, "slug": "s", "source": "corpecan", "url": "u", "visible_metadata": {"code": "GC-9", "age": "80 años"}, "islands": [{"name": "Gran Canaria"}], "audio": [{"id": 5}]}))
    (tmp_path / "fichas" / "sin").mkdir()
    row = dataset.qa_dataset(dataset.interviews(spark, str(tmp_path))).first()
    meta = json.loads(spark.createDataFrame([row], dataset.qa_dataset(dataset.interviews(spark, str(tmp_path))).schema).select(F.to_json("metadata").alias("m")).first().m)
    assert (row.id, row.question, row.answer) == ("corpecan:GC-9:0001", "¿Y eso?", "Pues nada.") and meta["audio"] == [{"id": 5}] and meta["slug"] == "s" and meta["islands"] == ["Gran Canaria"]
    with pytest.raises(FileNotFoundError):
        dataset.interviews(spark, str(tmp_path / "none"))


def test_rag_rows(spark):
    kind = "example_id string, messages array<struct<role:string,content:string>>, split string, metadata string"
    rows = [("a", [("user", "q")], "test", '{"author": "x", "split": "test"}'), ("a", [("user", "q")], None, None), ("b", [], "train", None), ("conv-7", [("user", "q")], "", "{}")]
    kept = dataset.rag_examples(spark.createDataFrame(rows, kind))
    assert sorted((r.example_id, r.split) for r in kept.collect()) == [("a", "test"), ("a", "validation"), ("conv-7", "train")]
    meta = [json.loads(r.m) for r in sinks.augmented_rows(kept).select(F.to_json("metadata").alias("m")).collect()]
    assert {"author": "x", "split": "test", "rag_augmented": True} in meta
    stages = dataset.two_stages(kept, kept.where("split = 'test'"))
    assert sorted((r.stage, r["count"]) for r in stages.groupBy("stage").count().collect()) == [(1, 3), (2, 1)]


def test_page_helpers(spark):
    raw = ['{"title": "F", "imageinfo": [{"url": "u", "mime": "image/png", "size": 3}]}', '{"title": "F"}', "x"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [r.i and r.i.url for r in df.select(pages.image_info(F.col("raw")).alias("i")).collect()] == ["u", None, None]
    page = spark.createDataFrame([('código GC-00000012 {"lat": "28.1", "lng": -15.2}',)], "h string").select(pages.recording_code(F.col("h")).alias("c"), pages.coordinates(F.col("h")).alias("g")).first()
    assert page.c == "GC-00000012" and (page.g.lat, page.g.lng) == (28.1, -15.2)
    assert sorted(r.batch for r in pages.batched(spark.range(7), 3, "id").collect()) == [0, 0, 0, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        pages.batched(spark.range(1), 0, "id")
