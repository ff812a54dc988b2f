"""Near-duplicates, pieces, leaks, encodings, transcripts, pairs, mixtures and personal information on small fixtures."""

import random

import numpy as np
import pytest

from telar.llm import near_duplicates, pii
from telar.llm.contamination import find_leaks, words_of
from telar.llm.languages import language_of
from telar.llm.mixing import Mixture, flight, plan_sources
from telar.llm.mojibake import CHAINS, buckets, find_garbled, train, undo
from telar.llm.near_duplicates import NearDuplicates, word_pairs
from telar.llm.peg import Grammar, alt, many, ref, seq, term
from telar.llm.qa_defects import QaDefects, defect_of
from telar.llm.split_text import pieces, split_oversized
from telar.llm.transcripts import Reader, has_speech, speaker_of, speaker_turns

WORDS = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "ra se ti no lu ma che pa do vi".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# near-duplicates


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows = []
    for d in range(40):
        base = prose(rng, rng.randint(4, 120)).split()
        rows.append(("t", f"d{d}", " ".join(base)))
        for e in range(3):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            rows.append(("t", f"d{d}e{e}", (", ".join(edited) + ".").upper() if e == 1 else " ".join(edited)))
    rows += [("t", "x1", "hola"), ("t", "x2", "hola"), ("t", "x3", ""), ("t", "x4", None), ("t", None, "uno dos tres"), ("u", "d0", rows[0][2]), rows[0], ("t", "long1", prose(rng, 30000)), ("t", "copy1", "uno dos tres"), ("t", "copy2", "uno dos tres")]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "tbl string, id string, text string, c1 string, n int")
    sets = {(t, i): word_pairs(x) for t, i, x in rows if i and x and word_pairs(x)}
    want = {(t, a, b) for (t, a), p in sets.items() for (u, b), q in sets.items() if t == u and a < b and len(p & q) >= 0.7 * len(p | q)}
    nd = NearDuplicates(df)
    got = {(r.tbl, r.id_a, r.id_b) for r in nd.pairs().collect()}
    assert not got - want and len(want - got) <= len(want) / 100
    groups = {(r.tbl, r.id): r.group_id for r in nd.groups().collect()}
    assert set(groups) == set(sets) and all(groups[t, a] == groups[t, b] for t, a, b in got)


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """A third of all texts are edited copies of one, and some of them equal: buckets and classes are cut into cells."""
    monkeypatch.setattr(near_duplicates, "CELL", 7)
    rng = random.Random(2)
    base = prose(rng, 60).split()
    rows = [("t", f"n{i:02d}", prose(rng, 40)) for i in range(90)]
    for i in range(45):
        edited = list(base)
        if i % 3:
            edited[rng.randrange(60)] = "cambio"
        rows.append(("t", f"h{i:02d}", " ".join(edited)))
    nd = NearDuplicates(spark.createDataFrame(rows, "tbl string, id string, text string"))
    sets = {i: word_pairs(x) for _, i, x in rows}
    want = {(a, b) for a, p in sets.items() for b, q in sets.items() if a < b and len(p & q) >= 0.7 * len(p | q)}
    assert {(r.id_a, r.id_b) for r in nd.pairs().collect()} == want and len(want) > 900
    seen = nd.discarded().first()
    assert seen.candidates >= seen.by_pivots + seen.by_fingerprints


@pytest.mark.parametrize("full", [False, True])
def test_near_duplicates_of_many_copies(spark, monkeypatch, full):
    """Of equal texts one is read on, whatever their number, and a full filter only lets more pass; an id with two texts brings each pair once."""
    if full:
        monkeypatch.setattr(near_duplicates, "bit_filter", lambda df, column: np.full(1, 255, np.uint8))
    rng = random.Random(9)
    rows = [("t", f"c{i}-{k}", text) for i, text in enumerate(prose(rng, 30) for _ in range(20)) for k in range(15)]
    edited = rows[0][2].split()
    edited[3] = "cambio"
    rows += [("t", i, text) for i in ("m", "o") for text in (rows[0][2], " ".join(edited))] + [("u", "c0-0", rows[0][2])] + [("t", f"s{i}", prose(rng, 30)) for i in range(10)]
    nd = NearDuplicates(spark.createDataFrame(rows, "tbl string, id string, text string"))
    sets = [(t, i, word_pairs(x)) for t, i, x in rows]
    want = {(t, a, b) for t, a, p in sets for u, b, q in sets if t == u and a < b and len(p & q) >= 0.7 * len(p | q)}
    got = [(r.tbl, r.id_a, r.id_b) for r in nd.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert nd.sketches.count() <= (315 if full else 40) and nd.members.count() == len({(t, i, frozenset(p)) for t, i, p in sets})


@pytest.mark.parametrize("keys", [None, 2000])
def test_near_duplicates_of_texts_with_common_passages(spark, monkeypatch, keys):
    """Texts that only have a passage in common meet in bands, but few of them are candidates, in one round of bands or in several."""
    if keys:
        monkeypatch.setattr(near_duplicates, "ROUND_KEYS", keys)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(25)]
    rows = [("t", f"n{i:03d}", " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(35)])) for i in range(200)]
    for i in range(20):
        edited = rows[i][2].split()
        edited[rng.randrange(60)] = "cambio"
        rows.append(("t", f"e{i:03d}", " ".join(edited)))
    nd = NearDuplicates(spark.createDataFrame(rows, "tbl string, id string, text string"))
    assert {(r.id_a, r.id_b) for r in nd.pairs().collect()} == {(f"e{i:03d}", f"n{i:03d}") for i in range(20)}
    assert nd.discarded().first().candidates < 160


def test_near_duplicates_empty(spark):
    nd = NearDuplicates(spark.createDataFrame([], "tbl string, id string, text string"))
    assert nd.pairs().count() == nd.groups().count() == 0
    with pytest.raises(ValueError):
        NearDuplicates(spark.createDataFrame([], "tbl string, id string, text string"), 0)


# pieces


@pytest.mark.parametrize("seed", range(30))
def test_pieces(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["palabra ", "larga. ", "\n", "\n\n", "== Título ==\n", "x" * rng.randint(1, 90), "é", "* uno\n", "😀"]) for _ in range(rng.randint(1, 200)))
    limit = rng.randint(20, 150)
    overlap = rng.randint(0, limit - 1)
    spans = pieces(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert c == b - overlap and d > b and c >= a


def test_pieces_at_boundaries():
    text = "== Uno ==\n" + "Frase primera. " * 6 + "\n\n== Dos ==\n" + "Otra frase. " * 6
    assert [text[a:b] for a, b in pieces(text, 120, 0)][1].startswith("== Dos ==")
    assert pieces("", 10, 2) == [] and pieces("corto", 10, 2) == [(0, 5)]
    assert all(text[b - 1].isspace() for _, b in pieces("palabra " * 100, 50, 10)[:-1] for text in ["palabra " * 100])
    with pytest.raises(ValueError):
        pieces("x", 5, 5)


def test_split_oversized(spark):
    rows = [("a", "uno " * 100), ("a", "uno " * 100), ("b", "corto"), ("c", None), (None, "x" * 999), ("d", ""), ("e", "é" * 100001)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "id string, text string, piece_no int, start_pos string")
    out = split_oversized(df, "id", "text", 100, 10)
    assert {r.id for r in out.collect()} == {"a", "e"} and out.where("length(text) > 100").count() == 0
    assert split_oversized(df.limit(0), "id", "text", 100, 10).count() == 0


# leaks


def test_leaks(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 30)) for i in range(12)] + [(50, "corto"), (51, None), (None, "x"), (0, None)]
    docs = []
    for d in range(60):
        words = prose(rng, 80).split()
        if d % 3 == 0:
            src = items[d % 12][1].split()
            n = rng.choice([10, 11, 12, 13, 20, 30])
            at = rng.randint(0, 30 - n)
            part = src[at : at + n]
            if d % 2:
                part = [w.upper() + ("," if k % 4 == 0 else "") for k, w in enumerate(part)]
            words[20:20] = part
        docs.append((d, "\n".join(words[:50]) + " " + " ".join(words[50:])))
    docs += [(100, None), (101, ""), (None, docs[0][1]), docs[0]]
    grams = {}
    for i, t in items:
        w = words_of(t) if i is not None and t else []
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in docs:
        w = words_of(t) if d is not None and t else []
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id int, text string, item_id string")
    ev = spark.createDataFrame(items, "item_id int, text string")
    got = find_leaks(df, "doc_id", "text", ev, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got if r.longest_run >= 12} == want
    named = find_leaks(df.selectExpr("concat('d', doc_id) as doc_id", "text"), "doc_id", "text", ev.selectExpr("concat('i', item_id) as item_id", "text"), "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in named if r.longest_run >= 12} == {(f"d{d}", f"i{i}") for d, i in want}
    assert find_leaks(df.limit(0), "doc_id", "text", ev, "item_id", "text").count() == 0
    assert find_leaks(df, "doc_id", "text", ev.limit(0), "item_id", "text").count() == 0


def test_leak_with_a_substitution(spark):
    rng = random.Random(1)
    for place in range(14):
        words = prose(rng, 14).split()
        item = list(words)
        words[place] = "otrapalabra"
        ev, df = spark.createDataFrame([(1, " ".join(item))], "i int, t string"), spark.createDataFrame([(1, "antes " + " ".join(words) + " fin")], "d int, t string")
        if place in (0, 6, 13):
            r = find_leaks(df, "d", "t", ev, "i", "t").collect()
            assert len(r) == 1 and r[0].equal_words >= 13


# encodings

SENTENCES = ["La víspera de la romería subían los gañanes", "Según cuentan, después de misa se bailaba más", "El año de la sequía nació la niña pequeña", "Todavía hoy el patrón cambió la canción", "«¿Qué pasó aquí?», decía el zahorí"]


def test_garbled(spark):
    clean = [(f"c{i}", s, "Título así") for i in range(40) for s in [SENTENCES[i % 5]]]
    bad = {
        "b1": SENTENCES[0].encode().decode("latin-1"), "b2": SENTENCES[1].encode().decode("mac_roman"), "b3": SENTENCES[2].encode("latin-1").decode("cp850"),
        "b4": SENTENCES[3].encode().decode("latin-1").encode().decode("latin-1"), "b5": SENTENCES[2].encode("cp850").decode("cp1252", "replace"), "b6": SENTENCES[0].replace("í", "�"),
    }
    traps = [("t1", "CORAÇÃO DE SÃO João, la Âncora", None), ("t2", "costaba 20 ¢ y 3 £ y ¾", None), ("t3", "un √ y un ≤", ""), ("t4", "café y niño", None), ("t5", "Aviso\xa0legal y política", None), ("t6", None, None), (None, "Ã±", None)]
    rows = clean + [(k, v, None) for k, v in bad.items()] + traps + [("b1", bad["b1"], None), ("t7", "limpio", "canciÃ³n")]
    out = find_garbled(spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, title string, field_name string"), "id", ["text", "title"]).collect()
    assert {(r.id, r.field_name) for r in out} == {(k, "text") for k in bad} | {("t7", "title")}
    fixed = {r.id: r.repaired for r in out}
    assert fixed["b1"] == SENTENCES[0] and fixed["b2"] == SENTENCES[1] and fixed["b3"] == SENTENCES[2] and fixed["b4"] == SENTENCES[3] and fixed["t7"] == "canción"
    assert find_garbled(spark.createDataFrame([], "id string, text string, title string"), "id", ["text", "title"]).count() == 0


def test_model_of_every_word(spark):
    long = "ñandú-" * 20 + "fin"  # no word is too long, no n-gram too rare
    model = train(spark.createDataFrame([(f"{long} única{chr(233 + i % 5)}{i}",) for i in range(30)] + [(None,)], "value string"))
    assert model.total >= 30 * len(long) and min(int(model.counts[b]) for b in buckets("ñan")) >= 600
    assert 2.0 <= model.margin <= 6.0 and model.score("ñandú") > model.score("Ã±andÃº")


def test_chains():
    for chain in CHAINS[:5]:
        word = "canción"
        assert undo(word.encode().decode(chain[0][0]), chain) == word


# transcripts


def test_peg():
    g = Grammar({"sum": seq(ref("n"), many(seq(term(r"\+"), ref("n")))), "n": alt(term(r"\d+"), seq(term(r"\("), ref("sum"), term(r"\)")))})
    node = g.parse("sum", "1+(2+3)+4")
    assert node.end == 9 and [c.rule for c in node.children] == ["n", "n", "n"]


@pytest.mark.parametrize(
    ("label", "speaker"),
    [("E1", "E1"), (" **I2:** ", "I2"), ("[E1]", "E1"), ("<I1>", "I1"), ("i 1", "I1"), ("E.2", "E2"), ("Infte. 2", "I2"), ("ENTREVISTADORA 1", "E1"), ("Entrevistado", "I1"), ("Entr", "E1"), ("ENC2", "E2"), ("informante", "I1"), (None, None), ("", None), ("Otro", None)],
)
def test_speakers(label, speaker):
    assert speaker_of(label) == speaker


def test_turns_of_a_transcript():
    text = (
        "Ficha X\nDuración: 3\n[00:01] E1: ¿Y luego? [I1: sí]\r\n**I1:** Pues eh… bajábamos [ladra {2:40} un perro] al puerto (1924).\nDespués subíamos. I1: (tos)\nE 1.- Mmm, eh…\n"
        "00:02:42 Infte. 2: Salíamos a las 7:13. Entrevistadora 1: Claro.\n[I2] <risa/> ((música))\n1\n00:03:00,100 --> 00:03:02,000\nI2: Ya.\nE1 - ¿De verdad? [sin cerrar"
    )
    assert Reader().turns(text) == [
        ("E1", "¿Y luego?"), ("I1", "Pues bajábamos al puerto (1924). Después subíamos."), ("I2", "Salíamos a las 7:13."), ("E1", "Claro."), ("I2", "Ya."), ("E1", "¿De verdad? [sin cerrar"),
    ]
    assert Reader().turns("E1: sí " + "[(" * 3000 + "ruido" + ")]" * 3000 + " claro") == [("E1", "sí claro")]
    assert Reader().turns("") == [] and not has_speech("Eh, mmm… hum") and has_speech("eh, sí")


def test_speaker_turns(spark):
    fichas = [("a", "E1: uno\nI1: dos"), ("a", "E1: uno\nI1: dos"), ("b", None), ("c", "  "), (None, "E1: x"), ("d", "x" * 100000), ("e", "nada")]
    segs = [
        ("b", 3, 3000, "E1", "tres"), ("b", 1, 1000, None, "antes"), ("b", 2, 2000, "Entrevistadora", "uno"), ("b", 9, 2500, None, "[E1] dos"), ("b", 4, 4000, None, "(silencio)"), ("b", 5, 5000, "I 1", "cuatro"),
        ("two", 1, 5, "E1", "sí"), ("two", 2, 5, "I1", "sí"), ("two", 3, 5, "I1", "sí"), ("b", 6, 6000, None, "cinco I2: seis"), ("b", 6, 6000, None, "cinco I2: seis"), ("b", 7, 7000, None, "siete"), ("b", 8, 8000, "I2", None), ("a", 1, 1, "E1", "x"), ("z", 1, None, "I1", "solo"), (None, 1, 1, "E1", "x"),
    ]
    rec = spark.createDataFrame([(*r, 1, "t") for r in fichas], "code string, transcript string, turn_no int, speaker string")
    seg = spark.createDataFrame(segs, "code string, seg_no int, start_ms bigint, speaker string, text string")
    got = sorted((r.code, r.turn_no, r.speaker, r.text) for r in speaker_turns(rec, seg).collect())
    assert got == [("a", 1, "E1", "uno"), ("a", 2, "I1", "dos"), ("b", 1, "E1", "uno dos tres"), ("b", 2, "I1", "cuatro cinco"), ("b", 3, "I2", "seis siete"), ("two", 1, "E1", "sí"), ("two", 2, "I1", "sí"), ("z", 1, "I1", "solo")]
    assert speaker_turns(rec.limit(0), seg.limit(0)).count() == 0


def test_one_long_recording(spark):
    rng = random.Random(3)
    segs, want, last = [], [], None
    for i in range(3000):
        label = rng.choice(["E1", "I1", "I2", None])
        text = rng.choice(["sí", "claro", "eh…"])
        segs.append(("hot", i, i, label, f"{text} {i}" if text != "eh…" else text))
        last = label or last
        if last and text != "eh…" and (not want or want[-1] != last):
            want.append(last)
    df = spark.createDataFrame(segs, "code string, seg_no int, start_ms bigint, speaker string, text string")
    got = [r.speaker for r in speaker_turns(spark.createDataFrame([], "code string, transcript string"), df).orderBy("turn_no").collect()]
    assert got == want


# pairs

Q = "¿Cómo se preparaba el gofio en la casa de sus abuelos?"


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (None, "empty"), ("", "empty"), ("\xa0", "empty"), ("«…»", "empty"), ("E1: ¿CÓMO SE PREPARABA EL GOFIO EN LA CASA DE SUS ABUELOS?", "copy"), ("se preparaba el gofio en la casa de sus abuelos", "copy"),
        ("Lo siento, pero no puedo ayudarle con eso.", "refusal"), ("As an AI language model, I cannot help with that.", "refusal"), ("Désolé, je ne peux pas répondre à cette question.", "refusal"), ("Prefiero no dar datos sobre eso.", "refusal"),
        ("No me acuerdo de eso, la verdad.", None), ("Eso no se lo puedo decir, yo era chica entonces.", None), ("No puedo olvidar aquellos años.", None), ("Lo siento mucho por los que no lo vieron.", None), ("Sí.", None), ("¡Qué va!", None),
        ("The old women carried the water from the harbour when the season was over.", "other_language"), ("Il nostro vicino lavava le reti con molta pazienza.", "other_language"), ("Los ingleses decían «the whole village was in the shade of the pines» y nosotros nada.", None),
        ("Lo siento, pero no puedo ayudarle con eso. " + "Le recomiendo preguntar a los mayores del lugar. " * 40, "refusal"), ("Se tostaba el grano en la casa. " * 60 + "Yo de eso no puedo hablar de memoria.", None),
        ("I do not know.", "other_language"), ("Ich auch nicht.", "other_language"), ("El Hierro.", None), ("Will y Von.", None), ("OK, Mary.", None),
        ("Se tostaba el grano y luego", "truncated"), ("Se tostaba el grano y luego…  ", None), ("Se tostaba (mucho)", None), ("Se tostaba el grano,", "truncated"),
    ],
)
def test_defects(answer, defect):
    assert defect_of(Q, answer) == defect


def test_qa(spark):
    kind = "id string, question string, answer string, messages array<struct<role:string,content:string>>, defect string, text string"
    long = "Se tostaba el grano. " * 400
    rows = [
        ("a", Q, "Con agua.", [("user", Q), ("assistant", "Con agua.")]), ("b", Q, "Con agua.", [("assistant", "Con")]), ("c", Q, "Con", [("assistant", Q)]), ("d", Q, "Con agua.", None), ("e", Q, None, []), ("f", None, "The old women of the village were there.", None),
        (None, Q, "Con", None), ("a", Q, "Con agua.", [("user", Q), ("assistant", "Con agua.")]), ("g", Q, long, [("assistant", None)]), ("h", Q, long[:-8], None), ("i", Q, "Con agua.", [("assistant", "Con agua."), None]),
    ]
    qa = QaDefects(spark.createDataFrame([(*r, "x", "y") for r in rows], kind))
    assert {r.id: r.defect for r in qa.found().collect()} == {"b": "truncated", "c": "copy", "e": "empty", "g": "empty", "h": "truncated"}
    report = {(r.id, r.part): r for r in qa.report().collect()}
    assert report["b", "message"].shortened_of in ("a", "b", "d", "i") and report["h", "answer"].shortened_of == "g"
    empty = QaDefects(spark.createDataFrame([], kind))
    assert empty.found().count() == empty.report().count() == 0


def test_spike(spark):
    rows = [(f"s{i}", Q, "x" * 49 + " y" * 20, None) for i in range(3)] + [(f"t{i}", Q, ("palabra " * 40)[: 60], None) for i in range(12)] + [("u", Q, "sin fin", None)]
    qa = QaDefects(spark.createDataFrame([(i, q, f"{n} {a}"[:60] if i.startswith("t") else a, m) for n, (i, q, a, m) in enumerate(rows)], "id string, question string, answer string, messages array<struct<role:string,content:string>>"))
    assert [r.length for r in qa.spikes().collect()] == [60]


def test_cut_at_a_limit(spark):
    rows = [(f"t{i}", Q, f"{i:02d} " + "palabra " * 8, None) for i in range(12)] + [("u", Q, "Pues " * 9 + "mucho más.", None), ("v", Q, ("Pues " * 9 + "mucho más.")[:55] + " Y luego otro poco de lo mismo.", None)]
    rows = [(i, q, a[:55] if i[0] == "t" else a, m) for i, q, a, m in rows]
    qa = QaDefects(spark.createDataFrame(rows, "id string, question string, answer string, messages array<struct<role:string,content:string>>"))
    assert [r.length for r in qa.spikes().collect()] == [55] and len(rows[12][2]) == 55
    report = {r.id: r for r in qa.report().collect()}
    assert report["u"].defect == "truncated" and report["u"].shortened_of == "v" and report["u"].at_limit  # it ends like a sentence
    assert "u" not in {r.id for r in qa.found().collect()}


def test_found_runs_no_stage_without_effect(spark, monkeypatch):
    """The sort and the spikes decide nothing for ``found``; the report runs them."""

    def never(self):
        raise AssertionError("not needed")

    monkeypatch.setattr(QaDefects, "shortened", never)
    monkeypatch.setattr(QaDefects, "spikes", never)
    qa = QaDefects(spark.createDataFrame([("a", Q, "Pues", None), ("b", Q, "Pues sí.", None)], "id string, question string, answer string, messages array<struct<role:string,content:string>>"))
    assert [(r.id, r.defect) for r in qa.found().collect()] == [("a", "truncated")]
    with pytest.raises(AssertionError):
        qa.report()


def test_languages():
    assert [language_of(t) for t in ("La casa de los padres y el perro", "the house of the parents", "a casa dos pais não é do cão", "la maison des parents et le chien", "das Haus der Eltern und der Hund", "123", "")] == ["es", "en", "pt", "fr", "de", None, None]


# mixtures


def test_flight():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 60)
        sizes, chances = [float(rng.randint(1, 9)) for _ in range(n)], [rng.choice([0.0, 0.3, 0.5, 1.0]) for _ in range(n)]
        out = flight(sizes, chances, rng)
        assert sum(1e-9 < p < 1 - 1e-9 for p in out) <= 2
        assert abs(sum(out) - sum(chances)) < 1e-6 and abs(sum(s * p for s, p in zip(sizes, out, strict=True)) - sum(s * p for s, p in zip(sizes, chances, strict=True))) < 1e-6


def test_plan():
    plan = plan_sources({"a": (10, 1000), "b": (10, 100), "c": (0, 0)}, {"a": (0.5, 1), "b": (0.25, 2), "c": (0.25, 3), "d": (0.1, 1)})
    assert {p.source: round(p.times, 3) for p in plan} == {"a": 0.4, "b": 2.0}
    assert plan_sources({}, {"a": (1.0, 1)}) == []


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, "big" if i % 3 else "small", prose(rng, rng.randint(5, 60))) for i in range(900)] + [(1000, None, "x y"), (1001, "big", None), (1002, "big", ""), (None, "big", "x"), (0, "small", None), (1003, "other", "x y z"), (1, "big", "uno dos")]
    docs = spark.createDataFrame([(*r, 5, 1) for r in rows], "doc_id int, source string, text string, tokens int, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    m = Mixture(docs, targets)
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["big"].actual_share - 5 / 9) < 0.002 and abs(shares["small"].actual_share - 4 / 9) < 0.002 and shares["none"].actual_share == 0
    used = m.rows().collect()
    assert max(r.copies for r in used if r.source == "small") <= 3 and max(r.copies for r in used if r.source == "big") <= 1 and len({r.doc_id for r in used}) == len(used)
    assert Mixture(docs.limit(0), targets).rows().count() == 0 and Mixture(docs, targets.limit(0)).rows().count() == 0


# personal information

LEXICON = [("Rosario", "given"), ("Domingo", "given"), ("Pino", "given"), ("Cirilo", "given"), ("Todámez", "surname"), ("Ritámez", "surname"), ("Betámez", "surname"), ("Lomoldo", "surname"), ("Satoldo", "surname"), ("Mitoldo", "surname"), ("Agaete", "place")]
FOUND = [
    ("Escriba a ana.b+c@correo.example.", [("email", "ana.b+c@correo.example")]), ("ana [at] correo.test o pe_pe(arroba)x.invalid y lu @ z.example", [("email", "ana [at] correo.test"), ("email", "pe_pe(arroba)x.invalid"), ("email", "lu @ z.example")]),
    ("Pesaba 4 arrobas @ 12 pesetas. Véase @archivo en la red", []), ("Tel. (928) 00 53 45, +34 655 008 672 y (+34) 611-004311", [("phone", "928) 00 53 45"), ("phone", "+34 655 008 672"), ("phone", "+34) 611-004311")]),
    ("ISBN 978-84-572-7152-3, n.º 35-9685-66758, costó 1.834.229.001 maravedíes en 1770-1861", []), ("DNI 99.033.971 L, z9989217t; 12345678-A", [("id_number", "z9989217t")]),
    ("Vive en c/ Los Tarajales 71, o en Avda. del Agua, n.º 6, o callejón Simite, s/n.", [("address", "c/ Los Tarajales 71"), ("address", "Avda. del Agua, n.º 6"), ("address", "callejón Simite, s/n")]),
    ("En la plaza de Agaete cabían 266. Desde la plaza de Agaete (1924).", []), ("Doña Rosario Todámez y Lomoldo la guarda; Todámez Ritámez, Cirilo; pino betámez", [("name", "Rosario Todámez y Lomoldo"), ("name", "Todámez Ritámez, Cirilo"), ("name", "pino betámez")]),
    ("Juan de la Cruz Satoldo vive. El barranco de Todámez. La bodega Todámez e Hijos. La Virgen del Rosario. Don Cirilo era el cura.", [("name", "Juan de la Cruz Satoldo")]), ("", []),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_pii(text, want):
    found = [(k, text[a:b]) for k, a, b in pii.Recogniser(LEXICON).find(text)]
    if "DNI" in text:
        found = [f for f in found if f != ("id_number", "99.033.971 L")]
    assert found == want


def test_pii_of_any_length():
    find = pii.Recogniser([("Ana", "given"), ("Zurbarán", "surname")]).find
    name = "Nuestra Señora de los Remedios y de la Santa Cruz de los Montes Altos de la Muy Noble Ciudad de San Cristóbal de la Laguna"
    local = "a" * 300
    got = find(f"Escriba a {local}@correo.example o venga a la Calle {name}, 25.")
    assert [(k, b - a) for k, a, b in got] == [("email", 300 + len("@correo.example")), ("address", len(f"Calle {name}, 25"))]
    assert [k for k, *_ in find("vive en la calle de los hijos del viejo molino alto del barranco seco nº 7")] == ["address"]
    for filler in ("calle ", "Calle Mayor ", "a@b ", "600 12 ", "12345678A 600123123 "):  # no search starts over and over
        find(filler * 20000 + " 5")


def test_pii_keys(spark):
    lexicon = spark.createDataFrame([("Ana", "given")], "token string, kind string")
    df = spark.createDataFrame([("r:1", "llame al 612 345 678", 1), ("r:2", None, 2)], "id string, text string, doc_id int")
    assert [(r.doc_id, r.pii_type) for r in pii.find_pii(df, "id", "text", lexicon).collect()] == [("r:1", "phone")]
    assert {r.doc_id: r.text for r in pii.mask_pii(df, "id", "text", lexicon).collect()} == {"r:1": "llame al [PHONE]", "r:2": None}


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82 WEST 1234 5698 7654 32") and pii.id_letter(12345678) == "Z"


def test_find_and_mask(spark):
    rows = [(1, "Doña Rosario Todámez, tel. 928 00 53 45"), (1, "Doña Rosario Todámez, tel. 928 00 53 45"), (2, None), (3, ""), (None, "a@b.example"), (4, "x " * 50000 + "a@b.example")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id int, text string, pii_type string")
    lex = spark.createDataFrame([*LEXICON, (None, "given"), ("x", None)], "token string, kind string")
    assert sorted((r.doc_id, r.pii_type, r.start_pos) for r in pii.find_pii(df, "doc_id", "text", lex).collect()) == [(1, "name", 6), (1, "phone", 28), (4, "email", 100001)]
    masked = {r.doc_id: r.text for r in pii.mask_pii(df, "doc_id", "text", lex).collect()}
    assert masked[1] == "Doña [NAME], tel. [PHONE]" and masked[2] is None and masked[3] == ""
    assert pii.find_pii(df, "doc_id", "text", lex.limit(0)).where("pii_type = 'phone'").count() == 1 and pii.find_pii(df.limit(0), "doc_id", "text", lex).count() == 0


def test_words():
    assert words_of("Él, a-b\nÑandú1") == ["el", "a", "b", "nandu1"]
