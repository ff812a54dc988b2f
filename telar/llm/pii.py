"""Personal information inside free text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm.words import fold
from telar.plans.shared import Shared

# Given names and surnames that are common in Spanish, beside those of the lexicon.
GIVEN = """
maria jose juan ana pedro luis carlos antonio manuel francisco javier miguel angel angeles carmen isabel teresa dolores pilar josefa
mercedes lucia paula laura marta elena sara julia rosa raquel cristina sofia irene silvia beatriz rafael fernando alberto jorge pablo
sergio andres diego alejandro david daniel adrian ivan oscar ruben ramon ramona enrique vicente joaquin jaime ignacio santiago jesus
tomas agustin julian salvador felipe guillermo gonzalo martin nicolas bernardo bernabe emilio felix gabriel hector hugo isidro isidora
saturnino saturnina candelaria inmaculada nieves concepcion consuelo esperanza fatima gloria guadalupe mariano mariana micaela
milagros montserrat natalia nuria olga patricia petra ricardo roberto rodrigo rogelio sebastiana susana valentin veronica victor
victoria virginia yolanda nolasco bentejui guacimara tanausu airam acaymo aday echedey idaira yaiza gara arminda zebenzui doramas
""".split()
# Second parts of given names such as Juan de la Cruz.
DEVOTIONS = "cruz pino rosario carmen pilar mar sol luz nieve nieves reyes socorro rocio paz concepcion angeles dolores remedios candelaria jesus dios valle monte fatima asuncion encarnacion milagro milagros mercedes guia salud".split()
SURNAMES = """
garcia gonzalez rodriguez fernandez lopez martinez sanchez perez gomez martin jimenez ruiz hernandez diaz moreno alvarez romero
alonso gutierrez navarro torres dominguez vazquez ramos gil ramirez serrano molina morales suarez ortega delgado castro ortiz rubio
marrero santana medina cabrera herrera quintana betancor betancort falcon bethencourt leon vega armas sosa guerra melian curbelo
""".split()
# Words that stand before or beside names without being part of them.
CUES = """
don dona d dna sr sra senor senora srta fray sor remite remitente firmado firma firmo firmante contacto informante atencion att
destinatario destinataria nombre segun con por para de del a al y e o u en el la los las lo un una su mi tu que como cuando donde sin
entre tras ante desde hasta sobre pero ni si no yo ella ellos entrevistado entrevistada testigo vecino vecina maestro maestra cura
alcalde alcaldesa autor autora direccion vive correo telefono tfno movil me se le les nos doctor doctora dr dra padre madre hermano
hermana tio tia the of and with by from for von der die das und mit le les et avec par o os as com do da dos das
""".split()
FIRM_AFTER = re.compile(r"\s*(?:,?\s*s\.?\s?[la]\.?(?!\w)|e\s+hij[oa]s|y\s+hij[oa]s|y\s+c[ií]a|&|hermanos)", re.I)
FIRM_BEFORE = re.compile(r"(?<!\w)(?:bodegas?|hijos de|viuda de|herederos de|casa|almac[eé]n(?:es)?|talleres|taller|f[aá]brica|imprenta|ferreter[ií]a|panader[ií]a|hermanos|empresa|comercial|librer[ií]a|farmacia|tienda)\s+$", re.I)
SAINT_BEFORE = re.compile(r"(?<!\w)(?:san|santa|santo|sta\.?|sto\.?|virgen(?: del?(?: l[ao]s?)?)?|nuestra señora(?: del?(?: l[ao]s?)?)?|ermita del?|iglesia del?|parroquia del?)\s+$", re.I)
PLACE_BEFORE = re.compile(r"(?<!\w)(?:barrancos?|valle|playa|monta[nñ]a|punta|cueva|fuente|lomo|caldera|puerto|pago|caser[ií]o|roque|hoya|degollada|municipio|pueblo|villa|isla|finca|cortijo|puente|molino|mirador|colegio|instituto|hospital|teatro|estadio)\s+(?:del?\s+(?:l[ao]s?\s+)?)?$", re.I)

_GAP = r"[^\S\n]*\n?[^\S\n]*"
SIGN = re.compile(r"[^\S\n]*[\[({]\s*(?:at|arroba)\s*[\])}][^\S\n]*|[^\S\n]+(?:@|arroba)[^\S\n]+|@", re.I)
LOCAL = re.compile(r"\w[\w.+%-]*\Z")
DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?(?:\.|[^\S\n]*[\[({]\s*(?:dot|punto)\s*[\])}][^\S\n]*|[^\S\n]+punto[^\S\n]+))+[^\W\d_]{2,}", re.I)
PHONE = re.compile(r"(?<![\w.+/-])(?<!\d )(\(?(?:\+34|0034)\)?[ .\xa0/-]{0,2})?(\(?[6-9]\d{2}\)?)((?:[ .\xa0/-]?\d){6})(?![\w])(?![.\xa0/-]?\d)(?! \d)")
FOREIGN_PHONE = re.compile(r"(?<![\w.+/-])(?:\+|00)(?!34)[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,11}(?![\w])(?![.-]?\d)")
DNI = re.compile(r"(?<![\w.-])(\d{8}|\d{2}\.\d{3}\.\d{3}|\d{2} \d{3} \d{3})([ \xa0]?-[ \xa0]?|[ \xa0]?)([A-Za-z])(?!\w)")
NIE = re.compile(r"(?<![\w.-])([XYZxyz])[ -]?(\d{7}|\d\.\d{3}\.\d{3})[ -]?([A-Za-z])(?!\w)")
LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])")

# Kinds of street, in full and abbreviated, with and without accents.
KINDS = """
calle c avenida avda avd av plaza plza pza pl camino cmno cno carretera ctra crta callejon urbanizacion urb paseo travesia trav
rambla rbla ronda glorieta pasaje pje psje vereda cuesta bulevar via senda poligono pol barriada bda residencial cerrada alameda
callejón urbanización travesía vía polígono
""".split()
_MUST = ("c", "pl", "pol")  # only with a stroke or full stop
_KIND = r"[^\W\d_]+(?:/|\.º|\.|(?=\s))|[Pp]\.?º"
_NUMBER = r"(?:(?:n\.?[^\S\n]?[ºo°]\.?|n[uú]m(?:\.|ero)?|#)" + _GAP + r"\d{1,4}|s/n)(?!\w)"
_PARTICLE = r"(?:de|del|la|las|el|los|y|e|d')"
_CAPITAL = r"[^\W\d_a-zà-öø-ÿ][\w'’·-]*\.?"
_SEP = r"(?:[^\S\n]+(?:\n[^\S\n]*)?|\n[^\S\n]*)"
_END = rf"(?:{_SEP}|,{_GAP})((?i:{_NUMBER})|\d{{1,4}}(?![\w]|[.,]\d)(?:-\d{{1,2}}º?)?)"
_PART = rf"(?:{_PARTICLE}(?!\w)|\d{{1,2}}(?=\s+de\s)|{_CAPITAL})"
# Words that go on with the sentence and stand in no name of a street written small.
_SENTENCE = "que|qué|cuando|donde|como|porque|pero|ni|se|no|ya|hay|había|es|era|fue|fueron|son|eran|está|estaba|vive|vivía|tiene|tenía|con|por|para|sin|hasta|desde|sobre|entre|su|sus|mi|mis|me|te|le|les|nos|lo|un|una|unos|unas|the|of|and"
_LOOSE = rf"(?!(?i:{_SENTENCE})(?![\w'’·-]))[^\W\d_][\w'’·-]*"
ADDRESS = re.compile(rf"({_KIND}){_GAP}({_PART}(?:{_SEP}{_PART})*?){_END}")
LOOSE_ADDRESS = re.compile(rf"({_KIND}){_GAP}({_LOOSE}(?:{_SEP}{_LOOSE})*?)(?:{_SEP}|,{_GAP})((?i:{_NUMBER}))")
#: As far as a name of a street may go: where one begins in vain, none that begins within its words ends in a number either.
_RUNS = (re.compile(rf"(?:{_KIND}){_GAP}{_PART}(?:{_SEP}{_PART})*"), re.compile(rf"(?:{_KIND}){_GAP}{_LOOSE}(?:{_SEP}{_LOOSE})*"))
NUMBER = re.compile(r"\d|s/n", re.I)

PHONE_YES = re.compile(r"tel[eé]f|tfno|tlf|\btel\b|m[oó]vil|llam|n[uú]mero es|contacto|whats|fax|centralita", re.I)
PHONE_NO = re.compile(r"isbn|issn|n\.\s?º|catalog|censo|cost[oó]|expediente|signatura|ref\.|registro|factura|maraved|pesetas|cabezas|habitantes|euros|€|lote|c[oó]digo", re.I)
TOKEN = re.compile(r"[^\W\d_]+")
MARKED_TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
MARK = re.compile("[\u0300-\u036f]")
DIGIT = re.compile(r"\d")


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of IBANs."""
    flat = iban.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def id_letter(number: int) -> str:
    """The check letter of DNI and NIE."""
    return LETTERS[number % 23]


class Recogniser:
    """Proposes spans by patterns, confirms them by checksums and lets nearby words settle what is left.

    ``lexicon`` has rows of token and kind (``given``, ``surname``, ``place``).  A word counts as a surname if it is listed, or if at
    least ``purity`` of the listed words that share its longest known ending are surnames.
    """

    def __init__(self, lexicon: list[tuple[str, str]], purity: float = 0.85):
        kinds: dict[str, set[str]] = {"given": set(), "surname": set(), "place": set()}
        for token, kind in lexicon:
            if token and kind in kinds:
                kinds[kind].add(fold(token.strip()))
        self.given = kinds["given"] | set(GIVEN)
        self.surnames = kinds["surname"] | set(SURNAMES)
        self.places = kinds["place"]
        self.cues = set(CUES)
        self.devotions = set(DEVOTIONS)
        self.kinds = {*KINDS, "pº", "p"}
        self.purity = purity
        yes, all_ = Counter(), Counter()
        for kind in kinds:
            for token in kinds[kind]:
                for n in range(3, 7):
                    if len(token) > n:
                        all_[token[-n:]] += 1
                        yes[token[-n:]] += kind == "surname"
        self.endings = {k: yes[k] / v for k, v in all_.items() if v >= 3}
        self._class: dict[str, str] = {}

    def kind(self, token: str) -> str:
        """``g`` given name, ``s`` surname, ``l`` looks like a surname, ``c`` cue or function word, ``p`` place, empty otherwise; ``gs`` both."""
        k = self._class.get(token)
        if k is None:
            folded = fold(token)
            k = "c" * (folded in self.cues) + "g" * (folded in self.given) + "s" * (folded in self.surnames)
            if not k:
                if folded in self.places:
                    k = "p"
                else:
                    for n in range(6, 2, -1):
                        if len(folded) > n and folded[-n:] in self.endings:
                            k = "l" if self.endings[folded[-n:]] >= self.purity else ""
                            break
            if len(self._class) < 500_000:
                self._class[token] = k
        return k

    def _names(self, text: str, toks: list[tuple[int, int]], free: Callable[[int, int], bool]) -> list[tuple[str, int, int]]:
        kinds = [self.kind(text[a:b]) for a, b in toks]
        marks = [i for i, k in enumerate(kinds) if "s" in k or "l" in k]
        if not marks:
            return []
        n, out, done = len(toks), [], -1

        def gap(i: int) -> str:  # between token i and the next
            return text[toks[i][1] : toks[i + 1][0]] if i + 1 < n else "\0"

        def near(i: int) -> bool:
            g = gap(i)
            return g.isspace() and g.count("\n") <= 1

        def capital(i: int) -> bool:
            return text[toks[i][0]].isupper()

        def surname(i: int) -> bool:
            return "s" in kinds[i] or "l" in kinds[i]

        def surnames_from(i: int) -> int:  # the index after up to two surnames, also joined by a hyphen or "y"
            j = i + 1
            if j < n and surname(j) and (near(i) or gap(i) in ("-", "‐", "–")):
                return j + 1
            if j + 1 < n and near(i) and text[toks[j][0] : toks[j][1]].lower() in ("y", "e", "i") and near(j) and surname(j + 1) and "g" not in kinds[j + 1]:
                return j + 2
            return j

        def given_before(i: int) -> int:  # the first of the given names that end right before token i; i if there are none
            j = i
            while j > 0 and j - 1 > done and near(j - 1):
                w = text[toks[j - 1][0] : toks[j - 1][1]].lower()
                if j - 2 > done and near(j - 2) and fold(w) in self.devotions and text[toks[j - 2][0] : toks[j - 2][1]].lower() in ("de", "del", "la", "los", "las"):
                    k = j - 2
                    while k > 0 and k - 1 > done and near(k - 1) and text[toks[k - 1][0] : toks[k - 1][1]].lower() in ("de", "la", "los", "las"):
                        k -= 1
                    if k > 0 and k - 1 > done and near(k - 1) and "g" in kinds[k - 1] and "c" not in kinds[k - 1]:
                        j = k - 1
                        continue
                if "g" in kinds[j - 1]:
                    j -= 1
                else:
                    break
            return j

        def given_from(i: int) -> int:  # the index after the given names that begin at token i; i if there are none
            j = i
            while j < n and "g" in kinds[j] and (j == i or near(j - 1)):
                j += 1
                k = j
                while k < n and near(k - 1) and text[toks[k][0] : toks[k][1]].lower() in ("de", "del", "la", "los", "las"):
                    k += 1
                if k > j > i and k < n and near(k - 1) and fold(text[toks[k][0] : toks[k][1]]) in self.devotions and capital(k) == capital(j - 1):
                    j = k + 1
            return j

        for i in marks:
            if i <= done:
                continue
            listed = "s" in kinds[i]
            after = surnames_from(i)
            first = given_before(i)
            if first == i and i - 1 > done and i > 0 and near(i - 1) and listed and not kinds[i - 1] and capital(i - 1) and capital(i) and len(text[toks[i - 1][0] : toks[i - 1][1]]) > 2:
                before = text[max(0, toks[i - 1][0] - 2) : toks[i - 1][0]].rstrip()
                if before and before[-1] not in ".!?…\n":  # an unlisted given name, but no word that is capital as the first of a sentence
                    first = i - 1
            if first < i:
                start, end, done_at = toks[first][0], toks[after - 1][1], after - 1
            else:  # surnames, given name
                if "g" in kinds[i] and not listed:
                    continue
                comma = after < n and re.fullmatch(r"\s*,\s*", gap(after - 1)) is not None
                stop = given_from(after) if comma else after
                if comma and stop == after and after < n and listed and not kinds[after] and capital(after) and re.match(r"\s*(?:[;:.()\n]|,\s|$)", text[toks[after][1] :]) and after - i == 2:
                    stop = after + 1
                if stop == after:
                    continue
                if stop < n and near(stop - 1) and surname(stop):
                    continue  # the given name belongs to the surname behind it
                start, end, done_at = toks[i][0], toks[stop - 1][1], stop - 1
            if not free(start, end):
                continue
            left = text[max(0, start - 40) : start]
            if FIRM_AFTER.match(text[end : end + 20]) or FIRM_BEFORE.search(left) or SAINT_BEFORE.search(left) or PLACE_BEFORE.search(left):
                done = done_at
                continue
            out.append(("name", start, end))
            done = done_at
        return out

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """Type, start and end of every piece of personal information, in order."""
        out: list[tuple[str, int, int]] = []
        starts: list[int] = []  # of the spans found so far, in order, none of which meets another
        ends: list[int] = []

        def free(a: int, b: int) -> bool:
            k = bisect_left(starts, b)
            return k == 0 or ends[k - 1] <= a

        def add(kind: str, a: int, b: int) -> None:
            if free(a, b):
                out.append((kind, a, b))
                k = bisect_left(starts, a)
                starts.insert(k, a)
                ends.insert(k, b)

        for m in SIGN.finditer(text):
            a = m.start()
            while a and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
                a -= 1
            if a == m.start() or (a and text[a - 1] == "@") or not LOCAL.match(text, a, m.start()):
                continue
            domain = DOMAIN.match(text, m.end())
            if domain:
                add("email", a, domain.end())
        toks = [m.span() for m in (TOKEN if text.isascii() or not MARK.search(text) else MARKED_TOKEN).finditer(text)]

        numbers = DIGIT.search(text) is not None
        if numbers:
            for m in DNI.finditer(text):
                if m[3].upper() == id_letter(int(re.sub(r"\D", "", m[1]))) and not (m[2].isspace() and m[3] in "aeyou"):
                    add("id_number", m.start(), m.end())
            for m in NIE.finditer(text):
                if m[3].upper() == id_letter(int("XYZ".index(m[1].upper()).__str__() + m[2].replace(".", ""))):
                    add("id_number", m.start(), m.end())
            for m in CARD.finditer(text):
                if luhn(re.sub(r"\D", "", m[0])) and re.search(r"tarjeta|card|visa|mastercard", text[max(0, m.start() - 40) : m.end() + 20], re.I):
                    add("card", m.start(), m.end())
            for m in IBAN.finditer(text):
                if mod97(m[0]):
                    add("iban", m.start(), m.end())
            for m in PHONE.finditer(text):
                left, right = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 16]
                score = 2 + 2 * bool(m[1]) + 2 * bool(PHONE_YES.search(left)) - 2 * bool(PHONE_NO.search(left) or PHONE_NO.match(right.strip()))
                shape = re.sub(r"\d", "9", m[2].strip("()") + m[3])
                score -= 2 * (shape == "999.999.999" and not m[1])
                a = m.start()
                while text[a] == "(":
                    a += 1
                if score > 0:
                    add("phone", a, m.end())
            for m in FOREIGN_PHONE.finditer(text):
                if m[0][0] == "+" or PHONE_YES.search(text[max(0, m.start() - 30) : m.start()]):
                    add("phone", m.start(), m.end())
        if numbers or "s/n" in text.lower():
            last = -1
            for m in NUMBER.finditer(text):
                last = m.start()
            vain, done = [0, 0], 0
            for x, y in toks:
                word = text[x:y]
                if x < done or y - x > 12 or (x and (text[x - 1].isalnum() or text[x - 1] == "/")) or word.lower() not in self.kinds:
                    continue
                if word.lower() in _MUST and text[y : y + 1] not in ("/", "."):
                    continue
                if y > last:
                    break
                m = None
                for k, pattern in enumerate((ADDRESS, LOOSE_ADDRESS)):
                    m = m or (pattern.match(text, x) if x >= vain[k] else None)
                    if m is None and x >= vain[k]:
                        run = _RUNS[k].match(text, x)
                        vain[k] = run.end() if run else 0
                if m is None:
                    continue
                year = re.fullmatch(r"1[4-9]\d\d|20\d\d", m[3]) and m[1] in ("camino", "vereda", "cuesta", "plaza", "carretera")
                if not year and re.search(r"[^\W\d_]{2}", m[2]) and not re.fullmatch(rf"(?:{_PARTICLE}\s*)+", m[2].strip()):
                    add("address", m.start(), m.end())
                    done = m.end()
        out += self._names(text, toks, free)
        return sorted(out, key=lambda x: (x[1], x[0]))


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]", "card": "[CARD]", "iban": "[IBAN]"}
MAX_LEXICON = 200_000


def _recogniser(lexicon: DataFrame):
    rows = [(r.token, r.kind) for r in lexicon.select("token", "kind").where("token is not null and kind is not null").distinct().limit(MAX_LEXICON + 1).collect()]
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} rows; it goes to every task")
    return Shared(lexicon.sparkSession, Recogniser(sorted(rows)))


def find_pii(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``doc_id, pii_type, start_pos, end_pos, value``: every occurrence; positions count code points from 1.  Keys may be of any type and keep it.

    Null texts and ids are dropped, empty texts have no occurrence, repeated rows count once, other columns are ignored.  The lexicon goes
    to every task and may have at most ``MAX_LEXICON`` rows; an empty one leaves the names of the fixed lists.  Types beside those of the
    project's query: ``card`` (Luhn) and ``iban`` (mod 97).
    """
    shared = _recogniser(lexicon)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = shared.value.find
        for batch in batches:
            rows = [(d, k, a + 1, b, t[a:b]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for k, a, b in find(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_pos", "end_pos", "value"])

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text != ''")
    return rows.mapInPandas(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pii_type string, start_pos bigint, end_pos bigint, value string").distinct()


def mask_pii(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``doc_id, text, n_masked``: one row per row, with a placeholder of its type for each occurrence and the rest as it was; null texts stay null."""
    shared = _recogniser(lexicon)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = shared.value.find
        for batch in batches:
            texts, counts = [], []
            for t in batch["text"]:
                found = find(t) if t else []
                parts, at = [], 0
                for k, a, b in found:
                    parts += [t[at:a], PLACEHOLDER[k]]
                    at = b
                texts.append(None if t is None else "".join(parts) + t[at:])
                counts.append(len(found))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "n_masked": counts})

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_masked int")
