"""Pages of the scraped sites: HTML and JSON into structures.  Fetching is left to others; each parser is a column function of the page."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions import rx
from telar.functions.text import block_text, decoded, tidy_spaces
from telar.plans.lineage import Scratch

# Parts of the addresses of layout images.
LAYOUT_IMAGES = """
imagenes/espacio imagenes/separa imagenes/menu imagenes/esq imagenes/bg imagenes/btn imagenes/indice imagenes/anterior imagenes/siguiente
imprimir.gif escuchar.gif metadatos.gif patrocinadores.gif aumentar.gif disminuir.gif
""".split()


class Element:
    """A node of a forgiving HTML tree."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self):
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def text(self, skip: frozenset[str] = frozenset({"script", "style"})) -> str:
        parts = [c if isinstance(c, str) else "" if c.tag in skip else c.text(skip) + (" " if c.tag in ("p", "br", "div", "li", "td", "tr") else "") for c in self.children]
        return "".join(parts)

    def find(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> list[Element]:
        def fits(e: Element) -> bool:
            return (tag is None or e.tag == tag) and (cls is None or cls in e.attrs.get("class", "").split()) and all(e.attrs.get(k) == v for k, v in attrs.items())

        return [e for e in self.walk() if fits(e)]


class _Builder(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in self.VOID:
            self.at = e

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(source: str) -> Element:
    b = _Builder()
    b.feed(source)
    b.close()
    return b.root


def space(text: str) -> str:
    out = re.sub(r"\s+", " ", text).strip()
    out = re.sub(r" +([.,;:!?])", r"\1", out)
    return re.sub(r" +\)", ")", re.sub(r"([¿¡(]) +", r"\1", out))


def _udf(parse: Callable[[str, str], object], schema: str) -> Callable[[Column, Column], Column]:
    def run(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([parse(h, u or "") if h else [] for h, u in zip(html, url, strict=True)])

    return lambda html, url: F.pandas_udf(run, schema)(html, url)


def _index(source: str, base: str) -> list[dict[str, str]]:
    out, seen = [], set()
    for a in tree(source).find("a"):
        href = a.attrs.get("href", "")
        title, url = space(a.text()), urljoin(base, href)
        if "mostrar_contenidos.php" in href and title and url not in seen:
            seen.add(url)
            q = parse_qs(urlparse(url).query)
            out.append({"title": title, "url": url, **{k: (q.get(k) or [""])[0] for k in ("idcat", "idcap", "idcon")}})
    return out


encyclopedia_index = _udf(_index, "array<struct<title:string,url:string,idcat:string,idcap:string,idcon:string>>")


def is_layout_image(url: str) -> bool:
    low = url.lower()
    return any(x in low for x in LAYOUT_IMAGES)


def _article(source: str, base: str) -> list[dict[str, object]]:
    root = tree(source)
    body = next(iter(root.find("div", id="tamano")), None)
    if body is None:
        return []
    titles = [space(p.text()) for p in body.find("p", "epigrafe")]
    captions = [f"Image caption: {space(td.text())}" for td in body.find("td", "texto") if space(td.text())]
    skip = {id(e) for e in [*body.find("p", "epigrafe"), *body.find("td", "texto")]}

    def told(e: Element) -> str:
        if id(e) in skip or e.tag in ("script", "style", "strike", "s"):
            return ""
        inner = "".join(c if isinstance(c, str) else told(c) for c in e.children)
        return f"\n{inner}\n" if e.tag in ("p", "br", "div", "li", "tr") else inner

    lines = [space(x) for x in told(body).split("\n")]
    images = list(dict.fromkeys(urljoin(base, i.attrs["src"]) for i in body.find("img") if i.attrs.get("src") and not is_layout_image(i.attrs["src"])))
    return [{"title": titles[0] if titles else "", "text": "\n".join([x for x in lines if x] + captions), "image_urls": images}]


encyclopedia_article = _udf(_article, "array<struct<title:string,text:string,image_urls:array<string>>>")


def _consultations(source: str, base: str) -> list[dict[str, object]]:
    out = []
    for row in tree(source).find("tr"):
        cells = row.find("td")
        link = next((a for a in cells[0].find("a") if a.attrs.get("href")), None) if cells else None
        if link is None:
            continue
        asked = next((space(p.text()) for p in cells[1].find("p")), "") if len(cells) > 1 else ""
        kinds = [space(a.text()) for a in row.find("a") if "badge" in a.attrs.get("class", "")]
        out.append({"url": urljoin(base, link.attrs["href"]), "question": asked, "categories": list(dict.fromkeys(k for k in kinds if k))})
    return out


consultation_list = _udf(_consultations, "array<struct<url:string,question:string,categories:array<string>>>")


def _consultation(source: str, base: str) -> list[dict[str, object]]:
    main = next(iter(tree(source).find("main")), None)
    boxes = [b for b in main.find("div") if "box" in b.attrs.get("class", "").split()] if main else []
    if not boxes:
        return []
    kinds = [space(a.text()) for a in main.find("a") if "badge" in a.attrs.get("class", "")]
    return [{"question": space(boxes[0].text()), "answer": space(boxes[1].text()) if len(boxes) > 1 else "", "categories": list(dict.fromkeys(k for k in kinds if k))}]


consultation_page = _udf(_consultation, "array<struct<question:string,answer:string,categories:array<string>>>")


def clean_definition(text: str, word: str) -> str:
    """Without page numbers at its end; empty if it only repeats the word."""
    out = re.sub(r"(?:\s*\d+\s*)+$", "", space(text))
    return "" if out.lower() == word.lower() else out


def _entries(source: str, base: str) -> list[dict[str, object]]:
    out: list[dict[str, object]] = []
    flat = list(tree(source).walk())
    heads = [i for i, e in enumerate(flat) if e.tag == "h3" and any("/palabra/" in a.attrs.get("href", "") for a in e.find("a"))]
    for n, i in enumerate(heads):
        link = next(a for a in flat[i].find("a") if "/palabra/" in a.attrs.get("href", ""))
        inside = set(map(id, flat[i].walk()))
        parts, images = [], []
        for e in flat[i + 1 : heads[n + 1] if n + 1 < len(heads) else None]:
            if e.tag in ("h5", "h6", "footer"):
                break
            if id(e) in inside:
                continue
            parts += [c for c in e.children if isinstance(c, str) and e.tag not in ("script", "style")] + [" "]
            images += [urljoin(base, e.attrs["src"])] if e.tag == "img" and e.attrs.get("src") else []
        word = space(flat[i].text())
        told = clean_definition("".join(parts), word)
        if told:
            out.append({"word": word, "definitions_text": told, "entry_url": urljoin(base, link.attrs["href"]), "image_urls": list(dict.fromkeys(images))})
    return out


dictionary_entries = _udf(_entries, "array<struct<word:string,definitions_text:string,entry_url:string,image_urls:array<string>>>")


def html_lines(col: Column) -> Column:
    """HTML text with a line per block."""
    return F.pandas_udf(lambda s: s.map(block_text, na_action="ignore"), "string")(col)


def rendered(col: Column) -> Column:
    """Rendered text of the site's interface: entities and tags out, spaces tidied."""
    return tidy_spaces(decoded(col, True, None))


def dynamic_values(html: Column) -> Column:
    """The page's listed field values, each once, in order."""
    cells = F.regexp_extract_all(html, F.lit(r'(?is)<div[^>]*class="[^"]*jet-listing-dynamic-field__content[^"]*"[^>]*>(.*?)</div>'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(cells, lambda x: rx.squeeze(F.regexp_replace(x, r"<[^>]+>", " "))), lambda x: x != ""))


def ficha_metadata(values: Column) -> Column:
    """What the listed values of a recording are: gender, age, topics, year, duration; the first of each kind counts, topics all."""
    first = lambda test: F.get(F.filter(values, test), F.lit(0))
    return F.struct(
        first(lambda x: F.lower(x).isin("mujer", "hombre")).alias("gender"), first(lambda x: F.contains(F.lower(x), F.lit("años"))).alias("age"),
        F.filter(values, lambda x: x.rlike(r"^\[t\d+\]")).alias("topics"), first(lambda x: x.rlike(r"^\d{4}$")).alias("year"), first(lambda x: x.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$")).alias("duration"),
    )


def coordinates(html: Column) -> Column:
    """``lat`` and ``lng`` of the page's map, null without."""
    lat, lng = F.regexp_extract(html, r'"lat"\s*:\s*"?(-?\d+(?:\.\d+)?)', 1), F.regexp_extract(html, r'"lng"\s*:\s*"?(-?\d+(?:\.\d+)?)', 1)
    return F.when((lat != "") & (lng != ""), F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng")))


def audio_files(items: Column) -> Column:
    """Of an array with ``mime_type`` and ``source_url``, the recordings."""
    return F.filter(items, lambda x: F.startswith(F.coalesce(x["mime_type"], F.lit("")), F.lit("audio/")) | F.endswith(F.lower(F.coalesce(x["source_url"], F.lit(""))), F.lit(".mp3")))


def query_id(url: Column) -> Column:
    """The first of the known ids of an address."""
    return F.coalesce(*[F.try_parse_url(url, F.lit("QUERY"), F.lit(k)) for k in ("idcat", "idcap", "idcon")])


def wiki_page(raw: Column) -> Column:
    """A page of the wiki's interface as a structure."""
    v = F.try_parse_json(raw)
    get = lambda p, kind="string": F.try_variant_get(v, p, kind)
    return F.struct(
        get("$.pageid", "bigint").alias("pageid"), get("$.title").alias("title"), get("$.fullurl").alias("url"), get("$.revisions[0].timestamp").alias("timestamp"), get("$.revisions[0].user").alias("user"),
        F.transform(get("$.categories", "array<struct<title:string>>"), lambda c: c["title"]).alias("categories"), get('$.revisions[0].slots.main["*"]').alias("wikitext"), get("$.extract").alias("text"),
    )


def image_info(raw: Column) -> Column:
    """The first image info of a wiki file page, null without one."""
    info = F.try_variant_get(F.try_parse_json(raw), "$.imageinfo[0]", "struct<url:string,mime:string,size:bigint,width:bigint,height:bigint,sha1:string>")
    title = F.try_variant_get(F.try_parse_json(raw), "$.title", "string")
    return F.when(info["url"].isNotNull(), F.struct(title.alias("title"), info["url"].alias("url"), info["mime"].alias("mime"), info["size"].alias("size"), info["width"].alias("width"), info["height"].alias("height"), info["sha1"].alias("sha1")))


def recording_code(html: Column) -> Column:
    """The code of a recording on its page, such as GC-00000001."""
    return F.nullif(F.regexp_extract(html, r"\b([A-Z]{2}-[A-Z]?\d{4,})\b", 1), F.lit(""))


def with_terms(df: DataFrame, ids: str, terms: DataFrame, to: str = "terms") -> DataFrame:
    """Names instead of ids of a taxonomy (``id, name``), in the order of the ids; unknown ids are left out.

    Each row's ids are looked up by a join, so neither side need be small.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    found = rows.select("_row", F.posexplode(ids).alias("_pos", "id")).join(terms.select("id", "name"), "id").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "name"))).alias("_n"))
    return rows.join(found, "_row", "left").withColumn(to, F.coalesce(F.transform("_n", lambda x: x["name"]), F.array().cast("array<string>"))).drop("_row", "_n")


def batched(df: DataFrame, n: int, order: str) -> DataFrame:
    """Rows with a batch number, ``n`` to a batch in order of a column; the order is made in ranges, one count per range goes to the driver."""
    if n <= 0:
        raise ValueError("a batch needs at least one row")
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    ranged = Scratch(df.sparkSession, "batched").cut(ranged, "ranged")  # ranges are sampled anew in every run: number rows of one run
    counts = {r.p: r.n for r in ranged.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(total).cast("bigint")]
        total += counts[p]
    start = F.create_map(*starts)[F.shiftright("_at", 33)] if starts else F.lit(0).cast("bigint")
    return ranged.withColumn("batch", F.floor((start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))) / n)).drop("_at")
