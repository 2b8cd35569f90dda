"""Contact evidence of stored web pages: text, links, attributes, scripts and JSON-LD of a page as long rows."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.phones import normalize_phone, tel_link, whatsapp_link
from ..functions.urls import public_url, website_host
from ..schemas import PAGE_EVIDENCE
from .contacts import nearest_phone

# fixed values from here to SCRIPT_LINK: words of links to contact pages with their rank, endings of paths that are no pages, element and attribute names, patterns
CONTACT_TERMS = (
    ("contato", 0), ("contact", 0), ("fale conosco", 0), ("entre em contato", 0), ("atendimento", 1), ("telefone", 1), ("whatsapp", 1), ("localizacao", 2), ("onde estamos", 2),
    ("unidades", 2), ("escritorios", 2), ("sobre", 3), ("quem somos", 3), ("institucional", 3), ("nossa equipe", 4), ("corretores", 4),
)
ASSET_ENDINGS = (".7z", ".avi", ".css", ".csv", ".doc", ".docx", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".js", ".json", ".mov", ".mp3", ".mp4", ".pdf", ".png", ".rar", ".svg", ".webp", ".xls", ".xlsx", ".xml", ".zip")
BLOCKS = ("address", "article", "br", "div", "footer", "h1", "h2", "h3", "h4", "header", "li", "main", "p", "section", "td", "tr")
HIDDEN = frozenset(("noscript", "style", "svg", "template"))
MAX_NODES, MAX_DEPTH = 1000, 10
DATA_TYPES = ("application/ld+json", "application/json+ld")
CONTEXT_NAMES = ("itemprop", "property", "name", "id", "class", "aria-label", "title")
VALUE_NAMES = ("content", "href", "value", "aria-label", "title", "itemprop")
ADDRESS_PARTS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
MARKER = re.compile(r"(?i)\bwhats\s*app\b")
DIRECT_LINK = re.compile(r"(?i)(?:(?:https?:)?//)?(?:wa\.me|(?:api\.|web\.)?whatsapp\.com)/[^\s\"'<>]+")

PHONE = re.compile(r"(?<!\d)(?:(?:\+|00)?55[\s().-]*)?(?:\(?[1-9]\d\)?[\s.-]*)(?:9[\s.-]*\d{4}|[2-9][\s.-]*\d{3})[\s.-]*\d{4}(?!\d)")
TAX_ID = re.compile(r"(?<!\d)(\d{2}[.\s]?\d{3}[.\s]?\d{3}\s*[/\-]\s*\d{4}[.\s-]?\d{2})(?!\d)")
LABELLED = re.compile(r"(?i)(?:whats\s*app|whats|zap)\s*(?:business\s*)?(?:n[uú]mero\s*)?(?:[:|\-–—]|é|e)?\s*((?:(?:\+|00)?55[\s().-]*)?\(?[1-9]\d\)?[\s.-]*(?:9[\s.-]*\d{4}|[2-9][\s.-]*\d{3})[\s.-]*\d{4})(?!\d)")
NEGATIVE = re.compile(r"(?i)(?:n[aã]o\s+(?:temos|possui|dispon[ií]vel).{0,24}whats\s*app|whats\s*app\s+(?:n[aã]o\s+dispon[ií]vel|indispon[ií]vel))")
ADDRESS = re.compile(r"(?i)(?:endere[cç]o|localiza[cç][aã]o)\s*[:\-–—]\s*([^\n]{8,240})")
WHATSAPP_NAME = re.compile(r"(?i)whats\s*app|whats|zap")
PHONE_NAME = re.compile(r"(?i)(?:^|[^a-z])(?:contact\s*)?(?:phone|telephone|telefone|telefone1|tel)(?:[^a-z]|$)")
SCRIPT_FIELD = re.compile(r"""(?i)["'](?:contact[_-]?)?(phone|telephone|telefone|tel|whatsapp|whats_app)["']\s*:\s*["']([^"']{7,160})["']""")
SCRIPT_TEL = re.compile(r"(?i)tel:(?:%2B|\+)?[\d%().\s\-/]{8,40}")
SCRIPT_LINK = re.compile(r"""(?i)(?:(?:https?:)?(?:\\?/){2})?(?:wa\.me|(?:api\.|web\.)?whatsapp\.com)(?:\\?/|/)[^\s"'<>]{1,200}""")


class _Page(HTMLParser):
    """Visible text with a line per block, links with labels, address elements, scripts, and attributes that may hold contacts."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[tuple[str, str, bool]] = []
        self.addresses: list[str] = []
        self.linked_data: list[str] = []
        self.scripts: list[str] = []
        self.attributes: list[tuple[str, str, str, str]] = []  # element, name, value, what its other attributes say
        self._hidden = 0
        self._link: list | None = None
        self._address: list[str] | None = None
        self._in_script = False
        self._script: list[str] | None = None
        self._is_data = False
        self.feed(page)
        self.close()
        self._end_link()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "").strip() for k, v in attrs}
        if tag in HIDDEN:
            self._hidden += 1
        if tag == "script":
            self._is_data = a.get("type", "").partition(";")[0].strip().lower() in DATA_TYPES
            self._in_script, self._script = True, [] if self._is_data or not a.get("src") else None
            return
        if self._hidden:
            return
        told = " ".join(a[k] for k in CONTEXT_NAMES if a.get(k))[:500]
        self.attributes += [(tag, k, v, told) for k, v in a.items() if v and len(v) <= 4096 and (k in VALUE_NAMES or k.startswith("data-"))]
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "address":
            self._address = []
        if tag == "a":
            self._end_link()
            self._link = [a.get("href", ""), [a[k] for k in ("aria-label", "title") if a.get(k)], "nofollow" in a.get("rel", "").lower().split()]
        if tag == "img" and a.get("alt"):
            self.parts.append(a["alt"])
            if self._link is not None:
                self._link[1].append(a["alt"])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self._hidden:
            self._hidden -= 1
        if tag == "script":
            if self._script is not None:
                (self.linked_data if self._is_data else self.scripts).append("".join(self._script))
            self._in_script, self._script = False, None
            return
        if self._hidden:
            return
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "address" and self._address is not None:
            self.addresses.append(" ".join(" ".join(self._address).split()))
            self._address = None
        if tag == "a":
            self._end_link()

    def _end_link(self) -> None:
        if self._link is not None:
            self.links.append((self._link[0], " ".join(" ".join(self._link[1]).split()), self._link[2]))
            self._link = None

    def handle_data(self, data: str) -> None:
        if self._in_script:
            if self._script is not None:
                self._script.append(data)
        elif not self._hidden:
            self.parts.append(data)
            if self._link is not None:
                self._link[1].append(data)
            if self._address is not None:
                self._address.append(data)

    def text(self) -> str:
        joined = " ".join("\n" if p == "\n" else p.strip() for p in self.parts if p == "\n" or p.strip())
        return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\f\v]+", " ", joined)).strip()


def _around(text: str, start: int, end: int) -> str:
    return " ".join(text[max(0, start - 100) : end + 100].split())


def _walk(node: object) -> Iterator[dict]:
    """The objects of a JSON-LD block, each before what it holds, up to MAX_NODES and MAX_DEPTH."""
    waiting, seen = [(node, 0)], 0
    while waiting and seen < MAX_NODES:
        item, depth = waiting.pop()
        if depth > MAX_DEPTH:
            continue
        seen += 1
        if isinstance(item, dict):
            yield item
        inner = item.values() if isinstance(item, dict) else item if isinstance(item, list) else ()
        waiting += [(x, depth + 1) for x in inner if isinstance(x, (dict, list))][::-1]


def _texts(value: object) -> list[str]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str)]


def _linked(node: dict) -> Iterator[tuple[str, str, str, str]]:
    """What an object of linked data says."""
    kinds = node.get("@type")
    if any(str(k).lower() == "postaladdress" for k in (kinds if isinstance(kinds, list) else [kinds])):
        joined = ", ".join(x.strip() for k in ADDRESS_PARTS for x in _texts(node.get(k))[:1] if x.strip() and not isinstance(node[k], list))
        if joined:
            yield "address", joined, "structured_data", joined
    for key in ("telephone", "phone", "contactPhone"):
        for v in _texts(node.get(key)):
            yield "phone", v, "structured_data", v
    for key in ("whatsapp", "whatsApp", "contact:whatsapp"):
        if isinstance(v := node.get(key), str):
            yield "whatsapp", v, "whatsapp_link" if DIRECT_LINK.search(v) else "explicit_whatsapp_label", f"Structured field {key}"
    for key in ("taxID", "vatID", "cnpj"):
        if isinstance(v := node.get(key), str):
            yield "cnpj", v, "structured_data", v
    for v in _texts(node.get("sameAs")) + [node[k] for k in ("url", "contactUrl") if isinstance(node.get(k), str)]:
        if "instagram.com" in v.lower():
            yield "instagram", v, "structured_data", v
        if DIRECT_LINK.search(v):
            yield "whatsapp", v, "whatsapp_link", v


def _attribute(tag: str, name: str, value: str, told: str) -> Iterator[tuple[str, str, str, str]]:
    """What an attribute says: a link, or numbers if its own or its element's names speak of a phone."""
    decoded, context = html.unescape(value).replace("\\/", "/"), f"{name} {told}".strip()
    about_whatsapp = bool(WHATSAPP_NAME.search(context))
    if DIRECT_LINK.match(decoded) or decoded.lower().startswith("whatsapp:"):
        yield "whatsapp", decoded, "whatsapp_link", context or "Public WhatsApp attribute"
    elif decoded.lower().startswith("tel:"):
        yield ("whatsapp", decoded, "explicit_whatsapp_label", context) if about_whatsapp else ("phone", decoded, "tel_link", context)
    elif about_whatsapp or PHONE_NAME.search(context):
        for m in PHONE.finditer(decoded):
            yield ("whatsapp", m.group(), "explicit_whatsapp_label", context) if about_whatsapp else ("phone", m.group(), "meta_tag" if tag == "meta" else "html_attribute", context)


def observed(page: str | None) -> list[tuple[str, str, str, str]]:
    """(field, raw value, evidence type, excerpt) of a page, in order; numbers and tax ids are checked later, in the JVM."""
    doc = _Page(page or "")
    text = doc.text()
    out: list[tuple[str, str, str, str]] = []
    for href, label, _ in doc.links:
        if re.search(r"(?i)wa\.me/|whatsapp", href) and not NEGATIVE.search(label):
            out.append(("whatsapp", href, "whatsapp_link", label or "Public WhatsApp link"))
        if href.strip().lower().startswith("tel:"):
            labelled = bool(WHATSAPP_NAME.search(label)) and not NEGATIVE.search(label)
            out.append(("whatsapp" if labelled else "phone", href, "explicit_whatsapp_label" if labelled else "tel_link", label or "Telephone link"))
        if "instagram.com" in href.lower():
            out.append(("instagram", href, "instagram_link", label))
    for attribute in doc.attributes:
        out += _attribute(*attribute)
    for block in doc.scripts:
        block = html.unescape(block).replace("\\/", "/")
        for m in SCRIPT_FIELD.finditer(block):
            kind = "whatsapp" if "whats" in m.group(1).lower() else "phone"
            out.append((kind, m.group(2), "explicit_whatsapp_label" if kind == "whatsapp" else "embedded_data", f"Embedded field {m.group(1)}"))
        out += [("phone", unquote(m.group()), "embedded_data", "Embedded telephone link") for m in SCRIPT_TEL.finditer(block)]
        out += [("whatsapp", m.group(), "whatsapp_link", "Embedded WhatsApp link") for m in SCRIPT_LINK.finditer(block)]
    ids = [m.span() for m in TAX_ID.finditer(text)]
    for m in LABELLED.finditer(text):
        around = _around(text, *m.span())
        if not NEGATIVE.search(around):
            out.append(("whatsapp", m.group(1), "explicit_whatsapp_label", around))
    for m in PHONE.finditer(text):
        if not any(m.start() < e and s < m.end() for s, e in ids):
            out.append(("phone", m.group(), "visible_text", _around(text, *m.span())))
    out += [("cnpj", m.group(1), "visible_text", _around(text, *m.span())) for m in TAX_ID.finditer(text)]
    out += [("address", a, "address_element", a) for a in doc.addresses if len(a) >= 8]
    out += [("address", m.group(1), "visible_text", _around(text, *m.span())) for m in ADDRESS.finditer(text)]
    for block in doc.linked_data:
        try:
            data = json.loads(block)
        except (ValueError, RecursionError):
            continue
        for node in _walk(data):
            out += _linked(node)
    return out


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence (schemas.PAGE_EVIDENCE) of pages (page_id, url, html): one row per distinct field, value and type of a page.

    Python only takes pages apart; numbers, tax ids and profiles are normalised, and what isn't one dropped, in the JVM.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, u, i, *e) for p, u, h in zip(frame["page_id"], frame["url"], frame["html"], strict=True) for i, e in enumerate(observed(h))]
            yield pd.DataFrame(rows, columns=["page_id", "url", "seq", "field", "value", "evidence_type", "excerpt"])

    c = F.col
    rows = pages.select("page_id", "url", "html").mapInPandas(run, PAGE_EVIDENCE)
    value = (
        F.when(c("evidence_type") == "whatsapp_link", F.concat(F.lit("55"), whatsapp_link(c("value"))))
        .when(c("field").isin("phone", "whatsapp"), F.when(F.lower("value").startswith("tel:"), tel_link(c("value"))).otherwise(normalize_phone(c("value"))))
        .when(c("field") == "cnpj", T.tax_id_checked(c("value")))
        .when(c("field") == "instagram", T.instagram_profile(c("value")))
        .otherwise(T.excerpt(c("value")))
    )
    rows = rows.withColumn("value", value).where(c("value").isNotNull()).withColumn("excerpt", T.excerpt(c("excerpt")))
    first = Window.partitionBy("page_id", "url", "field", "value", "evidence_type").orderBy("seq")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def marker_evidence(pages: DataFrame, source: str, official: Column, max_chars: int = 1_000_000) -> DataFrame:
    """WhatsApp evidence (schemas.EVIDENCE, with page_id for the company) of pages (page_id, url, html) that says so itself.

    Links to WhatsApp count, in attributes and in the text; and, near each mention of the name that is no denial, the
    number nearest to it. One row per kind and number of a page, the first. Pages without a public address give none.
    """
    schema = "page_id long, source_url string, seq int, evidence_type string, link string, context string, place int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, u, h in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                doc = _Page((h or "")[:max_chars])
                text = html.unescape(" ".join(x for x in doc.parts if x != "\n"))
                found = [("direct_link", x, "Public WhatsApp contact link", None) for x in [*(href for href, _, _ in doc.links if href), *(m.group() for m in DIRECT_LINK.finditer(text))]]
                for m in MARKER.finditer(text):
                    start = max(0, m.start() - 80)
                    near = " ".join(text[start : m.end() + 100].split())
                    if not NEGATIVE.search(near):
                        found.append(("explicit_label", None, near, m.start() - start))
                rows += [(p, u, i, *x) for i, x in enumerate(found)]
            out = pd.DataFrame(rows, columns=["page_id", "source_url", "seq", "evidence_type", "link", "context", "place"])
            yield out.astype({"place": "Int32"})

    c = F.col
    rows = pages.where(public_url(c("url")).isNotNull()).withColumn("__official", F.coalesce(official, F.lit(False)))
    found = rows.select("page_id", "url", "html").mapInPandas(run, schema)
    number = F.when(c("link").isNotNull(), F.concat(F.lit("55"), whatsapp_link(c("link")))).otherwise(nearest_phone(c("context"), c("place")))
    found = found.withColumn("number", number).where(c("number").isNotNull())
    first = found.groupBy("page_id", "source_url", "evidence_type", "number").agg(F.min_by(F.struct("link", "context"), "seq").alias("e"))
    first = first.join(rows.select("page_id", F.col("url").alias("source_url"), "__official").distinct(), ["page_id", "source_url"])
    return first.select(
        "page_id", F.coalesce("e.link", "number").alias("value"), "evidence_type", "source_url", F.lit(source).alias("source"), c("__official").alias("official_source"), c("e.context").alias("context"),
        F.when(c("evidence_type") == "explicit_label", F.lit("WhatsApp")).alias("field_name"), "number",
    )


def visible_text(pages: DataFrame) -> DataFrame:
    """page_id and the text of each page with a line per block."""

    @F.pandas_udf("string")
    def run(page: pd.Series) -> pd.Series:
        return pd.Series([_Page(p or "").text() for p in page], dtype=object)

    return pages.select("page_id", run("html").alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, position, target (absolute, without fragment), label and nofollow of each link of a page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, u, h in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                for i, (href, label, nofollow) in enumerate(_Page(h or "").links):
                    try:
                        rows.append((p, u, i, urljoin(u or "", href).partition("#")[0], label, nofollow))
                    except ValueError:
                        continue
            yield pd.DataFrame(rows, columns=["page_id", "url", "position", "target", "label", "nofollow"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, position int, target string, label string, nofollow boolean")


def contact_rank(path: Column, label: Column) -> Column:
    """The least rank of a contact term that a link's path or label holds; null if none does."""
    said = F.regexp_replace(T.normalize_text(F.concat_ws(" ", F.replace(F.lower(F.coalesce(F.try_url_decode(path), path)), F.lit("-"), F.lit(" ")), label)), "[^a-z0-9]+", " ")
    return F.least(*[F.when(F.contains(said, F.lit(term)), F.lit(rank)) for term, rank in CONTACT_TERMS], F.lit(None).cast("int"))


def ranked_contact_links(links: DataFrame) -> DataFrame:
    """page_id, target, rank and place of the links to contact pages of the same site, best first, each target once."""
    c = F.col
    path = F.regexp_extract("target", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    usable = ~F.coalesce("nofollow", F.lit(False)) & c("target").rlike("^https?://") & (website_host(c("target")) == website_host(c("url"))) & ~F.lower(path).rlike(f"(?:{'|'.join(map(re.escape, ASSET_ENDINGS))})$")
    rows = links.where(usable).withColumn("rank", contact_rank(path, c("label"))).where("rank is not null").groupBy("page_id", "target").agg(F.min_by("rank", "position").alias("rank"))
    order = Window.partitionBy("page_id").orderBy("rank", F.length(F.regexp_extract("target", r"^[a-z]+://[^/?#]*([^?#]*)", 1)), "target")
    return rows.withColumn("place", F.row_number().over(order).cast("int"))


def crawl(pages: DataFrame, starts: DataFrame, max_pages: int = 3) -> DataFrame:
    """start, url and depth of the pages that a bounded crawl of stored pages reaches from each start (column start).

    Breadth first over ranked contact links: level by level, a join of links and pages; at most max_pages for each start.
    """
    links = ranked_contact_links(page_links(pages)).join(pages.select("page_id", "url"), "page_id").select("url", F.col("target"), "place")
    reached = starts.join(pages.select(F.col("url").alias("start")), "start", "left_semi").select("start", F.col("start").alias("url"), F.lit(0).alias("depth"), F.lit(0).alias("place"))
    level = reached
    for depth in range(1, max_pages):
        found = level.select("start", "url").join(links, "url").select("start", F.col("target").alias("url"), F.lit(depth).alias("depth"), "place")
        level = found.join(pages.select("url"), "url", "left_semi").join(reached.select("start", "url"), ["start", "url"], "left_anti").groupBy("start", "url").agg(F.min("depth").alias("depth"), F.min("place").alias("place"))
        reached = reached.unionByName(level)
    order = Window.partitionBy("start").orderBy("depth", "place", "url")
    return reached.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max_pages).drop("__n", "place")
