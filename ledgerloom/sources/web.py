"""Saved web-search answers, and policy checks of stored pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Request
from ..functions import text as T
from ..functions.urls import is_http_url, public_url, website_host
from ..schemas import WEB_RESULT
from .base import Capabilities, as_leads

# fixed values: patterns of numbers, of titles that list companies, and of pages that are no company's
PHONE = r"(?U)((?<!\d)(?:(?:\+?55)\s*)?(?:\(?\d{2}\)?[\s.-]*)?(?:9\s*)?\d{4}[\s.-]*\d{4}(?!\d))"
TAX_ID = r"(?U)((?<!\d)\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s-]?(?:\d{4})[-.\s]?\d{2}(?!\d))"
WHATSAPP = r"(?iU)(?:wa\.me/|api\.whatsapp\.com/send\?phone=)(\d{10,15})"
LISTING = r"(?iuU)(?:^\s*(?:top\s+)?\d+\s+(?:das?\s+|dos?\s+|de\s+)?(?:melhores|empresas)\b|\b(?:lista|listagem|guia|ranking|diret[oó]rio)\s+(?:de|das?|dos?)\b)"
GENERIC = r"(?iuU)\b(?:resultados? de busca|pesquisa|categoria)\b"
SEPARATOR = r"(?U)\s+[|\-–—]\s+"


#: Most robots.txt answers that are broadcast; more are joined by shuffling.
BROADCAST_ORIGINS = 20_000


def read_results(spark: SparkSession, path: str) -> DataFrame:
    fields = ",".join(x.replace(" ", ":", 1) for x in WEB_RESULT.split(", "))
    return spark.read.option("multiLine", True).schema(f"request_id string, results array<struct<{fields}>>").json(path).select("request_id", F.explode("results").alias("r")).select("request_id", "r.*")


def company_from_title(title: Column, request: Request) -> Column:
    """The company that a page's title names; null for lists, search pages, and what only repeats the request."""
    name = F.btrim(F.split(title, SEPARATOR)[0], F.lit(" -|–—"))
    asked = [T.normalize_text(F.lit(x or "")) for x in (request.query, request.category, request.location)]
    good = (title != "") & ~title.rlike(LISTING) & ~title.rlike(GENERIC) & F.length(name).between(2, 300) & ~name.rlike(r"(?U)^\d") & ~T.normalize_text(name).isin(*asked)
    return F.when(good, name)


def result_leads(results: DataFrame, request: Request) -> DataFrame:
    """Search results (schemas.WEB_RESULT) as leads. City and category are kept only where the result's text supports them.

    Results are dealt to all tasks first: a file of few row groups would leave the patterns' work to as many tasks.
    """
    c = F.col
    results = results.repartition("url")
    title, url, content = (F.trim(F.coalesce(x, F.lit(""))) for x in ("title", "url", "content"))
    both = F.concat_ws("\n", title, content)
    plain = T.normalize_text(both)
    first = lambda p: F.nullif(F.regexp_extract(both, p, 1), F.lit(""))
    placed = F.contains(plain, T.normalize_text(F.lit(request.location))) if request.location else F.lit(False)
    words = F.filter(F.split(T.normalize_text(F.lit(request.category or "")), " "), lambda w: F.length(w) >= 4)
    kind = F.exists(words, lambda w: F.contains(plain, w) | F.contains(plain, F.regexp_replace(w, "s$", "")))
    social = F.lower(F.regexp_extract(url, "^https?://([^/?#:]*)", 1)).isin("instagram.com", "www.instagram.com")
    number = F.coalesce(first(WHATSAPP), T.labelled_whatsapp(both))
    rows = results.withColumn("__name", company_from_title(title, request)).where(c("__name").isNotNull() & is_http_url(url))
    data = F.map_filter(
        F.create_map(F.lit("title"), F.substring(title, 1, 500), F.lit("snippet"), F.substring(content, 1, 1500), F.lit("relevance_score"), c("score").cast("string"), F.lit("query"), F.lit(request.query), F.lit("category_text"), F.when(kind, F.lit(request.category))),
        lambda k, v: v.isNotNull(),
    )
    return as_leads(
        rows.select(
            c("__name").alias("name"), first(PHONE).alias("phone"), number.alias("whatsapp"), F.when(number.isNotNull(), "Public page contains a WhatsApp-labelled number or wa.me link").alias("whatsapp_evidence"),
            F.when(placed, F.lit(request.location)).alias("city"), F.when(kind, F.lit(request.category)).alias("category"), F.when(~social, url).alias("website"), F.when(social, url).alias("instagram"),
            first(TAX_ID).alias("cnpj"), url.alias("source_url"), F.sha2(url.cast("binary"), 256).alias("external_id"), data.alias("data"),
        ),
        "tavily",
    )


def fetchable(pages: DataFrame, max_bytes: int = 512_000, max_redirects: int = 5) -> DataFrame:
    """Stored pages that a fetch would have accepted: public address, HTML, within the size bound.

    Where there is a column `hops` (urls of redirects, in order), there are max_redirects at most and each is public too;
    where there is `status`, it is a success.
    """
    c = F.col
    html = F.coalesce(F.lower("content_type").rlike(r"^(?:text/html|application/xhtml\+xml)"), F.lit(True)) if "content_type" in pages.columns else F.lit(True)
    hops = (F.coalesce(F.size("hops"), F.lit(0)) <= max_redirects) & F.coalesce(F.forall("hops", lambda u: public_url(u).isNotNull()), F.lit(True)) if "hops" in pages.columns else F.lit(True)
    status = F.coalesce(c("status").between(200, 299), F.lit(True)) if "status" in pages.columns else F.lit(True)
    return pages.where(public_url(c("url")).isNotNull() & html & hops & status & (F.octet_length("html") <= max_bytes))


def origin_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)), F.lit(""))


@lru_cache(maxsize=1024)
def _robots(body: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    return parser


def robots_verdicts(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Pages (url and others) with `robots`: allowed, denied or error, by stored robots.txt answers (origin, status, body).

    401 and 403 deny all, other answers from 400 on but 429 allow all, 429 and from 500 on are errors; so allow origins without an
    answer. Of a body the group of the agent counts, else that of `*`, and in it the first rule that fits.
    """
    c = F.col
    told = robots.groupBy(F.lower("origin").alias("__origin")).agg(F.min_by(F.struct("status", "body"), F.struct("status", "body")).alias("__r"))
    told = F.broadcast(told) if told.count() <= BROADCAST_ORIGINS else told

    @F.pandas_udf("boolean")
    def permits(url: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([_robots(b or "").can_fetch(agent, u or "") for u, b in zip(url, body, strict=True)], dtype=bool)

    rows = pages.withColumn("__page_origin", origin_of(c("url"))).join(told, c("__page_origin") == c("__origin"), "left")
    status = c("__r.status")
    verdict = (
        F.when(status.isNull(), "allowed").when(status.isin(401, 403), "denied").when((status == 429) | (status >= 500), "error").when(status >= 400, "allowed")
        .when(permits("url", "__r.body"), "allowed").otherwise("denied")
    )
    return rows.withColumn("robots", verdict).drop("__page_origin", "__origin", "__r")


def allowed_by_robots(pages: DataFrame, denied: DataFrame) -> DataFrame:
    """Pages not under a denied path (host, path) of their host; an empty table of denials allows all."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    rows = pages.withColumns({"__host": website_host(F.col("url")), "__path": F.when(path == "", "/").otherwise(path)})
    return rows.join(denied.select(F.col("host").alias("__h"), F.col("path").alias("__p")), (F.col("__host") == F.col("__h")) & F.col("__path").startswith(F.col("__p")), "left_anti").drop("__host", "__path")


@dataclass(frozen=True)
class WebSearchSource:
    path: str
    name: str = "tavily"
    capabilities: Capabilities = Capabilities(query_variations=True, whatsapp_evidence=True)

    def read(self, spark: SparkSession, request: Request) -> DataFrame:
        return result_leads(read_results(spark, self.path), request)
