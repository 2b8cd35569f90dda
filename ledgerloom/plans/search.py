"""The life of a search as one plan: scan, resolve, enrich from stored pages, decide contacts, qualify, rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Request, Settings
from ..functions import text as T
from ..functions.urls import DIRECTORY_HOSTS, host_of, normalize_url, website_host
from ..operators import contacts, metrics, planning, qualify, resolve
from ..operators.cache import Cache, remembered
from ..operators.graph import cut
from ..operators.page_evidence import crawl, page_evidence
from ..sources.base import Source

#: Words of names that don't tell a company from others (fixed values).
GENERIC_TOKENS = ("brasil", "clinica", "contabilidade", "empresa", "grupo", "mecanica", "odontologia", "oficina", "restaurante", "servicos")


def asked(spark: SparkSession, request: Request, source: Source, settings: Settings) -> list[Request]:
    """The request, or for a source that knows them its variations, of which the driver holds a handful."""
    if not source.capabilities.query_variations:
        return [request]
    return [replace(request, query=q) for q in planning.variations(spark, request, settings.query_variations)]


def scan(spark: SparkSession, request: Request, sources: list[Source], settings: Settings = Settings(), cache: Cache | None = None) -> DataFrame:
    """Leads of all sources and their variations, each source's identities once and capped."""
    leads = None
    for source in sources:
        for position, one in enumerate(asked(spark, request, source, settings)):
            part = remembered(cache, spark, source, one) if cache is not None else source.read(spark, one)
            part = part.withColumn("__variation", F.lit(position))
            leads = part if leads is None else leads.unionByName(part)
    if leads is None:
        raise ValueError("no source is configured")
    order = [F.col("__variation"), F.col("external_id"), F.col("source_url"), F.col("name"), F.col("obs_id")]
    leads = metrics.first_seen(leads, order)
    return metrics.capped(leads, order, settings.max_items_per_source).drop("__variation")


def needs_enrichment(companies: DataFrame) -> DataFrame:
    gap = F.lit(False)
    for f in ("phone", "instagram", "address", "cnpj"):
        gap = gap | F.coalesce(F.col(f) == "", F.lit(True))
    return companies.where(F.col("website").isNotNull() & (~F.col("whatsapp_confirmed") | gap))


def attributed(companies: DataFrame) -> DataFrame:
    """Companies whose website is their own: no shared host, and a word of the name is in the domain or a map source names it."""
    host = website_host(F.col("website"))
    squeezed = F.regexp_replace(F.regexp_replace(host, ":.*$", ""), "[-.]", "")
    tokens = F.filter(F.split(T.company_name(F.col("name")), " "), lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC_TOKENS))
    declared = F.exists("sources", lambda s: (s["provider"] == "openstreetmap") & F.contains(s["data"], host))
    return companies.where(host.isNotNull() & ~host.isin(*DIRECTORY_HOSTS) & (F.exists(tokens, lambda t: F.contains(squeezed, t)) | F.coalesce(declared, F.lit(False))))


def site_observations(companies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observations of companies' own websites (one per company) from page evidence: only those that add what is missing."""
    c = F.col
    pages = evidence.withColumn("host", host_of(normalize_url(c("url"))))
    of = companies.select("cluster", website_host(c("website")).alias("host"), "website", "name", "city", "state", "category", *[c(f).isNull().alias(f"no_{f}") for f in ("phone", "instagram", "address", "cnpj")], (~c("whatsapp_confirmed")).alias("no_whatsapp"))
    rows = of.join(pages, "host")
    useful = F.lit(False)
    for f in ("phone", "instagram", "address", "cnpj", "whatsapp"):
        useful = useful | (c(f"no_{f}") & (c("field") == f))
    first = lambda f: F.min_by(F.when(c("field") == f, c("value")), F.when(c("field") == f, F.struct("url", "seq"))).alias(f)
    found = rows.groupBy("cluster", "website", "name", "city", "state", "category").agg(F.bool_or(useful).alias("useful"), *[first(f) for f in ("phone", "whatsapp", "instagram", "address", "cnpj")], F.min_by("excerpt", F.when(c("field") == "whatsapp", F.struct("url", "seq"))).alias("said")).where("useful")
    data = F.create_map(F.lit("website"), c("website"))
    return found.select(
        F.xxhash64(F.lit("site"), "cluster").alias("obs_id"), "name", F.coalesce("phone", "whatsapp").alias("phone"), "whatsapp", c("whatsapp").isNotNull().alias("whatsapp_confirmed"), F.when(c("whatsapp").isNotNull(), F.coalesce("said", F.lit("Official website WhatsApp evidence"))).alias("whatsapp_evidence"),
        "address", "city", "state", "category", "website", "instagram", "cnpj", F.lit("official_website").alias("provider"), c("website").alias("source_url"), F.sha2(c("website").cast("binary"), 256).alias("external_id"), data.alias("data"),
    )


def run(
    spark: SparkSession, request: Request, sources: list[Source], pages: DataFrame | None = None, settings: Settings = Settings(),
    classifier: Callable[[pd.DataFrame], pd.DataFrame] | None = None, cache: Cache | None = None,
) -> DataFrame:
    """Ranked companies of a search, with contact decisions and qualification.

    Sources that know query variations are asked for each; a cache keeps their answers. Of stored pages those that a crawl of
    enrichment_pages reaches from a company's website give evidence. What the rules leave open goes to the classifier, if there
    is one, within classifier_rows.
    """
    leads = cut(scan(spark, request, sources, settings, cache).drop("limit_reached"))
    companies = resolve.resolve(leads, settings.host_block_rows)
    evidence = None
    if pages is not None:
        wanted = resolve.ranked(attributed(needs_enrichment(companies))).where(F.col("rank") <= settings.enrichment_companies)
        starts = wanted.select(normalize_url(F.col("website")).alias("start")).distinct()
        near = crawl(pages.withColumn("url", normalize_url(F.col("url"))), starts, settings.enrichment_pages).select("url").distinct()
        evidence = cut(page_evidence(pages.withColumn("url", normalize_url(F.col("url"))).join(near, "url", "left_semi")))
        extra = cut(site_observations(wanted, evidence))
        leads = leads.unionByName(extra)
        companies = resolve.resolve(leads, settings.host_block_rows)
    companies = cut(companies)
    records = companies.select(F.col("cluster").alias("company_id"), "whatsapp", "website", "whatsapp_evidence", F.explode("sources").alias("s")).where("whatsapp is not null")
    records = records.select(
        "company_id", F.col("whatsapp").alias("value"), F.when(F.col("s.provider") == "official_website", "explicit_label").otherwise("claimed_number").alias("evidence_type"), F.col("s.source_url").alias("source_url"), F.col("s.provider").alias("source"),
        contacts.is_canonical_website(F.col("s.provider"), F.col("s.source_url"), F.col("website")).alias("official_source"), F.get("whatsapp_evidence", F.lit(0)).alias("context"), F.lit("WhatsApp").alias("field_name"),
    )
    if evidence is not None:
        sites = companies.select(F.col("cluster").alias("company_id"), website_host(F.col("website")).alias("host"))
        more = evidence.where("field = 'whatsapp'").withColumn("host", host_of(normalize_url(F.col("url")))).join(sites, "host")
        records = records.unionByName(more.select("company_id", "value", contacts.bridged_type(F.col("evidence_type")).alias("evidence_type"), F.col("url").alias("source_url"), F.lit("official_website").alias("source"), F.lit(True).alias("official_source"), F.col("excerpt").alias("context"), F.lit("WhatsApp").alias("field_name")))
    decided = contacts.decisions(companies.select(F.col("cluster").alias("company_id"), "phone"), records).withColumnRenamed("company_id", "cluster")
    told = companies.drop("phone", "whatsapp").join(decided.select("cluster", "phone", "whatsapp", F.col("status").alias("whatsapp_status")), "cluster")
    context = qualify.with_context(told.withColumns({"requested": F.lit(request.category), "source_texts": qualify.source_texts(F.col("sources"))}))
    judged = resolve.ranked(qualify.deterministic(context))
    if classifier is not None and settings.classifier_rows:
        judged = qualify.with_classifier(cut(judged), classifier, settings.classifier_rows, settings.classifier_batch)
    return judged.drop("q", "c", "n", "s", "requested", "source_texts", "refs")
