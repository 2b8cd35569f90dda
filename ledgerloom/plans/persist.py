"""Persistence of ranked results: which stored companies they are, what is inserted or enriched, and the rows of all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, storage
from ..operators.graph import cut

COMPANY = ("name", "cnpj", "phone", "whatsapp", "website", "city", "state", "address", "category", "instagram", "confidence", "whatsapp_status")


EVIDENCE = ("contact_type", "evidence_type", "source_provider", "source_url", "normalized_value", "official_source", "excerpt")


def evidence_rows(results: DataFrame, ranked: DataFrame, whatsapp: DataFrame, phones: DataFrame) -> DataFrame:
    """result_id, company_id and EVIDENCE: what the results' contacts rest on, each fact of a page once.

    whatsapp: rank and evaluated evidence (contacts.evaluated), of which records with a public page stay; phones: rank, field, value, evidence_type,
    source_url, excerpt of official pages, of which those of the chosen number stay.
    """
    c = F.col
    said = whatsapp.where(c("url").isNotNull()).select("rank", F.lit("whatsapp").alias("contact_type"), "evidence_type", c("source").alias("source_provider"), c("url").alias("source_url"), c("number").alias("normalized_value"), F.coalesce("official_source", F.lit(False)).alias("official_source"), T.excerpt(c("context")).alias("excerpt"))
    own = storage.phone_evidence(ranked.select(c("rank").alias("company_id"), "phone"), phones.withColumnRenamed("rank", "company_id"))
    own = own.select(c("company_id").alias("rank"), F.lit("phone").alias("contact_type"), "evidence_type", F.lit("official_website").alias("source_provider"), "source_url", "normalized_value", F.lit(True).alias("official_source"), "excerpt")
    key = ["rank", "contact_type", "evidence_type", "source_provider", "source_url", "normalized_value"]
    rows = said.unionByName(own).groupBy(*key).agg(F.bool_or("official_source").alias("official_source"), F.min("excerpt").alias("excerpt"))
    return results.select("rank", "result_id", "company_id").join(rows, "rank").select("result_id", "company_id", *EVIDENCE)


def finished(search_id: int, ranked: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: the search's status and message by its sources' runs, and the counters of its results."""
    c = F.col
    told = metrics.outcome(runs.select("search_id", "provider", (c("status") != "failed").alias("succeeded"), "limit_reached", "error"))
    counts = metrics.counters(ranked.withColumn("search_id", F.lit(search_id)))
    return told.join(counts, "search_id", "left").fillna(0, ["results", "whatsapp", "confirmed", "enriched", "classified"])


def plan(ranked: DataFrame, stored: DataFrame, search_id: int, whatsapp: DataFrame | None = None, phones: DataFrame | None = None, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables after a search: companies, search_results, result_sources; with evidence contact_evidences, with runs provider_runs and searches.

    ranked: rank, sources and the columns of COMPANY; stored: company_id and those columns. Ranks choose stored companies in
    turn; those without one are inserted under an id made of their identity, so that a run repeated gives the same rows.
    """
    c = F.col
    matches = storage.assign(storage.match_scores(ranked, stored)).select("rank", "company_id")
    told = cut(ranked.join(matches, "rank", "left"))
    fresh = storage.new_companies(told.where("company_id is null")).withColumn("company_id", F.xxhash64(F.lit(search_id), "rank", "name_fingerprint"))
    left = stored.select("company_id", *[c(x).alias(f"s_{x}") for x in COMPANY if x != "whatsapp_status"], c("whatsapp_status").alias("s_status"))
    right = told.where("company_id is not null").select("company_id", *[c(x).alias(f"r_{x}") for x in COMPANY if x != "whatsapp_status"], c("whatsapp_status").alias("r_status"))
    changed = storage.enriched(left.join(right, "company_id")).join(stored.select("company_id", "name"), "company_id")
    kept = stored.join(matches.select("company_id"), "company_id", "left_anti")
    columns = ["company_id", *COMPANY]
    companies = kept.select(*columns).unionByName(changed.select(*columns)).unionByName(fresh.select(*columns))
    ids = told.where("company_id is not null").select("rank", "company_id").unionByName(fresh.select("rank", "company_id"))
    results = ids.join(ranked.select("rank", "confidence"), "rank").select(F.xxhash64(F.lit(search_id), "rank").alias("result_id"), F.lit(search_id).alias("search_id"), "company_id", "rank", "confidence")
    sources = ranked.select(F.xxhash64(F.lit(search_id), "rank").alias("result_id"), F.explode("sources").alias("s")).select("result_id", "s.provider", "s.source_url", "s.external_id")
    companies = companies.withColumn("normalized_name", T.company_name(c("name"))).withColumn("name_fingerprint", T.fingerprint(c("normalized_name")))
    tables = {"companies": companies, "search_results": results, "result_sources": sources}
    if whatsapp is not None and phones is not None:
        tables["contact_evidences"] = evidence_rows(results, ranked, whatsapp, phones)
    if runs is not None:
        tables |= {"provider_runs": runs, "searches": finished(search_id, ranked, runs)}
    return tables


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet in its own folder; one that is being read must go to another place."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
