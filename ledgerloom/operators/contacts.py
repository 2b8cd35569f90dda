"""Contact evidence: evaluation of records, choice of a number for each company, phone near a marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.phones import PHONE_LIKE, extract_phones, normalize_phone, whatsapp_link
from ..functions.urls import host_of, normalize_url, public_url

#: Weight of each type of evidence (fixed values); generic phones are no WhatsApp evidence.
PRIORITY = {"direct_link": 4, "structured_field": 3, "explicit_label": 2, "claimed_number": 1}
REASONS = {
    "no_url": "The WhatsApp claim has no valid public source URL.",
    "not_official": "The WhatsApp claim was not published by an official company source.",
    "link": "The official website publishes a WhatsApp contact link.",
    "field": "A public structured field explicitly named WhatsApp contains the number.",
    "field_other": "The structured field is not explicitly identified as WhatsApp.",
    "label": "Public text explicitly labels this number as WhatsApp.",
    "label_other": "The public text does not explicitly associate this number with WhatsApp.",
    "claim": "The source claims a candidate number without explicit public WhatsApp evidence.",
}
CONFIRMED = "A public source explicitly identifies this number as WhatsApp."
UNCONFIRMED = "A WhatsApp candidate exists, but explicit public evidence is insufficient."
NOT_FOUND = "No WhatsApp-specific number was found in the supplied evidence."
#: Types of evidence on a website and what they count as.
PAGE_TYPES = {"whatsapp_link": "direct_link", "explicit_whatsapp_label": "explicit_label"}


def bridged_type(page_type: Column) -> Column:
    out = F.lit("structured_field")
    for name, kind in PAGE_TYPES.items():
        out = F.when(page_type == name, F.lit(kind)).otherwise(out)
    return out


def direct_public_url(value: Column) -> Column:
    """The public URL of a WhatsApp link."""
    link = F.btrim(F.replace(F.trim(value), F.lit("&amp;"), F.lit("&")), F.lit("\"'<>.,;)"))
    link = F.when(F.lower(link).rlike(r"^(?:wa\.me|(?:api|web)\.whatsapp\.com)/"), F.concat(F.lit("https://"), link)).otherwise(link)
    return F.when(host_of(F.lower(link)).isin("wa.me", "api.whatsapp.com", "web.whatsapp.com", "whatsapp.com"), public_url(link))


def evaluated(evidence: DataFrame) -> DataFrame:
    """Evidence (schemas.EVIDENCE) with number, url, confirmed and reason; records without a WhatsApp number drop out."""
    c = F.col
    rows = evidence.where(c("evidence_type") != "generic_phone").withColumn("number", normalize_phone(c("value"))).where(c("number").isNotNull())
    rows = rows.withColumn("url", F.coalesce(public_url(c("source_url")), F.when(whatsapp_link(c("value")).isNotNull(), direct_public_url(c("value")))))
    identified = F.coalesce(c("context").rlike(r"(?i)\bwhats\s*app\b"), F.lit(False)) & ~T.is_negative_mention(c("context")) & F.coalesce(F.array_contains(extract_phones(c("context")), c("number")), F.lit(False))
    kind = c("evidence_type")
    reason = (
        F.when(c("url").isNull(), F.lit(REASONS["no_url"]))
        .when(~F.coalesce("official_source", F.lit(False)), F.lit(REASONS["not_official"]))
        .when(kind == "direct_link", F.lit(REASONS["link"]))
        .when(kind == "structured_field", F.when(T.is_whatsapp_label(c("field_name")), F.lit(REASONS["field"])).otherwise(F.lit(REASONS["field_other"])))
        .when(kind == "explicit_label", F.when(identified, F.lit(REASONS["label"])).otherwise(F.lit(REASONS["label_other"])))
        .otherwise(F.lit(REASONS["claim"]))
    )
    return rows.withColumn("reason", reason).withColumn("confirmed", F.col("reason").isin(REASONS["link"], REASONS["field"], REASONS["label"]))


def decisions(companies: DataFrame, evidence: DataFrame) -> DataFrame:
    """company_id, phone, whatsapp, status, alternates and reason for every company (company_id, phone).

    Of the numbers of a company's evidence that with a confirmed record wins, then the strongest type, then the most records,
    then the lesser number.
    """
    c = F.col
    strength = F.lit(0)
    for kind, n in PRIORITY.items():
        strength = F.when(c("evidence_type") == kind, F.lit(n)).otherwise(strength)
    numbers = evaluated(evidence).groupBy("company_id", "number").agg(F.bool_or("confirmed").alias("confirmed"), F.max(strength).alias("strength"), F.count(F.lit(1)).alias("records"))
    key = F.struct((~c("confirmed")).alias("a"), (-c("strength")).alias("b"), (-c("records")).alias("c"), c("number").alias("number"), c("confirmed").alias("confirmed"))
    found = numbers.groupBy("company_id").agg(F.array_sort(F.collect_list(key)).alias("ranked"))
    first = c("ranked")[0]
    return companies.select("company_id", normalize_phone(c("phone")).alias("phone")).join(found, "company_id", "left").select(
        "company_id", "phone", first["number"].alias("whatsapp"),
        F.when(first.isNull(), "not_found").when(first["confirmed"], "confirmed").otherwise("unconfirmed").alias("status"),
        F.coalesce(F.transform(F.slice("ranked", 2, F.greatest(F.lit(1), F.size("ranked"))), lambda x: x["number"]), F.array().cast("array<string>")).alias("alternates"),
        F.when(first.isNull(), NOT_FOUND).when(first["confirmed"], CONFIRMED).otherwise(UNCONFIRMED).alias("reason"),
    )


def nearest_phone(text: Column, marker: Column) -> Column:
    """The number of the text nearest to the place `marker` (0-based); numbers after it come before those ahead of it."""
    # the characters before the i-th match, by cutting the text at each match
    found = F.regexp_extract_all(text, F.lit(PHONE_LIKE), F.lit(1))
    state = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<late:int,far:int,number:string>>").alias("seen")),
        lambda acc, m: _next_phone(acc, m, text, marker),
    )
    return F.array_min(F.filter(state["seen"], lambda x: x["number"].isNotNull()))["number"]


def _next_phone(acc: Column, m: Column, text: Column, marker: Column) -> Column:
    start = acc["at"] + F.call_function("instr", F.substring(text, acc["at"] + 1, F.length(text)), m) - 1
    end = start + F.length(m)
    far = F.least(F.abs(start - marker), F.abs(end - marker)).cast("int")
    row = F.struct(F.when(start >= marker, -1).otherwise(0).alias("late"), far.alias("far"), normalize_phone(m).alias("number"))
    return F.struct(end.cast("int").alias("at"), F.concat(acc["seen"], F.array(row)).alias("seen"))


def source_supports(number: Column, title: Column, snippet: Column, tag: Column) -> Column:
    """Whether a source's own text or tag holds a number, with or without country code."""
    held = T.digits(F.concat_ws(" ", title, snippet))
    short = F.regexp_replace(number, "^55", "")
    return F.coalesce(F.contains(held, number) | F.contains(held, short), F.lit(False)) | F.coalesce(normalize_phone(tag) == number, F.lit(False))


def is_canonical_website(provider: Column, source_url: Column, website: Column) -> Column:
    """Whether a source is the company's own website."""
    return F.coalesce((provider == "official_website") & (host_of(normalize_url(source_url)) == host_of(normalize_url(website))), F.lit(False))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """Page evidence without repetitions of field, value, type and page: the first of each stays."""
    key = Window.partitionBy("page_id", "field", "value", "evidence_type", "url").orderBy("seq")
    return evidence.withColumn("__n", F.row_number().over(key)).where("__n = 1").drop("__n")


def preferred_phone(evidence: DataFrame) -> DataFrame:
    """page_id and its preferred phone: by type of evidence, contact pages first, then as seen."""
    order = {"whatsapp_link": 0, "tel_link": 0, "structured_data": 1, "meta_tag": 2, "embedded_data": 3, "html_attribute": 4, "explicit_whatsapp_label": 4, "visible_text": 5}
    rank = F.lit(10)
    for kind, n in order.items():
        rank = F.when(F.col("evidence_type") == kind, F.lit(n)).otherwise(rank)
    contact = T.normalize_text(F.col("url")).rlike("contato|contact|fale-conosco|atendimento")
    return evidence.where(F.col("field") == "phone").groupBy("page_id").agg(F.min_by("value", F.struct(rank, ~contact, "seq")).alias("phone"))
