"""Overture-shaped places: nested Parquet rows, filtered by area and taxonomy, as leads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Request
from ..functions import text as T
from ..functions.urls import first_public
from .base import Capabilities, as_leads

#: Canonical category, triggers in a request, taxonomy terms, generic terms, and stems of names that make a generic term specific (fixed values).
CATEGORIES = (
    ("Imobiliária", ("imobili", "corretor", "negocio imobiliario", "administracao de imove", "estate agent"), ("commercial_real_estate", "property_management", "real_estate_agent", "real_estate_investment"), ("real_estate_service",), ("imobili", "imove", "corret", "negocio imobiliario", "real estate", "property")),
    ("Clínica odontológica", ("odontolog", "dentist", "clinica odontologica"), ("dentist", "dental_clinic", "orthodontist"), (), ()),
    ("Contabilidade", ("contab", "contador", "escritorio contabil"), ("accountant", "accounting_service", "tax_service"), (), ()),
    ("Oficina mecânica", ("oficina mecan", "mecanic", "auto mecan", "car repair"), ("auto_repair", "automotive_repair", "car_repair", "vehicle_repair"), (), ()),
    ("Restaurante", ("restaur",), ("restaurant",), (), ()),
)
CLOSED = ("closed", "permanently_closed", "temporarily_closed")


def category_of(text: str) -> tuple | None:
    """The first category whose trigger the normalised text holds."""
    import unicodedata

    plain = " ".join("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold().split())
    return next((c for c in CATEGORIES if any(t in plain for t in c[1])), None)


def taxonomy(df: DataFrame) -> Column:
    """A place's categories in lower case; the legacy ones only where it has no others."""
    strings = lambda *xs: F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in xs])
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    modern = clean(strings(F.array("basic_category"), F.array("taxonomy.primary"), F.col("taxonomy.hierarchy"), F.col("taxonomy.alternates")))
    legacy = clean(strings(F.array("categories.primary"), F.col("categories.alternate")))
    return F.when(F.size(modern) > 0, modern).otherwise(legacy)


def relevant(terms: Column, category: tuple) -> Column:
    return F.arrays_overlap(terms, F.array(*[F.lit(x) for x in (*category[2], *category[3])]))


def matches(terms: Column, name: Column, category: tuple) -> Column:
    """A specific term, or a generic one and a name that says so."""
    has = lambda xs: F.arrays_overlap(terms, F.array(*[F.lit(x) for x in xs])) if xs else F.lit(False)
    named = F.lit(False)
    for stem in category[4]:
        named = named | F.contains(T.normalize_text(name), F.lit(stem))
    return F.coalesce(has(category[2]) | (has(category[3]) & named), F.lit(False))


def inside(area: tuple[float, float, float, float]) -> Column:
    """Boxes that overlap the area (west, south, east, north); such plain bounds reach the Parquet scan."""
    west, south, east, north = area
    return (F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south)


def distinct_texts(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def place_leads(places: DataFrame, category: tuple, area: tuple[float, float, float, float], city: str | None = None, state: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Places (schemas.OVERTURE_PLACE) of the category in the area as leads: first of each id by confidence, closed ones left out.

    A place without confidence stays.
    """
    c = F.col
    rows = places.where(inside(area)).withColumn("__t", taxonomy(places)).where(relevant(c("__t"), category) & matches(c("__t"), c("names.primary"), category))
    rows = rows.where((F.trim("id") != "") & (F.trim("names.primary") != "") & (c("confidence").isNull() | (c("confidence") >= min_confidence)) & ~F.coalesce(F.lower("operating_status").isin(*CLOSED), F.lit(False)))
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("confidence"), "names.primary")
    rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    address = F.get("addresses", F.lit(0))
    joined = lambda f: F.array_join(distinct_texts(F.transform("sources", f)), ",")
    data = F.map_filter(
        F.create_map(
            F.lit("overture_id"), c("id"), F.lit("confidence"), c("confidence").cast("string"), F.lit("basic_category"), c("basic_category"),
            F.lit("datasets"), joined(lambda s: s["dataset"]), F.lit("licenses"), joined(lambda s: s["license"]), F.lit("source_updates"), joined(lambda s: s["update_time"]),
            F.lit("longitude"), ((c("bbox.xmin") + c("bbox.xmax")) / 2).cast("string"), F.lit("latitude"), ((c("bbox.ymin") + c("bbox.ymax")) / 2).cast("string"),
        ),
        lambda k, v: v.isNotNull() & (v != ""),
    )
    return as_leads(
        rows.select(
            F.trim("names.primary").alias("name"), F.get("phones", F.lit(0)).alias("phone"), F.nullif(F.concat_ws(", ", F.nullif(F.trim(address["freeform"]), F.lit(""))), F.lit("")).alias("address"),
            F.coalesce(address["locality"], F.lit(city)).alias("city"), F.coalesce(address["region"], F.lit(state)).alias("state"), F.lit(category[0]).alias("category"), first_public(c("websites")).alias("website"),
            F.get(F.filter("socials", lambda s: s.rlike(r"(?i)^https?://(?:www\.)?instagram\.com(?:[/?#]|$)")), F.lit(0)).alias("instagram"), F.concat(F.lit("overture:"), "id").alias("external_id"), data.alias("data"),
        ),
        "overture",
    )


@dataclass(frozen=True)
class PlacesSource:
    """Places in Parquet files at `path`, with the area of the request from `areas` (location: west, south, east, north, city, state)."""

    path: str
    areas: dict[str, tuple]
    min_confidence: float = 0.0
    name: str = "overture"
    capabilities: Capabilities = Capabilities(phone=True)

    def read(self, spark: SparkSession, request: Request) -> DataFrame:
        category = category_of(request.category or request.query or "")
        if category is None or request.location not in self.areas:
            raise ValueError("the request needs a known category and location")
        *box, city, state = self.areas[request.location]
        return place_leads(spark.read.parquet(self.path), category, tuple(box), city, state, self.min_confidence)
