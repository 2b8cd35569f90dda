"""OpenStreetMap elements: saved Overpass answers (JSON) or tables of elements, as leads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Request
from ..functions import text as T
from ..functions.phones import PHONE_LIKE, first_of_list, normalize_phone
from ..functions.urls import first_in_list
from ..schemas import OSM_ELEMENT
from .base import Capabilities, as_leads
from .places import category_of

#: For each category the (key, pattern) of tags that select its elements (fixed values).
SELECTORS = {
    "Restaurante": (("amenity", "^restaurant$"),),
    "Clínica odontológica": (("amenity", "^dentist$"), ("healthcare", "^dentist$"), ("healthcare:speciality", "(?i)(^|;)dentistry(;|$)")),
    "Contabilidade": (("office", "^accountant$"), ("craft", "^accountant$")),
    "Oficina mecânica": (("shop", "^car_repair$"), ("craft", "^car_repair$")),
    "Imobiliária": (("office", "^estate_agent$"), ("shop", "^estate_agent$")),
}
KEPT_TAGS = ("amenity", "healthcare", "healthcare:speciality", "office", "craft", "shop")


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Elements of saved answers, with the answer's remark (a remark reports a failed query)."""
    schema = f"remark string, elements array<struct<{','.join(x.replace(' ', ':', 1) for x in OSM_ELEMENT.split(', '))}>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    return raw.select("remark", F.posexplode("elements").alias("seq", "e")).select("remark", "seq", "e.*")


def tag(*keys: str) -> Column:
    """The first of the tags that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit("")) for k in keys])


def selected(category: str) -> Column:
    out = F.lit(False)
    for key, pattern in SELECTORS[category]:
        out = out | F.coalesce(F.try_element_at("tags", F.lit(key)).rlike(pattern), F.lit(False))
    return out


def valid_element() -> Column:
    return F.coalesce(F.col("type").isin("node", "way", "relation") & F.col("id").isNotNull() & (F.col("id") >= 0) & F.col("tags").isNotNull() & tag("name", "brand", "operator").isNotNull(), F.lit(False))


def inside(area: tuple[float, float, float, float]) -> Column:
    west, south, east, north = area
    lon, lat = F.coalesce("lon", "center.lon"), F.coalesce("lat", "center.lat")
    return lon.between(west, east) & lat.between(south, north)


def element_leads(elements: DataFrame, category: str, city: str | None = None, state: str | None = None) -> DataFrame:
    """Valid elements as leads, the first of each type and id by `seq`."""
    w = Window.partitionBy("type", "id").orderBy("seq")
    rows = elements.where(valid_element()).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    raw = tag("contact:whatsapp", "whatsapp")
    number = normalize_phone(raw)
    street = F.concat_ws(", ", tag("addr:street"), tag("addr:housenumber"))
    address = F.coalesce(tag("addr:full"), F.nullif(F.concat_ws(" - ", F.nullif(street, F.lit("")), tag("addr:suburb", "addr:neighbourhood")), F.lit("")))
    vat = tag("ref:vatin")
    phone = first_of_list(tag("contact:phone", "phone", "telephone", "contact:mobile", "mobile"))
    kept = F.map_filter("tags", lambda k, v: k.isin(*KEPT_TAGS))
    key = tag_name("contact:whatsapp", "whatsapp")
    place = F.concat_ws("/", "type", F.col("id").cast("string"))
    return as_leads(
        rows.select(
            tag("name", "brand", "operator").alias("name"), F.coalesce(F.nullif(F.regexp_extract(phone, PHONE_LIKE, 1), F.lit("")), phone).alias("phone"), number.alias("whatsapp"),
            F.when(number.isNotNull(), F.concat(F.lit('Public OpenStreetMap tag "'), key, F.lit('" explicitly identifies this number as WhatsApp.'))).alias("whatsapp_evidence"),
            address.alias("address"), F.coalesce(tag("addr:city", "addr:town", "addr:village", "addr:municipality"), F.lit(city)).alias("city"), F.coalesce(tag("addr:state"), F.lit(state)).alias("state"),
            F.lit(category).alias("category"), first_in_list(tag("contact:website", "website", "url")).alias("website"), tag("contact:instagram", "instagram").alias("instagram"),
            T.tax_id(F.coalesce(tag("ref:cnpj", "cnpj"), F.when(F.lower(vat).startswith("br"), vat))).alias("cnpj"),
            F.concat(F.lit("https://www.openstreetmap.org/"), place).alias("source_url"), F.concat_ws(":", F.lit("osm"), "type", F.col("id").cast("string")).alias("external_id"), kept.alias("data"),
        ),
        "openstreetmap",
    )


def tag_name(*keys: str) -> Column:
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit("")).isNotNull(), F.lit(k)).otherwise(out)
    return out


def counts(elements: DataFrame) -> DataFrame:
    """raw and rejected elements."""
    return elements.agg(F.count(F.lit(1)).alias("raw"), F.count_if(~valid_element()).alias("rejected"))


def overpass_query(category: str, area: tuple[float, float, float, float], seconds: int = 45) -> str:
    """The Overpass text that asks for a category's elements in an area; kept for whoever saves the answers."""
    west, south, east, north = area
    box = f"({south},{west},{north},{east})"

    def selector(key: str, pattern: str) -> str:
        plain = pattern.strip("^$")
        return f'["{key}"="{plain}"]' if pattern == f"^{plain}$" else f'["{key}"~"{pattern.removeprefix("(?i)")}",i]'

    return f"[out:json][timeout:{seconds}];(" + "".join(f"nwr{selector(k, p)}{box};" for k, p in SELECTORS[category]) + ");out center;"


@dataclass(frozen=True)
class OverpassSource:
    path: str
    areas: dict[str, tuple]
    name: str = "openstreetmap"
    capabilities: Capabilities = Capabilities(phone=True, whatsapp_evidence=True)

    def read(self, spark: SparkSession, request: Request) -> DataFrame:
        category = category_of(request.category or request.query or "")
        if category is None or request.location not in self.areas:
            raise ValueError("the request needs a known category and location")
        *box, city, state = self.areas[request.location]
        elements = read_overpass(spark, self.path)
        if not elements.where("remark is not null").isEmpty():
            raise ValueError("a saved answer reports an error")
        return element_leads(elements.where(selected(category[0]) & inside(tuple(box))), category[0], city, state)
