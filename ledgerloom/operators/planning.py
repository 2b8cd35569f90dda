"""Planning of a search: criteria, category terms and query variations, for tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Request
from ..functions import text as T

#: Triggers found in a normalised category, and the terms it stands for (fixed values).
SEMANTIC_CATEGORIES = (
    (("imobili", "corretor de imove", "negocio imobiliario"), ("imobiliária", "imobiliárias", "corretora de imóveis", "corretor de imóveis", "negócios imobiliários", "administração de imóveis", "venda de imóveis", "aluguel de imóveis")),
    (("dentist", "odontolog", "clinica odontologica"), ("dentista", "dentistas", "clínica odontológica", "consultório odontológico", "odontologia")),
    (("contab", "contador", "escritorio contabil"), ("contabilidade", "contador", "contadores", "escritório contábil", "assessoria contábil", "serviços contábeis")),
    (("oficina mecan", "mecanic", "auto mecan", "car repair"), ("oficina mecânica", "oficinas mecânicas", "mecânica automotiva", "reparo automotivo", "centro automotivo")),
    (("restaur",), ("restaurante", "restaurantes", "gastronomia", "comida e restaurante")),
)


def criteria(requests: DataFrame) -> DataFrame:
    """Requests (query, category, location) with what the query's own wording adds to a missing category or location."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))
    split = T.split_query(F.col("query"))
    return requests.withColumn("__s", split).withColumns({
        "query": clean(F.col("query")), "category": F.coalesce(clean(F.col("category")), F.col("__s.category")), "location": F.coalesce(clean(F.col("location")), F.col("__s.location")),
    }).drop("__s")


def category_terms(category: Column) -> Column:
    """The category and what else it is called, as an array in order; later spellings of one normal form drop out."""
    clean = F.trim(F.regexp_replace(category, r"(?U)\s+", " "))
    plain = T.normalize_text(clean)
    more = F.array(T.number_variant(clean))
    for triggers, terms in reversed(SEMANTIC_CATEGORIES):
        hit = F.lit(False)
        for t in triggers:
            hit = hit | F.contains(plain, F.lit(t))
        more = F.when(hit, F.array(*[F.lit(t) for t in terms])).otherwise(more)
    return first_by_key(F.concat(F.array(clean), more), T.normalize_text)


def first_by_key(values: Column, key) -> Column:
    """An array's values of which each key's first stays, in order; empty keys drop out."""
    keyed = F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v")))
    kept = F.aggregate(
        keyed, F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, x: F.when((x["k"] == "") | F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(kept, lambda x: x["v"])


def query_variations(requests: DataFrame, limit: int = 4) -> DataFrame:
    """Requests with `variation` and its `position` from 0: at most `limit` distinct queries for each."""
    rows = criteria(requests)
    both = F.col("category").isNotNull() & F.col("location").isNotNull()
    terms = F.transform(category_terms(F.col("category")), lambda t: F.concat(t, F.lit(" em "), F.col("location")))
    plain = F.array(F.col("query"), F.concat(F.col("query"), F.lit(' telefone contato "site oficial"')), F.concat(F.col("query"), F.lit(" WhatsApp")))
    found = F.slice(first_by_key(F.when(both, terms).otherwise(plain), F.lower), 1, limit)
    return rows.select("*", F.posexplode(found).alias("position", "variation"))


def variations(spark: SparkSession, request: Request, limit: int) -> list[str]:
    """The queries of one request, in order."""
    asked = spark.createDataFrame([(request.query, request.category, request.location)], "query string, category string, location string")
    return [r.variation for r in query_variations(asked, limit).select("position", "variation").orderBy("position").collect()] or [request.query]


def first_match(rows: DataFrame, text: Column, stems: tuple[tuple[str, str], ...], name: str) -> DataFrame:
    """rows with column `name`: of the (stem, value) pairs, in order, the value of the first whose stem the normalised text holds."""
    plain = T.normalize_text(text)
    out = F.lit(None).cast("string")
    for stem, value in reversed(stems):
        out = F.when(F.contains(plain, F.lit(stem)), F.lit(value)).otherwise(out)
    return rows.withColumn(name, out)


def chunks(rows: DataFrame, order: list[Column], size: int, budget: int, by: list[str]) -> DataFrame:
    """The first `budget` rows of each group with their batch number and a reference C1, C2... within the batch."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") <= budget).withColumns({
        "batch": F.floor((F.col("__n") - 1) / size).cast("int"), "ref": F.concat(F.lit("C"), ((F.col("__n") - 1) % size + 1).cast("string")),
    }).drop("__n")
