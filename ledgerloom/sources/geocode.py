"""Areas from saved geocoder answers, and requests with their area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Keys of an address that name its city, best first (fixed values).
CITY_KEYS = ("city", "town", "village", "municipality", "city_district")
ANSWER = "location string, results array<struct<boundingbox:array<string>,address:map<string,string>,display_name:string>>"
#: Most areas (some 100 bytes each) that are broadcast to requests.
BROADCAST_AREAS = 500_000


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER).json(path)


def geocode_query(location: Column) -> Column:
    """What the geocoder is asked: the location, with its country if it names none."""
    return F.when(F.array_contains(F.split(T.normalize_text(location), " "), "brasil"), location).otherwise(F.concat(location, F.lit(", Brasil")))


def areas(answers: DataFrame) -> DataFrame:
    """key (normal form of the location), south, west, north, east, city, state and display_name of each answer's first result.

    Answers without a result, or whose box is no box on earth, give no area. Of several answers for one key the least by
    display name stays.
    """
    c = F.col
    first = F.get("results", F.lit(0))
    box = [F.get(first["boundingbox"], F.lit(i)).try_cast("double") for i in range(4)]
    tag = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at(first["address"], F.lit(k))), F.lit("")) for k in keys])
    rows = answers.where(F.size(first["boundingbox"]) == 4).select(
        T.normalize_text(c("location")).alias("key"), box[0].alias("south"), box[2].alias("west"), box[1].alias("north"), box[3].alias("east"),
        tag(*CITY_KEYS).alias("city"), tag("state").alias("state"), F.nullif(F.trim(first["display_name"]), F.lit("")).alias("display_name"),
    )
    good = (c("south") < c("north")) & c("south").between(-90, 90) & c("north").between(-90, 90) & (c("west") < c("east")) & c("west").between(-180, 180) & c("east").between(-180, 180)
    names = ["south", "west", "north", "east", "city", "state", "display_name"]
    return rows.where(good).groupBy("key").agg(F.min_by(F.struct(*names), F.struct("display_name", "south", "west")).alias("a")).select("key", "a.*")


def located(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (location and others) with their area's columns; null where none is known."""
    known = known.withColumnRenamed("key", "__key")
    known = F.broadcast(known) if known.count() <= BROADCAST_AREAS else known
    return requests.withColumn("__location", T.normalize_text(F.col("location"))).join(known, F.col("__location") == F.col("__key"), "left").drop("__location", "__key")
