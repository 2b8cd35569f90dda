"""The contract of a source: it reads stored answers of a provider as leads (schemas.LEAD)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Request
from ..schemas import LEAD


@dataclass(frozen=True)
class Capabilities:
    pagination: bool = False
    query_variations: bool = False
    phone: bool = True
    whatsapp_evidence: bool = False
    enrichment: bool = False


class Source(Protocol):
    name: str
    capabilities: Capabilities

    def read(self, spark: SparkSession, request: Request) -> DataFrame: ...


_registry: dict[str, Source] = {}


def register(source: Source) -> Source:
    _registry[source.name] = source
    return source


def registered() -> dict[str, Source]:
    return dict(_registry)


def as_leads(df: DataFrame, provider: str) -> DataFrame:
    """A frame with some of a lead's columns as one with all; obs_id from provider and external id."""
    types = dict(x.strip().split(" ", 1) for x in LEAD.split(", "))
    out = df.withColumn("provider", F.lit(provider))
    out = out.withColumns({n: F.lit(None).cast(t) for n, t in types.items() if n not in out.columns})
    out = out.withColumn("whatsapp_confirmed", F.coalesce("whatsapp_confirmed", F.lit(False))).withColumn("obs_id", F.coalesce("obs_id", F.xxhash64("provider", "external_id", "source_url", "name")))
    return out.select(*[F.col(n).cast(t).alias(n) for n, t in types.items()])
