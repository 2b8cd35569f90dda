"""Settings of a run, with their ranges, and the checks of a request."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Name: (default, least, greatest).
RANGES = {
    "max_items_per_source": (5000, 1, 100_000),
    "max_pages_per_source": (10, 1, 1000),
    "query_variations": (4, 1, 8),
    "enrichment_companies": (250, 0, 5000),
    "enrichment_pages": (3, 1, 5),
    "classifier_rows": (25, 0, 500),
    "classifier_batch": (10, 1, 25),
    "host_block_rows": (50, 2, 1000),
    "result_page": (50, 1, 200),
    "cache_entries": (500, 1, 1_000_000),
    "cache_bytes": (32 << 20, 1, 1 << 40),
    "cache_ttl_seconds": (86_400, 1, 31_536_000),
}


@dataclass(frozen=True)
class Settings:
    max_items_per_source: int = 5000
    max_pages_per_source: int = 10
    query_variations: int = 4
    enrichment_companies: int = 250
    enrichment_pages: int = 3
    classifier_rows: int = 25
    classifier_batch: int = 10
    host_block_rows: int = 50
    result_page: int = 50
    cache_entries: int = 500
    cache_bytes: int = 32 << 20
    cache_ttl_seconds: int = 86_400
    min_source_confidence: float = 0.0

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name in RANGES:
                _, least, most = RANGES[f.name]
                if not least <= getattr(self, f.name) <= most:
                    raise ValueError(f"{f.name} must be between {least} and {most}")
        if not 0 <= self.min_source_confidence <= 1:
            raise ValueError("min_source_confidence must be between 0 and 1")


@dataclass(frozen=True)
class Request:
    """What is searched for: a query, or a category and a location."""

    query: str | None = None
    category: str | None = None
    location: str | None = None

    def __post_init__(self) -> None:
        clean = lambda x: " ".join(x.split()) or None if x else None
        for name, most in (("query", 500), ("category", 200), ("location", 200)):
            value = clean(getattr(self, name))
            if value is not None and not 2 <= len(value) <= most:
                raise ValueError(f"{name} must have 2 to {most} characters")
            object.__setattr__(self, name, value)
        if not self.query and not (self.category and self.location):
            raise ValueError("give a query, or a category and a location")
        if not self.query:
            object.__setattr__(self, "query", f"{self.category} em {self.location}")
