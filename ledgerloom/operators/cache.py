"""Answers of sources, kept as tables for a time: the contract of a cache, and one of Parquet tables in a shared folder."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict
from hashlib import sha256
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Request
from ..sources.base import Source


class Cache(Protocol):
    def get(self, key: str) -> DataFrame | None: ...

    def set(self, key: str, value: DataFrame, ttl_seconds: int | None = None) -> DataFrame: ...

    def delete(self, key: str) -> bool: ...

    def clear(self) -> None: ...


class TableCache:
    """A table for each key, and when it expires in its folder's name; the driver only lists folders.

    Entries beyond max_entries go, the first to expire first. The clock is a parameter.
    """

    def __init__(self, spark: SparkSession, root: str, ttl_seconds: int = 86_400, max_entries: int = 500, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.ttl, self.most, self.clock = spark, root.rstrip("/"), ttl_seconds, max_entries, clock
        self._path = lambda name="": spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _held(self) -> list[tuple[float, str]]:
        """(time of expiry, name) of complete entries, the first to expire first."""
        if not self._fs.exists(self._path()):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path())]
        return sorted((float(n.rpartition("-")[2]), n) for n in names if self._fs.exists(self._path(f"{n}/_SUCCESS")))

    @staticmethod
    def _name(key: str) -> str:
        return sha256(key.encode()).hexdigest()

    def get(self, key: str) -> DataFrame | None:
        live = [n for until, n in self._held() if n.startswith(self._name(key)) and until > self.clock()]
        return self.spark.read.parquet(f"{self.root}/{live[-1]}") if live else None

    def set(self, key: str, value: DataFrame, ttl_seconds: int | None = None) -> DataFrame:
        name = f"{self._name(key)}-{self.clock() + (self.ttl if ttl_seconds is None else ttl_seconds):.3f}"
        value.write.mode("overwrite").parquet(f"{self.root}/{name}")
        held = self._held()
        gone = {n for until, n in held if until <= self.clock() or (n.startswith(self._name(key)) and n != name)}
        left = [n for _, n in held if n not in gone]
        for n in gone | set(left[: max(0, len(left) - self.most)]) - {name}:
            self._fs.delete(self._path(n), True)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def delete(self, key: str) -> bool:
        found = [n for _, n in self._held() if n.startswith(self._name(key))]
        for n in found:
            self._fs.delete(self._path(n), True)
        return bool(found)

    def clear(self) -> None:
        self._fs.delete(self._path(), True)


def request_key(source: str, request: Request) -> str:
    """The key under which a source's answer to a request is kept."""
    return f"{source}:{sha256(json.dumps(asdict(request), sort_keys=True, ensure_ascii=False).encode()).hexdigest()}"


def remembered(cache: Cache, spark: SparkSession, source: Source, request: Request) -> DataFrame:
    """A source's leads for a request: those that the cache holds, else read and kept."""
    key = request_key(source.name, request)
    held = cache.get(key)
    return held if held is not None else cache.set(key, source.read(spark, request))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header (seconds or an HTTP date) asks for at `now`; null if it says neither."""
    moment = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.coalesce(value.try_cast("double"), moment.cast("double") - now.cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, asked: Column | None = None) -> Column:
    """Seconds before the next attempt (from 0): what the source asked for, else doubling from base; `most` at most."""
    wait = F.lit(base) * F.pow(F.lit(2.0), attempt)
    return F.least(F.lit(most), wait if asked is None else F.coalesce(asked, wait))
