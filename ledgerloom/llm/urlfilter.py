"""URL filters: sorted digest arrays of rules, memory-mapped and probed by vectorised binary search."""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

_ASCII_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no `://`."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_ASCII_LOWER), tail[:stop]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestIndex:
    """Strings with a value each in one file: sorted 64-bit digests, values, then the strings for confirmation."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, _ = struct.unpack("<QQ", data[:16].tobytes())
        at = 16
        self.keys = data[at : at + 8 * n].view(np.uint64)
        self.ends = data[at + 8 * n : at + 16 * n].view(np.uint64)
        self.values = data[at + 16 * n : at + 17 * n]
        self.strings = data[at + 17 * n :]

    @staticmethod
    def write(path: str, entries: dict[str, int]) -> None:
        """Beside the entries themselves this holds 24 bytes for each; strings go to the file one by one."""
        texts = list(entries)
        keys = np.fromiter(map(digest, texts), np.uint64, len(texts))
        order = np.argsort(keys, kind="stable")
        widths = np.fromiter((len(texts[i].encode("utf-8", "surrogatepass")) for i in order), np.uint64, len(texts))
        with open(path, "wb") as f:
            f.write(struct.pack("<QQ", len(texts), 0))
            f.write(keys[order].tobytes())
            f.write(np.cumsum(widths, dtype=np.uint64).tobytes())
            f.write(bytes(entries[texts[i]] for i in order))
            for i in order:
                f.write(texts[i].encode("utf-8", "surrogatepass"))

    def find(self, probes: list[str]) -> np.ndarray:
        """The value of each probe; -1 where it isn't in the index."""
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        wanted = np.array([digest(p) for p in probes], np.uint64)
        low = np.searchsorted(self.keys, wanted, "left")
        hit = low < len(self.keys)
        hit[hit] = self.keys[low[hit]] == wanted[hit]
        for i in np.flatnonzero(hit):  # equal digests: the stored string decides
            k, text = int(low[i]), probes[i].encode("utf-8", "surrogatepass")
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                start = int(self.ends[k - 1]) if k else 0
                if self.strings[start : int(self.ends[k])].tobytes() == text:
                    out[i] = self.values[k]
                    break
                k += 1
        return out


def index_file(spark: SparkSession, entries: dict[str, int]) -> str:
    """Build an index and give it to all executors; returns its file name.

    The driver's copy stays as long as its session, since Spark serves it to executors that start later. Machines map
    the file: of a list of any length only the pages that are probed take memory.
    """
    folder = tempfile.mkdtemp(prefix="url-index-")
    name = f"url-index-{uuid.uuid4().hex}.bin"
    DigestIndex.write(os.path.join(folder, name), entries)
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


@lru_cache(maxsize=4)
def _index(name: str) -> DigestIndex:
    return DigestIndex(SparkFiles.get(name))


def suffixes(host: str, longest: int) -> list[str]:
    """The host and its parent domains, of those that are no longer than `longest`."""
    out, at = [], 0
    if len(host) > longest:
        at = host.find(".", len(host) - longest - 1) + 1
        if not at:
            return out
    while True:
        out.append(host[at:])
        at = host.find(".", at) + 1
        if not at:
            return out


def parts_of(rule: str) -> tuple[str, str]:
    """A rule's host and path; one without a slash has the path ''."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], blocked_hosts: Sequence[str] = (), default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    rules: (verdict, `host/path`), verdict allow or block. A rule fits its host and all subdomains if the url's path
    starts with the rule's; of those that fit the longest wins. Urls that no rule fits are blocked if their host or a
    parent domain is in blocked_hosts, else they get `default`. Rules and hosts are in one digest array, and so is the
    number of each rule host's own list of path lengths. A url is probed with its host's suffixes; where one is a rule's
    host, with the suffix joined to as much of its path as that host's rules have. Hosts of any length cost
    no more probes than the longest rule's host has labels.

    A rule without a slash fits every path. If a rule is given twice, the last one counts. Null urls, and urls without `://`, have empty host and path, fit no rule and get `default`. Repeated rows give repeated
    results. Empty table: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    verdicts = ("allow", "block")
    split_rules = [(*parts_of(rule), verdict) for verdict, rule in rules]
    # kinds of entries, told apart by a first character: r rule, h rule host, b blocked host
    entries = {f"r{host}{path}": verdicts.index(verdict) for host, path, verdict in split_rules}
    held: dict[str, set[int]] = {}
    for host, path, _ in split_rules:
        held.setdefault(host, set()).add(len(path))
    # most lists have few distinct sets of lengths; hosts beyond 255 of them share one with all lengths
    every = tuple(sorted({w for ws in held.values() for w in ws}))
    kinds = [every, *sorted({tuple(sorted(ws)) for ws in held.values()} - {every})[:254]]
    number = {ws: i for i, ws in enumerate(kinds)}
    entries |= {f"h{host}": number.get(tuple(sorted(ws)), 0) for host, ws in held.items()}
    entries |= {f"b{host}": 0 for host in blocked_hosts}
    longest = max(map(len, (*held, *blocked_hosts)), default=0)
    name = index_file(spark, entries)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = _index(name)
        for urls in batches:
            split = [split_url(u) for u in urls]
            domains, owner = [], []
            for i, (host, _) in enumerate(split):
                if host:
                    mine = suffixes(host, longest)
                    domains += mine
                    owner += [i] * len(mine)
            bad = {owner[k] for k in np.flatnonzero(index.find(["b" + d for d in domains]) >= 0)}
            lengths = index.find(["h" + d for d in domains])
            probes, of = [], []
            for k in np.flatnonzero(lengths >= 0):
                path = split[owner[k]][1]
                mine = [f"r{domains[k]}{path[:w]}" for w in kinds[lengths[k]] if w <= len(path)]
                probes += mine
                of += [owner[k]] * len(mine)
            values = index.find(probes)
            rule: list[str | None] = [None] * len(split)
            verdict = [default] * len(split)
            for k in np.flatnonzero(values >= 0):
                i, found = of[k], probes[k][1:]
                if rule[i] is None or len(found) > len(rule[i]):
                    rule[i], verdict[i] = found, verdicts[values[k]]
            verdict = ["block" if r is None and i in bad else v for i, (r, v) in enumerate(zip(rule, verdict, strict=True))]
            yield pd.DataFrame({"host": [h for h, _ in split], "path": [p for _, p in split], "rule": rule, "verdict": verdict})

    return pages.select("page_id", run(F.col("url")).alias("j")).select("page_id", "j.*")
