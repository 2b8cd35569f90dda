"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, prepare

CAPACITY = 1024
END_ID = 2
#: Rows of one length that one task ranks, about.
RANK_ROWS = 200_000

#: Pre-tokens of the byte-level BPE (fixed value, as published with the vocabulary).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs that the fast encoder's pattern matcher may not have the stack for; texts with such go to `tokenizers` itself.
LONG_RUN = re.compile(r"\s{10000}|\S{100000}")


@cache
def encoder(path: str):
    """A tiktoken encoder of a byte-level BPE in the JSON form of `tokenizers`; ids are the same, at four times the speed.

    Strings of the file's special tokens become their ids, as `tokenizers` does by default. A file that splits or
    normalises texts in another way is refused.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"] or {}
    if (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True), spec["normalizer"], spec["model"]["type"]) != ("ByteLevel", False, True, None, "BPE") or spec["model"].get("ignore_merges"):
        raise ValueError(f"{path}: not a byte-level BPE without normaliser and prefix space")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    # printable stand-ins of the 256 bytes: themselves where printable in Latin-1, else from U+0100 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(stand_in[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("json", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


@cache
def plain_encoder(path: str):
    """The encoder of `tokenizers` itself, loaded where a text with LONG_RUN comes up."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str | None, path: str, end_id: int = END_ID) -> np.ndarray:
    """Ids of a text and the end id; of a null text only the end id."""
    bpe, special = encoder(path)
    text = text or ""
    if len(text) >= 10_000 and LONG_RUN.search(text):
        ids = plain_encoder(path).encode(text, add_special_tokens=False).ids
    else:
        ids = bpe.encode(text, allowed_special="all") if any(s in text for s in special) else bpe.encode_ordinary(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = end_id
    return out


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all of `capacity` but the first, which may be shorter."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """An array of (piece, start, length, ids_crc32) for each text."""

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for t in texts:
                ids = encode(t, path, end_id)
                rows.append([{"piece": i, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n].tobytes())} for i, (s, n) in enumerate(cut(len(ids), capacity))])
            yield pd.Series(rows)
        give_back()

    return run(text)


@dataclass
class Plan:
    """Sequences of one content: lengths[i] stands counts[i] times in each; `copies` of them."""

    counts: dict[int, int]
    copies: int


def best_pattern(prices: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest multiset of lengths that fits: an unbounded knapsack by dynamic programming; prices[n] is for length n."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = best[room - 1 :: -1] + prices[1 : room + 1]
        n = int(value.argmax())
        if value[n] > best[room - 1]:
            best[room], choice[room] = value[n], n + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(capacity + 1, np.int64), capacity
    while room:
        if choice[room]:
            pattern[choice[room]] += 1
            room -= choice[room]
        else:
            room -= 1
    return pattern


def solve(histogram: np.ndarray, capacity: int, rounds: int = 1000, rate: float = 0.3, steep: float = 5.0) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, such that no length is covered more than its demand: a feasible fraction of a cover.

    Multiplicative weights: a length's price is its share of the capacity, times a weight that falls exponentially in
    the part of its demand that is covered. The knapsack's best pattern at these prices comes next, used for a fixed
    share of the demand that limits it. Lengths are thus covered evenly, and what is left when the rounds are over
    has the shape of the whole. At the end all is scaled down by the largest cover.
    """
    demand, sizes = histogram.astype(float), np.arange(capacity + 1)
    wanted = demand > 0
    cover, used = np.zeros(capacity + 1), {}
    for _ in range(rounds):
        part = np.divide(cover, demand, out=np.ones(capacity + 1), where=wanted)
        live = wanted & (part < 1)
        if not live.any():
            break
        pattern = best_pattern(np.where(live, sizes * np.exp(-steep * (part - part[live].min())), 0.0), capacity)
        inside = pattern > 0
        often = rate * float((demand[inside] / pattern[inside]).min())
        used[pattern.tobytes()] = used.get(pattern.tobytes(), 0.0) + often
        cover += often * pattern
    most = float((cover[wanted] / demand[wanted]).max(initial=1.0))
    return [(np.frombuffer(k, np.int64), v / most) for k, v in used.items()]


def best_fit(histogram: np.ndarray, capacity: int) -> list[Plan]:
    """Best fit, longest first, on counts: all open sequences of one content and room are treated as one."""
    open_by_room: dict[int, list[Plan]] = {}
    for n in range(capacity, 0, -1):
        left = int(histogram[n])
        for room in range(n, capacity):
            # a sequence takes as many of this length as fit, before the next one is tried
            while left and open_by_room.get(room):
                plan = open_by_room[room].pop()
                each = min(room // n, left)
                copies = min(plan.copies, left // each)
                if copies < plan.copies:
                    open_by_room[room].append(Plan(plan.counts, plan.copies - copies))
                grown = dict(plan.counts)
                grown[n] = grown.get(n, 0) + each
                open_by_room.setdefault(room - n * each, []).append(Plan(grown, copies))
                left -= copies * each
            if not left:
                break
        if left:
            each = capacity // n
            if left // each:
                open_by_room.setdefault(capacity - n * each, []).append(Plan({n: each}, left // each))
            if left % each:
                open_by_room.setdefault(capacity - n * (left % each), []).append(Plan({n: left % each}, 1))
    return [p for plans in open_by_room.values() for p in plans]


def plan_histogram(histogram: np.ndarray, capacity: int = CAPACITY) -> list[Plan]:
    """Sequences for the histogram (count by length up to capacity), as few as found.

    The linear program's patterns are taken as many times as it says, rounded down; what this leaves, a smaller
    histogram of much the same shape, goes by best fit. As patterns that it uses seldom round badly, plans that take only its
    most used patterns are tried too, and the one of fewest sequences stands. Work and result are bounded by the
    capacity, whatever the number of documents.
    """
    full = [Plan({capacity: 1}, int(histogram[capacity]))] if histogram[capacity] else []
    short = histogram.astype(np.int64).copy()
    short[[0, capacity]] = 0
    solution = sorted(solve(short, capacity), key=lambda x: (-x[1], x[0].tobytes()))
    plans = []
    for part in (1.0, 0.5, 0.25, 0.1):
        rest, made = short.copy(), []
        for pattern, often in solution[: math.ceil(part * len(solution))]:
            inside = pattern > 0
            copies = min(int(often), int((rest[inside] // pattern[inside]).min()))
            if copies > 0:
                made.append(Plan({int(n): int(pattern[n]) for n in np.flatnonzero(inside)}, copies))
                rest -= copies * pattern
        plans.append(made + best_fit(rest, capacity))
    return full + min(plans, key=lambda x: sum(p.copies for p in x))


def slots(plans: list[Plan]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, number in a sequence, first sequence, first offset): where the pieces of this length go by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for plan in plans:
        offset = 0
        for n, each in sorted(plan.counts.items(), reverse=True):
            out.setdefault(n, []).append((ranks.get(n, 0), each, sequence, offset))
            ranks[n] = ranks.get(n, 0) + each * plan.copies
            offset += n * each
        sequence += plan.copies
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. A document is its ids and
    an end id; only longer ones are cut. The driver holds the histogram of lengths and its plan, both bounded by the
    capacity; pieces get their places by rank within their length. Ranks are counted in salted ranges of a length,
    so that no task holds all pieces of a frequent one.

    Null or empty texts: a piece of the end id alone. Repeated rows and null doc_ids: packed like others; of pieces that
    are equal in all, any may stand in either's place. Very long texts are encoded whole. Empty table: no rows. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    # the vocabulary's bytes come with the tasks' closure only as a path that all machines have
    cutting = docs.select("doc_id", F.explode(pieces(F.col("text"), path, capacity, end_id)).alias("p")).select("doc_id", "p.*")
    parts = materialize(cutting, "pack-pieces")
    counted = parts.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["count"]
    places = spark.sparkContext.broadcast(slots(plan_histogram(histogram, capacity)))
    salts = max(16, int(histogram.max()) // RANK_ROWS)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per_salt = salted.groupBy("length", "salt").count()
    before = per_salt.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            rows = places.value[int(n)]
            at = lengths == n
            k = np.searchsorted(rows[:, 0], ranks[at], side="right") - 1
            within = ranks[at] - rows[k, 0]
            sequence[at] = rows[k, 2] + within // rows[k, 1]
            offset[at] = rows[k, 3] + within % rows[k, 1] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
