"""LM scoring by prediction by partial matching over byte contexts, beside a word unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, prepare

#: Longest context in bytes.
ORDER = 5
#: Distinct n-grams or words after which a block of texts ends: a bound on what a task holds, not on the model.
NODES = 1 << 21
#: The counts of so many orders from 0 are told to every task, 256^LOW n-grams an order at most; longer ones stay dealt out by the last LOW bytes of their context.
LOW = 3
#: What method D takes from each symbol's count for the escape.
ESCAPE = 0.5
#: The symbol that ends a text and pads the context before its start; no UTF-8 text holds this byte.
END = 0xFF
#: Bytes of text whose n-grams are counted at once, and bytes after which a block of texts ends.
COUNT_BYTES, BLOCK_BYTES = 2 << 20, 48 << 20
#: Bytes of stored input for each deal of contexts, and bytes of keys that a task takes, about.
INPUT_BYTES, DEAL_BYTES = 8 << 20, 32 << 20
#: Bytes of text whose contexts are looked up at once.
CHUNK_BYTES = 2 << 20


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def gram_codes(texts: list[bytes], order: int, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each byte and the end of each text: the symbol in the low byte, the bytes before it above; and the text's place in the list.

    Comes in chunks of `size` bytes, so that texts of any length need little memory beside themselves.
    """
    pad = bytes([END]) * order
    data = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), np.uint8)
    stops = np.cumsum(np.array([len(t) + 1 + order for t in texts], np.int64))
    size = size or CHUNK_BYTES
    for start in range(0, len(data), size):
        head = min(start, order)
        piece = data[start - head : start + size].astype(np.uint64)
        codes = piece.copy()
        for k in range(1, order + 1):
            codes[k:] |= piece[:-k] << np.uint64(8 * k) if len(piece) > k else 0
        place = np.arange(start, min(start + size, len(data)))
        owner = np.searchsorted(stops, place, "right")
        # the padding before a text is no part of it
        inside = place - (stops[owner] - np.array([len(t) + 1 for t in texts], np.int64)[owner]) >= 0
        yield codes[head:][inside], owner[inside]


def _word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


#: What stands for the end token among words' hashes.
END_WORD = int(_word_hash([b" end"])[0])


#: What blocks() gives: rows of texts (data), or of a block's n-grams (kind 0) and words (1), packed by `deal`, or of the short n-grams' counts (2).
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("data", pa.binary()), ("kind", pa.int32()), ("deal", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])
_BLOCKS_DDL = "block long, doc_id long, held_out boolean, data binary, kind int, deal int, keys binary, numbers binary, key long, n long"


def _batch(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _summed(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(at, np.concatenate(numbers), len(unique)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values as bytes, their first bytes first: those of sorted keys and of small counts compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packed(group: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """For each group its keys and numbers as bytes."""
    order = np.argsort(group, kind="stable")
    group, keys, numbers = group[order], keys[order], numbers[order]
    bounds = [*np.flatnonzero(np.diff(group, prepend=group[:1] - 1)), len(group)]
    for i, j in zip(bounds, bounds[1:]):
        yield int(group[i]), _planes(keys[i:j]), _planes(numbers[i:j])


def _deal(kind: int, keys: np.ndarray, deals: int) -> np.ndarray:
    """Where a key is counted: n-grams by the last LOW bytes of their context, so that all contexts that long or longer are whole there."""
    part = keys >> np.uint64(8) & np.uint64((1 << 8 * LOW) - 1) if kind == 0 else keys
    return ((part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % deals


def blocks(rows: DataFrame, deals: int) -> DataFrame:
    """The rows (doc_id, text, held_out) dealt to blocks of neighbouring texts, and each block's distinct n-grams and words.

    The numbers that go with these count training texts only; those of held-out texts alone have 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        words: dict[bytes, int] = {}
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: tuple[list[bytes], list[bytes]] = ([], [])  # held-out texts, training texts
        waiting_bytes = block_bytes = ends = 0

        def count() -> None:
            for weight, texts in enumerate(waiting):
                for codes, _ in gram_codes(texts, ORDER, COUNT_BYTES) if texts else ():
                    unique, n = np.unique(codes, return_counts=True)
                    grams.append((unique, n * weight))
                    if len(grams) >= 8:
                        grams[:] = [_summed([g for g, _ in grams], [n for _, n in grams])]
                texts.clear()

        def merge() -> None:
            if len(grams) > 1:
                grams[:] = [_summed([g for g, _ in grams], [n for _, n in grams])]

        def told() -> Iterator[pa.RecordBatch]:
            found = [(1, np.append(_word_hash(list(words)), END_WORD).view(np.uint64), np.append(np.fromiter(words.values(), np.int64, len(words)), ends))]
            merge()
            if grams:
                keys, n = grams.pop()
                found.append((0, keys, n))
                short, n = _summed([keys[n > 0] & np.uint64((1 << 8 * LOW) - 1)], [n[n > 0]])
                yield _batch(_BLOCKS, len(short), block=np.full(len(short), block), kind=np.full(len(short), 2), key=short.view(np.int64), n=n)
            for kind, keys, n in found:
                packs = list(_packed(_deal(kind, keys, deals), keys, n.astype(np.int64)))
                yield _batch(_BLOCKS, len(packs), block=[block] * len(packs), kind=[kind] * len(packs), deal=[d for d, _, _ in packs], keys=[k for _, k, _ in packs], numbers=[x for _, _, x in packs])
            words.clear()

        for batch in batches:
            texts = [lowered(t) for t in batch.column("text").to_pylist()]
            held = batch.column("held_out").to_pylist()
            yield _batch(_BLOCKS, len(texts), block=[block] * len(texts), doc_id=batch.column("doc_id").cast(pa.int64()), held_out=held, data=texts)
            for data, out in zip(texts, held, strict=True):
                learnt = out is False
                for w in data.split():
                    words[w] = words.get(w, 0) + learnt
                ends += learnt
                waiting[learnt].append(data)
                waiting_bytes += len(data)
                block_bytes += len(data)
                if waiting_bytes >= COUNT_BYTES:
                    count()
                    waiting_bytes = 0
            if len(words) > NODES or block_bytes >= BLOCK_BYTES or grams and len(grams[0][0]) > NODES:
                count()
                yield from told()
                block += 1
                waiting_bytes = block_bytes = ends = 0
        count()
        if grams:
            yield from told()

    return rows.mapInArrow(run, _BLOCKS_DDL)


@dataclass
class Level:
    """The trie's nodes of one order: symbols seen after contexts, and for each context the sums that escapes need."""

    grams: np.ndarray  # context and symbol, sorted
    counts: np.ndarray
    contexts: np.ndarray  # sorted
    total: np.ndarray  # occurrences of the context
    kinds: np.ndarray  # symbols seen after it
    below: np.ndarray = field(default_factory=lambda: np.zeros(0))  # occurrences of these symbols after the next shorter context


class HashTable:
    """uint64 keys to their positions, by vectorised linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left, step = np.arange(len(keys), dtype=np.int32), np.uint64(0)
        while len(left):
            at = self._at(keys[left], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, one wins
            left = left[self.slots[at] != left]
            step += np.uint64(1)
        self.steps = int(step)
        self.held = np.zeros(1 << self.bits, np.uint64)
        self.held[self.slots >= 0] = keys[self.slots[self.slots >= 0]]

    def _at(self, keys: np.ndarray, step: np.uint64) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)) + step & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if it isn't there."""
        at = self._at(keys, np.uint64(0))
        slot = self.slots[at]
        out = np.where(self.held[at] == keys, slot, -1)
        left = np.flatnonzero((out < 0) & (slot >= 0))
        for step in range(1, self.steps + 1):
            if not len(left):
                break
            at = self._at(keys[left], np.uint64(step))
            slot = self.slots[at]
            hit = (slot >= 0) & (self.held[at] == keys[left])
            out[left[hit]] = slot[hit]
            left = left[~hit & (slot >= 0)]
        return out


class Trie:
    """PPM code lengths: escape estimation as in method D, full exclusion of the symbols of longer contexts.

    At a context that holds `kinds` symbols `total` times, a symbol seen n times has the probability (n - 1/2) / total, and
    the escape the rest, kinds / 2 / total. After an escape, the shorter context's counts go without the symbols that the longer one has;
    since kept symbols of a context are kept after all its suffixes, those are one sum per context. Below order 0
    all symbols not yet excluded are alike.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.gram_tables = [HashTable(x.grams) for x in levels]
        self.context_tables = [HashTable(x.contexts) for x in levels]
        top = levels[-1]
        place = np.searchsorted(top.contexts, top.grams >> np.uint64(8))
        self.top = np.log10((top.counts - ESCAPE) / top.total[place]) if len(top.grams) else np.zeros(0)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context."""
        order = len(self.levels) - 1
        at = self.gram_tables[order].find(codes)
        out = np.where(at >= 0, self.top[at] if len(self.top) else 0.0, 0.0)
        left = np.flatnonzero(at < 0)
        above = self.context_tables[order].find(codes[left] >> np.uint64(8))  # context one longer, of those left
        # escapes from the longest context
        level = self.levels[order]
        here = above >= 0
        k = above[here]
        out[left[here]] += np.log10(ESCAPE * level.kinds[k] / level.total[k])
        for j in range(order - 1, -1, -1):
            if not len(left):
                return out
            longer, level = self.levels[j + 1], self.levels[j]
            code = codes[left] & np.uint64((1 << 8 * (j + 1)) - 1)
            context = self.context_tables[j].find(code >> np.uint64(8))
            gram = self.gram_tables[j].find(code)
            seen = context >= 0
            excluded, excluded_kinds = np.zeros(len(left)), np.zeros(len(left))
            if len(longer.contexts):
                excluded[above >= 0], excluded_kinds[above >= 0] = longer.below[above[above >= 0]], longer.kinds[above[above >= 0]]
            c = np.maximum(context, 0)
            have = len(level.contexts) > 0
            kinds = (level.kinds[c] if have else 0.0) - excluded_kinds
            whole = (level.total[c] if have else 0.0) - excluded
            hit = (gram >= 0) & seen
            if hit.any():
                out[left[hit]] += np.log10((level.counts[gram[hit]] - ESCAPE) / whole[hit])
            escapes = seen & ~hit & (whole > 0)
            if escapes.any():
                out[left[escapes]] += np.log10(ESCAPE * kinds[escapes] / whole[escapes])
            left, above = left[~hit], np.where(seen, context, -1)[~hit]
        known = self.levels[0].kinds[0] if len(self.levels[0].contexts) else 0
        out[left] -= math.log10(256 - known)
        return out


def _level(keys: np.ndarray, n: np.ndarray, order: int, shorter: Level | None) -> Level:
    """The nodes of one order from sorted keys and their counts."""
    n = n.astype(np.float64)
    contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
    total = np.bincount(place, n, len(contexts))
    level = Level(keys, n, contexts, total, np.bincount(place, minlength=len(contexts)).astype(float))
    if shorter is not None:
        at = np.searchsorted(shorter.grams, keys & np.uint64((1 << 8 * order) - 1))
        level.below = np.bincount(place, shorter.counts[at], len(contexts)) if len(keys) else np.zeros(0)
    return level


def _levels(keys: np.ndarray, n: np.ndarray, orders: range, levels: list[Level]) -> list[Level]:
    """levels and those of the orders that follow, from all n-grams of the last of these orders."""
    out = list(levels)
    for k in orders:
        short, numbers = _summed([keys & np.uint64((1 << 8 * (k + 1)) - 1)], [n]) if len(keys) else (keys, n)
        out.append(_level(short, numbers, k, out[-1] if out else None))
    return out


_WORTH = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary())])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By kind: block, key and number of all that is packed in the rows."""
    found: dict[int, list] = {}
    for batch in batches:
        for block, kind, keys, numbers in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "keys", "numbers")), strict=True):
            found.setdefault(kind, []).append((np.full(len(keys) // 8, block, np.int64), _values(keys, np.uint64), _values(numbers, np.int64)))
    return {kind: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for kind, parts in found.items()}


def worths(packs: DataFrame, low: list[Level], parts: int) -> DataFrame:
    """block, kind, keys, numbers: what each block's n-grams cost by all training texts (log10), and how often these have its words."""
    spark = packs.sparkSession
    shared = spark.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (block, keys, n) in _unpacked(batches).items():
            unique, at = np.unique(keys, return_inverse=True)
            total = np.bincount(at, n, len(unique))
            if kind == 0:
                seen = total > 0
                worth = Trie(_levels(unique[seen], total[seen], range(LOW, ORDER + 1), shared.value)).log10(unique)
            else:
                worth = total.astype(np.float64)
            rows = list(_packed(block, keys, worth[at]))
            for i in range(0, len(rows), 64):
                some = rows[i : i + 64]
                yield _batch(_WORTH, len(some), block=[b for b, _, _ in some], kind=[kind] * len(some), keys=[k for _, k, _ in some], numbers=[x for _, _, x in some])

    return packs.select("block", "kind", "deal", "keys", "numbers").repartition(parts, "deal").mapInArrow(run, "block long, kind int, keys binary, numbers binary")


def known_words(packs: DataFrame, parts: int) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n in _unpacked(batches).values():
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(np.unique(keys[n > 0]))])], ["tokens", "kinds"])

    found = packs.where("kind = 1").select("block", "kind", "deal", "keys", "numbers").repartition(parts, "deal").mapInArrow(run, "tokens long, kinds long")
    n, kinds = found.agg(F.sum("tokens"), F.sum("kinds")).first()
    return n or 0, kinds or 0


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of doc_id as text leaves `fold` when divided by `folds`; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score(docs: DataFrame, is_held_out: Column) -> DataFrame:
    """Score all texts of documents (doc_id, text), learning from those that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word unigrams) and score, the log10
    probability of the lower-cased text and its end by a byte trie of order ORDER.

    Counts cover all training texts, and every n-gram and word of theirs is part of the model, however rare. The model is never in
    one place: blocks of texts tell their distinct n-grams and words, these are dealt out by context and get their
    costs there, and each block gets its own ones back. Only n-grams of up to LOW bytes are told to all.

    Null and empty texts are scored as the end alone. Repeated rows each get their row, null doc_ids too. Without training texts V and
    N are 0 and all symbols are alike. Empty table: no rows. Long texts are scored whole. Other columns are ignored,
    whatever their names. Counts are sums, so that nothing hangs on order.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", is_held_out.alias("held_out"))
    stored = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # a source that can't tell its size gives an absurd one
    deals = max(4 * parts, -(-stored // INPUT_BYTES) if stored < 1 << 50 else 0)
    path = new_folder(spark, "lm-blocks")
    blocks(rows, deals).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(_BLOCKS_DDL).parquet(path)
    packs = table.where("kind < 2")
    short = table.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    # a task gets about DEAL_BYTES of keys, so more tasks for more text
    held, n_blocks = packs.agg(F.sum(F.octet_length("keys")), F.count_distinct("block")).first()
    parts = min(max(parts, -(-(held or 0) // DEAL_BYTES)), deals)
    low = _levels(short["key"].to_numpy(np.int64).view(np.uint64), short["n"].to_numpy(np.int64), range(LOW), [])
    n_train, n_words = known_words(packs, parts)
    denominator = math.log10(n_train + n_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, tables = None, {0: [], 1: []}, {}
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            for kind, found in parts.items():
                if kind not in tables:
                    keys = np.concatenate([_values(k, np.uint64) for k, _ in found])
                    tables[kind] = HashTable(keys), np.concatenate([_values(x, np.float64) for _, x in found])
                    found.clear()
            texts = batch.column("data").to_pylist()
            # some texts at a time: their words and codes take many times their bytes
            ends = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(texts)]
            found = [measured(texts[i:j]) for i, j in zip(bounds, bounds[1:]) if j > i]
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns)], schema=schema)

        def measured(texts: list[bytes]) -> tuple[np.ndarray, ...]:
            """Of each text the number of tokens, of known ones, and both scores."""
            (grams, cost), (held, frequency) = tables[0], tables[1]
            n = len(texts)
            split = [t.split() for t in texts]
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in ws), np.int64)
            sizes = np.array([len(ws) for ws in split], np.int64)
            del split
            owner = np.repeat(np.arange(n), sizes)
            seen = frequency[held.find(np.append(_word_hash(list(numbers)), END_WORD).view(np.uint64))]
            worth = np.log10(seen + 1) - denominator
            scores = np.zeros(n)
            for codes, of in gram_codes(texts, ORDER):
                scores += np.bincount(of, cost[grams.find(codes)], n)
            return sizes + 1, np.bincount(owner, seen[ids] > 0, n).astype(np.int64) + int(seen[-1] > 0), np.bincount(owner, worth[ids], n) + worth[-1], scores

        for batch in batches:
            # a block's costs come before its texts
            kinds, of = batch.column("kind").to_pylist(), batch.column("block").to_pylist()
            at = 0
            while at < len(kinds):
                if of[at] != block:
                    block, parts, tables = of[at], {0: [], 1: []}, {}
                to = at + 1
                while to < len(kinds) and of[to] == block and (kinds[to] is None) == (kinds[at] is None):
                    to += 1
                some = batch.slice(at, to - at)
                if kinds[at] is None:
                    yield scored(some)
                else:
                    for kind, keys, x in zip(kinds[at:to], some.column("keys").to_pylist(), some.column("numbers").to_pylist(), strict=True):
                        parts[kind].append((keys, x))
                at = to

    texts = table.where("kind is null").select("block", "kind", "keys", "numbers", "doc_id", "held_out", "data")
    told = worths(packs, low, parts).unionByName(texts, allowMissingColumns=True)
    # a task takes a block, seldom two
    together = told.repartition(max(parts, 4 * n_blocks), "block").sortWithinPartitions("block", F.col("kind").isNull())
    out = together.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")
