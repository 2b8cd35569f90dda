"""SimHash near-duplicates: fingerprint segments decode to nearby Golay codewords, whose indices are the join keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, give_back, materialize, prepare
from .golay import likeliest_codewords, nearby_codewords

SEED = 42
#: Segments of a 64-bit fingerprint: (shift, bits). Of three, one at least is free of errors if two bits differ.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 2
#: Rows of one key that are paired directly; fuller buckets go an exact way that doesn't pair all their rows.
BUCKET = 256

#: Near copies: tables of keys; each key joins the indices of two segments of 24 bits, of PROBES codewords each.
TABLES, PROBES = 5, 4
#: Bits of their fingerprints, of which the first TABLES * 48 make keys.
BITS = 240
#: Words of 64 of these bits that travel with keys, and the most of them that differ in two texts worth an exact look: at a similarity
#: of 0.8 the mean is 19.4, the deviation 4.1, and 2 pairs in 100,000 differ in more.
WORDS = ("w0", "w1")
LOOK = 37
#: Classes from which keys hold a range of sizes too: texts of high similarity are of like size, so buckets shrink and no pair is lost.
BANDED = 50_000_000
#: Rows of one key that one task sees at first; fuller buckets are dealt out, and what remains meets again.
SALT_ROWS = 10_000
#: Keyed rows that one task compares, and rows of a key up to which each is compared with those of like size, all keys of a task at once.
MEET_ROWS, FEW = 250_000, 64
#: Classes of a candidate group that are compared in one block with those of another; small groups share tasks.
BLOCK, TASK_ROWS = 256, 1024
#: Most rows of a table of document numbers that is broadcast (16 bytes each); larger ones are joined by shuffling.
BROADCAST_ROWS = 2_000_000


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each run of `width` words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line, last = b" ".join(words), len(words) - width
    if last <= 0:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)]


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many of the uint64 values (n x k) have each of the 64 k bits set; in blocks, so that long texts need little memory."""
    total = np.zeros(values.shape[1] * 64, np.int64)
    for i in range(0, len(values), 8192):
        block = np.ascontiguousarray(values[i : i + 8192])
        total += np.unpackbits(block.view(np.uint8).reshape(len(block), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint_of(text: str | None, width: int) -> int:
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    values = np.array(hashes, np.uint64)[:, None]
    bits = 2 * bit_counts(values) > len(values)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int) -> Column:
    """The 64-bit SimHash as a signed long: a bit is set if it is in over half the shingles' hashes; 0 without words."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return run(text)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _segment_keys(fingerprints: pd.Series) -> pd.Series:
    values = fingerprints.to_numpy(np.int64).view(np.uint64)
    parts = [(values >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    keys = []
    for i in range(len(SEGMENTS)):
        fuzzy = nearby_codewords(parts[(i + 1) % len(SEGMENTS)])
        keys.append(np.int64(i) << 40 | parts[i][:, None] << 12 | fuzzy)
    return pd.Series([np.unique(row) for row in np.concatenate(keys, 1)])


def _apart(a: list[Column], b: list[Column]) -> Column:
    """Number of differing bits of two lists of longs."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def fingerprint_links(fingerprints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct 64-bit values (column fp) whose components are those of all links of DISTANCE bits.

    Each value has a key for each segment taken as free of errors: the segment itself (one of three is, if two bits differ; this
    alone would find all pairs) and an index of the next segment, in which at most two errors remain, which makes buckets small. Rows of a key are paired and verified. In buckets of over `bucket` rows
    values are tied to the words within one bit of them instead: two values lie within two bits of each other just
    if they share such a word, so this loses no link and costs 65 rows a value.
    """
    keyed = materialize(fingerprints.select("fp", F.explode(_segment_keys("fp")).alias("key")), "simhash-keys")
    full = materialize(keyed.groupBy("key").count().where(F.col("count") > bucket).select("key"), "simhash-full")
    few = keyed.join(full, "key", "left_anti")
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (_apart([F.col("a")], [F.col("b")]) <= DISTANCE)
    pairs = left.join(right, "key").where(near).select("a", "b").distinct()
    dense = keyed.join(full, "key", "left_semi").select("fp").distinct()
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    tied = dense.select("fp", F.explode(ball).alias("word"))
    shared = tied.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word")
    hubs = tied.join(shared, "word").select(F.col("fp").alias("a"), F.col("word").alias("b")).where("a <> b")
    return pairs.union(hubs)


def fingerprint_components(docs: DataFrame, width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable by links of at most two bits.

    One row per row of docs (doc_id, text). Null and empty texts have fingerprint zero and link like others. Null
    doc_ids get their row, but name a component only if it has no other (then null). Empty table: no rows.
    """
    prepare(docs.sparkSession)
    rows = materialize(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")), "simhash-rows")
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-values")
    groups = components(materialize(fingerprint_links(least.select("fp"), bucket), "simhash-links"), "simhash")
    linked = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(linked.join(names, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity of shingle sets

_SKETCH = T.StructType(
    [T.StructField("content", T.BinaryType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("codes", T.ArrayType(T.ShortType())), T.StructField("shingles", T.IntegerType())]
)


def content_of(text: str | None) -> bytes:
    """128-bit digest of the lower-cased words: texts with the same have the same shingles of any width."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def _spread(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits from 64-bit hashes."""
    z = hashes + np.uint64((word + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketch(text: Column, width: int) -> Column:
    """Content digest, SimHash of BITS bits over the set of shingles, codeword indices by segment, number of shingles."""
    n_words = -(-BITS // 64)

    @F.pandas_udf(_SKETCH)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            margins, sizes = np.zeros((len(texts), BITS), np.float32), []
            for row, t in enumerate(texts):
                hashes = np.unique(np.array(shingle_hashes(t, width), np.uint64))
                sizes.append(len(hashes))
                if len(hashes):
                    counts = bit_counts(np.stack([_spread(hashes, w) for w in range(n_words)], 1))[:BITS]
                    margins[row] = 2.0 * counts - len(hashes)
            bits = np.packbits(margins[:, : 64 * len(WORDS)] > 0, axis=1, bitorder="little").view(np.int64)
            codes = np.concatenate([likeliest_codewords(margins[:, s : s + 24], PROBES) for s in range(0, TABLES * 48, 24)], 1).astype(np.int16)
            yield pd.DataFrame({"content": [content_of(t) for t in texts], "bits": list(bits), "codes": list(codes), "shingles": np.array(sizes, np.int32)})
        give_back()

    return run.asNondeterministic()(text)


_SET = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("members", T.BinaryType())])


def _sets(text: Column, width: int) -> Column:
    """Content digest and the sorted distinct hashes of the shingles, as bytes."""

    @F.pandas_udf(_SET)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            members = [np.unique(np.array(shingle_hashes(t, width), np.uint64)).tobytes() for t in texts]
            yield pd.DataFrame({"content": [content_of(t) for t in texts], "members": members})
        give_back()

    return run.asNondeterministic()(text)


def _similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float, same: bool) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets (sorted distinct hashes) whose Jaccard similarity is high enough; with `same`, left is right and i < j.

    Common members are counted by products of incidence matrices, some thousand distinct hashes at a time.
    """
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    heads = [np.concatenate(side) for side in (left, right)]
    owners = [np.repeat(np.arange(len(side), dtype=np.int32), n) for side, n in zip((left, right), sizes, strict=True)]
    shared = np.unique(heads[0]) if same else np.intersect1d(heads[0], heads[1])
    places = []
    for head in heads:
        at = np.minimum(np.searchsorted(shared, head), max(len(shared) - 1, 0))
        places.append(np.where(shared[at] == head, at, -1) if len(shared) else np.full(len(head), -1))
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), 4096):
        width = min(4096, len(shared) - start)
        matrix = []
        for at, owner, n in zip(places, owners, sizes, strict=True):
            inside = (at >= start) & (at < start + width)
            m = np.zeros((len(n), width), np.float32)
            m[owner[inside], at[inside] - start] = 1
            matrix.append(m)
        common += matrix[0] @ matrix[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    hit = common >= similarity * union - 1e-6
    if same:
        hit &= np.triu(np.ones_like(hit), 1)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(hit), strict=True)]


def _close_groups(c: np.ndarray, n: np.ndarray, words: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges from the least class of each group that pairs of close fingerprints connect to its others; all rows are compared, one with many at a time."""
    words = words.view(np.uint64)
    group = np.arange(len(c))
    for i in range(len(c)):
        others = np.flatnonzero(group != group[i])
        apart = np.bitwise_count(words[others] ^ words[i]).sum(1, dtype=np.int64)
        close = others[(apart <= LOOK) & (np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]))]
        group[np.isin(group, group[close])] = group[i]
    least = {g: int(c[group == g].min()) for g in np.unique(group)}
    return [(least[g], int(x)) for g, x in zip(group, c, strict=True) if x != least[g]]


def _close_pairs(key: np.ndarray, n: np.ndarray, words: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of one key whose sizes and fingerprints are close; rows are sorted by key, then size.

    Each row is compared with the one 1, 2, ... places on, all rows at once, for as long as that one has its key and isn't too large.
    """
    words = words.view(np.uint64)
    at, ahead, found = np.arange(len(key)), 1, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(at := at[at + ahead < len(key)]):
        at = at[(key[at] == key[at + ahead]) & (n[at] >= similarity * n[at + ahead])]
        close = at[np.bitwise_count(words[at] ^ words[at + ahead]).sum(1, dtype=np.int64) <= LOOK]
        found.append((close, close + ahead))
        ahead += 1
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _candidate_edges(key: np.ndarray, c: np.ndarray, n: np.ndarray, words: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect the classes c which pairs of close fingerprints under one key connect, over all keys given; rows in any order."""
    order = np.lexsort((c, n, key))
    key, c, n, words = key[order], c[order], n[order], words[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= FEW, sizes)
    few = c[small]
    i, j = _close_pairs(key[small], n[small], words[small], similarity)
    pairs = np.unique(np.stack([np.minimum(few[i], few[j]), np.maximum(few[i], few[j])], 1), axis=0)
    edges = [(int(a), int(b)) for a, b in pairs]
    for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        rows = slice(start, start + size)
        edges += _close_groups(c[rows], n[rows], words[rows], similarity)
    return _stars(edges)


def _stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the pairs connect, as edges from the least member of each group to the others."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in root if find(x) != x]


def _bounded(df: DataFrame) -> DataFrame:
    """A materialised table as broadcast if its counted rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class NearCopies:
    """Groups of texts whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more, transitively.

    Texts of equal words are one class. Classes get keys by soft Golay decoding (a pair of similarity 0.8 shares one
    with a probability of 0.998, of 0.85 with 0.9995). Under each key, classes of like size are compared by their fingerprints, all
    with all; classes close enough form candidate groups. Within a candidate
    group all pairs are verified on exact sets, block against block, and a block passes on what it
    connects as edges from the least class of each group to the others. So no link between classes of a candidate group is lost, while the rows that move follow
    the number of classes: a group of m meets in (m / BLOCK)^2 / 2 blocks.

    docs: doc_id, text and any others, whatever their names. Null and empty texts are one class. Null doc_ids
    (least of all) and repeated rows are allowed; of rows equal in doc_id and words one stays, any. Very long texts count whole. An
    empty table has no groups.
    """

    def __init__(self, docs: DataFrame, width: int = 5, similarity: float = 0.8):
        prepare(docs.sparkSession)
        self.docs, self.width, self.similarity = docs, width, similarity
        self.rows = materialize(docs.select("doc_id", sketch(F.col("text"), width).alias("s")).select("doc_id", "s.*"), "near-rows")
        slim = self.rows.groupBy("content").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("bits", "codes", "shingles")])
        # numbered in order of doc_id, so that the least number of a group is its least document
        self.classes = materialize(slim.repartitionByRange("rep", "content").sortWithinPartitions("rep", "content").withColumn("c", F.monotonically_increasing_id()), "near-classes")

    def _close(self, x: str, y: str) -> Column:
        """Whether the structs x and y (class, shingles, words of the fingerprint) are worth an exact look."""
        sizes = F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= self.similarity * F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))
        return sizes & (_apart([F.col(f"{x}.{w}") for w in WORDS], [F.col(f"{y}.{w}") for w in WORDS]) <= LOOK)

    def _meet(self, rows: DataFrame, by: list[str], total: int) -> DataFrame:
        """Candidate edges (a, b) among rows (x, and `by`) that share `by`; total: about how many rows there are.

        A task gets MEET_ROWS rows or somewhat more, with all rows of a key, and passes on what its keys connect as edges from the
        least class of each group to the others.
        """
        similarity = self.similarity

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if parts:
                table = pa.Table.from_batches(parts)
                columns = {name: table.column(name).to_numpy() for name in table.column_names}
                keys = columns["key"]
                if "salt" in columns:  # places of the distinct pairs of key and salt
                    keys = np.unique(np.stack([keys, columns["salt"]], 1), axis=0, return_inverse=True)[1].reshape(-1)
                edges = _candidate_edges(keys, columns["c"], columns["n"], np.stack([columns[w] for w in WORDS], 1), similarity)
                a, b = np.array(edges, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            give_back()

        return rows.select(*by, "x.*").repartition(total // MEET_ROWS + 1, *by).mapInArrow(compare, "a long, b long")

    def candidates(self) -> DataFrame:
        """node, root: of each class in a candidate group, the least class of the group."""
        keys = F.array(*[
            F.lit(t << 24) + F.element_at("codes", 2 * t * PROBES + i + 1).cast("long") * F.lit(4096) + F.element_at("codes", (2 * t + 1) * PROBES + j + 1).cast("long")
            for t in range(TABLES) for i in range(PROBES) for j in range(PROBES)
        ])
        total = self.classes.count()
        if total > BANDED:
            # of a pair the larger one is at most 1 / similarity times as large, so one of its two ranges is the smaller one's
            band = F.floor(F.log(F.greatest(F.col("shingles"), F.lit(1))) / F.lit(-math.log(self.similarity - 0.001)))
            keys = F.flatten(F.transform(keys, lambda k: F.array(k + band * F.lit(1 << 32), k + (band + 1) * F.lit(1 << 32))))
            total *= 2
        keys, total = F.explode(keys), total * TABLES * PROBES**2
        words = [F.col("bits")[i].alias(w) for i, w in enumerate(WORDS)]
        of = lambda classes: classes.select(F.struct("c", F.col("shingles").alias("n"), *words).alias("x"), keys.alias("key"))
        rows = of(self.classes)
        # full keys are told by a share of the classes that holds hundreds of rows of each; a key that is missed takes its task longer
        share = max(1, SALT_ROWS // 500)
        count = of(self.classes.where(F.pmod(F.xxhash64("c"), F.lit(share)) == 0)).groupBy("key").agg((F.count(F.lit(1)) * share).alias("count"))
        full = materialize(count.where(F.col("count") > SALT_ROWS).select("key", F.ceil(F.col("count") / SALT_ROWS).alias("parts")), "near-full")
        if full.isEmpty():
            edges = self._meet(rows, ["key"], total)
        else:
            dealt = rows.join(_bounded(full), "key", "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("x.c"), F.col("parts"))).otherwise(F.lit(0).cast("long")))
            edges = materialize(self._meet(dealt, ["key", "salt"], total), "near-meet")
            firsts = dealt.where(F.col("parts").isNotNull()).groupBy("key", "salt").agg(F.min("x").alias("x"))
            firsts = materialize(firsts.select("key", "x"), "near-firsts")
            met = firsts.join(firsts.select("key", F.col("x").alias("y")), "key").where((F.col("x.c") < F.col("y.c")) & self._close("x", "y"))
            edges = materialize(edges.union(met.select("x.c", "y.c")), "near-parts")
            # a full key is mostly one group by now; where it isn't, rows of different groups are compared one by one
            found = components(edges, "near-parts").select(F.col("node").alias("c"), "root")
            hot = rows.join(_bounded(full), "key").withColumn("c", F.col("x.c")).join(found, "c", "left").withColumn("root", F.coalesce("root", "c"))
            several = hot.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
            hot = materialize(hot.join(several, "key", "left_semi").select("key", "root", "x", "parts", F.pmod(F.xxhash64("x.c"), F.col("parts")).alias("own")), "near-rest")
            # block against block, so that no task has more than SALT_ROWS rows of a key and about as many others
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
            left = hot.select("key", F.col("own").alias("i"), every.alias("j"), "root", "x")
            right = hot.select("key", every.alias("i"), F.col("own").alias("j"), F.col("root").alias("root2"), F.col("x").alias("y"))
            met = left.join(right, ["key", "i", "j"]).where((F.col("root") < F.col("root2")) & self._close("x", "y"))
            edges = edges.union(met.select(F.least("x.c", "y.c"), F.greatest("x.c", "y.c")))
        return components(materialize(edges.distinct(), "near-candidates"), "near")

    def groups(self) -> DataFrame:
        """node, root: of each class in a group of two or more, the least class of the group."""
        found = self.candidates().withColumnRenamed("node", "c")
        wanted = materialize(self.classes.select("c", "rep", "content").join(found, "c"), "near-wanted")
        texts = self.docs.select("doc_id", "text").join(_bounded(materialize(wanted.select("rep").distinct(), "near-ids")), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        sets = texts.select(_sets(F.col("text"), self.width).alias("s")).select("s.*")
        sets = materialize(sets.join(wanted.select("c", "root", "content"), "content").dropDuplicates(["content"]).select("c", "root", "members"), "near-sets")
        sizes = materialize(sets.groupBy("root").count(), "near-sizes")
        bins = max(1, sizes.agg(F.sum("count")).first()[0] or 0) // TASK_ROWS + 1
        blocks = F.ceil(F.col("count") / BLOCK)
        sets = sets.join(sizes, "root").withColumn("large", F.col("count") > BLOCK)
        sets = sets.withColumn("own", F.pmod(F.xxhash64("c"), blocks)).withColumn("part", F.when(F.col("large"), F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))))
        # a row of a large group goes to its own block's meetings with each block
        others = F.when(F.col("large"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.lit(0).cast("long")))
        dealt = sets.select("large", "part", "c", "root", "own", "members", F.explode(others).alias("other")).select("large", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "root", "own", "members")
        similarity = self.similarity

        def verify(rows: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, int]] = []
            for _, group in rows.groupby("root", sort=False):
                group = group.sort_values("c")
                first, second = group[group["own"] == group["i"]], group[group["own"] == group["j"]]
                same = bool((group["i"] == group["j"]).all()) or not group["large"].iloc[0]
                if same:
                    first = second = group
                sets = [[np.frombuffer(m, np.uint64) for m in side["members"]] for side in (first, second)]
                if sets[0] and sets[1]:
                    a, b = first["c"].to_numpy(), second["c"].to_numpy()
                    out += _stars([(int(a[i]), int(b[j])) for i, j in _similar(*sets, similarity, same)])
            give_back()
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        links = dealt.groupBy("large", "part", "i", "j").applyInPandas(verify, "a long, b long")
        return components(materialize(links, "near-links"), "near")

    def membership(self) -> DataFrame:
        """One row per class: c, content, rep (its least doc_id), root (the least class of its group) and root_rep."""
        grouped = self.classes.select("c", "content", "rep").join(self.groups().withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        return materialize(grouped, "near-members")

    def keep_one(self) -> DataFrame:
        """The rows of docs, columns unchanged, of which one stays of each group: that of the least doc_id."""
        kept = self.membership().where("c = root").select("rep", "content")
        # doc_ids that stand in several rows need their texts' digests to tell the rows apart; most tables have none
        twice = materialize(self.rows.groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("twice")), "near-twice")
        rows = self.docs.select(F.struct("*").alias("document"))
        same = F.col("document.doc_id").eqNullSafe(F.col("rep"))
        if twice.isEmpty():
            return rows.join(_bounded(materialize(kept.select("rep"), "near-kept")), same, "left_semi").select("document.*")
        is_twice = F.col("document.doc_id").eqNullSafe(F.col("twice"))
        single = rows.join(_bounded(twice), is_twice, "left_anti").join(_bounded(materialize(kept.select("rep").distinct(), "near-kept")), same, "left_semi")
        several = rows.join(_bounded(twice), is_twice, "left_semi").withColumn("digest", _sets(F.col("document.text"), self.width)["content"])
        several = several.withColumn("id", F.col("document.doc_id")).join(kept, same & (F.col("digest") == F.col("content")), "left_semi").dropDuplicates(["id", "digest"]).select("document")
        return single.unionByName(several).select("document.*")
