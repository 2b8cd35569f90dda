"""Approximate nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a block, each with its own sorted arrays, and queries that meet a block at once; about as many.
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
#: Share of the projections in which a vector must collide with the query to be verified.
THRESHOLD = 0.85
#: A query's windows grow until this share of a block (and the number of neighbours wanted) is to be verified.
VERIFIED = 0.10
#: First half-width of the windows, in deviations of the projections, and the factor of each virtual rehashing.
FIRST, GROWTH = 1.0, 1.25


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero (an empty vector is zero)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def projections(dim: int, bases: int = 1, seed: int = 7) -> np.ndarray:
    """Columns of random orthonormal bases of dim + 1 dimensions; the same in every task."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0] for _ in range(bases)], 1)


def _distinct(ids: pd.Series, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors as arrays, each pair once."""
    rows = {(int(i), np.asarray(v, np.float64).tobytes()) for i, v in zip(ids, vectors, strict=True)}
    ordered = sorted(rows)
    return np.array([i for i, _ in ordered], np.int64), np.stack([np.frombuffer(v, np.float64) for _, v in ordered])


def scores_of(data: np.ndarray, picked: np.ndarray, query: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Inner products of the picked rows, each summed in one order whatever its row: equal vectors get equal scores, in any block. room: overwritten."""
    products = np.take(data, picked, axis=0, out=room[: len(picked)], mode="clip")
    with np.errstate(over="ignore", invalid="ignore"):
        return np.multiply(products, query, out=products).sum(1)


def search_block(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, largest: float, longest: float, k: int) -> list[tuple]:
    """For each query its k best of a block by inner product: (query_id, vec_id, score).

    With a further component, sqrt(longest^2 - |x|^2) for vectors and 0 for queries, the nearest in Euclidean distance
    is the one of largest inner product. Each projection has one sorted array of the block. Around a query's own place
    in it a window opens on both sides; widening all windows by a factor is a virtual rehashing. Vectors are
    counted by the windows that hold them, as their places in the sorted arrays tell; those that reach the threshold are verified on original vectors. Lengths
    are taken after division by `largest`, the largest component, so that none is too large to be squared.
    """
    n, dim = data.shape
    basis = projections(dim)
    small, asked = data / largest, queries / largest
    lift = np.sqrt(np.maximum(longest**2 - (small * small).sum(1), 0))
    places = np.concatenate([small, lift[:, None]], 1) @ basis
    at = np.concatenate([asked, np.zeros((len(asked), 1))], 1) @ basis
    order = np.argsort(places, axis=0, kind="stable").T.copy()  # one row per projection
    lines = np.take_along_axis(places.T, order, 1)
    m = len(order)
    scale = max(float(np.std(np.concatenate([places, at]))), 1e-12)
    need = min(n, k + 1 + int(VERIFIED * n))
    limit = int(np.ceil(THRESHOLD * m))
    # a vector's place in each sorted array tells whether a window holds it
    kind = np.uint16 if n < 1 << 16 else np.uint64
    rank = np.empty((m, n), kind)
    np.put_along_axis(rank, order, np.arange(n, dtype=kind)[None, :], 1)
    past, inside, tally = np.empty((m, n), kind), np.empty((m, n), bool), np.uint8 if m < 256 else np.uint16
    widths, windows = [FIRST * scale], []

    def counted(q: int, step: int) -> np.ndarray:
        """The vectors that reach the threshold after `step` rehashings."""
        while len(windows) <= step:  # of all queries at once
            width = widths[-1]
            low = np.stack([np.searchsorted(lines[j], at[:, j] - width, "left") for j in range(m)], 1)
            high = np.stack([np.searchsorted(lines[j], at[:, j] + width, "right") for j in range(m)], 1)
            windows.append((low, high))
            widths.append(width * GROWTH)
        low, high = (side[q][:, None] for side in windows[step])
        np.subtract(rank, low.astype(kind), out=past)  # places before the window wrap around to large ones
        np.less(past, (high - low).astype(kind), out=inside)
        return np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=tally) >= limit)

    rows, step, room = [], 0, np.empty((n, dim))
    for q in range(len(asked)):
        # the first rehashing that finds enough, at the latest when all windows hold the whole block; sought from the one of the query before
        picked = counted(q, step)
        if len(picked) >= need:
            while step and len(fewer := counted(q, step - 1)) >= need:
                picked, step = fewer, step - 1
        else:
            while len(picked) < need:
                step += 1
                picked = counted(q, step)
        picked = picked[ids[picked] != query_ids[q]]
        score = scores_of(data, picked, queries[q], room)
        if len(picked) > k:  # none that is worse than the k-th; what isn't a number stays and comes last
            kept = ~(-score > np.partition(-score, k - 1)[k - 1])
            picked, score = picked[kept], score[kept]
        for i in np.lexsort((ids[picked], -score))[:k]:
            rows.append((int(query_ids[q]), int(ids[picked[i]]), float(score[i])))
    return rows


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors found of largest inner product for each row where is_query.

    vectors: vec_id, embedding and any others. Rows are dealt to blocks by vec_id; each block meets all queries, some
    at a time, and answers with its best, of which the best of all blocks remain. Ties go to the smaller vec_id. A
    query's own vec_id is no answer to it. Vectors that are null, zero or hold null or non-finite components, and null
    vec_ids, take no part; vectors of another length than the query's aren't compared. Rows that repeat a vec_id and
    its vector count once; different vectors under one vec_id are all candidates, and as queries share one answer. A score
    beyond the range of doubles is infinite; one that isn't a number (infinities of both signs) comes last.
    Empty table, or none but the query: no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = materialize(rows.withColumn("dim", F.size("v")), "ann-vectors")
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-total // block_rows)), max(1, -(-(asking or 0) // query_rows))
    # one row per length of vectors
    largest = rows.groupBy("dim").agg(F.max(F.array_max(F.transform("v", F.abs))).alias("largest"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x / F.col("largest") * (x / F.col("largest"))))
    longest = rows.join(largest, "dim").groupBy("dim", "largest").agg(F.max(norm).alias("longest"))
    rows = rows.join(longest, "dim").select("vec_id", "v", "asks", "dim", "largest", "longest", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("own"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).alias("own_query"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = rows.select("dim", F.col("own").alias("block"), every(query_blocks).alias("part"), "vec_id", "v", "largest", "longest")
    asked = rows.where("asks").select(F.col("dim").alias("of_dim"), every(blocks).alias("of_block"), F.col("own_query").alias("of_part"), F.col("vec_id").alias("query_id"), F.col("v").alias("query"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, data = _distinct(left["vec_id"], left["v"])
            query_ids, queries = _distinct(right["query_id"], right["query"])
            out = search_block(ids, data, query_ids, queries, float(left["largest"].iloc[0]), float(left["longest"].iloc[0]), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    best = data.groupBy("dim", "block", "part").cogroup(asked.groupBy("of_dim", "of_block", "of_part")).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = best.dropDuplicates(["query_id", "vec_id", "score"])
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
