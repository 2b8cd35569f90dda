"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

#: Repetitions of a document that a mix may take.
EPOCHS = 2
#: Most sources whose table (some 100 bytes each) is broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """Targets of the sources in sizes (skey, source_size), one row each.

    Weights repeat over the sources in order of skey and share `share` times all sizes. No target exceeds EPOCHS times
    its source's size; what is over goes to the others by weight, until none is above: sources are filled in order
    of cap / weight, so the water level is a running sum over one row per source.
    """
    order = Window.orderBy("skey")
    level = Window.orderBy("ratio", "skey")
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(EPOCHS))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.least(F.lit(float(share)) * F.sum("source_size").over(every), F.sum("cap").over(every).cast("double")))
        .withColumn("filled", F.sum("cap").over(level) - F.col("cap"))
        .withColumn("open_weight", F.sum("weight").over(every) - F.sum("weight").over(level) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open_weight"))
        # the first source, in order of ratio, whose cap the level doesn't reach, sets the level for all after it
        .withColumn("water", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "skey", "level"))).over(every)["level"])
    )
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight"))
    return ranked.select("skey", "source_size", target.alias("target"), "budget")


def keyed(docs: DataFrame, seed: str) -> DataFrame:
    """Rows of docs as the struct `document`, and what the mix knows of each: size, skey (sorts by code point, null last) and dealt (place in the shuffle)."""
    return docs.select(
        F.struct("*").alias("document"),
        size_of(F.col("text")).alias("size"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("skey"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("dealt"),
    )


def cutoffs(sized: DataFrame, weights: Sequence[float], share: float, slices: int = 1024) -> DataFrame:
    """One row per source of sized (size, skey, dealt): skey, source_size, target and, for each epoch, cut<epoch>: the last place of the shuffle taken.

    A source's finish times grow along its shuffle, so what a mix takes of it is a prefix of each epoch; this small
    table is all that decides about a document.
    """
    slim = sized.select("size", "skey", "dealt", F.substring("dealt", 1, 3).alias("part"))
    parts = materialize(slim.groupBy("skey", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    targets = materialize(source_targets(parts.groupBy("skey").agg(F.sum("part_size").alias("source_size")), weights, share), "mix-targets")
    ahead = parts.select("skey", "part", (F.sum("part_size").over(Window.partitionBy("skey").orderBy("part")) - F.col("part_size")).alias("before"))
    run = Window.partitionBy("skey", "part").orderBy("dealt")
    queued = materialize(
        slim.where("size > 0")
        .withColumn("upto", F.sum("size").over(run))
        .join(ahead, ["skey", "part"])
        .join(targets, "skey")
        .where("target > 0")
        .select("skey", "size", "dealt", "budget", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])).alias("epoch"), ((F.col("upto") + F.col("before") + F.col("epoch") * F.col("source_size")) / F.col("target")).alias("finish"))
        # ranges of equal width up to twice the common time, where targets are met; beyond that, for documents longer than targets, by logarithm
        .withColumn("place", F.when(F.col("finish") < 2, F.col("finish") * slices).otherwise((F.log2(F.col("finish")) + 1) * slices))
        .withColumn("slice", F.floor("place"))
        .withColumn("fine", F.floor((F.col("place") - F.col("slice")) * slices)),
        "mix-queued",
    )
    whole, rest, start = None, queued, F.lit(0)
    # the range in which the budget ends is found among all, then among its own finer ones; only that is sorted copy by copy
    for by in ("slice", "fine"):
        sums = rest.groupBy(by).agg(F.sum("size").alias("words"), F.max("budget").alias("budget"), F.max(start).alias("before"))
        ends = sums.withColumn("end", F.col("before") + F.sum("words").over(Window.orderBy(by))).withColumn("start", F.col("end") - F.col("words"))
        # one row: null if all fits
        last = ends.where(F.col("end") > F.col("budget")).groupBy().agg(F.min(F.struct(by, "start")).alias("x")).select(F.col(f"x.{by}").alias("last"), F.col("x.start").alias("start"))
        marked = rest.drop("last", "start").join(F.broadcast(last), F.lit(True))
        done = marked.where(F.col("last").isNull() | (F.col(by) < F.col("last"))).select("skey", "epoch", "dealt")
        whole = done if whole is None else whole.union(done)
        rest, start = materialize(marked.where(F.col(by) == F.col("last")), f"mix-{by}"), F.col("start")
    order = Window.orderBy("finish", "skey", "dealt", "epoch")
    rest = rest.withColumn("total", F.col("start") + F.sum("size").over(order)).where(F.col("total") <= F.col("budget")).select("skey", "epoch", "dealt")
    ends_at = [F.max(F.when(F.col("epoch") == e, F.col("dealt"))).alias(f"cut{e}") for e in range(EPOCHS)]
    found = whole.union(rest).groupBy("skey").agg(*ends_at)
    return targets.join(found, "skey", "left").select("skey", F.col("source_size").cast("long").alias("source_size"), "target", *[f"cut{e}" for e in range(EPOCHS)])


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    """What the mix knows of documents, without their texts, as a table."""
    return materialize(keyed(docs.select("doc_id", "source", "text"), seed).select("document.doc_id", "document.source", "size", "skey", "dealt"), "mix-sizes")


def marked(rows: DataFrame, sized: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """Keyed rows with source_size, target and epochs, the number of times that the mix of `sized` takes a row."""
    cuts = materialize(cutoffs(sized, weights, share), "mix-cutoffs")
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    taken = [F.coalesce((F.col("dealt") <= F.col(f"cut{e}")).cast("int"), F.lit(0)) for e in range(EPOCHS)]
    return rows.join(cuts, "skey").withColumn("epochs", F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(F.lit(0)))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, seed: str = "mix") -> DataFrame:
    """Deal the words of documents (doc_id, text, source) to a mix: doc_id, source, size, source_size, target, taken.

    Each source's documents stand in an order shuffled by md5 of seed and doc_id, twice over (a second epoch follows
    the first). The virtual finish time of a copy is its source's words up to its end, divided by the source's
    target; copies are sorted by it over all sources, and those that fit into the budget in this order are taken.

    No task holds a whole source or the whole order: running sums go over ranges of the shuffle key and add the sums
    of the ranges before; finish times fall into ranges of which only the one where the budget ends is sorted copy
    by copy. Texts are never shuffled: a table of one row per source tells which rows are taken.

    Null text: size 0, never taken. Null source: a source of its own, after all others. Sources without words: target
    0. Rows of one source with equal doc_ids (null is one too) are taken or left together; copies that finish at one time go by
    source, then place in the shuffle. Very long texts count whole. Empty table: no rows. Other columns are ignored, whatever their names.

    The table of sources, a row each, is ordered in one task: their number is bounded by what a task sorts on disk.
    """
    sized = sizes(docs, seed)
    return marked(sized, sized, weights, share).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, seed: str = "mix") -> DataFrame:
    """The mix as rows of docs: one taken n times stands in the result n times, one not taken not at all.

    Cases are settled as in mix(); rows without words are in no mix.
    """
    rows = marked(keyed(docs, seed), sizes(docs, seed), weights, share).where("epochs > 0")
    return rows.select("document", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("copy")).select("document.*")
