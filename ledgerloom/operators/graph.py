"""Connected components by label spreading and pointer jumping, and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir; where it is unset, a temporary one is set, on a single machine only."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, ordered: bool = False) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, columns still pruned by what reads it.

    A lost executor costs the tasks that read it, not what made it. Tables go when the driver's Python ends. With `ordered`, or
    where a column has no type yet, it is a checkpoint, which keeps partitions and their order.
    """
    spark = df.sparkSession
    root = _folder(spark)
    if ordered or "void" in df.schema.simpleString():
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
        return df.checkpoint()
    path = f"{root}/tables/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables of cut()."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has already gone; the folder's owner cleans up
            return


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a < b) with the same components: each b hangs on its least a only, and its other a's on that one too."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    told = edges.join(least, "b")
    return told.select(F.col("least").alias("a"), "b").union(told.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for each node of the undirected edges (a, b).

    A node without edges has no row; a loop gives it one. Edges are contracted first, so that dense groups go on with few. Labels take the minimum of their neighbours', then jump to
    their label's label, until none changes: rounds follow the logarithm of the longest path. Only changed is asked of
    the driver.
    """
    few = cut(contracted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).union(edges.where("a = b").select("a", "b").distinct()))
    both = few.union(few.select("b", "a"))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
    labels = cut(labels)
    while True:
        reached = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        spread = labels.join(reached, "node").select("node", "root", F.least("root", "other").alias("via"))
        onward = labels.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        step = cut(spread.join(onward, "via", "left").select("node", F.coalesce(F.least("via", "beyond"), "via").alias("root"), (F.coalesce(F.least("via", "beyond"), "via") < F.col("root")).alias("moved")))
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            return labels
