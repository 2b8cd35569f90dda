"""Helpers shared by the corpus operators: shared-folder tables, components and word splitting."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definition used by every operator here: bytes 0x20 and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Arrow batches hold at most this many rows, and about so many bytes: whole texts travel in them.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20

_folders: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one is set, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session asks for other bounds.

    The session keeps these settings: results are computed only when the caller asks for them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None and spark.conf.isModifiable(key):
        spark.conf.set(key, str(ARROW_BYTES))


def give_back() -> None:
    """Return what a worker has freed to the machine: workers live on after a task, and what they hold adds up on an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared root, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(release)
    _folders.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    A lost executor costs at most the tasks that read from this table; what made it never runs again.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that materialize() wrote in this session."""
    while _folders:
        spark, path = _folders.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has already gone; the folder's owner cleans up
            return


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a < b) with the same components: each b hangs on its least a only, and its other a's on that one too."""
    told = edges.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    return told.select(F.col("least").alias("a"), "b").union(told.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root being the least node reachable.

    Every node of an edge gets a row. Edges are contracted first, so that dense groups go on with little more than one
    edge a node. Labels spread to neighbours by minimum, then jump to their label's label, so the number of rounds
    follows the logarithm of the longest path. Each round's labels are a table in the shared
    folder; nothing is collected but one count.
    """
    few = contract(contract(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    few = materialize(few, f"{label}-few")
    both = few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")),
        f"{label}-labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("reached")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("reached").alias("reached"))
        )
        spread = labels.join(near, "node").select("node", "root", F.least("root", "reached").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        step = materialize(
            spread.join(jump, "next").select("node", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") < F.col("root")).alias("moved")),
            f"{label}-labels",
        )
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            return labels
