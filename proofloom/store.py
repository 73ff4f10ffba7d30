"""Tables in the shared folder, which cut lineage and survive lost executors, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one in local mode (tests); a cluster must name it."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="proofloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/proofloom/{kind}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a statement go when it ends; else they stay until the driver's JVM collects garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, kind: str = "table", *by: str) -> DataFrame:
    """df as a table in the shared folder: computed once, no lineage, safe when executors are lost. Its shuffles leave the disk once it is written. by: columns whose values have a folder each, so a filter on them reads no other."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "written_at", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is a node of the component.

    Each round hooks every node to its smallest neighbour, jumps pointers until each node points at the root
    of its tree, and contracts the edges: a path of any length is one tree after the jumps, whose number grows with the
    logarithm of its length; only nodes smaller than all their neighbours are left for the next round.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    parents: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hook = written(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("root"), F.lit(False).alias("moved")), "hook")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = written(hook.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "hook")
            discard(hook)
            hook = jumped
            if hook.where("moved").isEmpty():
                break
        if parents is None:
            grown = written(hook.select("node", "root"), "parents")
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            grown = written(parents.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "parents")
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        left = left.join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        rest = written(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(parents, hook, edges)
        parents, edges = grown, rest
    return parents if parents is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
