"""Session helpers, lineage cuts and joins that survive a hot key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds more than 1/HEAVY_PARTS of all rows, so there are
#: never more than HEAVY_PARTS heavy keys: what is broadcast for them has a fixed bound.
HEAVY_PARTS = 1024


def session(name: str = "pagewright", **conf: str) -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.master": "local[8]",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that was set as the checkpoint folder.

    Where neither is, a temporary one serves a local session; on a cluster, whose
    executors share no such folder, that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table into the shared folder and read them from there.

    They survive the loss of an executor, are compressed, and their size is known to
    the planner. The table goes when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def heavy_keys(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """The keys that hold more than 1/HEAVY_PARTS of the rows: at most HEAVY_PARTS of them.

    Counts are combined on the map side, so a hot key costs one row per task. The
    result is written once, as the joins that follow read it several times.
    """
    counts = rows.groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n_rows"))
    total = rows.agg(F.sum(weight if weight is not None else F.lit(1))).first()[0] or 0
    return materialize(counts.filter(F.col("n_rows") * HEAVY_PARTS > total))


def split_join(rows: DataFrame, side: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner",
               cond: Column | None = None) -> DataFrame:
    """Join rows with side where some keys hold a large part of the rows.

    Rows of heavy keys meet a broadcast of the side's rows for those keys and are not
    shuffled; all others are shuffled by key. The caller vouches that the side has a
    bounded number of rows per heavy key; the heavy keys themselves are bounded
    (heavy_keys). Null keys match nothing.
    """
    marks = F.broadcast(heavy.select(*keys))
    hot_side = F.broadcast(side.join(marks, keys, "left_semi"))
    on = [rows[k] == side[k] for k in keys] if cond is not None else keys

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        if cond is None:
            return left.join(right, keys, how)
        matched = on[0]
        for c in on[1:]:
            matched = matched & c
        return left.join(right, matched & cond, how)

    hot = join(rows.join(marks, keys, "left_semi"), hot_side)
    cold = join(rows.join(marks, keys, "left_anti"), side.join(marks, keys, "left_anti"))
    return hot.unionByName(cold)
