"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` overrides them.

    Without ``master`` that of ``spark-submit`` or the environment holds, and so do its memory
    and shuffle partitions.  AQE does the runtime re-planning (coalescing, skew splits, join
    switches), so partition counts are only an upper bound.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local["):
            settings |= {"spark.sql.shuffle.partitions": os.environ.get("BENCH_CPUS", "8"), "spark.driver.memory": "8g"}
    settings |= conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage.

    The folder is the cluster's ``spark.checkpoint.dir``; only a session on one machine
    (tests) gets a temporary folder where none is named, any other is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_width(df: DataFrame, part: int = 32_000_000, most: int = 100_000) -> int:
    """Partitions to use where an operator must name a number: those set for the session, or
    one for each ``part`` bytes of what ``df`` reads, if these are more.

    Sizes are those of the files; what is kept or made in the session counts nothing, as the
    planner's estimates for it multiply with every join.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    read = sum(int(str(x.stats().sizeInBytes())) for x in files if x.getClass().getSimpleName() == "LogicalRelation")
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-read // part)))
