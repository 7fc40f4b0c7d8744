"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablon")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the session names in spark.checkpoint.dir. Only a
    session on one machine (tests, bench) gets a folder of its own where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablon-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run's own, in the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows over as many partitions as shuffles have, or cores: for few bytes a row that much is computed from, which
    adaptive execution would put into a task or two."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder; later stages read them from
    there, so losing an executor repeats no earlier work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
