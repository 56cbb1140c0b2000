"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Runtime settings the operators are written for.  All are ordinary Spark SQL
# settings; a cluster that already sets its own keeps working, only slower.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Apply row_number() <= k inside tasks, before the shuffle, for k up to this.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "storeloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a local session that names none gets one of its own under the machine's
    temporary folder; on a cluster such a folder would vanish with its executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="storeloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run's files."""
    return f"{shared_folder(spark)}/storeloom/{label}-{uuid.uuid4().hex}"
